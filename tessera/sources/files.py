"""Registry input files, JSON-lines sinks, and catalog snapshots."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import Catalog


def read_registry(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of a JSON array (.json) or of JSON lines; a key that repeats is an error."""
    df = spark.read.schema(schema).option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)
    twice = df.groupBy(key).count().where("count > 1").orderBy(key).limit(3).collect()
    if twice:
        raise ValueError(f"{key} repeats: {', '.join(str(r[0]) for r in twice)}")
    return df


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, its keys sorted and nulls kept."""
    names = sorted(df.columns)
    df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_snapshot(spark: SparkSession, catalog: Catalog, path: str) -> None:
    spark.createDataFrame([(catalog.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_snapshot(spark: SparkSession, path: str) -> Catalog:
    return Catalog.from_json("\n".join(r[0] for r in spark.read.text(path).collect()))


def expand(text: str, environment: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; a name that is not set and has no default is an error."""
    env = os.environ if environment is None else environment

    def value(m: re.Match[str]) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(f"{m[1]} is not set")
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)


def expanded(value: Any, environment: dict[str, str] | None = None) -> Any:
    """expand() on all text in a configuration, at any depth."""
    if isinstance(value, dict):
        return {k: expanded(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, environment) for v in value]
    return expand(value, environment) if isinstance(value, str) else value


def read_config(spark: SparkSession, path: str, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """A configuration in YAML, or JSON, which is YAML too, with its variables filled in. Spark brings the reader along."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    yaml = spark.sparkContext._jvm.org.yaml.snakeyaml
    try:
        read = yaml.Yaml(yaml.constructor.SafeConstructor(yaml.LoaderOptions())).load(text)
        config = json.loads(spark.sparkContext._jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(read))
    except Py4JJavaError as e:
        raise ValueError(f"{path} is no YAML: {str(e.java_exception.getMessage()).splitlines()[0]}") from e
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no keys")
    return expanded(config, environment)


def strict(config: dict[str, Any], known: set[str] | dict[str, Any], here: str = "") -> dict[str, Any]:
    """The configuration, if it has known keys only. known: names, or a map of names to what is known below them, null where anything goes; below the name * are the keys of every name."""
    if isinstance(known, (set, frozenset)):
        known = dict.fromkeys(known)
    if unknown := [] if "*" in known else sorted(set(config) - set(known)):
        raise ValueError(f"unknown keys: {', '.join(here + str(k) for k in unknown)}")
    for key, value in config.items():
        below = known.get(key, known.get("*"))
        for item in value if isinstance(value, list) else [value]:
            if below is not None and isinstance(item, dict):
                strict(item, below, f"{here}{key}.")
    return config
