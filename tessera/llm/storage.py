"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a temporary folder; a cluster gets an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")  # once the table is written, nothing reads the shuffles that led to it
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of two ids (16 bytes) that are sent to all executors at most, where texts or sets would be shuffled otherwise.
BROADCAST_IDS = 500_000


def beside(df: DataFrame, ids: int = 2, texts: bool = False) -> DataFrame:
    """A written table as the other side of a join. Where it meets rows that hold texts or sets, it is sent to all executors if its rows, of `ids` numbers each, are few; narrow rows are left to Spark, which shuffles them at every size and splits what is skewed."""
    return F.broadcast(df) if texts and df.count() * ids <= 2 * BROADCAST_IDS else df


def shield(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with every column that is not in `used` under a name that no operator has, and what restores the names (and order) of all, with further columns after them."""
    inner = {c: c if c in used else f"__column_{k}" for k, c in enumerate(df.columns)}

    def restore(out: DataFrame, *more: str) -> DataFrame:
        return out.select(*(F.col(x).alias(c) for c, x in inner.items()), *more)

    return df.select(*(df[f"`{c}`"].alias(x) for c, x in inner.items())), restore
