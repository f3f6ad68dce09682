"""Commands over tables of Parquet: python -m tessera.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import explore
from tessera.operators import registry_ops as reg
from tessera.operators.drafts import plain
from tessera.plans.catalog import star_catalog
from tessera.session import local_session
from tessera.sources import files
from tessera.sources.runs import RunStore
from tessera.sources.tables import read_table


def smoke_test(spark: SparkSession) -> dict[str, str]:
    """The session's names, as a query returns them."""
    return spark.sql("SELECT current_catalog() AS database_name, current_user() AS user_name, current_database() AS schema_name").first().asDict()


def _pairs(given: Sequence[str]) -> dict[str, str]:
    if any("=" not in x for x in given):
        raise ValueError("a filter is column=value")
    return dict(x.split("=", 1) for x in given)


def _leaves_open(known: dict) -> dict:
    """Keys that nothing is said about below may hold anything."""
    return {k: _leaves_open(v) if v else None for k, v in known.items()}


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    """What the command answers, for JSON."""
    table = lambda: read_table(spark, a.root, a.table)
    if a.command == "check-db":
        return smoke_test(spark)
    if a.command == "show-layout":
        return explore.schema_map(star_catalog(), None, 0) | {"queries": sorted(registry.queries())}
    if a.command == "validate-config":
        known: dict = {}
        for path in a.known:  # a.b is key b below a
            at = known
            for name in path.split("."):
                at[name] = at.get(name) or {}
                at = at[name]
        return {"valid": True, "keys": sorted(files.strict(files.read_config(spark, a.path), _leaves_open(known)))}
    if a.command == "bootstrap-run-db":
        return {"ready": a.path, "created": RunStore(spark, a.path).bootstrap()}
    if a.command == "run-db-summary":
        rows = RunStore(spark, a.path).summaries().where(F.col("run_id") == a.run_id).collect()
        none = {"run_id": a.run_id, "total": 0, "accepted": 0, "rejected": 0, "other": 0, "verification_results": 0, "event_count": 0}
        return rows[0].asDict() if rows else none
    if a.command == "query":
        df = registry.queries()[a.name](spark, a.root)
        return [r.asDict(recursive=True) for r in df.limit(a.limit).collect()]
    if a.command == "show-task-registry":
        equal = _pairs(a.where)
        rows = reg.recent(table(), a.columns, a.limit, a.created, a.key, equal)
        return [r.asDict(recursive=True) for r in rows.collect()]
    if a.command == "plan-synthesis-coverage":
        df = table()
        rows = reg.deficits(df, reg.coverage(df, a.columns), a.columns, a.target).where("deficit > 0").limit(a.limit)
        return [r.asDict() for r in rows.collect()]
    if a.command == "run-summary":
        return reg.run_summary(table(), a.status, a.accepted, a.rejected).first().asDict()
    if a.command == "export-bundle":
        reg.export(table(), a.path, a.by, [a.key], F.expr(a.having) if a.having else None)
        return {"written": a.path}
    raise ValueError(f"unknown command {a.command!r}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *table: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        for x in table:
            c.add_argument(x)
        return c

    command("check-db", "open a session and name it")
    command("show-layout", "tables, edges and queries")
    command("validate-config", "read a configuration in YAML or JSON, its variables filled in", "path").add_argument("--known", nargs="*", default=[], help="keys; a.b is b below a, and * is any key")
    command("bootstrap-run-db", "make the tables of runs", "path")
    command("run-db-summary", "tasks, verifications and events of a run", "path", "run_id")
    command("query", "run a registered query", "root", "name").add_argument("--limit", type=int, default=100)
    c = command("show-task-registry", "the newest rows", "root", "table")
    c.add_argument("--columns", nargs="+", required=True)
    c.add_argument("--created", required=True)
    c.add_argument("--key", required=True)
    c.add_argument("--where", nargs="*", default=[])
    c.add_argument("--limit", type=int, default=20)
    c = command("plan-synthesis-coverage", "groups that lack rows, the largest lack first", "root", "table")
    c.add_argument("--columns", nargs="+", required=True)
    c.add_argument("--target", type=int, required=True)
    c.add_argument("--limit", type=int, default=20)
    c = command("run-summary", "rows by status", "root", "table", "status", "accepted", "rejected")
    c = command("export-bundle", "rows as Parquet by a column", "root", "table", "path")
    c.add_argument("--by", required=True)
    c.add_argument("--key", required=True)
    c.add_argument("--having")
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints JSON; an error goes to stderr and gives 1."""
    a = parser().parse_args(arguments)
    try:
        print(json.dumps(plain(run(spark or local_session(), a)), default=str, ensure_ascii=False))
    except (ValueError, KeyError, LookupError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
