"""The durable tables of runs: keyed ones, of which the last row of a key stands, and logs with ids of their own.

Rows come in numbered batches, as from foreachBatch; a batch that comes again leaves the tables as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import registry_ops
from tessera.sources import sinks
from tessera.sources.scratch import exists, file_system

# Tables (fixed values): columns, and keys; a table without keys is a log.
TABLES = {
    "runs": ("run_id string, config_hash string, created_at string", ("run_id",)),
    "tasks": ("task_id string, run_id string, status string, payload_json string", ("task_id",)),
    "accepted_examples": ("task_id string, run_id string, payload_json string", ("task_id",)),
    "verification_results": ("task_id string, run_id string, solver_id string, payload_json string", ("task_id", "solver_id")),
    "processed_keys": ("namespace string, item_key string, payload_json string", ("namespace", "item_key")),
    "budget_reservations": ("reservation_id string, payload_json string", ("reservation_id",)),
    "event_log": ("run_id string, event_type string, payload_json string", ()),
    "budget_ledger": ("phase string, amount_usd double, kind string", ()),
}


class RunStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = sinks.BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bootstrap(self) -> list[str]:
        """Makes the folders of tables that are not there yet, and names them."""
        new = [name for name in TABLES if not exists(self.spark, f"{self.path}/{name}")]
        for name in new:
            fs, at = file_system(self.spark, f"{self.path}/{name}")
            fs.mkdirs(at)
        return new

    def record(self, table: str, batch: DataFrame, number: int) -> None:
        """Adds a batch: of a keyed table, rows in place of those of their key from batches before; of a log, rows with the next ids."""
        schema, keys = TABLES[table]
        names = [c.split()[0] for c in schema.split(", ")]
        rows = batch.select(*names)
        if keys:
            sinks.upsert(rows, number, f"{self.path}/{table}", keys, (), self.buckets)
        else:
            sinks.append(rows, number, f"{self.path}/{table}", names)

    def read(self, table: str) -> DataFrame:
        """The table as it stands; of a log, with log_id."""
        schema, keys = TABLES[table]
        path = f"{self.path}/{table}"
        full = schema if keys else f"{sinks.LOG_ID} bigint, {schema}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(path)

    def summaries(self) -> DataFrame:
        """By run: tasks by status, verification results, events."""
        return registry_ops.run_summaries(self.read("tasks"), self.read("verification_results"), self.read("event_log"), "run_id", "status", "accepted", "rejected")

    def unprocessed(self, namespace: str, items: DataFrame, item: str) -> DataFrame:
        """Items whose key is not among the namespace's processed ones."""
        return registry_ops.unprocessed(items, self.read("processed_keys").where(F.col("namespace") == namespace), item, "item_key")
