"""Sessions: settings the engine relies on, and the package's place for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in one JVM, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return reach_workers(builder.getOrCreate())


#: Rows of an Arrow batch, unless the session sets its own: texts can be long, and a batch is held on both sides.
BATCH_ROWS, BATCH_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def reach_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on machines that hold this package at the same place import it, whatever folder the driver runs in, and keeps their batches small. Elsewhere, ship the package with --py-files."""
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
