"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "tagtally", cores: int | None = None, **settings: str) -> SparkSession:
    """Local session by default; on a cluster ``spark-submit`` sets master and resources, and these are defaults."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(name)
    if "SPARK_REMOTE" not in os.environ and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]")
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(8, cores)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; a temporary one in a single process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagtally-"))
    return sc.getCheckpointDir()
