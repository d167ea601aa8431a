"""Streams into tables: each micro-batch is a folder of its own, written again as a whole if it is run again.

The stream hands over what changed (update mode), so its state may forget what the watermark has passed, and nothing of
a result stays in the driver. A reader folds the batches: the last row of each key, or an aggregate over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def into_table(rows: DataFrame, folder: str, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Start the stream into ``folder``; a batch that is repeated after a failure replaces its own folder, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of all batches with their ``batch``; none before the first one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def folded(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Each key with aggregates over all its rows, for results that fold, such as a minimum."""
    return rows.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
