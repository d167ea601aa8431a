"""A library's records laid out once by molecule, so that what follows reads them without another shuffle.

The table is bucketed and sorted by the molecule's key. Estimation, posteriors, picks, the first record of each molecule and
rarefaction group or join by that key, so they run bucket by bucket; a table of picks of the same layout
serves look-ups by key. The one join that is not by molecule takes the abundances, a row for each transcript.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtally.operators import reads as R

#: Buckets of a table, and rows of abundances that are broadcast; more are joined by the planner's choice.
SHARDS, BROADCAST_ROWS = 64, 1_000_000


def write_molecules(rows: DataFrame, table: str, folder: str, shards: int = SHARDS) -> DataFrame:
    """Rows as the table of that name under the folder: one file a bucket, sorted by molecule. Older rows go."""
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    laid = rows.repartition(shards, *R.GROUP)
    laid.write.format("parquet").mode("overwrite").option("path", f"{folder}/{table}").bucketBy(shards, *R.GROUP).sortBy(*R.GROUP).saveAsTable(table)
    return spark.table(table)


def molecules(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def edges(records: DataFrame, mode: str = "AS", beta: float = 0.1, gamma: float = 1.0) -> DataFrame:
    """Weighted candidates of each molecule."""
    return R.weighted(R.best_per_key(records), mode, beta, gamma)


def picks(records: DataFrame, counts: DataFrame, mode: str = "AS", beta: float = 0.1, gamma: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """The hard pick of each molecule by abundances ``transcript, count``."""
    few = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return R.hard_pick(R.posterior(edges(records, mode, beta, gamma), few), mode, eps)


def first_records(records: DataFrame, picked: DataFrame, order: list[str], mapq: int = 255) -> DataFrame:
    """``reads.deduplicate`` over tables of one layout: joined by molecule alone, then held to the chosen transcript."""
    both = records.join(picked.select(*R.GROUP, "transcript", "posterior", "tie_count", "tie_break"), R.GROUP)
    # An equality would become a third key of the join, by which neither side is laid out.
    both = both.where("rname >= transcript and rname <= transcript").drop("transcript")
    rows = both.withColumn("__at", F.row_number().over(Window.partitionBy(*R.GROUP).orderBy(*order))).where("__at = 1").drop("__at")
    if "flag" in rows.columns:
        rows = rows.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~0x900)))
    return rows.withColumn("mapq", F.lit(mapq)) if "mapq" in rows.columns else rows


def look_up(keys: DataFrame, picked: DataFrame) -> DataFrame:
    """Keys ``umi, seq`` with what the table of picks says of them; NULL where it has no such molecule."""
    return keys.join(picked, R.GROUP, "left")
