"""Structured Streaming forms of the operators whose state is small: deduplication, windowed counts and earliest fractions.

All state is bounded by a watermark; what comes after it is folded where the table is read (``streaming.tables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_molecule(stream: DataFrame, event_time: str, late: str = "10 minutes", keys: tuple[str, ...] = ("umi", "seq")) -> DataFrame:
    """Each molecule once within the watermark; state older than it is dropped, and a molecule that comes again later is told once more."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], width: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling window and key; late rows beyond the watermark do not count."""
    what = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    rows = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), *by).agg(*what)
    return rows.select(F.col("w.start").alias("window_start"), *by, "n", *(["total"] if value else []))


def earliest_bins(stream: DataFrame, bin_of: Column, keys: tuple[str, ...] = ("umi", "seq"), event_time: str = "ts", width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Of each key and window of event time the earliest fraction it is seen at; windows behind the watermark leave the state.

    The earliest of a key is the least over its windows, which fold where the table is read.
    """
    rows = stream.withWatermark(event_time, late).withColumn("bin", bin_of)
    rows = rows.groupBy(F.window(event_time, width).alias("w"), *keys).agg(F.min("bin").alias("bin"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "bin")
