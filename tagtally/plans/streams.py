"""Queries that run a stream over the events table until its input is used up, into a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagtally.plans.registry import query
from tagtally.session import shared_folder
from tagtally.streaming import molecules as M
from tagtally.streaming import tables as S


def _stream(t):
    batch = t.events
    return t.spark.readStream.schema(batch.schema).parquet(f"{t.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(t, rows, mode: str = "update"):
    """The batches of a stream that ran to the end of its input."""
    folder = f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    S.into_table(rows, f"{folder}/table", f"{folder}/state", mode).awaitTermination()
    return S.batches(t.spark, f"{folder}/table", rows.schema)


@query("stream_window_counts", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(t):
    rows = S.latest(_finished(t, M.windowed_counts(_stream(t), "ts", ["event_type"])), ["window_start", "event_type"])
    return rows.select(F.unix_timestamp("window_start").alias("hour"), "event_type", "n")


@query("stream_earliest_bin", "SELECT user_id, event_type, CAST(min(floor(value / 10)) AS BIGINT) AS bin FROM events GROUP BY 1, 2")
def stream_earliest_bin(t):
    rows = _finished(t, M.earliest_bins(_stream(t), F.floor(F.col("value") / 10), ("user_id", "event_type")))
    return S.folded(rows, ["user_id", "event_type"], bin=F.min("bin"))


@query("stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events)")
def stream_dedup(t):
    rows = _finished(t, M.first_per_molecule(_stream(t), "ts", "1 hour", ("user_id", "event_type", "value")), "append")
    return S.folded(rows, ["user_id", "event_type", "value"], batch=F.min("batch")).agg(F.count("*").alias("n"))
