"""Exact quantiles of groups in stretches, sums of products in blocks, and streams into tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtally.operators import ordination as O
from tagtally.operators.quantiles import quantiles
from tagtally.streaming import molecules as M
from tagtally.streaming import tables as S


@pytest.mark.parametrize("stretch", [None, 300, 20])
def test_quantiles_are_exact(spark, stretch):
    rng = random.Random(2)
    groups = {"wide": [rng.gauss(0, 1) * 10 ** rng.uniform(-200, 200) for _ in range(700)], "ties": [float(rng.randrange(3)) for _ in range(900)], "one": [4.0], "two": [1.0, 2.0], None: [rng.random() for _ in range(500)], "same": [7.0] * 400, "end": [0.0] * 5 + [math.inf] * 600}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("nan", math.nan), ("one", math.nan)]
    rng.shuffle(rows)
    shares = {"lo": 0.0, "a": 0.05, "m": 0.5, "z": 0.975, "hi": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares, stretch).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in shares.items():
            s = sorted(vs)
            k = p * (len(s) - 1)
            a, b = s[math.floor(k)], s[min(math.floor(k) + 1, len(s) - 1)]
            want = a if a == b else a + (k - math.floor(k)) * (b - a)
            assert got[g][name] == pytest.approx(want, rel=1e-12) or got[g][name] == want


def test_winsorised_and_boxes_use_no_percentile_buffer(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=2000)
    frame = spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(values)] + [("a", None)], "g string, v double")
    got = sorted(r.v for r in O.winsorised(frame, "v", 0.05).where("v is not null").collect())
    lo, hi = np.quantile(values, [0.05, 0.95])
    assert np.allclose(got, np.sort(np.clip(values, lo, hi)))
    box = {r.g: r for r in O.box_stats(frame, ["g"], "v").collect()}
    for k, g in enumerate("ab"):
        own = values[k::2]
        q1, m, q3 = np.quantile(own, [0.25, 0.5, 0.75])
        inside = own[(own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([box[g].q1, box[g]["median"], box[g].q3, box[g].low, box[g].high, box[g].n], [q1, m, q3, inside.min(), inside.max(), 1000])
    assert "percentile(" not in O.box_stats(frame, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()


def fed(spark, tmp_path, rows):
    """One file to the stream's source."""
    n = len(list(tmp_path.glob("in/*"))) if (tmp_path / "in").exists() else 0
    spark.createDataFrame(rows, "k string, t long, x double").select("k", F.timestamp_seconds("t").alias("ts"), "x").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")


def test_streams_resume_and_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fed(spark, tmp_path, [("a", 100, 5.0), ("a", 200, 3.0), ("b", 100, 9.0)])
    schema = "k string, ts timestamp, x double"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = []
        for name, rows, mode in (
            ("n", M.windowed_counts(stream, "ts", ["k"], "1 hour", "10 minutes", "x"), "update"),
            ("bin", M.earliest_bins(stream, F.col("x"), ("k",), width="1 hour"), "update"),
            ("first", M.first_per_molecule(stream, "ts", "10 minutes", ("k", "x")), "append"),
        ):
            S.into_table(rows, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", mode).awaitTermination()
            out.append(S.batches(spark, f"{tmp_path}/{name}", rows.schema))
        counts = {(r.k, r.window_start.timestamp()): (r.n, r.total) for r in S.latest(out[0], ["window_start", "k"]).collect()}
        bins = {r.k: r.bin for r in S.folded(out[1], ["k"], bin=F.min("bin")).collect()}
        firsts = {(r.k, r.x) for r in out[2].collect()}
        return counts, bins, firsts

    counts, bins, firsts = run()
    assert counts == {("a", 0.0): (2, 8.0), ("b", 0.0): (1, 9.0)} and bins == {"a": 3.0, "b": 9.0} and firsts == {("a", 5.0), ("a", 3.0), ("b", 9.0)}
    assert run() == (counts, bins, firsts)  # nothing new: nothing twice
    fed(spark, tmp_path, [("a", 300, 1.0), ("a", 8000, 4.0), ("b", 100, 9.0)])
    counts, bins, firsts = run()
    assert counts == {("a", 0.0): (3, 9.0), ("b", 0.0): (2, 18.0), ("a", 7200.0): (1, 4.0)} and bins == {"a": 1.0, "b": 9.0}
    assert firsts == {("a", 5.0), ("a", 3.0), ("b", 9.0), ("a", 1.0), ("a", 4.0)}
    fed(spark, tmp_path, [("b", 50, 2.0), ("b", 8100, 6.0)])  # the first is behind the watermark and its window is gone
    counts, bins, _ = run()
    assert counts[("b", 0.0)] == (2, 18.0) and counts[("b", 7200.0)] == (1, 6.0) and bins["b"] == 6.0


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    for n in (1, 1, 2):
        spark.range(3).selectExpr("id k", f"{n} v").write.mode("overwrite").parquet(f"{tmp_path}/t/batch={n}")
    rows = S.batches(spark, f"{tmp_path}/t", "k long, v int")
    assert rows.count() == 6 and {(r.k, r.v) for r in S.latest(rows, ["k"]).collect()} == {(0, 2), (1, 2), (2, 2)}
    assert S.batches(spark, f"{tmp_path}/none", "k long").count() == 0


@pytest.mark.parametrize("block,groups", [(512, 4096), (3, 4096), (512, 2)])
def test_sums_of_products_by_blocks(spark, monkeypatch, block, groups):
    monkeypatch.setattr(O, "GRAM_BLOCK", block)
    monkeypatch.setattr(O, "GRAM_GROUPS", groups)
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(6)}", rng.randrange(40), rng.gauss(0, 2)) for _ in range(150)] + [("alone", 99, 1.0), ("zero", 1, 0.0), ("g1", None, 3.0)]
    got = {(r.g1, r.g2): (r.xy, r.xx, r.yy) for r in O.gram(spark.createDataFrame(rows, "group string, feature int, value double").repartition(3)).collect()}
    want = {}
    for a, f, x in rows:
        for b, e, y in rows:
            if a <= b and f == e and f is not None:
                p = want.get((a, b), (0, 0, 0))
                want[a, b] = (p[0] + x * y, p[1] + x * x, p[2] + y * y)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_long_stretches_are_cut_where_they_lie(spark, monkeypatch):
    from tagtally.operators import quantiles as q

    held, kind = [], type(spark.range(1))
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: (held.append(self._jdf.queryExecution().optimizedPlan().toString()), real(self, *a))[1])
    rows = spark.range(30_000).select((F.col("id") % 3).alias("f"), (F.col("id") * 7919 % 10_007).cast("double").alias("x")).unionByName(spark.createDataFrame([(9, 4.0), (9, 8.0)], "f long, x double"))
    got = {r.f: r.m for r in q.quantiles(rows, ["f"], "x", {"m": 0.5}, stretch=1000).collect()}
    for f in range(3):
        assert got[f] == np.median([i * 7919 % 10_007 for i in range(f, 30_000, 3)])
    assert got[9] == 6
    assert any("strategy=broadcast" in p and "percentile_approx" in p for p in held)  # no exchange of all values by group
