"""Molecules: hand-computed cases of the ordering, tie and abundance rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtally.operators import reads as R

ROWS = "qname string, umi string, seq string, rname string, as int, nm int"


def test_topk_order(spark):
    rows = spark.createDataFrame([("r", "u", "s", "a", 10, 1), ("r", "u", "s", "b", 10, None), ("r", "u", "s", "c", 10, 1), ("r", "u", "s", "d", 9, 0)], ROWS)
    best = lambda k, mode="AS": {r.rname for r in R.top_candidates(rows, k, mode).collect()}
    assert best(1) == {"b"} and best(2) == {"b", "c"} and best(0) == {"a", "b", "c", "d"}
    assert best(1, "NM") == {"d"} and best(2, "NM") == {"d", "a"}


def test_prune(spark):
    rows = spark.createDataFrame([("r", "u", "s", "a", 10, 1), ("r", "u", "s", "b", 8, 2), ("r", "u", "s", "c", 7, None), ("r", "u", "s", "d", None, 0)], ROWS)
    assert {r.rname for r in R.prune_delta(rows, "AS", 2).collect()} == {"a", "b"}
    assert {r.rname for r in R.prune_delta(rows, "AS", None).collect()} == {"a", "b", "c"}
    assert {r.rname for r in R.prune_delta(rows, "NM", 1).collect()} == {"a", "d"}


def test_best_per_key_is_independent_by_score(spark):
    rows = spark.createDataFrame([("r1", "u", "s", "a", 10, 3), ("r2", "u", "s", "a", 7, 1), ("r3", "u", "s", "a", None, None)], ROWS)
    r = R.best_per_key(rows).first()
    assert (r["as"], r["nm"]) == (10, 1)


def test_skip_reasons(spark):
    rows = spark.createDataFrame([("a_X", 4, "t", 30, "AC", 1, 1), ("a_X", 0, "t", 1, "AC", 1, 1), ("a_X", 0, "t", 30, "*", 1, 1), ("a", 0, "t", 30, "AC", 1, 1), ("a_X", 0, "*", 30, "AC", 1, 1), ("a_X", 0, "t", 30, "AC", None, None), ("a_X", 0, "t", 30, "AC", None, 1)], "qname string, flag int, rname string, mapq int, seq string, as int, nm int")
    got = {r.reason: r.n for r in R.skip_counts(R.ingest(rows, 10)).collect()}
    assert got == dict.fromkeys(["unmapped", "low_mapq", "no_seq", "no_umi", "no_rname", "no_score", "kept"], 1)


def edges_of(spark, groups):
    rows = [(f"q{g}", f"u{g}", "s", t, a, 0) for g, members in enumerate(groups) for t, a in members]
    return R.weighted(R.best_per_key(spark.createDataFrame(rows, ROWS)))


def brute_em(groups, rounds, beta=0.1):
    names = sorted({t for g in groups for t, _ in g})
    single = {t: float(sum(len(g) == 1 and g[0][0] == t for g in groups)) for t in names}
    a = {t: 1 + v for t, v in single.items()}
    for _ in range(rounds):
        new = dict(single)
        for g in groups:
            if len(g) > 1:
                w = {t: a[t] * np.exp(beta * (s - max(x for _, x in g))) for t, s in g}
                for t in w:
                    new[t] += w[t] / sum(w.values())
        a = new
    scale = len(groups) / sum(a.values())
    return {t: v * scale for t, v in a.items()}


GROUPS = [[("a", 10)], [("a", 10), ("b", 10)], [("a", 10), ("b", 9)], [("b", 10), ("c", 8), ("a", 9)], [("c", 5)], [("a", 10), ("b", 10)]]


@pytest.mark.parametrize("driver_edges", [10**6, 0])
def test_em(spark, driver_edges):
    edges = edges_of(spark, GROUPS)
    got = {r["transcript"]: r["count"] for r in R.estimate(edges, 7, 0.0, driver_edges).collect()}
    want = brute_em(GROUPS, 7)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(len(GROUPS))


@pytest.mark.parametrize("driver_edges", [10**6, 0])
def test_em_over_packed_classes(spark, monkeypatch, driver_edges):
    """Rows of few edges and stretches of few transcripts add up to the same; what an iteration reads are bytes."""
    monkeypatch.setattr(R, "PACK", 3)
    monkeypatch.setattr(R, "STRETCH", 2)
    rng = np.random.default_rng(3)
    groups = [[(str(t), int(rng.integers(5, 9))) for t in rng.choice(11, rng.integers(1, 5), replace=False)] for _ in range(60)]
    edges = edges_of(spark, groups).checkpoint()
    got = {r["transcript"]: r["count"] for r in R.estimate(edges, 9, 0.0, driver_edges, written=True).collect()}
    assert got == pytest.approx(brute_em(groups, 9))
    packed = R._packed(R.classes(edges.withColumn("t", F.col("rname").cast("int")), "t"))
    assert dict(packed.dtypes) == {"edges": "bigint"} | dict.fromkeys(R.PACKED, "binary") and packed.count() > 4
    assert packed.agg(F.sum("edges")).first()[0] == sum(r["n"] for r in R.classes(edges).select(F.size("members").alias("n")).collect())


def test_edges_written_already_are_not_persisted_again(spark, monkeypatch):
    edges, persisted = edges_of(spark, GROUPS).checkpoint(), []
    real = type(edges).persist
    monkeypatch.setattr(type(edges), "persist", lambda self, *a: persisted.append(self.columns) or real(self, *a))
    R.estimate(edges, 3, 0.0, written=True).collect()
    assert persisted == [["edges", *R.PACKED]]


def test_edges_of_the_tables_are_pruned_without_another_shuffle(spark):
    from tagtally.plans.molecules import _edges
    from tagtally.plans.registry import Tables

    plan = _edges(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qname" not in plan and "hashpartitioning(umi" in plan


@pytest.mark.parametrize("name", ["unassigned_records", "dedup_first"])
def test_records_are_not_shuffled_by_molecule(spark, name):
    """Molecules are looked up for orders; a shuffle by molecule carries no record that the look-up did not leave."""
    import re

    from tagtally.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"Join (LeftAnti|Inner)", line) and "l_orderkey" in line]
    below = plan[plan.index(joins[-1]) :]
    assert "o_custkey" in below and re.search(r"Join (LeftAnti|Inner).*umi", below)


def test_em_singletons_and_empty(spark):
    got = {r["transcript"]: r["count"] for r in R.estimate(edges_of(spark, [[("a", 1)], [("a", 1)], [("b", 2)]])).collect()}
    assert got == pytest.approx({"a": 2, "b": 1})
    assert R.estimate(edges_of(spark, [[("a", 1)]]).where("false")).count() == 0


def test_em_recovers_a_known_mix(spark):
    rng = np.random.default_rng(0)
    truth = rng.random(1500) < 0.75
    groups = [[("a", 40 + 10 * bool(x) - 10 * bool(not x)), ("b", 40)] if rng.random() < 0.5 else [("a", 40), ("b", 40)] for x in truth]
    got = {r["transcript"]: r["count"] for r in R.estimate(edges_of(spark, groups), 200, 1e-9).collect()}
    assert got["a"] > got["b"]


def test_hard_pick_labels(spark):
    post = spark.createDataFrame([("1", "s", "a", 9, 0, 0.7, 2), ("1", "s", "b", 9, 0, 0.3, 2), ("2", "s", "a", 9, 0, 0.5, 2), ("2", "s", "b", 8, 0, 0.5, 2), ("3", "s", "b", 9, 0, 0.5, 2), ("3", "s", "a", 9, 0, 0.5, 2)], "umi string, seq string, rname string, as int, nm int, p double, n int")
    got = {r.umi: (r.transcript, r.tie_count, r.tie_break) for r in R.hard_pick(post).collect()}
    assert got == {"1": ("a", 1, "posterior"), "2": ("a", 2, "posterior->AS"), "3": ("a", 2, "posterior->AS->lexi_name")}


def test_dedup_keeps_the_first_record(spark):
    rows = spark.createDataFrame([("q1", "u", "s", "a", 9, 0, 256, 3), ("q2", "u", "s", "a", 9, 0, 0, 1), ("q3", "u", "s", "b", 9, 0, 0, 0)], ROWS + ", flag int, ord int")
    picks = spark.createDataFrame([("u", "s", "a", 1.0, 1, "posterior")], "umi string, seq string, transcript string, posterior double, tie_count int, tie_break string")
    got = R.deduplicate(rows.withColumn("mapq", F.lit(3)), picks, ["ord"]).collect()
    assert [(r.qname, r.mapq, r.flag) for r in got] == [("q2", 255, 0)]
    assert R.unassigned(rows, picks.where("false")).count() == 3


def test_rarefaction(spark):
    rows = spark.createDataFrame([(f"q{i}", f"u{i % 7}", "s") for i in range(200)], "qname string, umi string, seq string")
    u = (F.xxhash64("qname") % 1000 + 1000) / 2000.0
    got = [(r.fraction, r.reads_included, r.unique_umi_seq, r.saturation) for r in R.rarefy(rows, [0.1, 0.5, 1.0], u).orderBy("fraction").collect()]
    assert got[-1][1:3] == (200, 7) and got == sorted(got) and all(r[3] == (r[2] / r[1] if r[1] else 0) for r in got)
    assert [r.saturation for r in R.rarefy(rows.where("false"), [0.5], F.lit(0.1)).collect()] == [0.0]
