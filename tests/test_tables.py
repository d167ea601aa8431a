"""Trimming against brute force, orders in stretches, resampling by counts against shuffled rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute_start(read, adapter, rate, overlap):
    """Alignments of all prefixes of the adapter that may count, by plain dynamic programming from each start."""
    best = (-1, 0, len(read))
    for s in range(len(read)):
        row = [(i, 0) for i in range(len(adapter) + 1)]  # (errors, -equal letters) of adapter[:i]
        for j in range(s, len(read)):
            new = [(row[0][0] + 1, row[0][1])]
            for i in range(1, len(adapter) + 1):
                same = read[j] == adapter[i - 1]
                new.append(min((row[i - 1][0] + (not same), row[i - 1][1] - same), (new[i - 1][0] + 1, new[i - 1][1]), (row[i][0] + 1, row[i][1])))
            row = new
            for i in [len(adapter)] if j < len(read) - 1 else range(overlap, len(adapter) + 1):
                if row[i][0] <= int(rate * i):
                    best = max(best, (-row[i][1], -row[i][0], best[2] if (-row[i][1], -row[i][0]) == best[:2] else s), key=lambda b: (b[0], b[1]))
    return best


def test_adapters_with_errors():
    from tagtally.operators.trimming import adapter_starts

    rng = random.Random(12)
    adapter = "AGATCGGAAGAG"
    reads, planted = [], []
    for _ in range(200):
        body, tail = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40))), list(adapter)
        if rng.random() < 0.5:
            tail[rng.randrange(12)] = rng.choice("ACGT")
        rest = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 12)))
        reads.append(body + "".join(tail) + rest)
        planted.append(len(body))
    starts = adapter_starts([r.encode() for r in reads], [adapter.encode()], 0.1, 12)
    for r, s in zip(reads, starts):
        want = brute_start(r, adapter, 0.1, 12)
        assert s < len(r) and want[0] >= 11
    assert np.mean(np.abs(starts - planted) <= 1) > 0.97
    assert adapter_starts([b"", b"ACGT", b"CCCCCCCCCCAAAAAAAA", b"CCCCAAAAAATAAACCCC"], [b"A" * 10], 0.2, 8).tolist() == [0, 4, 10, 4]


def test_trimming_passes(spark):
    from tagtally.operators import trimming as t

    tag, body = "ACGTACGTACGT", "CGTCGTCTCGTCTTCGTCTC"
    rows = [("a", tag + body + "A" * 12, "I" * 44), ("b", tag + body + "AAAAATAAAA", "I" * 42), ("c", tag + body + "ACGT", "I" * 30 + "######"), ("d", tag + "CC", "I" * 14), ("e", "", ""), ("f", tag + body, "#" * 32)]
    out = {r.qname: (r.seq, r.qual) for r in t.first_pass(spark.createDataFrame(rows, "qname string, seq string, qual string")).collect()}
    assert out == {f"a_{tag}": (body, "I" * 20), f"b_{tag}": (body, "I" * 20), f"c_{tag}": (body[:18], "I" * 18)}
    two = spark.createDataFrame([("x", "GGG" + body + "AGATCGGAAGAGCACAC", "I" * 40), ("y", "GGG" + body, "I" * 23), ("z", "GGGCC", "IIIII")], "qname string, seq string, qual string")
    assert {(r.qname, r.seq) for r in t.second_pass(two).collect()} == {("x", body), ("y", body)}


def test_orders_in_stretches(spark, monkeypatch):
    from tagtally.operators import counts, ordered, statistics

    plain = ordered.stretched
    rng = random.Random(2)
    p = [round(rng.random() ** 3, 3) for _ in range(900)] + [None, 0.0, 1.0]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    labels = spark.createDataFrame([(rng.randrange(2), rng.randrange(60)) for _ in range(500)], "y int, s int")
    once = (sorted(counts.benjamini_hochberg(frame, "p", "q").collect(), key=lambda r: r.i), sorted(statistics.roc(labels, "y", "s").collect()), statistics.auc(labels, "y", "s").first())
    many = lambda rows, order, rows_each=0: plain(rows, order, 25)
    monkeypatch.setattr(counts, "stretched", many)
    monkeypatch.setattr(statistics, "stretched", many)
    assert many(frame.where("p is not null").select("p").distinct(), "p").select("__b").distinct().count() > 5
    again = (sorted(counts.benjamini_hochberg(frame, "p", "q").collect(), key=lambda r: r.i), sorted(statistics.roc(labels, "y", "s").collect()), statistics.auc(labels, "y", "s").first())
    assert [tuple(r) for r in once[0]] == [tuple(r) for r in again[0]] and once[1] == again[1] and once[2] == again[2]
    known = sorted(x for x in p if x is not None)
    q = {r.i: r.q for r in again[0]}
    for i, x in enumerate(p):
        want = None if x is None else min(1.0, min(y * len(known) / sum(z <= y for z in known) for y in known if y >= x))
        assert q[i] == pytest.approx(want) if x is not None else q[i] is None


def test_resampling_by_counts(spark):
    """Intervals and p values agree with resampling of rows one by one."""
    from tagtally.operators import sequences as s

    rng = np.random.default_rng(5)
    rows = [(i, "s%d" % (i % 3), "".join(rng.choice(list("ACGT"), 3, p=[0.2, 0.3, 0.3, 0.2] if i % 4 else [0.3, 0.2, 0.2, 0.3])), i % 4 == 0) for i in range(600)]
    frame = spark.createDataFrame(rows, "rowid long, st string, kmer string, hit boolean")
    got = sorted(s.bootstrap_gc(frame.where("hit"), frame.where("not hit"), "st").collect(), key=lambda r: r.k_pos)
    perm = sorted(s.permutation_gc(frame, "st").collect(), key=lambda r: r.k_pos)
    gc = np.array([[c in "GC" for c in k] for _, _, k, _ in rows], float)
    hit, st = np.array([h for *_, h in rows]), np.array([x for _, x, _, _ in rows])
    draws, nulls = [], []
    for _ in range(800):
        pick = np.concatenate([rng.choice(np.flatnonzero(~hit & (st == x)), (hit & (st == x)).sum(), replace=False) for x in sorted(set(st))])
        draws.append(gc[hit].mean(0) - gc[pick].mean(0))
        moved = hit.copy()
        for x in set(st):
            moved[st == x] = rng.permutation(hit[st == x])
        nulls.append(gc[moved].mean(0) - gc[~moved].mean(0))
    lo, hi = np.percentile(draws, [2.5, 97.5], axis=0)
    observed = gc[hit].mean(0) - gc[~hit].mean(0)
    for k, (a, b) in enumerate(zip(got, perm)):
        assert a.delta_gc == pytest.approx(np.mean(draws, 0)[k], abs=0.01) and a.lo == pytest.approx(lo[k], abs=0.02) and a.hi == pytest.approx(hi[k], abs=0.02)
        assert b.observed == pytest.approx(observed[k]) and b.p == pytest.approx((1 + (np.abs(np.array(nulls)[:, k]) >= abs(observed[k]) - 1e-12).sum()) / 801, abs=0.06)
    # A pool that is smaller than its hits is drawn from with replacement.
    few = s.bootstrap_gc(frame.where("hit"), frame.where("not hit").limit(5), "st").collect()
    assert len(few) == 3 and all(r.lo <= r.delta_gc <= r.hi for r in few)


def test_billions_of_rows_are_drawn(spark):
    from tagtally.operators.sequences import _drawn

    out = _drawn(np.random.default_rng(1), np.array([3 * 10**9, 10**9, 5]), 10**9, 50)
    assert (out.sum(1) == 10**9).all() and abs(out[:, 0].mean() / 10**9 - 0.75) < 1e-3 and (out[:, 2] <= 5).all()


def test_table_steps(spark):
    from tagtally.operators import tables as t

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, w int")
    assert [tuple(r) for r in t.inner_chain([a, b], "k").collect()] == [(2, "y", 5)]
    assert [tuple(r) for r in t.bind_columns(a, b.withColumnRenamed("k", "j"), "k", "j").orderBy("k").collect()] == [(1, "x", 2, 5), (2, "y", 3, 6)]
    assert [r.d for r in a.select(t.looked_up(F.col("v"), {"x": 1.0}, 0.0).alias("d")).collect()] == [1.0, 0.0]


def test_one_adapter_of_several_goes():
    from tagtally.operators.trimming import adapter_starts

    # A stretch of G with one error at 17 and ten A at 35: the better one goes alone.
    read = b"CTCTCTCTCTCTCTCTC" + b"GGGGCGGGGGG" + b"TCTCTCT" + b"A" * 10
    both = [b"A" * 10, b"G" * 10]
    assert adapter_starts([read, read[:28], b"CTCT", b""], both, 0.2, 8).tolist() == [35, 17, 4, 0]
    assert adapter_starts([b"CTCTCTCT" + b"G" * 10 + b"CTCT" + b"A" * 10], both, 0.2, 8).tolist() == [22]  # as good: the first named


def test_first_pass_cuts_one_adapter(spark):
    from tagtally.operators.trimming import first_pass

    seq = "ACGTACGTACGT" + "CTCTCTCTCTCTCTCTC" + "GGGGCGGGGGG" + "TCTCTCT" + "A" * 10
    row = first_pass(spark.createDataFrame([("r", seq, "I" * len(seq))], "qname string, seq string, qual string")).first()
    assert row.seq == seq[12:47] and len(row.qual) == 35 and row.qname == "r_ACGTACGTACGT"


def test_trimming_takes_a_long_read_among_short_ones():
    import time

    from tagtally.operators.trimming import adapter_matches, good_parts

    # One place for each letter of each read, were they laid out side by side: 4 GB.
    reads = [b"CT" * 10_000, *[b"CTCTCT" + b"A" * 10 + b"CT"] * 200_000]
    begun = time.monotonic()
    found = adapter_matches(reads, b"A" * 10, 0.2, 8)
    assert time.monotonic() - begun < 60
    assert found[0].tolist() == [-1, 0, 20_000] and (found[1:] == [10, 0, 6]).all()
    assert good_parts(["", "II##", "####", "I#I", "#I#", "IIII"]).tolist() == [0, 2, 0, 3, 2, 4]


def test_reads_are_cut_in_one_pass(spark):
    from tagtally.plans.registry import Tables
    from tagtally.plans.scans import _reads

    plan = _reads(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(" not in plan and plan.count("regexp_extract_all") == 1
