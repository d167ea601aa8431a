"""Quirks of the count, variant, set and ordination operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtally.operators import counts as C
from tagtally.operators import ordination as O
from tagtally.operators import sequences as Q
from tagtally.operators import sets as H
from tagtally.operators import statistics as S
from tagtally.operators import variants as V


def test_half_even_and_guarded(spark):
    r = spark.createDataFrame([(0.5, None), (1.5, 2.0), (2.5, 1.0)], "x double, y double")
    assert [v[0] for v in r.select(C.rounded(F.col("x"))).collect()] == [0, 2, 2]
    assert [v[0] for v in r.select(C.guarded(F.greatest, F.col("x"), F.col("y"))).collect()] == [None, 2.0, 2.5]


def test_bh(spark):
    p = [0.01, 0.04, 0.03, None, 0.5, 0.04]
    r = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {x.i: x.q for x in C.benjamini_hochberg(r, "p", "q").collect()}
    assert got[3] is None and [got[i] for i in (0, 1, 2, 4, 5)] == pytest.approx([0.05, 0.05, 0.05, 0.5, 0.05])


def test_stouffer_keeps_weights_of_missing_z(spark):
    r = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "z double, w double")
    assert r.agg(C.stouffer(F.col("z"), F.col("w"))).first()[0] == pytest.approx(2 / math.sqrt(8))
    assert r.where("z is null").agg(C.stouffer(F.col("z"), F.col("w"))).first()[0] is None


def test_levels(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "t string")
    got = {r.t: (r.n, r.percent) for r in C.level_counts(rows, ["a", "b"], "t").collect()}
    assert got == {"a": (2, 50.0), "b": (0, 0.0), "others": (2, 50.0)}
    full = C.with_missing_levels(spark.createDataFrame([(1, "a")], "i int, t string"), spark.createDataFrame([("a",), ("b",)], "t string"), "t")
    assert sorted(map(repr, map(tuple, full.collect()))) == sorted([repr((1, "a")), repr((None, "b"))])


def test_null_sd_fallbacks(spark):
    f = lambda z: C.null_sd(spark.createDataFrame([(float(v),) for v in z], "z_delta double")).first()["sd"]
    assert f([0.1] * 3) == 0.3 and f(np.linspace(0.6, 0.9, 12)) == pytest.approx(np.std(np.linspace(0.6, 0.9, 12), ddof=1))


def test_pileup_projection(spark):
    rows = spark.createDataFrame([("t", 1, "A", "30,10,2,3,4,0,1,2,3,4"), ("t", 2, "n", "5,1"), ("t", 3, "C", None)], "chr string, pos int, ref_base string, packed string")
    got = {r.pos: r for r in V.project(V.unpack(rows)).collect()}
    assert (got[1].REF, got[1].SGID, got[1].mismatches, got[1].total_variant, got[1].nonvariant) == (10, 10, 9, 19, 11)
    assert got[2].REF == 0 and got[2].mismatches == 1 and got[3].depth == 0


def test_paired_fill_and_clip(spark):
    rows = spark.createDataFrame([("x", 1, "IP", 30, 25), ("x", 1, "Input", 1, 20), ("y", 1, "IP", 3, 40)], "site string, pair int, condition string, K int, N int")
    got = V.paired(rows).collect()
    assert [(r.site, r.K_IP, r.N_IP, r.K_Input) for r in got] == [("x", 25, 25, 1)]
    assert V.paired(rows, 0).where("site = 'y'").first().N_Input == 0


def test_pileup_from_alignments(spark):
    rows = spark.createDataFrame([("t", 5, "2M1I2M1D1M", "ACGTAC", "IIIIII"), ("t", 5, "2M", "AC", "I!")], "rname string, pos int, cigar string, seq string, qual string")
    got = {r.pos: r for r in V.pileup(rows).collect()}
    assert (got[5].A, got[6].C, got[6].Insert, got[7].T, got[8].A, got[9].Gap, got[9].Delete, got[10].C) == (2, 1, 1, 1, 1, 1, 1, 1)


def test_five_retention_modes(spark):
    rows = spark.createDataFrame([("l", p, 10 * p) for p in (1, 2, 4, 7, 9, 12)], "lib string, pos int, depth int")
    mean = np.mean([10 * p for p in (1, 2, 4, 7, 9, 12)])
    assert V.five_retention(rows, ["lib"]).first()[1] == pytest.approx(np.mean([10, 20, 40]) / mean)
    assert V.five_retention(rows, ["lib"], present=True).first()[1] == pytest.approx(np.mean([10, 20, 40, 70, 90]) / mean)
    assert V.five_retention(rows.where("pos < 5"), ["lib"], present=True).count() == 0


def test_moderated_t_on_null_data(spark):
    rng = np.random.default_rng(3)
    rows = [(s, p, float(rng.normal()), 1.0) for s in range(400) for p in range(6)]
    fit = V.weighted_fit(spark.createDataFrame(rows, "site int, pair int, delta double, w double"))
    got = V.moderated(fit).toPandas()
    assert 0.01 < (got.p < 0.05).mean() < 0.1 and (got.df >= 5).all()


def test_moderated_t_is_fitted_over_all_sites(spark):
    import inspect

    from tagtally.functions.tails import digamma, trigamma, trigamma_inverse

    assert list(inspect.signature(V.moderated).parameters) == ["fit"]  # no bound on the sites of the prior
    rng = np.random.default_rng(6)
    n, x = rng.integers(4, 9, 700), rng.normal(0, 1, 700).round(2)
    s2 = np.exp(0.3 * x) * 5 / rng.chisquare(5, 700) * rng.chisquare(n - 1) / (n - 1)
    fit = spark.createDataFrame([(i, int(n[i]), 1.0, 0.5, float(s2[i]), float(x[i])) for i in range(700)], "site int, n long, sw double, beta double, s2 double, amean double")
    assert V.order_statistics(fit, "amean", [0, 10, 350, 699], 4) == np.sort(x)[[0, 10, 350, 699]].tolist()
    d = n - 1.0
    e = np.log(s2) - digamma(d / 2) + np.log(d / 2)
    basis, _ = V.spline_basis(x, np.unique(np.quantile(x, np.linspace(0, 1, 5))))
    coef = np.linalg.lstsq(basis, e, rcond=None)[0]
    v = ((e - basis @ coef) ** 2).sum() / (700 - basis.shape[1]) - trigamma(d / 2).mean()
    d0 = 2 * trigamma_inverse(v)
    prior = np.exp(basis @ coef + digamma(np.array(d0 / 2)) - np.log(d0 / 2))
    got = V.moderated(fit).toPandas().sort_values("site")
    assert np.allclose(got.df, d + d0) and np.allclose(got.s2_post, (d0 * prior + d * s2) / (d0 + d))


def test_set_categories(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("A", 2), ("B", 2), ("C", 3), ("A", 4), ("A", 4), ("C", 5), ("A", 5), ("B", 6), ("C", 6), ("B", 7), ("A", None)], "set_name string, item int")
    got = {r.item: r.category for r in H.categories(rows, ["A", "B", "C"]).collect()}
    assert got == {1: "A&B&C", 2: "A&B", 3: "C", 4: "A", 5: "A&C", 6: "B&C", 7: "B"}
    assert {r.item for r in H.intersection(rows, ["A", "B"]).collect()} == {1, 2} and {r.item for r in H.difference(rows, "A", "B").collect()} == {4, 5}


def test_cosine(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 2.0), ("c", 3, 5.0), ("d", 1, 0.0), ("e", 1, float("nan"))], "group string, feature int, value double")
    got = {(r.g1, r.g2): r.d for r in O.cosine_distances(rows).collect()}
    assert got["a", "b"] == pytest.approx(0) and got["a", "c"] == 1 and got["a", "d"] == 1 and got["e", "e"] == 1 and len(got) == 15


def test_batch_and_zscore(spark):
    rows = spark.createDataFrame([("g1", "x", 1, 1.0), ("g2", "x", 1, 3.0), ("g3", "y", 1, 8.0), ("g4", "y", 1, 12.0), ("g1", "x", 2, 5.0), ("g2", "x", 2, 7.0)], "group string, batch string, feature int, value double")
    got = {(r.group, r.feature): r.value for r in O.batch_residual(rows).collect()}
    assert got["g1", 1] == 5.0 and got["g4", 1] == 8.0 and got["g1", 2] == 5.0
    flat = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0)], "group string, feature int, value double")
    assert {r.value for r in O.zscore(flat).collect()} == {0.0}


def test_mds_svm_permanova(spark):
    x = np.array([[0, 0], [0, 3], [4, 0], [4, 3.0]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = O.mds(list("abcd"), d)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d) and O.axes_kept(y) == 2
    points = np.random.default_rng(0).normal(0, 0.2, (12, 2)) + np.repeat([[0, 0], [3, 3]], 6, 0)
    label = np.repeat([0, 1], 6)
    scores = O.loocv_svm(spark, list(range(12)), points, label)
    assert S.auc(scores, "label", "score").first()["auc"] == 1.0
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    r = O.permanova(spark, dist, label.tolist(), 199).first()
    assert r.p <= 0.02 and 0.8 < r.r2 < 1
    order = O.cluster_order(list(range(12)), dist)
    assert {frozenset(order[:6]), frozenset(order[6:])} == {frozenset(range(6)), frozenset(range(6, 12))}


def test_negative_binomial_wald(spark):
    rng = np.random.default_rng(1)
    rows = []
    for f in range(60):
        mean, lfc = rng.uniform(40, 300), (2.0 if f < 8 else 0.0)
        for rep in range(4):
            for c in ("Input", "IP"):
                m = mean * 2 ** (lfc * (c == "IP"))
                rows.append((f"f{f}", f"{rep}{c}", str(rep), c, int(rng.negative_binomial(20, 20 / (20 + m)))))
    counts = spark.createDataFrame(rows, "feature string, sample string, replicate string, condition string, count int")
    factors = counts.select("sample").distinct().withColumn("size_factor", F.lit(1.0))
    got = S.nb_wald(counts, factors).toPandas().set_index("feature").sort_index()
    up = [f"f{i}" for i in range(8)]
    assert (got.loc[up].padj < 0.05).all() and got.loc[up].log2FoldChange.mean() == pytest.approx(2, abs=0.25)
    assert (got.drop(up).pvalue < 0.05).mean() < 0.2


def test_negative_binomial_outliers_and_weak_features(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(130):
        for i in range(12):
            c = "IP" if i % 2 else "Input"
            m = (200 * 2 ** (2 * (c == "IP"))) if f < 30 else 1.0 if f >= 40 else 200
            rows.append((f, f"s{i}", "0", c, 100_000 if (f, i) == (35, 0) else int(rng.negative_binomial(20, 20 / (20 + m)))))
    counts = spark.createDataFrame(rows, "feature long, sample string, replicate string, condition string, count int")
    got = S.nb_wald(counts, counts.select("sample").distinct().withColumn("size_factor", F.lit(1.0))).toPandas().set_index("feature").sort_index()
    assert math.isnan(got.loc[35].pvalue) and math.isnan(got.loc[35].padj) and got.pvalue.isna().sum() <= 3
    assert (got.loc[:29].padj < 0.01).all()
    mean = np.concatenate([np.linspace(0.1, 5, 900), np.linspace(50, 300, 100)])
    p = np.concatenate([np.linspace(0.01, 1, 900), np.linspace(1e-4, 0.04, 100)])
    least = S.filter_threshold(mean, p)
    assert 3 < least <= 50
    assert S.filter_threshold(mean, np.full(1000, 0.9)) == mean.min() and S.filter_threshold(mean[:3], p[:3], 5) <= mean[0]


def test_nb_glm_tests_every_part(spark, tmp_path):
    from datetime import date

    from tagtally.plans.registry import QUERIES

    rng = np.random.default_rng(4)
    lines = []
    for part in range(1, 41):
        for year in (1995, 1996, 1997, 1998):
            for flag in "NR":
                n = 60 if part % 10 == 0 else int(rng.negative_binomial(30, 30 / (30 + 30 * 2 ** (2 * (part <= 4 and flag == "R")))))
                lines += [(part, flag, date(year, 3, 1), 1.0, "O", 1)] * n
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string, l_shipdate date, l_quantity double, l_linestatus string, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 5}") for p in range(1, 41)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["nb_glm"](spark, str(tmp_path)).toPandas().set_index("feature").sort_index()
    assert sorted(got.index) == list(range(1, 41))
    assert got.loc[[1, 2, 3, 4]].log2FoldChange.mean() == pytest.approx(2, abs=0.3) and (got.loc[[1, 2, 3, 4]].padj < 0.01).all()
    assert got.loc[10].log2FoldChange == pytest.approx(0, abs=1e-3) and got.loc[10].baseMean == pytest.approx(60, abs=1e-3)


def test_regressions(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x + 1, 1.0, b) for x in range(6) for b in ("u", "v")], "x double, y double, se double, b string")
    fit = S.inverse_variance_fit(rows, "y", "x", "se")
    assert fit["slope"] == pytest.approx(2) and fit["intercept"] == pytest.approx(1)
    assert S.blocked_fit(rows.withColumn("y", F.col("y") + F.when(F.col("b") == "u", 5).otherwise(0)), "y", "x", "b")["slope"] == pytest.approx(2)
    assert S.band(spark, S.inverse_variance_fit(rows.withColumn("y", F.col("y") + F.col("x") % 2), "y", "x", "se"), [0.0, 5.0]).where("lo < y and y < hi").count() == 2


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, "".join(rng.choice(list("GC" if i % 4 == 0 else "ACGT"), 5)), i % 4 == 0) for i in range(240)]
    k = spark.createDataFrame(rows, "rowid int, s int, kmer string, hit boolean")
    b = Q.bootstrap_gc(k.where("hit"), k.where("not hit"), "s", 60).collect()
    assert len(b) == 5 and all(r.lo <= r.delta_gc <= r.hi and r.delta_gc > 0.2 for r in b)
    assert all(r.q < 0.05 for r in Q.permutation_gc(k, "s", 99).collect())
    few = Q.bootstrap_gc(k.where("hit"), k.where("not hit and rowid < 12"), "s", 20).collect()
    assert len(few) == 5


def test_dispersions_of_many_features():
    """Batched fits are those of each feature alone, and the dispersion found is the best of the exact likelihood."""
    import math

    from tagtally.operators import statistics as s

    rng = np.random.default_rng(8)
    x = np.column_stack([np.ones(10), np.tile([0, 1], 5), np.repeat([0, 1], 5)])
    sf = rng.uniform(0.5, 2, 10)
    y = rng.negative_binomial(2, 2 / (2 + 20 * sf), (40, 10)).astype(float)
    y[:10] = rng.poisson(1.5, (10, 10)) + 1.0
    alpha = np.full(40, 0.3)
    beta, cov, mu = s._fit_beta(y, x, sf, alpha)
    for i in (0, 3, 20, 39):
        b, c, m = s._fit_beta(y[i : i + 1], x, sf, alpha[:1])
        assert np.allclose(b[0], beta[i]) and np.allclose(c[0], cov[i]) and np.allclose(m[0], mu[i])
        w = mu[i] / (1 + 0.3 * mu[i])
        assert np.abs(x.T @ ((y[i] - mu[i]) * w / mu[i]) - 1e-6 * beta[i]).max() < 1e-4  # the score of the ridged model

    def exact(i, a):
        ll = sum(sum(math.log1p(a * k) for k in range(int(v))) + v * math.log(m) - (v + 1 / a) * math.log1p(a * m) for v, m in zip(y[i], mu[i]))
        w = mu[i] / (1 + a * mu[i])
        return ll - 0.5 * np.linalg.slogdet(x.T @ (w[:, None] * x))[1]

    best = s._best_dispersion(y, mu, x)
    grid = np.exp(np.linspace(math.log(1e-8), math.log(10), 60))
    for i in range(40):
        assert exact(i, best[i]) >= max(exact(i, a) for a in grid) - 1e-3
        got = s._profile(y[i : i + 1], mu[i : i + 1], x, np.array([math.log(0.5)]))[0] - s._profile(y[i : i + 1], mu[i : i + 1], x, np.array([math.log(1e-6)]))[0]
        assert got == pytest.approx(exact(i, 0.5) - exact(i, 1e-6), abs=1e-6)


def test_expected_intersection_needs_no_distribution(spark, monkeypatch):
    from tagtally.functions import tails
    from tagtally.plans.registry import QUERIES

    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 9)], "set_name string, item int")
    universe = spark.range(1, 5).withColumnRenamed("id", "item")
    assert H.expected_intersection(sets, ["a", "b"], universe).first()["expected"] == pytest.approx(0.5)
    assert H.expected_intersection(sets, ["a", "c"], universe).first()["expected"] == 0
    monkeypatch.setattr(tails, "intersection_pmf", None)  # a call fails
    assert QUERIES["nway_expected"](spark, "/root/testdata/sf0.001").count() == 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_adjustment_finds_rows_whose_values_differ_when_made_again(spark, by):
    import random

    again = F.udf(lambda i: (i + 1) / 100 + random.random() * 1e-9, "double").asNondeterministic()  # as sums in another order
    rows = spark.range(60).select((F.col("id") % 3).alias("g"), "id", again("id").alias("p"))
    assert C.benjamini_hochberg(rows, "p", "q", *by).where("q is null").count() == 0


def counted(spark, column):
    """A column as it is, and how often rows of it were made."""
    made = spark.sparkContext.accumulator(0)

    def see(x):
        made.add(1)
        return x

    kind = "double" if column == "s2" else "string"
    return F.udf(see, kind)(column), made


def test_moderated_t_makes_its_fits_once(spark):
    rows = spark.range(200).select(F.col("id").alias("site"), (F.col("id") % 5 + 3).alias("n"), F.lit(2.0).alias("sw"), (F.col("id") / 100 - 1).alias("beta"), ((F.col("id") % 17 + 1) / 10).alias("s2"), (F.col("id") % 31 / 3).alias("amean"))
    s2, made = counted(spark, "s2")
    assert V.moderated(rows.withColumn("s2", s2)).where("padj is not null").count() == 200
    assert made.value == 200


def test_permutation_reads_its_rows_once(spark):
    words = ["GCATGCA", "AAAAAAA", "GGGGGGG", "TTTTGCA"]
    rows = spark.createDataFrame([(i, f"s{i % 2}", words[i % 4], i % 3 == 0) for i in range(60)], "rowid long, source string, kmer string, hit boolean")
    kmer, made = counted(spark, "kmer")
    assert Q.permutation_gc(rows.withColumn("kmer", kmer), "source", 50).count() == 7
    assert made.value == 60


def test_kmers_of_the_tables_are_made_once(spark):
    from tagtally.plans.registry import Tables
    from tagtally.plans.summaries import _kmers

    plan = _kmers(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
