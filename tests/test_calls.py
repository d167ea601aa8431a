"""Counts to calls and pileups to motifs, against simulated truth and recomputation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtally.functions import tail_columns, tails
from tagtally.operators import calls as K
from tagtally.operators import sequences as Q
from tagtally.operators import statistics as S


def simulated(seed=3, features=160, replicates=4, up=20, fake=15):
    """Features 0..up rise in IP alone, the next ``fake`` in IP and control; the last ten normalise."""
    rng = np.random.default_rng(seed)
    rows = []
    for rep in range(replicates):
        for suffix, condition in (("i", "Input"), ("p", "IP"), ("h", "Control")):
            depth = rng.uniform(0.6, 1.6)
            for f in range(features):
                change = 4 if f < up and condition == "IP" else 4 if up <= f < up + fake and condition != "Input" else 1
                mean = depth * change * (60 + f)
                rows.append((f"f{f}", f"{rep}{suffix}", str(rep), condition, int(rng.negative_binomial(25, 25 / (25 + mean)))))
    return rows


COLUMNS = "feature string, sample string, replicate string, condition string, count int"
def normal():
    return F.col("feature").isin([f"f{i}" for i in range(150, 160)])


@pytest.mark.parametrize("model", ["nb", "moments"])
def test_true_positives_are_those_that_rise_alone(spark, model):
    rows = K.true_positives(spark.createDataFrame(simulated(), COLUMNS), normal(), model=model).toPandas().set_index("feature")
    assert len(rows) == 150 and not set(rows.index) & {f"f{i}" for i in range(150, 160)}
    alone, both = [f"f{i}" for i in range(20)], [f"f{i}" for i in range(20, 35)]
    assert rows.loc[alone].tp.mean() > 0.9 and rows.loc[both].vs_input.mean() > 0.9
    # The null is cut off at half a unit, so a feature that rises in both may pass by chance; its change against the control is near 0.
    assert abs(rows.loc[both].delta.mean()) < 0.5 < rows.loc[alone].delta.mean() and rows.drop(alone + both).tp.mean() < 0.05


def test_the_chain_is_its_parts(spark):
    """From the fitted contrasts on, everything is recomputed in plain Python."""
    counts = spark.createDataFrame(simulated(5), COLUMNS)
    kept, factors = K.prepared(counts, normal())
    fits = S.nb_contrasts(kept, factors, K.PAIRS).toPandas()
    got = K.true_positives(counts, normal()).toPandas().set_index("feature")
    sf = {r["sample"]: r.size_factor for r in factors.collect()}
    offset = np.median([-math.log2(sf[f"{r}h"] / sf[f"{r}p"]) for r in range(4)])
    a, b = (fits[fits.contrast == c].set_index("feature") for c in ("pI", "cI"))
    z = (a.log2FoldChange - b.log2FoldChange + offset) / np.sqrt(a.lfcSE**2 + b.lfcSE**2)
    near = z[z.abs() < 0.5]
    near = near if len(near) >= 10 else z[z.abs() < 1]
    sd = near.std() if len(near) >= 10 else 0.3
    p = z.map(lambda v: 0.5 * math.erfc(v / sd / math.sqrt(2))).sort_values()
    q = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1)).to_numpy()[::-1])[::-1].clip(max=1)
    q = dict(zip(p.index, q))
    for f in z.index:
        row = got.loc[f]
        assert row.z_delta == pytest.approx(z[f]) and row.padj_delta == pytest.approx(q[f]) and row.null_sd == pytest.approx(sd)
        hit = a.log2FoldChange[f] > 0.5 and a.padj[f] < 0.05
        assert row.vs_input == hit and row.tp == (hit and z[f] > 0 and q[f] < 0.05)


def test_contrasts_in_one_pass_are_those_alone(spark):
    counts = spark.createDataFrame(simulated(7, features=60), COLUMNS)
    factors = counts.select("sample").distinct().withColumn("size_factor", F.lit(1.0))
    both = S.nb_contrasts(counts, factors, K.PAIRS).toPandas()
    for name, pair in K.PAIRS.items():
        alone = S.nb_wald(counts, factors, *pair).toPandas().set_index("feature").sort_index()
        own = both[both.contrast == name].set_index("feature").sort_index()
        for c in ("baseMean", "log2FoldChange", "lfcSE", "pvalue"):
            assert np.allclose(own[c], alone[c])


def test_outliers_of_large_cells_are_replaced(spark):
    rng = np.random.default_rng(8)
    rows = []
    for f in range(60):
        for i in range(16):
            c = "IP" if i % 2 else "Input"
            mean = 100 * (4 if f < 10 and c == "IP" else 1)
            rows.append((f"f{f}", f"s{i}", "0", c, 90_000 if (f, i) in ((5, 0), (30, 1)) else int(rng.negative_binomial(20, 20 / (20 + mean)))))
    counts = spark.createDataFrame(rows, COLUMNS)
    got = S.nb_wald(counts, counts.select("sample").distinct().withColumn("size_factor", F.lit(1.0))).toPandas().set_index("feature")
    assert got.loc["f5"].outliers == 1 and got.loc["f30"].outliers == 1 and got.outliers.sum() <= 4
    assert got.loc["f5"].log2FoldChange == pytest.approx(2, abs=0.6) and got.loc["f5"].padj < 0.01
    assert abs(got.loc["f30"].log2FoldChange) < 0.8 and got.loc["f30"].baseMean < 200 and not got.pvalue.isna().any()


def test_a_library_without_normalisers_is_an_error(spark):
    rows = [r for r in simulated(features=155) if not (r[1] == "0i" and r[0] in {f"f{i}" for i in range(150, 160)})]
    with pytest.raises(ValueError, match="normalising"):
        K.true_positives(spark.createDataFrame(rows, COLUMNS), normal())


def test_command_of_calls(spark, tmp_path):
    from tagtally import enrich

    rows = simulated(9, features=120, up=15, fake=5)
    samples = sorted({r[1] for r in rows})
    table = {(r[0], r[1]): r[4] for r in rows}
    (tmp_path / "m.csv").write_text("," + ",".join(samples) + "\n" + "".join(f"f{i}," + ",".join(str(table[f"f{i}", s]) for s in samples) + "\n" for i in range(120)))
    (tmp_path / "meta.csv").write_text("sample_name,group_name,replicates,plot_name\n" + "".join(f" {i} ,G1,{i},Group\n" for i in range(4)) + "9,G2,1,No\n")
    (tmp_path / "ann.csv").write_text("transcript_id,family\n" + "".join(f"f{i},{'28S ribosomal RNA' if i >= 110 else 'x'}\n" for i in range(120)))
    out = tmp_path / "out"
    enrich.main(["calls", "--counts", str(tmp_path / "m.csv"), "--metadata", str(tmp_path / "meta.csv"), "--annotation", str(tmp_path / "ann.csv"), "--out", str(out)])
    read = lambda n: spark.read.csv(str(out / n), header=True, inferSchema=True, nullValue="NA")
    assert read("all_G1").count() == 110 and read("contrast_pI_G1").count() == 110 and not (out / "all_G2").exists()
    assert {r.feature for r in read("true_positives_G1").collect()} >= {f"f{i}" for i in range(13)}


def test_tiles_give_every_context(spark):
    rng = np.random.default_rng(2)
    seqs = [(i, "".join(rng.choice(list("ACGT"), n))) for i, n in enumerate((1, 5, 16, 17, 40, 100))] + [(9, ""), (10, None)]
    sites = [(i, p) for i in (*range(6), 9, 10, 11) for p in (-1, 0, 1, 2, 8, 9, 16, 17, 33, 40, 100, 101)] + [(None, 1), (2, None)]
    fasta, frame = spark.createDataFrame(seqs, "id int, seq string"), spark.createDataFrame(sites, "transcript_id int, pos int")
    by = {i: s for i, s in seqs if s}
    for flank, size in ((7, 8), (3, 16), (7, 1000), (0, 5)):
        for r in Q.with_context(frame, fasta, flank, size=size).collect():
            s = by.get(r.transcript_id, "")
            want = ("N" * flank + s + "N" * flank)[r.pos - 1 : r.pos + 2 * flank] if r.pos and 1 <= r.pos <= len(s) else None
            assert (r.sequence_context, r.ref_base) == (want, want and s[r.pos - 1]), (r, flank, size)


def test_sites_on_a_long_sequence_join_tiles(spark):
    fasta = spark.range(1).select(F.lit("c").alias("id"), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.substring(F.sha2(i.cast("string"), 512), 1, 125))).alias("seq"))
    sites = spark.range(20_000).select(F.lit("c").alias("transcript_id"), (F.col("id") * 250 + 1).cast("int").alias("pos"))
    got = Q.with_context(sites, fasta, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "cartesian" not in plan.lower() and got.where("sequence_context is null").count() == 0
    whole = fasta.first().seq
    for r in got.where("pos % 40001 < 251").collect():
        assert r.sequence_context == ("N" * 7 + whole + "N" * 7)[r.pos - 1 : r.pos + 14]


def test_tails_as_expressions(spark):
    x = [*np.linspace(-9, 9, 61).tolist(), -50.0, 38.0, 0.0, 2.8284, math.nan, None]
    for r in spark.createDataFrame([(v,) for v in x], "x double").withColumn("p", tail_columns.normal_sf(F.col("x"))).collect():
        assert r.p is None if r.x is None or r.x != r.x else r.p == pytest.approx(float(tails.normal_sf(np.array([r.x]))[0]), rel=1e-11)
    grid = [(t, df) for t in (0.0, 0.1, 2.0, 20.0, -3.0) for df in (0.5, 1.0, 7.5, 200.0, 9e4, math.inf)] + [(None, 1.0), (math.nan, 1.0), (1.0, 0.0)]
    rows = spark.createDataFrame(grid, "t double, df double").withColumn("p", tail_columns.t_two_sided(F.col("t"), F.col("df")))
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        assert r.p is None if r.t is None or r.t != r.t or not r.df else r.p == pytest.approx(min(1.0, 2 * tails.t_sf(abs(r.t), r.df)), rel=1e-8)
    grid = [(f, a, b) for f in (0.0, 0.2, 1.0, 9.0) for a in (1.0, 4.0, 90.0) for b in (2.0, 30.0)]
    for r in spark.createDataFrame(grid, "f double, a double, b double").withColumn("p", tail_columns.f_sf(F.col("f"), F.col("a"), F.col("b"))).collect():
        assert r.p == pytest.approx(tails.f_sf(r.f, r.a, r.b), rel=1e-9)


def test_draws_from_very_large_pools():
    rng = np.random.default_rng(1)
    got = np.array([Q._hypergeometric(rng, 4 * 10**9, 6 * 10**9, 1000) for _ in range(400)])
    assert got.mean() == pytest.approx(400, abs=4) and got.std() == pytest.approx(math.sqrt(240), rel=0.15)
    small = np.bincount([Q._hypergeometric(rng, 5, 7, 6) for _ in range(4000)], minlength=6) / 4000
    want = [math.comb(5, k) * math.comb(7, 6 - k) / math.comb(12, 6) for k in range(6)]
    assert np.abs(small - want).max() < 0.03
    drawn = Q._drawn(rng, np.array([10**10, 3, 10**9]), 50, 6)
    assert (drawn.sum(1) == 50).all() and (drawn[:, 1] <= 3).all()


def test_sites_to_their_motif(spark):
    """Planted sites lie on one motif: they are found, their letters stand out, and the permutation null says so."""
    rng = np.random.default_rng(12)
    motif, rows, seqs, places = "GGCAGCC", [], [], []
    for site in range(240):
        hit = site < 40
        left, right = ("".join(rng.choice(list("ACGT"), 40)) for _ in range(2))
        middle = motif if hit else "".join(rng.choice(list("ACGT"), 7))
        seqs.append((f"t{site}", left + middle + right))
        places.append((site, f"t{site}", 44, "all"))
        for pair in range(6):
            for condition, p in (("IP", 0.3 if hit else 0.1), ("Input", 0.1)):
                rows.append((site, pair, condition, int(rng.binomial(400, p)), 400))
    sums = spark.createDataFrame(rows, "site int, pair int, condition string, K int, N int")
    for test in ("moderated", "normal"):
        tested = K.variant_sites(sums, 20, 4, test=test)
        hits = {r.site for r in tested.where("hit").collect()}
        assert hits >= set(range(40)) and len(hits) <= 44
    found = K.motif_sites(tested, spark.createDataFrame(places, "site int, transcript_id string, pos int, stratum string"), spark.createDataFrame(seqs, "id string, seq string"), stratum="stratum")
    assert {r.sequence_context for r in found["sites"].where("site < 40").collect()} == {motif}
    odds = {r.k_pos: r for r in found["log_odds"].collect()}
    assert all(odds[i + 1][b] > 1 for i, b in enumerate(motif))
    null = {r.k_pos: r for r in found["permutation"].collect()}
    assert null[1].q < 0.05 and null[1].observed > 0.3 and null[4].observed < 0


def test_command_of_sites(spark, tmp_path):
    from tagtally import enrich

    rng = np.random.default_rng(13)
    for rep in range(5):
        for suffix, raised in (("p", 0.35), ("i", 0.08)):
            lines = []
            for pos in range(1, 41):
                p = raised if pos <= 8 else 0.08
                wrong = int(rng.binomial(300, p))
                lines.append(f"t1\t{pos}\t{'ACGT'[pos % 4]}\t300," + ",".join(str(300 - wrong if b == "ACGT"[pos % 4] else (wrong if b == "ACGT"[(pos + 1) % 4] else 0)) for b in "ACGT") + ",0,0,0,0,0")
            (tmp_path / f"{rep}{suffix}.pileup.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "meta.csv").write_text("sample_name,group_name,replicates,plot_name\n" + "".join(f"{i},G1,{i},G\n" for i in range(5)))
    (tmp_path / "t.fa").write_text(">t1 x\n" + "".join("ACGT"[i % 4] for i in range(1, 61)) + "\n")
    enrich.main(["sites", "--pileups", str(tmp_path / "*.pileup.txt"), "--metadata", str(tmp_path / "meta.csv"), "--out", str(tmp_path / "o"), "--fasta", str(tmp_path / "t.fa")])
    got = spark.read.parquet(str(tmp_path / "o" / "sites"))
    hits = {int(r.site.split(":")[1]) for r in got.where("hit").collect()}
    assert got.count() == 40 and hits >= set(range(1, 9)) and len(hits) <= 11
    assert spark.read.parquet(str(tmp_path / "o" / "motif_sites")).where("sequence_context is not null").count() == 40
    assert spark.read.parquet(str(tmp_path / "o" / "motif_log_odds")).count() == 7


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_pileup_by_tiles_is_that_of_single_bases(monkeypatch, depth):
    import random
    import re
    from collections import Counter, defaultdict

    import pyarrow as pa

    from tagtally.operators import variants as V

    monkeypatch.setattr(V, "TILE", 16)
    rng, reads, seen = random.Random(3), [], defaultdict(list)
    for i in range(400):
        cigar = rng.choice(["12M", "2S10M", "5M20N7M", "3M2D4M1I4M", "4M40D2M", "2I10M", "6=1X5M"])
        pos = rng.choice([1, 16, 17, rng.randint(1, 200), 33])
        reads.append((rng.choice(["a", "b", None]), pos, cigar, "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([12, 12, 5]))), rng.choice(["*", "IIIIII!!HHHH", "III", ""]), i // 2 if i % 50 == 1 else i + 1000))
    for name, pos, cigar, seq, qual, ord_ in reads:
        at, i = pos, 0
        for n, o in ((int(n), o) for n, o in re.findall(r"(\d+)([MIDNS=X])", cigar)):
            for k in range(n if o in "M=XDN" else 0):
                if o in "DN":
                    seen[name, at + k].append((ord_, "Gap" if o == "D" else "Skip"))
                elif i + k < len(seq) and (qual in ("", "*") or (i + k < len(qual) and ord(qual[i + k]) - 33 >= 10)):
                    seen[name, at + k].append((ord_, seq[i + k].upper()))
            if o in "ID":
                seen[name, at - (o == "I")].append((ord_, "Insert" if o == "I" else "Delete"))
            at += n if o in "M=XDN" else 0
            i += n if o in "M=XIS" else 0
    want = {}
    for place, events in seen.items():
        kept = sorted({o for o, _ in events})[: depth or None]
        counts = Counter(what for o, what in events if o in kept)
        want[place] = (sum(counts[c] for c in ("A", "C", "G", "T", "N", "Gap")), *[counts[c] for c in V.PACKED[1:]])
    rows = []
    for r in reads:
        length = sum(int(n) for n in re.findall(r"(\d+)[MDN=X]", r[2]))
        rows += [(*r, t) for t in range((r[1] - 1) // 16, (r[1] + max(length - 1, 0)) // 16 + 1)]
    rows.sort(key=lambda r: (str(r[0]), r[6], r[5]))
    names = ["rname", "pos", "cigar", "seq", "qual", "ord", "tile"]
    for size in (1, 7, 100, 10_000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + size]], pa.schema(list(zip(names, [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()])))) for k in range(0, len(rows), size)]
        got = [r for b in V._tile_counts(batches, 10, depth) for r in b.to_pylist()]
        assert len(got) == len(want)
        assert {(r["chr"], r["pos"]): tuple(r[c] for c in V.PACKED) for r in got} == want


def test_equal_counts_are_fitted_once(spark, monkeypatch):
    samples = [(f"{r}{c[1]}", r, c) for r in range(4) for c in ("IP", "Input")]
    rng = np.random.default_rng(2)
    own = [rng.poisson(6 + k, len(samples)).tolist() for k in range(12)]
    rows = [(copy * 100 + k, s, r, c, int(n)) for copy in range(5) for k, counts in enumerate(own) for (s, r, c), n in zip(samples, counts) if n]
    counts = spark.createDataFrame(rows, "feature long, sample string, replicate int, condition string, count long")
    factors = spark.createDataFrame([(s, 1.0 + i / 10) for i, (s, _, _) in enumerate(samples)], "sample string, size_factor double")
    fits = spark.sparkContext.accumulator(0)
    rough = S._Design.rough

    def counted(self, y):
        fits.add(len(y))
        return rough(self, y)

    monkeypatch.setattr(S._Design, "rough", counted)
    got = {r["feature"]: tuple(r)[1:] for r in S.nb_wald(counts, factors).collect()}
    assert len(got) == 60 and all(got[100 + k] == got[k] for k in range(12))
    y, d = np.array(own, float), None
    d = S._Design(counts.select("sample", "replicate", "condition").distinct().join(factors, "sample").toPandas(), "IP", "Input")
    order = [[s for s, _, _ in samples].index(s) for s in d.at]
    mean, alpha = rough(d, y[:, order])
    final, beta, cov, _ = d.fitted(y[:, order], mean, alpha, S._dispersion_trend(np.repeat(mean, 5), np.repeat(alpha, 5), d.x.shape[0] - d.x.shape[1]))
    assert np.allclose([got[k][0] for k in range(12)], mean) and np.allclose([got[k][2] for k in range(12)], beta[:, -1] / math.log(2), atol=1e-6)
    assert fits.value in (0, 12)  # 0 where workers have a copy of the module of their own


def test_filter_threshold_sorts_once(monkeypatch):
    rng = np.random.default_rng(1)
    mean = rng.gamma(0.5, 20, 20_000)
    p = np.where(rng.random(len(mean)) < 0.2, rng.random(len(mean)) * 1e-4 * (mean > 5), rng.random(len(mean)))
    p[::7] = np.nan
    sorts, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda v, *a: sorts.append(len(v)) or sort(v, *a))
    assert S.filter_threshold(mean, p) >= 0 and not any(n > 1000 for n in sorts)  # it sorted at each of 50 cuts


def test_rounding_is_no_variance(spark):
    """Sites whose pairs agree have a variance of 0 in every order of the sums; small variances stay."""
    from tagtally.operators import variants as V

    rng = np.random.default_rng(4)
    rows = [(site, d if site else d + 1e-4 * i, float(w)) for site, d in enumerate(rng.normal(0, 2, 200).tolist()) for i, w in enumerate(rng.uniform(0.1, 3, 5))]
    for some in (rows, rows[::-1]):
        got = {r.site: r.s2 for r in V.weighted_fit(spark.createDataFrame(some, "site int, delta double, w double")).collect()}
        assert len(got) == 200 and 1e-9 < got.pop(0) < 1e-6 and set(got.values()) == {0.0}
