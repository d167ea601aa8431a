"""Queries of sets, sequences, ordination and classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagtally.functions.strings import center_kmer
from tagtally.operators import ordination as O
from tagtally.operators import sequences as Q
from tagtally.operators import sets as H
from tagtally.operators import statistics as S
from tagtally.plans import statements as X
from tagtally.plans.registry import bases, letters, query

NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
IN = ", ".join(f"'{n}'" for n in NAMES)


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# ---------------------------------------------------------------- sets


@query("set_union", "SELECT DISTINCT item FROM {sets}")
def set_union(t):
    return H.union(t.sets)


@query("set_intersect", f"SELECT item FROM {{sets}} WHERE set_name IN ({IN}) GROUP BY 1 HAVING count(*) = 3")
def set_intersect(t):
    return H.intersection(t.sets, NAMES)


@query("set_except", "SELECT item FROM {sets} WHERE set_name = '1-URGENT' EXCEPT SELECT item FROM sets WHERE set_name = '2-HIGH'")
def set_except(t):
    return H.difference(t.sets, "1-URGENT", "2-HIGH")


@query("set_multiplicity", "SELECT item, count(*) AS n_sets FROM {sets} GROUP BY 1")
def set_multiplicity(t):
    return H.multiplicity(t.sets)


@query("set_categories", f"SELECT item, string_agg(set_name, '&' ORDER BY set_name) AS category FROM {{sets}} WHERE set_name IN ({IN}) GROUP BY 1")
def set_categories(t):
    return H.categories(t.sets, NAMES)


@query("set_category_counts", f"SELECT category, count(*) AS n FROM (SELECT item, string_agg(set_name, '&' ORDER BY set_name) AS category FROM {{sets}} WHERE set_name IN ({IN}) GROUP BY 1) GROUP BY 1")
def set_category_counts(t):
    return H.categories(t.sets, NAMES).groupBy("category").agg(F.count("*").alias("n"))


@query("set_membership_wide", "SELECT item, " + ", ".join(f"count(*) FILTER (set_name = '{n}') > 0 AS s{n[0]}" for n in NAMES) + " FROM {sets} GROUP BY 1")
def set_membership_wide(t):
    return H.membership(t.sets, NAMES).select("item", *[F.col(f"`{n}`").alias(f"s{n[0]}") for n in NAMES])


@query("set_align", "SELECT count(*) FILTER (o.item IS NOT NULL) AS kept, count(*) FILTER (o.item IS NULL) AS dropped FROM (SELECT c_custkey AS item FROM customer) c LEFT JOIN (SELECT DISTINCT item FROM {sets}) o ON o.item = c.item")
def set_align(t):
    kept, dropped = H.align(t.customer.select(F.col("c_custkey").alias("item")), t.sets)
    return kept.agg(F.count("*").alias("kept")).join(dropped.agg(F.count("*").alias("dropped")))


@query("set_union_all", "SELECT l_partkey AS item, 'line' AS source FROM lineitem UNION ALL SELECT p_partkey, 'part' FROM part")
def set_union_all(t):
    return t.lineitem.select(F.col("l_partkey").alias("item"), F.lit("line").alias("source")).unionByName(t.part.select(F.col("p_partkey").alias("item"), F.lit("part").alias("source")))


@query("hypergeom", X.HYPERGEOM)
def hypergeom(t):
    universe = t.customer.select(F.col("c_custkey").alias("item"))
    return H.over_representation(t.sets, "1-URGENT", "2-HIGH", universe).withColumn("p", r("p", 8))


@query("nway_intersection", X.nway(IN))
def nway_intersection(t):
    universe = t.customer.select(F.col("c_custkey").alias("item"))
    return H.exact_intersection(t.sets, NAMES, universe).select("observed", r("expected").alias("expected"), r("enrichment").alias("enrichment"), r("p", 8).alias("p"))


@query("nway_expected", f"WITH u AS (SELECT count(*)::DOUBLE AS n FROM customer), s AS (SELECT set_name, count(*)::DOUBLE AS k FROM {{sets}} WHERE set_name IN ({IN}) AND item IN (SELECT c_custkey FROM customer) GROUP BY 1) SELECT round(product(k / (SELECT n FROM u)) * (SELECT n FROM u), 6) AS expected FROM s")
def nway_expected(t):
    universe = t.customer.select(F.col("c_custkey").alias("item"))
    return H.expected_intersection(t.sets, NAMES, universe).select(r("expected").alias("expected"))


@query("overlap_count_mean", "SELECT o_custkey AS family, count(DISTINCT o_orderpriority) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def overlap_count_mean(t):
    pairs = t.orders.select("o_custkey", "o_orderpriority").distinct().groupBy(F.col("o_custkey").alias("family")).agg(F.count("*").alias("n"))
    means = t.orders.groupBy(F.col("o_custkey").alias("family")).agg(r(F.avg("o_totalprice")).alias("mean"))
    return pairs.join(means, "family", "left")


@query("display_lookup", "SELECT n_nationkey AS key, coalesce(r_name, concat(upper(substr(CAST(n_nationkey AS VARCHAR), 1, 1)), substr(CAST(n_nationkey AS VARCHAR), 2))) AS display FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def display_lookup(t):
    first = t.region.select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("display"), F.lit(0).alias("ord"))
    second = t.region.select(F.col("r_regionkey").cast("string").alias("key"), F.lower("r_name").alias("display"), F.lit(0).alias("ord"))
    keys = t.nation.select(F.col("n_nationkey").cast("string").alias("key"))
    return H.display_names([first, second], keys).select(F.col("key").cast("int").alias("key"), "display")


# ---------------------------------------------------------------- sequences

KMER = "km AS (SELECT id, source, substr(seq, CAST(floor((length(seq) - 7) / 2.0) AS INTEGER) + 1, 7) AS kmer FROM {seqs} WHERE length(seq) >= 7), ok AS (SELECT * FROM km WHERE regexp_matches(kmer, '^[ACGT]{7}$'))"
BASE = KMER + ", b AS (SELECT id, source, k AS k_pos, substr(kmer, k, 1) AS base FROM ok, (SELECT unnest(range(1, 8))::INTEGER AS k))"


def _kmers(t):
    # Only the middle letters become bases, not the whole text's.
    middle = F.transform(F.array(letters("text")), lambda x: bases(center_kmer(x, 7)))[0]
    return Q.kmers(t.documents.select(F.col("doc_id").alias("rowid"), "source", middle.alias("seq")), 7).select("rowid", "source", "kmer")


@query("kmer_center", "WITH " + KMER + " SELECT id, kmer FROM ok")
def kmer_center(t):
    return _kmers(t).select(F.col("rowid").alias("id"), "kmer")


@query("gc_by_position", "WITH " + BASE + " SELECT k_pos, round(avg(CASE WHEN base IN ('G', 'C') THEN 1.0 ELSE 0.0 END), 6) AS gc, count(*) AS n FROM b GROUP BY 1")
def gc_by_position(t):
    return Q.gc_by_position(_kmers(t)).select("k_pos", r("gc").alias("gc"), "n")


LOG = ", ".join(f"round(log2((avg((base = '{x}')::INT) FILTER (hit) + 1e-6) / (avg((base = '{x}')::INT) FILTER (NOT hit) + 1e-6)), 6) AS {x.lower()}" for x in "ACGT")


@query("pwm_logodds", "WITH " + BASE + f" SELECT k_pos, {LOG} FROM (SELECT *, source < 'src5' AS hit FROM b) GROUP BY 1")
def pwm_logodds(t):
    k = _kmers(t)
    return Q.log_odds(k.where("source < 'src5'"), k.where("not (source < 'src5')")).select("k_pos", *[r(x).alias(x.lower()) for x in "ACGT"])


@query("seq_context", """SELECT id, pos, substr(concat('NNNNNNN', seq, 'NNNNNNN'), pos, 15) AS context, substr(seq, pos, 1) AS ref FROM (SELECT id, seq, CAST(unnest([1, 3, length(seq) // 2, length(seq), length(seq) + 1]) AS INTEGER) AS pos FROM {seqs}) WHERE pos BETWEEN 1 AND length(seq)""")
def seq_context(t):
    n = F.length("seq")
    sites = t.seqs.select("id", F.explode(F.array(F.lit(1), F.lit(3), F.floor(n / 2).cast("int"), n, n + 1)).alias("pos"))
    c = Q.with_context(sites, t.seqs, key="id")
    return c.where("sequence_context is not null").select("id", "pos", F.col("sequence_context").alias("context"), F.col("ref_base").alias("ref"))


@query("gc_posmatched_weighted", "WITH " + BASE + ", h AS (SELECT source, count(*) AS h FROM ok WHERE id % 3 = 0 GROUP BY 1), c AS (SELECT source, k_pos, avg(CASE WHEN base IN ('G', 'C') THEN 1.0 ELSE 0.0 END) AS gc FROM b WHERE id % 3 <> 0 GROUP BY 1, 2) SELECT k_pos, round(sum(h * gc) / sum(h), 6) AS gc FROM c JOIN h USING (source) GROUP BY 1")
def gc_posmatched_weighted(t):
    k = _kmers(t)
    return Q.matched_gc(k.where("rowid % 3 = 0"), k.where("rowid % 3 <> 0"), "source").select("k_pos", r("gc").alias("gc"))


@query("bootstrap_ci")
def bootstrap_ci(t):
    k = _kmers(t)
    return Q.bootstrap_gc(k.where("rowid % 3 = 0"), k.where("rowid % 3 <> 0"), "source").select("k_pos", r("delta_gc").alias("delta_gc"), r("lo").alias("lo"), r("hi").alias("hi"))


@query("permutation_null")
def permutation_null(t):
    return Q.permutation_gc(_kmers(t).withColumn("hit", F.col("rowid") % 3 == 0), "source").select("k_pos", r("observed").alias("observed"), r("p").alias("p"), r("q").alias("q"))


# ---------------------------------------------------------------- ordination

LONG = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INTEGER AS feature FROM embeddings)"


def _long(t):
    rows = t.embeddings.select("vec_id", F.col("label").alias("batch"), F.posexplode("embedding").alias("feature", "value"))
    return rows.select(F.col("vec_id").alias("group"), "batch", "feature", F.col("value").cast("double").alias("value"))


@query("min_presence", "WITH " + LONG + " SELECT feature, count(DISTINCT vec_id) AS n FROM e WHERE v > 0.1 GROUP BY 1 HAVING count(DISTINCT vec_id) >= 90")
def min_presence(t):
    rows = _long(t).where("value > 0.1")
    return O.min_presence(rows, 90).groupBy("feature").agg(F.countDistinct("group").alias("n"))


@query("batch_residual", "WITH " + LONG + " SELECT vec_id, feature, round(v - avg(v) OVER (PARTITION BY feature, label) + avg(v) OVER (PARTITION BY feature), 6) AS v FROM e")
def batch_residual(t):
    return O.batch_residual(_long(t)).select(F.col("group").alias("vec_id"), "feature", r("value").alias("v"))


@query("feature_zscore", "WITH " + LONG + " SELECT vec_id, feature, round((v - avg(v) OVER (PARTITION BY feature)) / stddev_samp(v) OVER (PARTITION BY feature), 6) AS v FROM e")
def feature_zscore(t):
    return O.zscore(_long(t)).select(F.col("group").alias("vec_id"), "feature", r("value").alias("v"))


@query("cosine_pairs", "SELECT a.grp AS g1, b.grp AS g2, round(1 - sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) AS d FROM {vecs} a JOIN vecs b ON a.feature = b.feature AND a.grp <= b.grp GROUP BY 1, 2")
def cosine_pairs(t):
    return O.cosine_distances(t.vecs).select("g1", "g2", r("d").alias("d"))


def _layout(t):
    return O.distance_matrix(O.cosine_distances(t.vecs))


@query("mds", X.MDS)
def mds(t):
    names, d = _layout(t)
    x = O.mds(names, d, 3)
    return t.spark.createDataFrame([(str(n), *[float(abs(v)) for v in row]) for n, row in zip(names, np.round(x, 5))], "grp string, a1 double, a2 double, a3 double")


@query("mds_axes", X.MDS_AXES)
def mds_axes(t):
    names, d = _layout(t)
    return t.spark.createDataFrame([(O.axes_kept(O.mds(names, d, 9)),)], "k int")


@query("pca", X.PCA)
def pca(t):
    names, x, share = O.pca(t.vecs, 2)
    return t.spark.createDataFrame([(str(n), float(abs(a)), float(abs(b)), round(float(share[0]), 6)) for n, (a, b) in zip(names, np.round(x, 5))], "grp string, pc1 double, pc2 double, share1 double")


@query("cluster_order")
def cluster_order(t):
    names, d = _layout(t)
    return t.spark.createDataFrame([(i, str(n)) for i, n in enumerate(O.cluster_order(names, d))], "leaf int, grp string")


@query("hull")
def hull(t):
    points = t.embeddings.select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return O.hulls(points)


@query("umap")
def umap(t):
    names, d = _layout(t)
    y = O.neighbour_embedding(names, d)
    return t.spark.createDataFrame([(str(n), float(a), float(b)) for n, (a, b) in zip(names, y)], "grp string, x double, y double")


def _classes(t):
    names, d = _layout(t)
    return names, d, np.array([1 if int(n) % 2 else 0 for n in names])


@query("loocv_svm")
def loocv_svm(t):
    names, d, y = _classes(t)
    scores = O.loocv_svm(t.spark, names, O.mds(names, d, 3), y)
    return S.auc(scores, "label", "score").select(r("auc").alias("auc"), "n_pos", "n_neg")


@query("permanova_f", X.PERMANOVA)
def permanova_f(t):
    names, d, y = _classes(t)
    return O.permanova(t.spark, d, y.tolist(), permutations=0).select(r("f").alias("f"), r("r2").alias("r2"))


@query("permanova")
def permanova(t):
    names, d, y = _classes(t)
    return O.permanova(t.spark, d, y.tolist())


@query("roc_auc", """WITH s AS (SELECT n_chars::DOUBLE AS x, quality AS y FROM labels JOIN documents USING (doc_id)), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM s)
    SELECT round((sum(rk * y)::DOUBLE - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auc, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg FROM k""")
def roc_auc(t):
    scores = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("x"))
    return S.auc(scores, "y", "x").select(r("auc").alias("auc"), "n_pos", "n_neg")


@query("roc_curve", """WITH s AS (SELECT n_chars AS x, quality AS y FROM labels JOIN documents USING (doc_id)), k AS (SELECT x, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1)
    SELECT x, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr, round(sum(n) OVER w / sum(n) OVER ()::DOUBLE, 6) AS fpr FROM k WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(t):
    scores = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("x"))
    return S.roc(scores, "y", "x").select("x", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query("most_variable", "WITH " + LONG + " SELECT feature, round(var_samp(v), 6) AS variance FROM e GROUP BY 1 ORDER BY var_samp(v) DESC, feature LIMIT 20")
def most_variable(t):
    return O.most_variable(_long(t), 20).select("feature", r("variance").alias("variance"))


@query("histogram", "SELECT floor(l_extendedprice / 5000) * 5000 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(t):
    return O.histogram(t.lineitem, "l_extendedprice", 5000.0).select(F.col("bin").cast("double").alias("bin"), "n")


@query("boxplot_stats", """WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS m, quantile_cont(l_extendedprice::DOUBLE, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT f, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS low,
    max(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS high, count(l_extendedprice) AS n FROM lineitem JOIN q ON f = l_returnflag GROUP BY 1""")
def boxplot_stats(t):
    b = O.box_stats(t.lineitem.select(F.col("l_returnflag").alias("f"), "l_extendedprice"), ["f"], "l_extendedprice")
    return b.select("f", r("q1", 4).alias("q1"), r("median", 4).alias("median"), r("q3", 4).alias("q3"), "low", "high", "n")


@query("winsorize", "WITH q AS (SELECT quantile_cont(c_acctbal::DOUBLE, 0.05) AS lo, quantile_cont(c_acctbal::DOUBLE, 0.95) AS hi FROM customer) SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 4) AS x FROM customer, q")
def winsorize(t):
    return O.winsorised(t.customer.select("c_custkey", F.col("c_acctbal").alias("x")), "x", 0.05).select("c_custkey", r("x", 4).alias("x"))


@query("cap_floor", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS x, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l, round_even(c_acctbal, 0) AS whole FROM customer")
def cap_floor(t):
    from tagtally.operators.counts import guarded, rounded

    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", guarded(F.least, guarded(F.greatest, x, F.lit(0.0)), F.lit(5000.0)).alias("x"), F.when(x > 0, r(F.log10(x))).alias("l"), rounded(x).alias("whole"))
