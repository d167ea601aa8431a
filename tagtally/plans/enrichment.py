"""Queries of count matrices, contrasts, roll-ups, variants and titrations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagtally.operators import counts as C
from tagtally.operators import statistics as S
from tagtally.operators import variants as V
from tagtally.plans import statements as X
from tagtally.plans.registry import query

SAMPLES = [f"{y}{c}" for y in range(1995, 2002) for c in "iph"]


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# ---------------------------------------------------------------- matrices and factors


@query("count_matrix_wide", "SELECT feature, " + ", ".join(f"sum(CASE WHEN sample = '{s}' THEN count ELSE 0 END)::BIGINT AS c_{s}" for s in SAMPLES) + " FROM {cnt} GROUP BY 1")
def count_matrix_wide(t):
    wide = C.matrix(t.cnt, SAMPLES)
    return wide.select("feature", *[F.col(f"`{s}`").alias(f"c_{s}") for s in SAMPLES])


@query("count_matrix_long", "SELECT f.feature, s.sample, coalesce(c.count, 0)::BIGINT AS count FROM (SELECT DISTINCT feature FROM {cnt}) f CROSS JOIN (SELECT unnest([" + ", ".join(f"'{s}'" for s in SAMPLES) + "]) AS sample) s LEFT JOIN cnt c ON c.feature = f.feature AND c.sample = s.sample")
def count_matrix_long(t):
    return C.long_form(C.matrix(t.cnt, SAMPLES), "feature", [f"{s}" for s in SAMPLES])


FACTORS = "f AS (SELECT sample, min(condition) AS condition, min(replicate) AS replicate, sum(CASE WHEN feature % 10 = 0 THEN count ELSE 0 END)::DOUBLE AS total FROM {cnt} GROUP BY 1), sf AS (SELECT sample, condition, replicate, total / avg(total) OVER () AS size_factor FROM f)"


def _factors(t):
    return C.size_factors(t.cnt, F.col("feature") % 10 == 0)


@query("size_factors", "WITH " + FACTORS + " SELECT sample, round(size_factor, 6) AS size_factor FROM sf")
def size_factors(t):
    return _factors(t).select("sample", r("size_factor").alias("size_factor"))


@query("de_row_filter", "SELECT feature FROM {cnt} GROUP BY 1 HAVING count(*) FILTER (condition = 'Input') >= 3 AND count(*) FILTER (condition = 'IP') >= 3")
def de_row_filter(t):
    return C.expressed(t.cnt, 3)


@query("group_complete", "WITH d AS (SELECT DISTINCT p_brand AS group_name, concat(y, c) AS sample FROM part, (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest(['i', 'p']) AS c)), have AS (SELECT DISTINCT p_brand AS b, sample FROM {cnt} JOIN part ON feature = p_partkey WHERE count > 1) SELECT group_name FROM d LEFT JOIN have ON b = group_name AND have.sample = d.sample GROUP BY 1 HAVING bool_and(have.sample IS NOT NULL)")
def group_complete(t):
    rows = t.cnt.where("count > 1").join(t.part, F.col("feature") == F.col("p_partkey")).select(F.concat_ws("|", "p_brand", "sample").alias("sample"))
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    declared = t.part.select(F.col("p_brand").alias("group_name")).distinct().withColumn("y", years).withColumn("c", F.explode(F.array(F.lit("i"), F.lit("p"))))
    declared = declared.select("group_name", F.concat_ws("|", "group_name", F.concat(F.col("y").cast("string"), "c")).alias("sample"))
    return C.complete_groups(declared, rows)


@query("log_norm_expr", "WITH " + FACTORS + " SELECT feature, c.sample, round(log2(count / size_factor + 1), 6) AS value FROM cnt c JOIN sf USING (sample)")
def log_norm_expr(t):
    return C.log_normalised(t.cnt, _factors(t)).select("feature", "sample", r("value").alias("value"))


@query("vst_closed_form", "WITH " + FACTORS + " SELECT feature, c.sample, round((2 * asinh(sqrt(0.2 * count / size_factor)) - ln(0.2::DOUBLE) - ln(4::DOUBLE)) / ln(2::DOUBLE), 6) AS value FROM cnt c JOIN sf USING (sample)")
def vst_closed_form(t):
    return S.variance_stabilised(t.cnt, _factors(t), 0.2).select("feature", "sample", r("value").alias("value"))


OFFSETS = "WITH " + FACTORS + ", e AS (SELECT replicate, max(CASE WHEN condition = 'Control' THEN size_factor END) AS c, max(CASE WHEN condition = 'IP' THEN size_factor END) AS p FROM sf GROUP BY 1 HAVING count(*) FILTER (condition = 'Control') = 1 AND count(*) FILTER (condition = 'IP') = 1) "


def _conditions(t):
    f = _factors(t)
    c = F.when(F.col("sample").endswith("i"), "Input").when(F.col("sample").endswith("p"), "IP").otherwise("Control")
    return f.select(F.substring("sample", 1, 4).cast("int").alias("replicate"), c.alias("condition"), "size_factor")


for _how in ("median", "mean"):
    _f = "median" if _how == "median" else "avg"
    query(f"replicate_offset_{_how}", OFFSETS + f"SELECT round({_f}(-log2(c / p)), 6) AS off, count(*) AS replicates FROM e")(lambda t, how=_how: C.replicate_offsets(_conditions(t), how).select(r("offset").alias("off"), "replicates"))

# ---------------------------------------------------------------- contrasts

CONTRASTS = "v AS (SELECT feature, condition, log2(count + 1) AS value FROM {cnt}), s AS (SELECT feature, " + ", ".join(f"avg(value) FILTER (condition = '{c}') AS m{k}, var_samp(value) FILTER (condition = '{c}') AS v{k}, count(*) FILTER (condition = '{c}') AS n{k}" for c, k in (("IP", "p"), ("Input", "i"), ("Control", "c"))) + """ FROM v GROUP BY 1),
    pi AS (SELECT feature, mp - mi AS lfc_pi, sqrt(vp / np + vi / ni) AS se_pi FROM s WHERE np > 1 AND ni > 1), ci AS (SELECT feature, mc - mi AS lfc_ci, sqrt(vc / nc + vi / ni) AS se_ci FROM s WHERE nc > 1 AND ni > 1),
    w AS (SELECT coalesce(pi.feature, ci.feature) AS feature, lfc_pi, se_pi, lfc_ci, se_ci, lfc_pi - lfc_ci + 0.1 AS delta, sqrt(se_pi * se_pi + se_ci * se_ci) AS se_delta FROM pi FULL JOIN ci ON pi.feature = ci.feature), z AS (SELECT *, CASE WHEN se_delta <> 0 THEN delta / se_delta END AS z FROM w)"""


def _wald(t):
    rows = t.cnt.withColumn("value", F.log2(F.col("count") + 1))
    return C.delta_wald(C.contrast(rows, "IP", "Input", "pI"), C.contrast(rows, "Control", "Input", "cI"), 0.1)


@query("delta_wald_z", "WITH " + CONTRASTS + " SELECT feature, round(lfc_pi, 6) AS lfc_pi, round(lfc_ci, 6) AS lfc_ci, round(delta, 6) AS delta, round(se_delta, 6) AS se_delta, round(z, 4) AS z FROM z")
def delta_wald_z(t):
    w = _wald(t)
    return w.select("feature", r("lfc_pI").alias("lfc_pi"), r("lfc_cI").alias("lfc_ci"), r("delta").alias("delta"), r("se_delta").alias("se_delta"), r("z_delta", 4).alias("z"))


@query("null_sd", "WITH " + CONTRASTS + ", k AS (SELECT count(*) FILTER (abs(z) < 0.5) AS n1, stddev_samp(CASE WHEN abs(z) < 0.5 THEN z END) AS s1, count(*) FILTER (abs(z) < 1) AS n2, stddev_samp(CASE WHEN abs(z) < 1 THEN z END) AS s2 FROM z) SELECT round(CASE WHEN n1 >= 10 THEN s1 WHEN n2 >= 10 THEN s2 ELSE 0.3 END, 5) AS sd, n1 AS n_half, n2 AS n_one FROM k")
def null_sd(t):
    return C.null_sd(_wald(t)).select(r("sd", 5).alias("sd"), "n_half", "n_one")


NULL_SD = "sdk AS (SELECT count(*) FILTER (abs(z) < 0.5) AS n1, stddev_samp(CASE WHEN abs(z) < 0.5 THEN z END) AS s1, count(*) FILTER (abs(z) < 1) AS n2, stddev_samp(CASE WHEN abs(z) < 1 THEN z END) AS s2 FROM z), sd AS (SELECT CASE WHEN n1 >= 10 THEN s1 WHEN n2 >= 10 THEN s2 ELSE 0.3 END AS sd FROM sdk)"


@query("wald_pvalues", "WITH " + CONTRASTS + ", " + NULL_SD + f""", p AS (SELECT feature, z, {X.normal_sf("zz")} AS p FROM (SELECT feature, z, z / sd AS zz FROM z, sd)), k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk, count(*) OVER () AS n FROM p WHERE p IS NOT NULL),
    q AS (SELECT feature, least(1.0, min(p * n / rk) OVER (ORDER BY p DESC, feature ROWS UNBOUNDED PRECEDING)) AS q FROM k) SELECT p.feature, round(z, 4) AS z, round(p, 6) AS p, round(q, 6) AS padj FROM p LEFT JOIN q USING (feature)""")
def wald_pvalues(t):
    rows = _wald(t)
    sd = C.null_sd(rows).first()["sd"]
    return C.with_wald_p(rows, float(sd)).select("feature", r("z_delta", 4).alias("z"), r("pval_delta").alias("p"), r("padj_delta").alias("padj"))


PVALUES = "p AS (SELECT p_partkey AS feature, CASE WHEN p_size <> 13 THEN round(p_retailprice / (SELECT max(p_retailprice) + 1 FROM part), 4) END AS p, p_brand AS brand FROM part)"


def _pvalues(t):
    top = t.part.agg(F.max("p_retailprice")).first()[0] + 1
    return t.part.select(F.col("p_partkey").alias("feature"), F.when(F.col("p_size") != 13, F.round(F.col("p_retailprice") / top, 4)).alias("p"), F.col("p_brand").alias("brand"))


def _bh(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"k AS (SELECT *, rank() OVER ({part} ORDER BY p) + count(*) OVER ({('PARTITION BY ' + by + ', p') if by else 'PARTITION BY p'}) - 1 AS rk, count(*) OVER ({part}) AS n FROM p WHERE p IS NOT NULL), adj AS (SELECT feature, least(1.0, min(p * n / rk) OVER ({part} ORDER BY p DESC, feature ROWS UNBOUNDED PRECEDING)) AS q0, p, brand FROM k)"


@query("bh_adjust", "WITH " + PVALUES + ", " + _bh("") + ", q AS (SELECT p, min(q0) AS q FROM adj GROUP BY 1) SELECT p.feature, p.p, round(q.q, 6) AS padj FROM p LEFT JOIN q ON p.p = q.p")
def bh_adjust(t):
    return C.benjamini_hochberg(_pvalues(t), "p", "q").select("feature", "p", r("q").alias("padj"))


@query("bh_adjust_grouped", "WITH " + PVALUES + ", " + _bh("brand") + ", q AS (SELECT brand, p, min(q0) AS q FROM adj GROUP BY 1, 2) SELECT p.feature, p.brand, round(q.q, 6) AS padj FROM p LEFT JOIN q ON p.p = q.p AND p.brand = q.brand")
def bh_adjust_grouped(t):
    return C.benjamini_hochberg(_pvalues(t), "p", "q", "brand").select("feature", "brand", r("q").alias("padj"))


@query("tp_flags", "WITH " + CONTRASTS + ", " + PVALUES + """ SELECT z.feature, coalesce(lfc_pi > 0.1, false) AS directionality, coalesce(lfc_pi > 0.1 AND p < 0.6, false) AS vs_input, coalesce(z > 0 AND p < 0.4, false) AS vs_control,
    coalesce(lfc_pi > 0.1 AND p < 0.6, false) AND coalesce(z > 0 AND p < 0.4, false) AS tp FROM z LEFT JOIN p USING (feature)""")
def tp_flags(t):
    rows = _wald(t).join(_pvalues(t).select("feature", F.col("p").alias("padj_pI")), "feature", "left").withColumn("padj_delta", F.col("padj_pI") * 1.5)
    flags = C.call_flags(rows, least=0.1, alpha=0.6)
    return flags.select("feature", "directionality", "vs_input", "vs_control", "tp")


# ---------------------------------------------------------------- annotation and roll-ups


@query("annotate_left", "SELECT feature, sample, count, p_type AS biotype, p_brand AS family FROM {cnt} LEFT JOIN part ON p_partkey = feature")
def annotate_left(t):
    ann = t.part.select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("biotype"), F.col("p_brand").alias("family"))
    return C.annotate(t.cnt, ann, "feature").select("feature", "sample", "count", "biotype", "family")


@query("annotate_complete", "SELECT p_partkey, p_type FROM part WHERE p_size > 48 AND p_type <> 'STANDARD' UNION ALL SELECT NULL, p_type FROM (SELECT DISTINCT p_type FROM part) WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 48 AND p_type <> 'STANDARD')")
def annotate_complete(t):
    rows = t.part.where("p_size > 48 and p_type <> 'STANDARD'").select("p_partkey", "p_type")
    return C.with_missing_levels(rows, t.part, "p_type")


FAMILY = "WITH " + PVALUES + ", x AS (SELECT p_brand AS family, ln(p_retailprice) AS l, CASE WHEN p = 0 THEN 300 ELSE -log10(p) END AS lp, CASE WHEN p_size > 5 THEN p_size - 25.0 END AS z, p_size * 1.0 AS w FROM part JOIN p ON feature = p_partkey)"


def _family(t):
    p = _pvalues(t).select("feature", "p")
    return t.part.join(p, F.col("p_partkey") == F.col("feature")).select(F.col("p_brand").alias("family"), F.ln("p_retailprice").alias("l"), "p", F.when(F.col("p_size") > 5, F.col("p_size") - 25.0).alias("z"), (F.col("p_size") * 1.0).alias("w"))


@query("family_rollup", FAMILY + " SELECT family, round(sum(l * w) / sum(CASE WHEN l IS NOT NULL THEN w END), 6) AS avg_lfc, round(sum(lp * w) / sum(CASE WHEN lp IS NOT NULL THEN w END), 6) AS avg_lp, count(*) AS n FROM x GROUP BY 1")
def family_rollup(t):
    return C.family_rollup(_family(t), "l", "p", "z", "w").select("family", r("avg_log2FC").alias("avg_lfc"), r("avg_log10padj").alias("avg_lp"), "n")


@query("stouffer", FAMILY + " SELECT family, round(sum(z::DOUBLE * w::DOUBLE) / sqrt(sum(w::DOUBLE * w::DOUBLE)), 6) AS z FROM x GROUP BY 1")
def stouffer(t):
    return _family(t).groupBy("family").agg(r(C.stouffer(F.col("z"), F.col("w"))).alias("z"))


@query("family_ranked", FAMILY + " SELECT family, round(sum(z::DOUBLE * w::DOUBLE) / sqrt(sum(w::DOUBLE * w::DOUBLE)), 6) AS z FROM x GROUP BY 1 ORDER BY z DESC NULLS LAST, family LIMIT 10")
def family_ranked(t):
    return C.top_rows(stouffer(t), 10, F.col("z").desc_nulls_last(), F.col("family"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


@query("biotype_pie", "WITH l AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in [*TYPES, "others"]) + "]) AS p_type), g AS (SELECT CASE WHEN p_type IN (" + ", ".join(f"'{x}'" for x in TYPES) + ") THEN p_type ELSE 'others' END AS p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(n) OVER (), 6) AS percent, 100.0 * coalesce(n, 0) / sum(n) OVER () >= 5 AS labelled FROM l LEFT JOIN g USING (p_type)")
def biotype_pie(t):
    return C.level_counts(t.part, TYPES, "p_type").select("p_type", "n", r("percent").alias("percent"), "labelled")


@query("family_biotypes", "SELECT DISTINCT f.family, p_type AS biotype FROM (SELECT DISTINCT p_brand AS family FROM part WHERE p_size > 25) f LEFT JOIN part ON p_brand = f.family")
def family_biotypes(t):
    fam = t.part.where("p_size > 25").select(F.col("p_brand").alias("family")).distinct()
    pairs = t.part.select(F.col("p_brand").alias("family"), F.col("p_type").alias("biotype")).distinct()
    return fam.join(pairs, "family", "left").dropDuplicates(["family", "biotype"])


@query("merge_features", "SELECT CASE WHEN feature IN (1, 2, 3) THEN 0 ELSE feature END AS feature, condition, sum(count)::BIGINT AS count FROM {cnt} GROUP BY 1, 2")
def merge_features(t):
    rows = t.cnt.groupBy("feature", "condition").agg(F.sum("count").alias("count"))
    return C.merge_features(rows, [1, 2, 3], 0)


# ---------------------------------------------------------------- variants


@query("pileup_project", """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'C' ELSE 'N' END AS ref, CAST(floor(l_quantity) AS INTEGER) AS a, l_linenumber AS c, CAST(floor(l_quantity) AS INTEGER) % 3 AS g, CAST(floor(l_quantity) AS INTEGER) % 5 AS u, CAST(floor(l_quantity) AS INTEGER) % 2 AS skip FROM lineitem),
    y AS (SELECT *, a + c + g + u + skip + 2 AS depth, CASE ref WHEN 'A' THEN a WHEN 'C' THEN c ELSE 0 END AS rf, CASE WHEN ref = 'A' THEN 0 ELSE a END + CASE WHEN ref = 'C' THEN 0 ELSE c END + g + u AS mm FROM x)
    SELECT l_orderkey, l_linenumber, ref, depth, skip AS sgid, rf, mm AS mismatches, mm + skip AS total_variant, greatest(depth - mm - skip, 0) AS nonvariant FROM y""")
def pileup_project(t):
    q = F.floor("l_quantity").cast("int")
    ref = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "C").otherwise("N")
    parts = [q + F.col("l_linenumber") + q % 3 + q % 5 + q % 2 + 2, q, F.col("l_linenumber"), q % 3, q % 5, F.lit(0), q % 2, F.lit(0), F.lit(0), F.lit(0)]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", ref.alias("ref_base"), F.concat_ws(",", *[p.cast("string") for p in parts]).alias("packed"))
    p = V.project(V.unpack(rows))
    return p.select("l_orderkey", "l_linenumber", F.col("ref_base").alias("ref"), "depth", F.col("SGID").alias("sgid"), F.col("REF").alias("rf"), "mismatches", "total_variant", "nonvariant")


def _sums(t):
    return V.site_sums(t.pile, "k", "n")


@query("pileup_sum", "SELECT site, pair, condition, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM {pile} GROUP BY 1, 2, 3")
def pileup_sum(t):
    return _sums(t).select("site", "pair", "condition", F.col("K").alias("k"), F.col("N").alias("n"))


PAIRS = "pr AS (SELECT site, pair, " + ", ".join(f"coalesce(sum({x}) FILTER (condition = '{c}'), 0)::BIGINT AS {x}_{s}" for c, s in (("IP", "p"), ("Input", "i")) for x in "kn") + " FROM {pile} GROUP BY 1, 2), ok AS (SELECT * FROM pr WHERE n_p >= 1 AND n_i >= 1)"
LOGITS = PAIRS + """, lg AS (SELECT site, pair, ln((k_p + 0.5) / (n_p - k_p + 0.5)) - ln((k_i + 0.5) / (n_i - k_i + 0.5)) AS delta,
    (greatest(n_p * ((k_p + 0.5) / (n_p + 1.0)) * (1 - (k_p + 0.5) / (n_p + 1.0)), 1e-6) + greatest(n_i * ((k_i + 0.5) / (n_i + 1.0)) * (1 - (k_i + 0.5) / (n_i + 1.0)), 1e-6)) / 2 AS w FROM ok)"""


def _logits(t):
    return V.paired_logits(V.paired(_sums(t), 1))


@query("paired_counts", "WITH " + PAIRS + " SELECT * FROM ok")
def paired_counts(t):
    p = V.paired(_sums(t), 1)
    return p.select("site", "pair", F.col("K_IP").alias("k_p"), F.col("N_IP").alias("n_p"), F.col("K_Input").alias("k_i"), F.col("N_Input").alias("n_i"))


@query("paired_elogit", "WITH " + LOGITS + " SELECT site, pair, round(delta, 6) AS delta, round(w, 6) AS w FROM lg")
def paired_elogit(t):
    return _logits(t).select("site", "pair", r("delta").alias("delta"), r("w").alias("w"))


@query("paired_wmean", "WITH " + LOGITS + " SELECT site, count(*) AS n, round(sum(w * delta) / sum(w), 5) AS beta, round(sum(delta) / count(*), 5) AS amean FROM lg GROUP BY 1 HAVING count(*) >= 4")
def paired_wmean(t):
    return V.weighted_fit(_logits(t)).select("site", "n", r("beta", 5).alias("beta"), r("amean", 5).alias("amean"))


@query("site_having", "SELECT site, count(DISTINCT pair) AS pairs FROM {pile} GROUP BY 1 HAVING count(DISTINCT pair) >= 6")
def site_having(t):
    return t.pile.groupBy("site").agg(F.countDistinct("pair").alias("pairs")).where("pairs >= 6")


@query("moderated_t")
def moderated_t(t):
    return V.moderated(V.weighted_fit(_logits(t), 3)).select("site", "n", r("beta").alias("beta"), r("t", 4).alias("t"), r("df", 4).alias("df"), r("p").alias("p"), r("padj").alias("padj"))


HITS = "WITH " + LOGITS + ", s AS (SELECT site, sum(w * delta) / sum(w) AS beta, count(*) AS n FROM lg GROUP BY 1), " + PVALUES + ", h AS (SELECT site, beta, p AS padj FROM s JOIN p ON feature = site)"


def _effects(t):
    one = _logits(t).groupBy("site").agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("beta"))
    return one.join(_pvalues(t).select(F.col("feature").alias("site"), F.col("p").alias("padj")), "site")


@query("hit_filter", HITS + " SELECT site, round(beta, 6) AS beta, padj FROM h WHERE padj IS NOT NULL AND beta > ln(1.25) AND padj < 0.95")
def hit_filter(t):
    import math

    return V.hits(_effects(t), "beta", "padj", math.log(1.25), 0.95).select("site", r("beta").alias("beta"), "padj")


@query("hit_topn", HITS + " SELECT site, padj FROM h WHERE padj IS NOT NULL ORDER BY padj, site LIMIT 20")
def hit_topn(t):
    return C.top_rows(_effects(t).where("padj is not null").select("site", "padj"), 20, F.col("padj"), F.col("site"))


@query("hit_semi", HITS + " SELECT site, pair, condition, k, n FROM pile WHERE site IN (SELECT site FROM h WHERE beta > ln(1.25) AND padj < 0.95)")
def hit_semi(t):
    import math

    return t.pile.join(V.hits(_effects(t), "beta", "padj", math.log(1.25), 0.95).select("site"), "site", "left_semi").select("site", "pair", "condition", "k", "n")


@query("nonhit_anti", HITS + " SELECT DISTINCT site FROM pile WHERE site NOT IN (SELECT site FROM h WHERE beta > ln(1.25) AND padj < 0.95)")
def nonhit_anti(t):
    import math

    return V.nonhits(t.pile.select("site").distinct(), V.hits(_effects(t), "beta", "padj", math.log(1.25), 0.95))


OBSERVED = ["o", "f", "small", "large"]


@query("conversion_delta", """WITH s AS (SELECT l_shipdate_y AS y, condition, sum(o) AS o, sum(f) AS f, sum(small) AS small, sum(large) AS large FROM (SELECT replicate AS l_shipdate_y, condition, (status = 'O')::INT AS o, (status = 'F')::INT AS f, (quantity < 10)::INT AS small, (quantity > 40)::INT AS large FROM {lib} WHERE condition <> 'Control') GROUP BY 1, 2),
    q AS (SELECT y, condition, unnest(['o', 'f', 'small', 'large']) AS observed, unnest([o, f, small, large]) / (o + f + small + large)::DOUBLE AS fr FROM s)
    SELECT y AS replicate, observed, round(max(fr) FILTER (condition = 'IP'), 6) AS fraction_ip, round(max(fr) FILTER (condition = 'Input'), 6) AS fraction_input, round(max(fr) FILTER (condition = 'IP') - max(fr) FILTER (condition = 'Input'), 6) AS delta FROM q GROUP BY 1, 2""")
def conversion_delta(t):
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = t.lib.where("condition <> 'Control'").select("replicate", "condition", one(F.col("status") == "O").alias("o"), one(F.col("status") == "F").alias("f"), one(F.col("quantity") < 10).alias("small"), one(F.col("quantity") > 40).alias("large"))
    d = V.conversion(rows, OBSERVED, ["replicate"])
    return d.select("replicate", "observed", r("fraction_IP").alias("fraction_ip"), r("fraction_Input").alias("fraction_input"), r("delta").alias("delta"))


@query("dominant_conversion", """WITH s AS (SELECT replicate, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS f FROM {lib} GROUP BY 1) SELECT replicate, CASE WHEN o > f THEN 'o' WHEN f > o THEN 'f' ELSE 'f' END AS observed FROM s""")
def dominant_conversion(t):
    rows = t.lib.groupBy("replicate").agg(F.count_if(F.col("status") == "O").alias("o"), F.count_if(F.col("status") == "F").alias("f")).unpivot(["replicate"], ["o", "f"], "observed", "n")
    return V.first_rows(rows, ["replicate"], F.desc("n"), F.col("observed")).select("replicate", "observed")


@query("mode_tie", "SELECT part, mode, n FROM (SELECT l_partkey AS part, l_returnflag AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS rk FROM lineitem GROUP BY 1, 2) WHERE rk = 1")
def mode_tie(t):
    return V.mode_of(t.lineitem.select(F.col("l_partkey").alias("part"), "l_returnflag"), ["part"], "l_returnflag").withColumnRenamed("mode_n", "n")


@query("position_spikes", """WITH m AS (SELECT l_suppkey, l_linenumber, upper(l_linestatus) AS b, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY count(*) DESC, upper(l_linestatus)) AS rk FROM lineitem GROUP BY 1, 2, 3)
    SELECT l.l_suppkey AS grp, l.l_linenumber AS pos, round(avg(l_quantity), 6) AS score, count(*) AS n, min(m.b) AS ref_base FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey AND m.l_linenumber = l.l_linenumber AND rk = 1 GROUP BY 1, 2""")
def position_spikes(t):
    s = V.spikes(t.lineitem.select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("pos"), "l_quantity", "l_linestatus"), ["grp", "pos"], "l_quantity", "l_linestatus")
    return s.select("grp", "pos", r("score").alias("score"), "n", "ref_base")


COVER = "c AS (SELECT l_suppkey AS lib, l_linenumber AS pos, count(*) AS depth FROM lineitem GROUP BY 1, 2), v AS (SELECT lib, pos, depth, depth / avg(depth) OVER (PARTITION BY lib) AS cov FROM c)"


def _cover(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("lib"), F.col("l_linenumber").alias("pos")).agg(F.count("*").alias("depth"))


@query("coverage_norm", "WITH " + COVER + " SELECT lib, pos, depth, round(cov, 9) AS cov FROM v")
def coverage_norm(t):
    return V.normalised_coverage(_cover(t), ["lib"]).select("lib", "pos", "depth", r("cov_norm", 9).alias("cov"))


@query("five_retention", "WITH " + COVER + " SELECT lib, round(avg(CASE WHEN pos <= 5 THEN cov END), 9) AS five FROM v GROUP BY 1")
def five_retention(t):
    return V.five_retention(_cover(t), ["lib"]).select("lib", r("five_retention", 9).alias("five"))


@query("five_retention_present", "WITH " + COVER + ", n AS (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY pos) AS rk FROM v) SELECT lib, round(avg(cov), 9) AS five FROM n WHERE rk <= 5 GROUP BY 1 HAVING count(*) >= 5")
def five_retention_present(t):
    return V.five_retention(_cover(t), ["lib"], present=True).select("lib", r("five_retention", 9).alias("five"))


# ---------------------------------------------------------------- tests and titrations


@query("welch_t", """WITH s AS (SELECT replicate, avg(quantity) FILTER (condition = 'IP') AS a, avg(quantity) FILTER (condition = 'Input') AS b, var_samp(quantity) FILTER (condition = 'IP') AS va, var_samp(quantity) FILTER (condition = 'Input') AS vb, count(*) FILTER (condition = 'IP') AS na, count(*) FILTER (condition = 'Input') AS nb FROM {lib} GROUP BY 1)
    SELECT replicate, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round((a - b) / sqrt(va / na + vb / nb), 5) AS t, round(power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 3) AS df FROM s WHERE na > 1 AND nb > 1""")
def welch_t(t):
    w = S.welch(t.lib, ["replicate"], "condition", "quantity", "IP", "Input")
    return w.select("replicate", r("mean_a").alias("mean_a"), r("mean_b").alias("mean_b"), r("t", 5).alias("t"), r("df", 3).alias("df"))


@query("welch_pvalues", """WITH s AS (SELECT replicate, avg(quantity) FILTER (condition = 'IP') AS a, avg(quantity) FILTER (condition = 'Input') AS b, var_samp(quantity) FILTER (condition = 'IP') AS va, var_samp(quantity) FILTER (condition = 'Input') AS vb, count(*) FILTER (condition = 'IP') AS na, count(*) FILTER (condition = 'Input') AS nb FROM {lib} GROUP BY 1)
    , t AS (SELECT replicate, abs(a - b) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df FROM s WHERE na > 1 AND nb > 1) SELECT replicate, round(2 * """ + X.t_sf("t", "df") + """, 6) AS p FROM t""")
def welch_pvalues(t):
    return S.welch(t.lib, ["replicate"], "condition", "quantity", "IP", "Input").select("replicate", r("p").alias("p"))


@query("paired_t", """WITH m AS (SELECT supplier, replicate, avg(quantity) FILTER (condition = 'IP') - avg(quantity) FILTER (condition = 'Input') AS d FROM {lib} GROUP BY 1, 2)
    SELECT replicate, round(avg(d), 6) AS mean_diff, count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t FROM m GROUP BY 1 HAVING count(d) > 1""")
def paired_t(t):
    rows = t.lib.groupBy("supplier", "replicate", "condition").agg(F.avg("quantity").alias("x"))
    p = S.paired_t(rows, ["replicate"], "supplier", "condition", "x", "IP", "Input")
    return p.select("replicate", r("mean_diff").alias("mean_diff"), "n", r("t", 4).alias("t"))


@query("ols_slope", "SELECT replicate, round(regr_slope(quantity, supplier), 6) AS slope, count(*) AS n FROM {lib} GROUP BY 1 HAVING count(*) >= 3")
def ols_slope(t):
    return S.slopes(t.lib, ["replicate"], "quantity", "supplier").select("replicate", r("slope").alias("slope"), "n")


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def pearson(t):
    from tagtally.operators.ordination import correlation

    return correlation(t.lineitem, "l_quantity", "l_extendedprice").select(r("r").alias("r"), "n")


IVW = "x AS (SELECT p_size::DOUBLE AS x, ln(p_retailprice) AS y, 1.0 + p_size % 7 AS se FROM part), s AS (SELECT sum(1 / (se * se)) AS w, sum(x / (se * se)) AS sx, sum(y / (se * se)) AS sy, sum(x * x / (se * se)) AS sxx, sum(x * y / (se * se)) AS sxy FROM x)"


def _ivw(t):
    return t.part.select(F.col("p_size").cast("double").alias("x"), F.ln("p_retailprice").alias("y"), (1.0 + F.col("p_size") % 7).alias("se"))


@query("ivw_slope", "WITH " + IVW + " SELECT round((sxy - sx * sy / w) / (sxx - sx * sx / w), 6) AS slope, round(sy / w - (sxy - sx * sy / w) / (sxx - sx * sx / w) * sx / w, 5) AS intercept FROM s")
def ivw_slope(t):
    fit = S.inverse_variance_fit(_ivw(t), "y", "x", "se")
    return t.spark.createDataFrame([(round(fit["slope"], 6), round(fit["intercept"], 5))], "slope double, intercept double")


@query("ivw_band", "WITH RECURSIVE " + IVW + ", m AS (SELECT w, sx / w AS mx, sy / w AS my, sxx - sx * sx / w AS xx, sxy - sx * sy / w AS xy FROM s), yy AS (SELECT sum((y - my) * (y - my) / (se * se)) AS yy, count(*) - 2 AS df FROM x, m), f AS (SELECT *, xy / xx AS slope, (yy - xy / xx * xy) / df AS var FROM m, yy), "
    + X.t_quantile("yy", 0.975) + """, g AS (SELECT unnest(range(0, 101, 5))::DOUBLE AS x), l AS (SELECT x, my + slope * (x - mx) AS y, (SELECT q FROM tq) * sqrt(var * (1 / w + power(x - mx, 2) / xx)) AS e FROM g, f) SELECT x, round(y, 6) AS y, round(y - e, 6) AS lo, round(y + e, 6) AS hi FROM l""")
def ivw_band(t):
    fit = S.inverse_variance_fit(_ivw(t), "y", "x", "se")
    return S.band(t.spark, fit, [float(g) for g in range(0, 101, 5)]).select("x", r("y").alias("y"), r("lo").alias("lo"), r("hi").alias("hi"))


@query("blocked_lm", "WITH b AS (SELECT condition, count(*) AS n, sum(supplier)::DOUBLE AS x, sum(quantity) AS y, sum(supplier * supplier)::DOUBLE AS xx, sum(supplier * quantity) AS xy FROM {lib} GROUP BY 1) SELECT round(sum(xy - x * y / n) / sum(xx - x * x / n), 6) AS slope FROM b")
def blocked_lm(t):
    fit = S.blocked_fit(t.lib.withColumn("x", F.col("supplier").cast("double")), "quantity", "x", "condition")
    return t.spark.createDataFrame([(round(fit["slope"], 6),)], "slope double")


@query("enrichment_log2", "WITH s AS (SELECT replicate, sum((status = 'O')::INT) FILTER (condition = 'IP') AS sp, count(*) FILTER (condition = 'IP') AS bp, sum((status = 'O')::INT) FILTER (condition = 'Input') AS si, count(*) FILTER (condition = 'Input') AS bi FROM {lib} GROUP BY 1) SELECT replicate, CASE WHEN sp > 0 AND si > 0 THEN round(log2((sp / bp::DOUBLE) / (si / bi::DOUBLE)), 6) END AS enrichment FROM s")
def enrichment_log2(t):
    rows = t.lib.withColumn("spike", F.when(F.col("status") == "O", 1).otherwise(0)).withColumn("base", F.lit(1))
    return S.enrichment_log2(rows, "spike", "base", ["replicate"]).select("replicate", r("enrichment").alias("enrichment"))


@query("detection_offset", """WITH s AS (SELECT supplier % 4 AS dose, replicate, sum(quantity) FILTER (condition = 'IP' AND status = 'O') AS gp, sum(quantity) FILTER (condition = 'IP' AND status = 'F') AS fp, sum(quantity) FILTER (condition = 'Input' AND status = 'O') AS gi, sum(quantity) FILTER (condition = 'Input' AND status = 'F') AS fi FROM {lib} GROUP BY 1, 2)
    SELECT dose, round(avg(log2((gp / 0.8 + fp) / (gi / 0.9 + fi)) - log2((gp + fp) / (gi + fi))), 6) AS off FROM s WHERE gi + fi > 0 AND gp + fp > 0 GROUP BY 1""")
def detection_offset(t):
    s = lambda c, x: F.sum(F.when((F.col("condition") == c) & (F.col("status") == x), F.col("quantity")))
    rows = t.lib.groupBy((F.col("supplier") % 4).alias("dose"), "replicate").agg(s("IP", "O").alias("gp"), s("IP", "F").alias("fp"), s("Input", "O").alias("gi"), s("Input", "F").alias("fi"))
    return S.detection_offset(rows, ["dose"], 0.9, 0.8).select("dose", r("offset").alias("off"))


@query("nb_glm")
def nb_glm(t):
    return S.nb_wald(t.cnt, _factors(t)).select("feature", *[r(c).alias(c) for c in ("baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj")])


@query("mean_absolute_error", "SELECT l_returnflag AS method, round(avg(abs(l_discount - l_tax)), 6) AS mae, count(*) AS n FROM lineitem GROUP BY 1")
def mean_absolute_error(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("method")).agg(r(F.avg(F.abs(F.col("l_discount") - F.col("l_tax")))).alias("mae"), F.count("*").alias("n"))


@query("spread_check", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 HAVING max(p_retailprice) - min(p_retailprice) < 1e6")
def spread_check(t):
    g = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("s"))
    return g.where("s < 1e6").select("p_brand", r("m", 4).alias("mean"))


@query("bin_presence", "SELECT p_brand AS family, count(DISTINCT p_type) AS n_files, round(avg(p_size), 6) AS mean_z FROM part GROUP BY 1")
def bin_presence(t):
    return t.part.groupBy(F.col("p_brand").alias("family")).agg(F.countDistinct("p_type").alias("n_files"), r(F.avg("p_size")).alias("mean_z"))


@query("fraction_of_total", "SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS fraction FROM part GROUP BY 1, 2")
def fraction_of_total(t):
    g = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return g.withColumn("fraction", r(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand"))))
