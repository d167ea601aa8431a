"""Queries of whole plans: counts to calls, pileups to motifs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tagtally.operators import calls as K
from tagtally.operators import statistics as S
from tagtally.plans import statements as X
from tagtally.plans.enrichment import LOGITS, _sums, r
from tagtally.plans.registry import query

def _normaliser():
    return F.col("feature") % 10 == 0


def _contrast(name: str, a: str) -> str:
    """One contrast of moments against the input: change, error, statistic, p and its BH adjustment."""
    return f"""{name} AS (SELECT feature, lfc, se, lfc / nullif(se, 0) AS stat, 2 * {X.normal_sf("abs(lfc / nullif(se, 0))")} AS p FROM (SELECT feature, m{a} - mi AS lfc, sqrt(v{a} / n{a} + vi / ni) AS se FROM s WHERE n{a} > 1 AND ni > 1)),
    {name}k AS (SELECT feature, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk, count(*) OVER () AS n FROM {name} WHERE p IS NOT NULL),
    {name}q AS (SELECT feature, least(1.0, min(p * n / rk) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q0, p FROM {name}k), {name}a AS (SELECT feature, min(q0) OVER (PARTITION BY p) AS padj FROM {name}q)"""


STATS = ", ".join(f"avg(value) FILTER (condition = '{c}') AS m{k}, var_samp(value) FILTER (condition = '{c}') AS v{k}, count(*) FILTER (condition = '{c}') AS n{k}" for c, k in (("IP", "p"), ("Input", "i"), ("Control", "c")))
CALLS = f"""WITH kept AS (SELECT feature FROM {{cnt}} GROUP BY 1 HAVING count(*) FILTER (condition = 'Input') >= 2 AND count(*) FILTER (condition = 'IP') >= 2), kc AS (SELECT cnt.* FROM cnt JOIN kept USING (feature)),
    f AS (SELECT sample, min(condition) AS condition, min(replicate) AS replicate, sum(CASE WHEN feature % 10 = 0 THEN count ELSE 0 END)::DOUBLE AS total FROM kc GROUP BY 1), sf AS (SELECT sample, condition, replicate, total / avg(total) OVER () AS size_factor FROM f),
    v AS (SELECT feature, kc.condition, log2(count / size_factor + 1) AS value FROM kc JOIN sf USING (sample) WHERE feature % 10 <> 0), s AS (SELECT feature, {STATS} FROM v GROUP BY 1),
    {_contrast("pi", "p")}, {_contrast("ci", "c")},
    e AS (SELECT replicate, max(CASE WHEN condition = 'Control' THEN size_factor END) AS c, max(CASE WHEN condition = 'IP' THEN size_factor END) AS p FROM sf GROUP BY 1 HAVING count(*) FILTER (condition = 'Control') = 1 AND count(*) FILTER (condition = 'IP') = 1), o AS (SELECT median(-log2(c / p)) AS off FROM e),
    w AS (SELECT coalesce(pi.feature, ci.feature) AS feature, pi.lfc AS lfc_pi, pi.se AS se_pi, ci.lfc AS lfc_ci, ci.se AS se_ci, pia.padj AS padj_pi FROM pi FULL JOIN ci ON pi.feature = ci.feature LEFT JOIN pia ON pia.feature = pi.feature),
    z AS (SELECT *, lfc_pi - lfc_ci + off AS delta, (lfc_pi - lfc_ci + off) / nullif(sqrt(se_pi * se_pi + se_ci * se_ci), 0) AS z FROM w, o),
    sdk AS (SELECT count(*) FILTER (abs(z) < 0.5) AS n1, stddev_samp(CASE WHEN abs(z) < 0.5 THEN z END) AS s1, count(*) FILTER (abs(z) < 1) AS n2, stddev_samp(CASE WHEN abs(z) < 1 THEN z END) AS s2 FROM z), sd AS (SELECT CASE WHEN n1 >= 10 THEN s1 WHEN n2 >= 10 THEN s2 ELSE 0.3 END AS sd FROM sdk),
    dp AS (SELECT z.*, {X.normal_sf("z / sd")} AS p FROM z, sd), dk AS (SELECT feature, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk, count(*) OVER () AS n FROM dp WHERE p IS NOT NULL), dq AS (SELECT feature, p, least(1.0, min(p * n / rk) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q0 FROM dk), da AS (SELECT feature, min(q0) OVER (PARTITION BY p) AS padj_delta FROM dq)
    SELECT dp.feature, round(lfc_pi, 6) AS lfc_pi, round(lfc_ci, 6) AS lfc_ci, round(padj_pi, 6) AS padj_pi, round(delta, 6) AS delta, round(z, 4) AS z, round(padj_delta, 6) AS padj_delta,
    coalesce(lfc_pi > 0.5, false) AS directionality, coalesce(lfc_pi > 0.5 AND padj_pi < 0.05, false) AS vs_input, coalesce(z > 0 AND padj_delta < 0.05, false) AS vs_control,
    coalesce(lfc_pi > 0.5 AND padj_pi < 0.05, false) AND coalesce(z > 0 AND padj_delta < 0.05, false) AS tp FROM dp LEFT JOIN da USING (feature)"""


@query("true_positives_moments", CALLS)
def true_positives_moments(t):
    rows = K.true_positives(t.cnt, _normaliser(), model="moments")
    return rows.select("feature", r("lfc_pI").alias("lfc_pi"), r("lfc_cI").alias("lfc_ci"), r("padj_pI").alias("padj_pi"), r("delta").alias("delta"), r("z_delta", 4).alias("z"), r("padj_delta").alias("padj_delta"), "directionality", "vs_input", "vs_control", "tp")


@query("true_positives")
def true_positives(t):
    rows = K.true_positives(t.cnt, _normaliser())
    return rows.select("feature", *[r(c).alias(c) for c in ("lfc_pI", "se_pI", "padj_pI", "lfc_cI", "se_cI", "padj_cI", "delta", "se_delta", "z_delta", "pval_delta", "padj_delta")], "directionality", "vs_input", "vs_control", "tp")


@query("nb_contrasts")
def nb_contrasts(t):
    kept, factors = K.prepared(t.cnt, _normaliser())
    return S.nb_contrasts(kept, factors, K.PAIRS).select("contrast", "feature", *[r(c).alias(c) for c in ("baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj")])


# ---------------------------------------------------------------- sites to motifs

#: By normal tails no site of random counts passes an error rate, so the effect alone decides in the statements what a hit is; tests plant real ones.
EFFECT, ALPHA = math.log(1.05), 1.01
#: By moderated t some do, and the test decides too.
RATE = 0.05


def _places(t):
    """Each site's place in a sequence, and its stratum."""
    sites = t.pile.select("site").distinct()
    return sites.select("site", (F.col("site") % 200).alias("transcript_id"), (F.col("site") * 7 % 60 + 1).cast("int").alias("pos"), (F.col("site") % 3).alias("stratum"))


def _tested(t, test: str, alpha: float = ALPHA):
    return K.variant_sites(_sums(t), 1, 3, EFFECT, alpha, test)


TESTED = f"""WITH {LOGITS}, b AS (SELECT site, sum(w * delta) / sum(w) AS beta, sum(w) AS sw FROM lg GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT site, beta, 2 * {X.normal_sf("abs(beta * sqrt(sw))")} AS p FROM b),
    k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk, count(*) OVER () AS n FROM p), q AS (SELECT site, beta, p, least(1.0, min(p * n / rk) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q0 FROM k), h AS (SELECT site, beta, min(q0) OVER (PARTITION BY p) AS padj FROM q), hit AS (SELECT site, beta, padj, beta > {EFFECT!r} AND padj < {ALPHA} AS hit FROM h),
    c AS (SELECT site, beta, padj, hit, CASE WHEN pos <= length(seq) THEN substr(concat('NNN', seq, 'NNN'), pos, 7) END AS context FROM (SELECT hit.*, CAST(site * 7 % 60 + 1 AS INTEGER) AS pos, site % 200 AS id FROM hit) JOIN {{seqs}} USING (id))"""


@query("motif_sites", TESTED + " SELECT site, round(beta, 6) AS beta, round(padj, 6) AS padj, hit, context FROM c")
def motif_sites(t):
    found = K.motif_sites(_tested(t, "normal"), _places(t), t.seqs.where("id < 200"))["sites"]
    return found.select("site", r("beta").alias("beta"), r("padj").alias("padj"), "hit", F.col("sequence_context").alias("context"))


SHARES = ", ".join(f"round(log2((avg((base = '{x}')::INT) FILTER (hit) + 1e-6) / (avg((base = '{x}')::INT) FILTER (NOT hit) + 1e-6)), 6) AS {x.lower()}" for x in "ACGT")


@query("motif_log_odds", TESTED + f", b2 AS (SELECT hit, k AS k_pos, substr(context, k, 1) AS base FROM c, (SELECT unnest(range(1, 8))::INTEGER AS k) WHERE regexp_matches(context, '^[ACGT]{{{{7}}}}$')) SELECT k_pos, {SHARES} FROM b2 GROUP BY 1".replace("{{7}}", "{7}"))
def motif_log_odds(t):
    odds = K.motif_sites(_tested(t, "normal"), _places(t), t.seqs.where("id < 200"))["log_odds"]
    return odds.select("k_pos", *[r(x).alias(x.lower()) for x in "ACGT"])


@query("motif_permutation")
def motif_permutation(t):
    null = K.motif_sites(_tested(t, "moderated", RATE), _places(t), t.seqs.where("id < 200"), stratum="stratum")["permutation"]
    return null.select("k_pos", r("observed").alias("observed"), r("p").alias("p"), r("q").alias("q"))
