"""Queries of reads, molecules and abundances."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagtally.functions.strings import base_id, condition_of, digest_udf, family_key, site_position, site_transcript, stars, umi_of, uniform_md5, uniform_udf
from tagtally.operators import layout as L
from tagtally.operators import reads as R
from tagtally.plans.registry import query
from tagtally.session import shared_folder

PRUNED = "pruned AS (SELECT * FROM (SELECT *, max(a_s) OVER (PARTITION BY qname) AS top FROM {aln}) WHERE a_s >= top - 2)"
BEST = PRUNED + ", best AS (SELECT umi, seq, rname, max(a_s) AS a_s, min(nm) AS nm FROM pruned GROUP BY 1, 2, 3)"
EDGES = BEST + ", edges AS (SELECT *, max(a_s) OVER (PARTITION BY umi, seq) - a_s AS d, exp(-0.1 * (max(a_s) OVER (PARTITION BY umi, seq) - a_s)) AS w, count(*) OVER (PARTITION BY umi, seq) AS n FROM best)"
START = EDGES + ", t0 AS (SELECT rname, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS single FROM edges GROUP BY 1), a0 AS (SELECT rname, single, 1 + single AS a FROM t0)"


#: The iteration to convergence: 200 rounds at most, or until the abundances move by less than 1e-6 of the molecules.
EM = START + """, usable AS (SELECT count(*) AS u FROM (SELECT DISTINCT umi, seq FROM edges)),
    classes AS MATERIALIZED (SELECT row_number() OVER () AS c, members, count(*) AS k FROM (SELECT list({'r': rname, 'w': w} ORDER BY rname) AS members FROM edges WHERE n > 1 GROUP BY umi, seq) GROUP BY members),
    ce AS MATERIALIZED (SELECT c, k, len(members) AS n, unnest(members).r AS rname, unnest(members).w AS w FROM classes),
    it(i, rname, single, a, moved) AS (SELECT 0, rname, single, a, 1e300::DOUBLE FROM a0 UNION ALL
        SELECT i + 1, rname, single, a, sum(abs(a - old)) OVER () FROM (SELECT it.i, it.rname, it.single, it.a AS old, it.single + coalesce(g.got, 0) AS a FROM it LEFT JOIN
            (SELECT rname, sum(CASE WHEN s > 0 THEN k * x / s ELSE k * 1.0 / n END) AS got FROM (SELECT c, k, n, ce.rname, a * w AS x, sum(a * w) OVER (PARTITION BY c) AS s FROM ce JOIN it ON it.rname = ce.rname) GROUP BY 1) g ON g.rname = it.rname
            WHERE it.i < 200 AND it.moved >= 1e-6 * (SELECT u FROM usable))),
    last AS (SELECT * FROM it WHERE i = (SELECT max(i) FROM it)), em AS (SELECT rname AS transcript, a * (SELECT u FROM usable) / (SELECT sum(a) FROM last) AS cnt FROM last)"""
POST = EM + ", post AS (SELECT umi, seq, rname, a_s, nm, n, CASE WHEN sum(c * w) OVER (PARTITION BY umi, seq) > 0 THEN c * w / sum(c * w) OVER (PARTITION BY umi, seq) ELSE 1.0 / n END AS p FROM (SELECT e.*, round(cnt, 6) AS c FROM edges e JOIN em ON e.rname = em.transcript))"
PICK = POST + """, tied AS (SELECT *, count(*) OVER (PARTITION BY umi, seq) AS tie_count, max(a_s) OVER (PARTITION BY umi, seq) AS top_s FROM (SELECT *, max(p) OVER (PARTITION BY umi, seq) AS mp FROM post) WHERE p >= mp - 1e-9),
    pick AS (SELECT umi, seq, rname AS transcript, p AS posterior, CAST(tie_count AS INTEGER) AS tie_count, CASE WHEN tie_count = 1 THEN 'posterior' WHEN even = 1 THEN 'posterior->AS' ELSE 'posterior->AS->lexi_name' END AS tie_break
    FROM (SELECT *, sum(CASE WHEN a_s = top_s THEN 1 ELSE 0 END) OVER (PARTITION BY umi, seq) AS even, row_number() OVER (PARTITION BY umi, seq ORDER BY a_s DESC, rname) AS rk FROM tied) WHERE rk = 1)"""


def _edges(t):
    return R.weighted(R.best_per_key(R.prune_delta(t.alignments("l_orderkey"), "AS", 2, "l_orderkey")))


def _counts(t):
    return R.estimate(_edges(t))


def _post(t):
    shared_folder(t.spark)
    edges = _edges(t).checkpoint()  # read by the estimate and by the posterior
    counts = R.estimate(edges, written=True).withColumn("count", F.round("count", 6))  # as they are written
    return R.posterior(edges, counts)


def _keyed_orders(t):
    """Orders with the molecule that all their records belong to; far fewer than records, so molecules are looked up for them."""
    return t.orders.withColumns({"umi": F.col("o_custkey").cast("string"), "seq": F.col("o_orderpriority")})


@query("umi_extract", "SELECT page_id, CASE WHEN contains(url, '/') THEN nullif(trim(split_part(url, '/', -1)), '') END AS umi FROM pages")
def umi_extract(t):
    return t.pages.select("page_id", umi_of(F.col("url"), "/").alias("umi"))


@query("condition_parse", """SELECT c_custkey, c_name, CASE lower(right(c_mktsegment, 1)) WHEN 'i' THEN 'Input' WHEN 'p' THEN 'IP' WHEN 'h' THEN 'Control' END AS condition,
    regexp_replace(c_mktsegment, '[iIhHpP]$', '') AS base FROM customer""")
def condition_parse(t):
    return t.customer.select("c_custkey", "c_name", condition_of(F.col("c_mktsegment"), True).alias("condition"), base_id(F.col("c_mktsegment")).alias("base"))


@query("chr_pos_parse", """SELECT p_partkey, CASE WHEN regexp_matches(x, '^.*_[^_]+$') THEN regexp_extract(x, '^(.*)_([^_]+)$', 1) END AS chr, try_cast(regexp_extract(x, '^(.*)_([^_]+)$', 2) AS INTEGER) AS pos
    FROM (SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_', p_size) AS x FROM part)""")
def chr_pos_parse(t):
    x = F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", site_transcript(x).alias("chr"), site_position(x).alias("pos"))


@query("family_canon", """SELECT p_partkey, regexp_replace(regexp_replace(x, '^snord[0-9a-z]*$', 'small nucleolar rna c/d box'), '^snora[0-9a-z]*$', 'small nucleolar rna h/aca box') AS family
    FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(concat(p_type, '-', p_brand, ', ', p_name))), '[-_,]+', ' ', 'g'), ' +', ' ', 'g')) AS x FROM part)""")
def family_canon(t):
    return t.part.select("p_partkey", family_key(F.concat("p_type", F.lit("-"), "p_brand", F.lit(", "), "p_name")).alias("family"))


@query("strings_misc", """SELECT conv_id, turn, upper(role) AS role, length(text) AS n, left(text, 5) AS head, right(text, 5) AS tail, lpad(CAST(turn AS VARCHAR), 4, '0') AS padded,
    CASE WHEN length(text) % 5 = 0 THEN '****' WHEN length(text) % 5 = 1 THEN '***' WHEN length(text) % 5 = 2 THEN '**' WHEN length(text) % 5 = 3 THEN '*' ELSE 'n.s.' END AS stars FROM conversations""")
def strings_misc(t):
    p = F.element_at(F.array(*[F.lit(x) for x in (0.00001, 0.0005, 0.005, 0.03, 0.5)]), F.length("text") % 5 + 1)
    return t.conversations.select("conv_id", "turn", F.upper("role").alias("role"), F.length("text").cast("long").alias("n"), F.left("text", F.lit(5)).alias("head"), F.right("text", F.lit(5)).alias("tail"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("padded"), stars(p).alias("stars"))


INGEST = """SELECT *, CASE WHEN status = 'F' AND l_linenumber = 1 THEN 'unmapped' WHEN l_tax < 0.02 THEN 'low_mapq' WHEN seq IS NULL THEN 'no_seq' WHEN umi IS NULL THEN 'no_umi' END AS skip_reason FROM
    (SELECT l_orderkey, l_partkey, l_linenumber, l_tax, l_linestatus AS status, CASE WHEN l_returnflag <> 'A' OR l_linenumber > 2 THEN l_returnflag END AS seq, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS umi FROM lineitem)"""


def _ingest(t):
    rows = t.lineitem.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("_"), F.col("l_suppkey").cast("string"))).otherwise("")).alias("qname"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 4).otherwise(0).alias("flag"),
        F.lit("t").alias("rname"), F.when(F.col("l_tax") < 0.02, 0).otherwise(30).alias("mapq"),
        F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") > 2), F.col("l_returnflag")).alias("seq"),
        F.col("l_linenumber").alias("as"), F.col("l_linenumber").alias("nm"), "l_orderkey", "l_partkey", "l_linenumber",
    )
    return R.ingest(rows, min_mapq=10)


@query("ingest_filter", f"SELECT l_orderkey, l_partkey, l_linenumber, seq, umi FROM ({INGEST}) WHERE skip_reason IS NULL")
def ingest_filter(t):
    return R.kept(_ingest(t)).select("l_orderkey", "l_partkey", "l_linenumber", "seq", "umi")


@query("skip_counters", f"SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM ({INGEST}) GROUP BY 1")
def skip_counters(t):
    return R.skip_counts(_ingest(t))


@query("read_prune_delta", "WITH " + PRUNED + " SELECT qname, umi, seq, rname, a_s, nm FROM pruned")
def read_prune_delta(t):
    return R.prune_delta(t.aln, "AS", 2).select("qname", "umi", "seq", "rname", F.col("as").alias("a_s"), "nm")


@query("read_prune_nm", "SELECT qname, umi, seq, rname, a_s, nm FROM (SELECT *, min(nm) OVER (PARTITION BY qname) AS low FROM {aln}) WHERE nm <= low + 1")
def read_prune_nm(t):
    return R.prune_delta(t.aln, "NM", 1).select("qname", "umi", "seq", "rname", F.col("as").alias("a_s"), "nm")


@query("read_topk", "SELECT qname, rname, a_s, nm FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY a_s DESC, nm ASC NULLS FIRST, rname DESC) AS rk FROM {aln}) WHERE rk <= 2")
def read_topk(t):
    return R.top_candidates(t.aln, 2).select("qname", "rname", F.col("as").alias("a_s"), "nm")


@query("best_per_key", "WITH " + BEST + " SELECT * FROM best")
def best_per_key(t):
    return R.best_per_key(R.prune_delta(t.aln, "AS", 2)).withColumnRenamed("as", "a_s")


@query("group_weights", "WITH " + EDGES + " SELECT umi, seq, rname, CAST(d AS INTEGER) AS d, round(w, 6) AS w, n FROM edges")
def group_weights(t):
    return _edges(t).select("umi", "seq", "rname", F.col("drop").alias("d"), F.round("w", 6).alias("w"), "n")


@query("posterior_init", "WITH " + EDGES + " SELECT umi, seq, rname, round(w / sum(w) OVER (PARTITION BY umi, seq), 6) AS p FROM edges")
def posterior_init(t):
    edges = _edges(t)
    even = edges.select(F.col("rname").alias("transcript")).distinct().withColumn("count", F.lit(1.0))
    return R.posterior(edges, even).select("umi", "seq", "rname", F.round("p", 6).alias("p"))


@query("equivalence_classes", "WITH " + EDGES + """, g AS (SELECT umi, seq, string_agg(concat(rname, ':', d), ';' ORDER BY rname) AS members FROM edges WHERE n > 1 GROUP BY 1, 2) SELECT members, count(*) AS n FROM g GROUP BY 1""")
def equivalence_classes(t):
    text = F.transform("members", lambda m: F.concat_ws(":", m["rname"], F.round(F.ln(m["w"]) * -10).cast("int").cast("string")))
    return R.classes(_edges(t)).select(F.array_join(text, ";").alias("members"), "n")


@query("em_counts", "WITH RECURSIVE " + EM + " SELECT transcript, round(cnt, 4) AS cnt FROM em")
def em_counts(t):
    return _counts(t).select("transcript", F.round("count", 4).alias("cnt"))


@query("em_counts_frames", "WITH RECURSIVE " + EM + " SELECT transcript, round(cnt, 4) AS cnt FROM em")
def em_counts_frames(t):
    return R.estimate(_edges(t), driver_edges=0).select("transcript", F.round("count", 4).alias("cnt"))


@query("hard_assign", "WITH RECURSIVE " + PICK + " SELECT umi, seq, transcript, round(posterior, 4) AS posterior, tie_count, tie_break FROM pick")
def hard_assign(t):
    return R.hard_pick(_post(t), eps=1e-9).withColumn("posterior", F.round("posterior", 4))


@query("tie_break_stats", "WITH RECURSIVE " + PICK + " SELECT tie_break, count(*) AS n FROM pick GROUP BY 1")
def tie_break_stats(t):
    return R.hard_pick(_post(t), eps=1e-9).groupBy("tie_break").agg(F.count("*").alias("n"))


@query("posterior_string", "WITH RECURSIVE " + POST + " SELECT umi, seq, string_agg(concat(rname, ':', CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR)), ';' ORDER BY rname) AS posteriors FROM post GROUP BY 1, 2")
def posterior_string(t):
    rows = _post(t).withColumn("p", F.round(F.col("p") * 100))
    return R.posterior_text(rows, 0)


@query("dedup_first", "WITH RECURSIVE " + PICK + """ SELECT umi, seq, transcript, start, l_quantity FROM (SELECT a.umi, a.seq, a.rname AS transcript, a.start, a.a_s AS l_quantity, row_number() OVER (PARTITION BY a.umi, a.seq ORDER BY a.start, a.a_s, a.part, a.nm, a.qname) AS rk
    FROM aln a JOIN pick ON a.umi = pick.umi AND a.seq = pick.seq AND a.rname = pick.transcript) WHERE rk = 1""")
def dedup_first(t):
    picks = R.hard_pick(_post(t), eps=1e-9)
    orders = _keyed_orders(t).join(picks.select("umi", "seq", "transcript"), ["umi", "seq"]).drop("umi", "seq")
    rows = t.alignments("transcript", orders=orders).where("rname = transcript").drop("transcript")
    return R.deduplicate(rows, picks, ["start", "as", "part", "nm", "qname"]).select("umi", "seq", F.col("rname").alias("transcript"), "start", F.col("as").alias("l_quantity"))


@query("unassigned_records", "WITH RECURSIVE " + PICK + " SELECT qname, umi, seq, rname, a.a_s, a.nm, a.start, a.part FROM aln a WHERE NOT EXISTS (SELECT 1 FROM pick WHERE pick.umi = a.umi AND pick.seq = a.seq AND round(pick.posterior, 4) >= 0.5)")
def unassigned_records(t):
    picks = R.hard_pick(_post(t), eps=1e-9).where("round(posterior, 4) >= 0.5")
    orders = R.unassigned(_keyed_orders(t), picks).drop("umi", "seq")
    return t.alignments(orders=orders).select("qname", "umi", "seq", "rname", F.col("as").alias("a_s"), "nm", "start", "part")


for _how, _sql in {
    "primary": "SELECT rname, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY a_s DESC, nm ASC NULLS FIRST, rname DESC) AS rk FROM {aln}) WHERE rk = 1 GROUP BY 1",
    "top_as": "SELECT rname, round(sum(1.0 / k), 6) AS cnt FROM (SELECT *, count(*) OVER (PARTITION BY qname) AS k FROM (SELECT *, max(a_s) OVER (PARTITION BY qname) AS top FROM {aln}) WHERE a_s = top) GROUP BY 1",
    "all": "SELECT rname, round(sum(1.0 / k), 6) AS cnt FROM (SELECT *, count(*) OVER (PARTITION BY qname) AS k FROM {aln}) GROUP BY 1",
    "unique": "SELECT rname, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT *, count(*) OVER (PARTITION BY qname) AS k FROM {aln}) WHERE k = 1 GROUP BY 1",
}.items():
    query("baseline_" + {"all": "one_over_n"}.get(_how, _how), _sql)(lambda t, how=_how: R.baseline(t.aln, how).select("rname", F.round("count", 6).alias("cnt")))

query("baseline_random", "SELECT rname, CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT qname, arg_min(rname, md5(concat(qname, '|', rname))) AS rname FROM {aln} GROUP BY 1) GROUP BY 1")(lambda t: R.baseline(t.aln, "random").withColumnRenamed("count", "cnt"))


@query("group_digest")
def group_digest(t):
    key = digest_udf(16)(F.concat_ws("\t", "umi", "seq"))
    return t.aln.select("umi", "seq").distinct().withColumn("digest", key)


FRACTIONS = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query("laid_out_assignment", "WITH RECURSIVE " + PICK + """ SELECT umi, seq, transcript, start, l_quantity FROM (SELECT a.umi, a.seq, a.rname AS transcript, a.start, a.a_s AS l_quantity, row_number() OVER (PARTITION BY a.umi, a.seq ORDER BY a.start, a.a_s, a.part, a.nm, a.qname) AS rk
    FROM aln a JOIN pick ON a.umi = pick.umi AND a.seq = pick.seq AND a.rname = pick.transcript) WHERE rk = 1""")
def laid_out_assignment(t):
    top = F.max("as").over(Window.partitionBy("l_orderkey"))
    table = L.write_molecules(t.alignments("l_orderkey").withColumn("near", F.col("as") >= top - 2).drop("l_orderkey"), f"aln_{uuid.uuid4().hex}", f"{shared_folder(t.spark)}/layouts", 16)
    near = table.where("near")
    counts = R.estimate(L.edges(near)).withColumn("count", F.round("count", 6))
    rows = L.first_records(table, L.picks(near, counts, eps=1e-9), ["start", "as", "part", "nm", "qname"])
    return rows.select("umi", "seq", F.col("rname").alias("transcript"), "start", F.col("as").alias("l_quantity"))


@query("rarefaction", f"""WITH f AS (SELECT unnest({FRACTIONS}::DOUBLE[]) AS fraction), e AS (SELECT user_id, event_type, concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM events)
    SELECT fraction, count(*) AS reads_included, count(DISTINCT (user_id, event_type)) AS unique_umi_seq, round(count(DISTINCT (user_id, event_type)) / count(*)::DOUBLE, 6) AS saturation FROM f JOIN e ON f.fraction > e.u GROUP BY 1""")
def rarefaction(t):
    rows = t.events.select(F.col("event_id").alias("qname"), F.col("user_id").alias("umi"), F.col("event_type").alias("seq"))
    out = R.rarefy(rows, FRACTIONS, uniform_md5(F.col("qname"))).where("reads_included > 0")
    return out.withColumn("saturation", F.round("saturation", 6))


@query("rarefaction_digest")
def rarefaction_digest(t):
    rows = t.events.select(F.col("event_id").cast("string").alias("qname"), F.col("user_id").alias("umi"), F.col("event_type").alias("seq"))
    return R.rarefy(rows, FRACTIONS, uniform_udf(42)(F.col("qname")))


@query("pileup_walk", """WITH r AS (SELECT l_suppkey AS chr, CAST(l_linenumber * 3 AS INTEGER) AS p, count(*) AS k FROM lineitem GROUP BY 1, 2), b AS (SELECT chr, CAST(p + unnest([0, 1, 2, 3]) AS INTEGER) AS pos, unnest(['A', 'C', 'G', 'T']) AS base, k FROM r)
    SELECT CAST(chr AS VARCHAR) AS chr, pos, sum(k)::BIGINT AS depth, coalesce(sum(k) FILTER (base = 'A'), 0)::BIGINT AS a, coalesce(sum(k) FILTER (base = 'C'), 0)::BIGINT AS c, coalesce(sum(k) FILTER (base = 'G'), 0)::BIGINT AS g, coalesce(sum(k) FILTER (base = 'T'), 0)::BIGINT AS t FROM b GROUP BY 1, 2""")
def pileup_walk(t):
    from tagtally.operators.variants import pileup

    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("rname"), (F.col("l_linenumber") * 3).cast("int").alias("pos"), F.lit("4M").alias("cigar"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    return pileup(rows).select("chr", "pos", "depth", F.col("A").alias("a"), F.col("C").alias("c"), F.col("G").alias("g"), F.col("T").alias("t"))


@query("kv_pivot", "SELECT event_type, sum(CASE WHEN k = 'k' THEN v END)::DOUBLE AS k_sum, count(v) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events) GROUP BY 1")
def kv_pivot(t):
    kv = t.events.select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("k", "v"))
    wide = kv.groupBy("event_type").pivot("k", ["k"]).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    return wide.select("event_type", F.col("k_s").alias("k_sum"), F.col("k_n").alias("n"))


@query("distinct_umis", "SELECT count(DISTINCT umi) AS umis, count(DISTINCT (umi, seq)) AS molecules, count(*) AS records, count(*) FILTER (nm = 1) AS first_records FROM {aln}")
def distinct_umis(t):
    return t.aln.agg(F.countDistinct("umi").alias("umis"), F.countDistinct("umi", "seq").alias("molecules"), F.count("*").alias("records"), F.count_if(F.col("nm") == 1).alias("first_records"))
