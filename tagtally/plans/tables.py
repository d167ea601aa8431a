"""Queries of whole-table steps, of file discovery and of the sinks of results."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagtally.operators import tables as T
from tagtally.operators import trimming
from tagtally.operators.variants import pileup
from tagtally.plans.registry import query
from tagtally.plans.scans import READS, RECORDS, _reads, _records, _written
from tagtally.session import shared_folder
from tagtally.sources import files


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/tables/{uuid.uuid4().hex}/{name}"


@query("inner_chain", "WITH a AS (SELECT p_partkey AS k, p_size AS size FROM part), b AS (SELECT l_partkey AS k, count(*) AS lines FROM lineitem GROUP BY 1), c AS (SELECT l_partkey AS k, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), d AS (SELECT l_partkey AS k, max(l_shipdate) AS last FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT * FROM a JOIN b USING (k) JOIN c USING (k) JOIN d USING (k)")
def inner_chain(t):
    key = F.col("l_partkey").alias("k")
    b = t.lineitem.groupBy(key).agg(F.count("*").alias("lines"))
    c = t.lineitem.where("l_returnflag = 'R'").groupBy(key).agg(F.sum("l_quantity").alias("returned"))
    d = t.lineitem.where("l_suppkey % 2 = 0").groupBy(key).agg(F.max("l_shipdate").alias("last"))
    return T.inner_chain([t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size")), b, c, d], "k")


@query("bind_columns", "SELECT s_suppkey, s_name, c_custkey FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer) USING (i)")
def bind_columns(t):
    customers = t.customer.select("c_custkey", (-F.col("c_custkey")).alias("down"))
    return T.bind_columns(t.supplier.select("s_suppkey", "s_name"), customers, "s_suppkey", "down").select("s_suppkey", "s_name", "c_custkey")


@query("lookup_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 100.0 WHEN '2-HIGH' THEN 75.0 ELSE 0.0 END::DOUBLE AS dose FROM orders")
def lookup_map(t):
    return t.orders.select("o_orderkey", T.looked_up(F.col("o_orderpriority"), {"1-URGENT": 100.0, "2-HIGH": 75.0}, 0.0).alias("dose"))


@query("matrix_align", "WITH a AS (SELECT feature, sample, count FROM {cnt} WHERE feature % 3 <> 0 AND condition <> 'IP'), b AS (SELECT feature, sample, count FROM cnt WHERE feature % 2 = 0 AND condition <> 'Control') SELECT 'a' AS side, * FROM a WHERE feature IN (SELECT feature FROM b) AND sample IN (SELECT sample FROM b WHERE feature IN (SELECT feature FROM a)) UNION ALL SELECT 'b', * FROM b WHERE feature IN (SELECT feature FROM a) AND sample IN (SELECT sample FROM a WHERE feature IN (SELECT feature FROM b))")
def matrix_align(t):
    a = t.cnt.where("feature % 3 <> 0 and condition <> 'IP'").select("feature", "sample", "count")
    b = t.cnt.where("feature % 2 = 0 and condition <> 'Control'").select("feature", "sample", "count")
    a, b = T.aligned(a, b, "feature", "sample")
    return a.select(F.lit("a").alias("side"), "*").unionByName(b.select(F.lit("b").alias("side"), "*"))


@query("coerce_numbers", "SELECT c_custkey, coalesce(try_cast(substr(c_name, 10) AS DOUBLE), 0) AS n, coalesce(try_cast(c_name AS DOUBLE), 0) AS z FROM customer")
def coerce_numbers(t):
    return t.customer.select("c_custkey", T.number_or_zero(F.substring("c_name", 10, 100)).alias("n"), T.number_or_zero(F.col("c_name")).alias("z"))


@query("trim_keys", "SELECT trim(k) AS k, count(*) AS n FROM (SELECT concat(repeat(' ', CAST(c_custkey % 3 AS INTEGER)), c_mktsegment, ' ') AS k FROM customer) GROUP BY 1")
def trim_keys(t):
    padded = F.concat(F.repeat(F.lit(" "), (F.col("c_custkey") % 3).cast("int")), "c_mktsegment", F.lit(" "))
    return t.customer.select(F.trim(padded).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("facet_peaks", "SELECT l_returnflag AS flag, l_linestatus AS status, max(l_extendedprice) AS peak, (SELECT max(l_extendedprice) FROM lineitem) AS overall FROM lineitem GROUP BY 1, 2")
def facet_peaks(t):
    return T.facet_peaks(t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice"), "l_extendedprice", "flag", "status")


@query("files_by_pattern", "SELECT concat('f', feature) AS transcript, CAST(sum(count) AS DOUBLE) AS cnt, CASE condition WHEN 'Input' THEN 'input' ELSE 'ip' END AS grp FROM {cnt} WHERE condition <> 'Control' GROUP BY feature, condition")
def files_by_pattern(t):
    folder = _place(t, "many")
    for condition in ("Input", "IP", "Control"):
        rows = t.cnt.where(F.col("condition") == condition).groupBy(F.concat(F.lit("f"), F.col("feature")).alias("transcript")).agg(F.sum("count").cast("double").alias("count"))
        files.write_counts(rows, f"{folder}/{condition}")
        part = next(f for f in files.bam_files(t.spark, f"{folder}/{condition}") if "part-" in f)
        files.move(t.spark, part, f"{folder}/L1_{condition.lower()}.counts.tsv")
    rows = files.read_found(t.spark, folder, r"^L\d+_i.*\.counts\.tsv$", r"^L\d+_(\w+)\.counts", "transcript string, count double")
    return rows.select("transcript", F.col("count").alias("cnt"), F.col("group").alias("grp"))


@query("csv_sink", "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey * 0.5 END::DOUBLE AS half FROM nation")
def csv_sink(t):
    path = _place(t, "r.csv")
    files.write_csv(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey") * 0.5).alias("half")), path, ["k"])
    return files.read_table(t.spark, path, "k long, name string, half double")


@query("inferred_scan", "SELECT n_nationkey AS k, n_name AS name, n_regionkey * 0.5::DOUBLE AS half FROM nation")
def inferred_scan(t):
    path = _place(t, "r.csv")
    files.write_csv(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_regionkey") * 0.5).alias("half")), path)
    return files.read_inferred(t.spark, path).select(F.col("k").cast("long").alias("k"), "name", "half")


@query("saved_tables", "WITH f AS (SELECT sample, sum(count)::BIGINT AS depth FROM {cnt} GROUP BY 1) SELECT feature, sample, count, depth FROM cnt JOIN f USING (sample)")
def saved_tables(t):
    folder = _place(t, "object")
    files.save_tables(folder, {"counts": t.cnt, "depth": t.cnt.groupBy("sample").agg(F.sum("count").alias("depth"))})
    held = files.load_tables(t.spark, folder, "counts", "depth")
    return held["counts"].join(held["depth"], "sample").select("feature", "sample", "count", "depth")


@query("empty_counts", "SELECT 'x' AS transcript, 1.0::DOUBLE AS cnt WHERE false")
def empty_counts(t):
    path = _place(t, "empty")
    files.write_counts(t.cnt.where("false").select(F.lit("x").alias("transcript"), F.lit(1.0).alias("count")), path)
    return files.read_counts(t.spark, path).select("transcript", F.col("count").alias("cnt"))


@query("name_sorted", f"WITH {RECORDS} SELECT count(*) AS records, count(DISTINCT qname) AS reads, count(DISTINCT qname) AS runs FROM rec")
def name_sorted(t):
    path = _place(t, "n")
    files.write_by_name(_records(t), path)
    rows = t.spark.read.parquet(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "qname")
    before = F.lag("qname").over(Window.partitionBy("p").orderBy("i"))
    return rows.withColumn("new", before.isNull() | (before != F.col("qname"))).agg(F.count("*").alias("records"), F.countDistinct("qname").alias("reads"), F.count_if("new").alias("runs"))


@query("pileup_capped", f"""WITH {RECORDS}, b AS (SELECT rname, pos, CASE WHEN cigar = '12M' THEN 0 ELSE 2 END AS skip FROM rec WHERE flag <> 4), x AS (SELECT rname AS chr, CAST(pos + unnest(range(0, 12 - skip)) AS INTEGER) AS pos FROM b)
    SELECT chr, pos, least(count(*), 2) AS depth FROM x GROUP BY 1, 2""")
def pileup_capped(t):
    return pileup(_records(t).where("flag <> 4").withColumn("ord", F.monotonically_increasing_id()), max_depth=2).select("chr", "pos", F.col("depth").cast("long").alias("depth"))


#: Letters of texts as C and T alone, which no adapter resembles, with adapters at known places by the read's number: the cut is known.
_BODY = f"b AS (SELECT qname, (id + k) % 6 AS kind, translate(seq, 'AG', 'CT') AS s FROM ({READS}) WHERE length(seq) = 60)"
_PLANTED = {
    # One that fits with one letter too many, one that fits, the second kind, and both: then the one that fits better goes alone.
    0: ("AAAACAAAAAA", 20), 1: ("AAAAAAAAAA", 25), 2: ("GGGGGGGGGG", 30), 3: ("GGGGCGGGGGGTCTCTCTAAAAAAAAAA", 18), 4: ("", 60),
}
_SECOND = {0: ("AGATCGGAAGAG", 20), 1: ("AGATCGCAAGAG", 33), 2: ("AGATTTTAAGAG", 25)}


def _with(planted: dict) -> str:
    cases = " ".join(f"WHEN {k} THEN concat(substr(s, 1, {at}), '{what}', substr(s, {at + 1}))" for k, (what, at) in planted.items())
    return f"CASE kind {cases} ELSE s END"


def _planted(t, planted: dict):
    rows = _reads(t).where("length(seq) = 60").select("qname", ((F.col("id") + F.col("k")) % 6).alias("kind"), F.translate("seq", "AG", "CT").alias("s"))
    rows = rows.withColumn("seq", F.expr(_with(planted)))
    poor = F.when(F.col("kind") == 4, F.concat(F.repeat(F.lit("I"), F.length("seq") - 7), F.lit("#######"))).otherwise(F.repeat(F.lit("I"), F.length("seq")))
    return _written(t, rows.withColumn("qual", poor).select("qname", "seq", "qual"))


@query("trim_first_pass", f"""WITH {_BODY}, p AS (SELECT qname, kind, {_with(_PLANTED)} AS s FROM b)
    SELECT concat(qname, '_', substr(s, 1, 12)) AS qname, substr(s, 13, CAST(CASE kind WHEN 0 THEN 8 WHEN 1 THEN 13 WHEN 2 THEN 18 WHEN 3 THEN 24 WHEN 4 THEN 41 ELSE 48 END AS INTEGER)) AS seq FROM p WHERE kind >= 2""")
def trim_first_pass(t):
    return trimming.first_pass(_planted(t, _PLANTED)).select("qname", "seq")


@query("trim_second_pass", f"""WITH {_BODY}, p AS (SELECT qname, kind, {_with(_SECOND)} AS s FROM b)
    SELECT qname, substr(s, 4, CAST(CASE kind WHEN 0 THEN 17 WHEN 1 THEN 30 WHEN 2 THEN 69 WHEN 4 THEN 50 ELSE 57 END AS INTEGER)) AS seq FROM p""")
def trim_second_pass(t):
    return trimming.second_pass(_planted(t, _SECOND)).select("qname", "seq")
