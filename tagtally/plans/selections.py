"""Queries of predicates, classifications and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtally.operators import selection as L
from tagtally.plans.registry import query


@query("library_names", "SELECT r_name, s AS suffix, concat(trim(r_name), s) AS library FROM region, (SELECT unnest(['i', 'p', 'h']) AS s)")
def library_names(t):
    return L.library_names(t.region, "r_name").select("r_name", "suffix", "library")


@query("group_classify", "SELECT n_nationkey, CASE WHEN n_name IN ('FRANCE', 'GERMANY') THEN 'west' WHEN n_name IN ('CHINA', 'JAPAN', 'FRANCE') THEN 'east' END AS exact, CASE WHEN contains(n_name, 'AN') THEN 'an' WHEN contains(n_name, 'IA') THEN 'ia' END AS part FROM nation")
def group_classify(t):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", L.classify(n, {"west": ["FRANCE", "GERMANY"], "east": ["CHINA", "JAPAN", "FRANCE"]}).alias("exact"), L.classify(n, {"an": ["AN"], "ia": ["IA"]}, True).alias("part"))


@query("prefix_exclude", "SELECT p_partkey, p_brand FROM part WHERE NOT (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#3'))")
def prefix_exclude(t):
    return L.without_prefixes(t.part, "p_brand", ["Brand#1", "Brand#3"]).select("p_partkey", "p_brand")


@query("substring_select", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_type), 'promo')")
def substring_select(t):
    return L.containing(t.part, "a1", "p_name").unionByName(L.containing(t.part, "PROMO", "p_type")).select("p_partkey", "p_name").distinct()


@query("complete_cases", "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, CASE WHEN value > 10 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def complete_cases(t):
    rows = t.events.select("user_id", "event_type", F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return L.complete_cases(rows, "value")


@query("family_members", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22')) GROUP BY 1")
def family_members(t):
    ids = t.part.where(F.col("p_brand").isin("Brand#11", "Brand#22")).select(F.col("p_partkey").alias("l_partkey"))
    return L.members(t.lineitem, ids, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("family_nonmembers", "SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22'))")
def family_nonmembers(t):
    ids = t.part.where(F.col("p_brand").isin("Brand#11", "Brand#22")).select(F.col("p_partkey").alias("l_partkey"))
    return L.members(t.lineitem, ids, "l_partkey", False).agg(F.count("*").alias("n"))


@query("mode_or_max_length", """WITH m AS (SELECT l_suppkey, l_linenumber AS len, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rk FROM lineitem GROUP BY 1, 2), x AS (SELECT l_suppkey, CAST(max(l_quantity) / 10 AS INTEGER) AS top FROM (SELECT l_suppkey, floor(l_quantity / 10) * 10 AS l_quantity FROM lineitem) GROUP BY 1)
    SELECT x.l_suppkey, greatest(len, top) AS length FROM x LEFT JOIN m ON m.l_suppkey = x.l_suppkey AND rk = 1""")
def mode_or_max_length(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("len"), F.floor(F.col("l_quantity") / 10).cast("int").alias("pos"))
    return L.length_of(rows, "l_suppkey", "len", "pos")


@query("nearest_snap", "SELECT c_custkey, CASE WHEN abs(x) <= abs(x - 25) THEN 0.0::DOUBLE WHEN abs(x - 25) <= abs(x - 50) THEN 25.0::DOUBLE WHEN abs(x - 50) <= abs(x - 100) THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS nominal FROM (SELECT c_custkey, c_acctbal / 100 AS x FROM customer)")
def nearest_snap(t):
    return t.customer.select("c_custkey", L.snap(F.col("c_acctbal") / 100, [0, 25, 50, 100]).alias("nominal"))


@query("flagstat", "SELECT count(*) AS total, count(*) FILTER (l_linenumber & 4 = 0) AS mapped, count(*) FILTER (l_partkey & 256 <> 0) AS secondary FROM lineitem")
def flagstat(t):
    rows = t.lineitem.select((F.col("l_linenumber").bitwiseAND(4) + F.col("l_partkey").bitwiseAND(256)).alias("flag"))
    return L.flag_counts(rows).select("total", "mapped", "secondary")


@query("stage_names", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'sgid' WHEN 1 THEN 'total' WHEN 2 THEN 'total' END AS metric, CASE WHEN n_nationkey % 4 < 3 THEN n_name END AS grp FROM nation")
def stage_names(t):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Annotated_stage2_sgidshare_"), "n_name", F.lit("_FAST.csv"))).when(k == 1, F.concat(F.lit("Annotated_stage1_variant_rate_"), "n_name", F.lit(".csv"))).when(k == 2, F.concat(F.lit("Annotated_hits_total_"), "n_name", F.lit(".csv"))).otherwise("other.csv")
    metric, group = L.stage_of(name)
    return t.nation.select("n_nationkey", metric.alias("metric"), group.alias("grp"))


@query("measured_percent", "SELECT l_suppkey, round(CASE WHEN g + f > 0 THEN 100.0 * g / (g + f) END, 6) AS percent FROM (SELECT l_suppkey, sum(l_quantity) FILTER (l_linestatus = 'O') AS g, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1)")
def measured_percent(t):
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    rows = t.lineitem.groupBy("l_suppkey").agg(side("O").alias("g"), side("F").alias("f"))
    return rows.select("l_suppkey", F.round(L.measured_percent(F.col("g"), F.col("f")), 6).alias("percent"))


@query("standard_error", "SELECT p_brand, round(stddev_samp(p_retailprice) / sqrt(count(p_retailprice)), 6) AS se FROM part GROUP BY 1")
def standard_error(t):
    return t.part.groupBy("p_brand").agg(F.round(L.standard_error("p_retailprice"), 6).alias("se"))


@query("depth_matrix", "SELECT l_partkey AS site, sum(CASE WHEN l_suppkey % 4 = 0 THEN l_quantity END) AS d0, sum(CASE WHEN l_suppkey % 4 = 1 THEN l_quantity END) AS d1, sum(CASE WHEN l_suppkey % 4 = 2 THEN l_quantity END) AS d2, sum(CASE WHEN l_suppkey % 4 = 3 THEN l_quantity END) AS d3 FROM lineitem GROUP BY 1")
def depth_matrix(t):
    rows = t.lineitem.withColumn("s", F.concat(F.lit("d"), (F.col("l_suppkey") % 4).cast("string")))
    return rows.groupBy(F.col("l_partkey").alias("site")).pivot("s", ["d0", "d1", "d2", "d3"]).agg(F.sum("l_quantity"))


@query("row_ids", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rowid FROM lineitem")
def row_ids(t):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).cast("long").alias("rowid"))


@query("keep_first", "SELECT l_partkey, l_shipdate, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rk FROM lineitem) WHERE rk = 1")
def keep_first(t):
    from tagtally.operators.variants import first_rows

    return first_rows(t.lineitem, ["l_partkey"], F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_shipdate", "l_orderkey")
