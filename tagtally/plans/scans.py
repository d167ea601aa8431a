"""Queries that write the domain's files from the provided tables, in a shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagtally.operators import reads as R
from tagtally.operators import variants as V
from tagtally.plans.registry import query
from tagtally.session import shared_folder
from tagtally.sources import files

HEADER = ["@HD\tVN:1.6\tSO:unsorted"]

RECORDS = """rec AS (SELECT concat('r', l_orderkey, '_', o_custkey) AS qname, CAST(CASE WHEN l_linenumber = 7 THEN 4 WHEN l_linenumber > 1 THEN 256 ELSE 16 END AS INTEGER) AS flag, concat('t', l_suppkey) AS rname,
    CAST(l_partkey % 5000 + 1 AS INTEGER) AS pos, CAST(l_linenumber * 5 AS INTEGER) AS mapq, CASE WHEN l_linenumber % 2 = 0 THEN '2S10M' ELSE '12M' END AS cigar, '=' AS rnext, CAST(l_partkey % 5000 + 40 AS INTEGER) AS pnext, CAST(52 AS INTEGER) AS tlen,
    substr('ACGTTGCAACGT', CAST(l_linenumber AS INTEGER), 6) || substr('TTGACCGATAGC', CAST(o_custkey % 7 + 1 AS INTEGER), 6) AS seq, 'IIIIIIHHHHHH' AS qual, -CAST(floor(l_quantity) AS INTEGER) AS a_s, CAST(l_linenumber AS INTEGER) AS nm, CASE WHEN l_linenumber % 3 = 0 THEN concat('RX', o_custkey) END AS rx
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FIELDS = "qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, a_s, nm, rx"
TAGS = "concat('AS:i:', a_s, chr(9), 'XN:Z:kept as it is', chr(9), 'NM:i:', nm, CASE WHEN rx IS NULL THEN '' ELSE concat(chr(9), 'RX:Z:', rx) END)"


def _records(t):
    n, c = F.col("l_linenumber").cast("int"), F.col("o_custkey")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("_"), c).alias("qname"), F.when(n == 7, 4).when(n > 1, 256).otherwise(16).alias("flag"), F.concat(F.lit("t"), F.col("l_suppkey")).alias("rname"),
        (F.col("l_partkey") % 5000 + 1).cast("int").alias("pos"), (n * 5).alias("mapq"), F.when(n % 2 == 0, "2S10M").otherwise("12M").alias("cigar"), F.lit("=").alias("rnext"), (F.col("l_partkey") % 5000 + 40).cast("int").alias("pnext"), F.lit(52).alias("tlen"),
        F.concat(F.substring(F.lit("ACGTTGCAACGT"), n, F.lit(6)), F.substring(F.lit("TTGACCGATAGC"), (c % 7 + 1).cast("int"), F.lit(6))).alias("seq"), F.lit("IIIIIIHHHHHH").alias("qual"),
        (-F.floor("l_quantity")).cast("int").alias("as"), n.alias("nm"), F.when(n % 3 == 0, F.concat(F.lit("RX"), c)).alias("rx"),
    )
    tags = F.concat_ws("\t", F.concat(F.lit("AS:i:"), F.col("as")), F.lit("XN:Z:kept as it is"), F.concat(F.lit("NM:i:"), F.col("nm")), F.when(F.col("rx").isNotNull(), F.concat(F.lit("RX:Z:"), F.col("rx"))))
    return rows.withColumn("tags", tags)


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/scans/{uuid.uuid4().hex}/{name}"


def _header(t) -> list[str]:
    names = sorted(r["l_suppkey"] for r in t.lineitem.select("l_suppkey").distinct().collect())  # a line for each reference
    return [*HEADER, *[f"@SQ\tSN:t{x}\tLN:10000" for x in names]]


def _listed(rows):
    return rows.select(*[F.col("as").alias("a_s") if c == "a_s" else F.col(c) for c in FIELDS.split(", ")], "tags")


@query("sam_round_trip", f"WITH {RECORDS} SELECT {FIELDS}, {TAGS} AS tags FROM rec")
def sam_round_trip(t):
    path = _place(t, "a.sam")
    files.write_sam(_records(t), path, files.program_line(_header(t), "sam_round_trip"))
    return _listed(files.read_sam(t.spark, path))


@query("bam_round_trip", f"WITH {RECORDS} SELECT {FIELDS}, {TAGS} AS tags FROM rec")
def bam_round_trip(t):
    path = _place(t, "a.bam")
    files.write_bam_parts(_records(t), path, files.program_line(_header(t), "bam_round_trip"))
    return _listed(files.read_bam(t.spark, path))


@query("region_scan", f"""WITH {RECORDS} SELECT {FIELDS}, {TAGS} AS tags FROM rec WHERE rname = (SELECT min(rname) FROM rec) AND pos <= 400 AND pos + CASE WHEN cigar = '12M' THEN 12 ELSE 10 END > 100""")
def region_scan(t):
    path = _place(t, "sorted")
    header = _header(t)
    files.write_bam_sorted(_records(t), path, header)
    first = min(x.split("SN:")[1].split("\t")[0] for x in header if "SN:" in x)
    return _listed(files.read_region(t.spark, path, first, 100, 400))


@query("indexed_order", f"""WITH {RECORDS} SELECT rname, count(*) AS n, min(pos) AS least, max(pos) AS most, CAST(0 AS BIGINT) AS falls FROM rec GROUP BY rname""")
def indexed_order(t):
    path = _place(t, "sorted")
    files.write_bam_sorted(_records(t), path, _header(t))
    rows = files.read_bam(t.spark, path)
    rows = rows.withColumn("falls", (F.lag("pos").over(Window.partitionBy("rname").orderBy("ord")) > F.col("pos")).cast("long"))
    return rows.groupBy("rname").agg(F.count("*").alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.coalesce(F.sum("falls"), F.lit(0)).alias("falls"))


@query("bam_header", "SELECT concat('@SQ', chr(9), 'SN:t', l_suppkey, chr(9), 'LN:10000') AS line FROM (SELECT DISTINCT l_suppkey FROM lineitem) UNION ALL SELECT concat('@HD', chr(9), 'VN:1.6', chr(9), 'SO:unsorted') UNION ALL SELECT concat('@PG', chr(9), 'ID:tagtally', chr(9), 'PN:tagtally', chr(9), 'VN:0.2', chr(9), 'CL:x')")
def bam_header(t):
    path = _place(t, "a.bam")
    files.write_bam_parts(_records(t).limit(0), path, files.program_line(_header(t), "x"))
    return t.spark.createDataFrame([(x,) for x in files.read_header(t.spark, path)], "line string")


@query("skip_reasons_of_files", f"""WITH {RECORDS} SELECT CASE WHEN flag = 4 THEN 'unmapped' WHEN mapq < 10 THEN 'low_mapq' ELSE 'kept' END AS reason, count(*) AS n FROM rec GROUP BY 1""")
def skip_reasons_of_files(t):
    path = _place(t, "a.bam")
    files.write_bam_parts(_records(t), path, _header(t))
    return R.skip_counts(R.ingest(files.read_bam(t.spark, path), 10))


@query("assigned_records_out", f"""WITH {RECORDS}, one AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY nm, a_s, pos, rname) AS k FROM rec)
    SELECT qname, CAST(CASE WHEN flag = 256 THEN 0 ELSE flag END AS INTEGER) AS flag, CAST(255 AS INTEGER) AS mapq, concat({TAGS}, chr(9), 'HP:f:0.5', chr(9), 'HC:i:2', chr(9), 'HB:Z:hard_assign') AS tags FROM one WHERE k = 1""")
def assigned_records_out(t):
    path = _place(t, "a.bam")
    rows = _records(t).withColumn("umi", F.lit("u"))
    picks = rows.groupBy("umi", F.col("qname").alias("seq")).agg(F.lit("all").alias("transcript"), F.lit(0.5).alias("posterior"), F.lit(2).alias("tie_count"), F.lit("posterior->AS").alias("tie_break"))
    one = R.deduplicate(rows.withColumn("s", F.col("seq")).withColumn("r", F.col("rname")).withColumn("seq", F.col("qname")).withColumn("rname", F.lit("all")), picks, ["nm", "as", "pos", "r"])
    files.write_bam_parts(files.tagged(one.withColumn("seq", F.col("s")).withColumn("rname", F.col("r"))), path, _header(t))
    return files.read_bam(t.spark, path).select("qname", "flag", "mapq", "tags")


@query("fasta_scan", "SELECT concat('d', id) AS id, seq FROM {seqs} WHERE length(seq) > 0")
def fasta_scan(t):
    path = _place(t, "a.fa")
    body = F.regexp_replace("seq", "(.{60})", "$1\n")
    t.seqs.where("length(seq) > 0").select(F.concat(F.lit(">d"), F.col("id"), F.lit(" a sequence, A->G > here\n"), body).alias("value")).write.text(path)
    return files.read_fasta(t.spark, path)


#: Every stretch of 60 letters of every text is a read; those of 30 and more are kept.
READS = """SELECT concat('q', id, '_', k) AS qname, id, k, substr(seq, CAST(60 * k + 1 AS INTEGER), 60) AS seq FROM (SELECT id, seq, unnest(range(0, CAST((length(seq) + 59) // 60 AS BIGINT))) AS k FROM {seqs})"""
FASTQ = f"f AS (SELECT qname, seq, repeat('I', length(seq)) AS qual FROM ({READS}) WHERE length(seq) >= 30)"


def _reads(t):
    # In one pass over a text: a substring counts its place from the text's begin. Outer, or a filter would cut the text once more.
    rows = t.seqs.select("id", F.posexplode_outer(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0))).alias("k", "seq")).where("seq is not null")
    return rows.select(F.concat(F.lit("q"), "id", F.lit("_"), "k").alias("qname"), "id", "k", "seq")


def _written(t, rows, gzip: bool = False):
    """Reads ``qname, seq, qual`` as a file of four lines each."""
    path = _place(t, "a.fastq")
    lines = rows.select(F.concat(F.lit("@"), F.col("qname"), F.lit(" run 1\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))
    (lines.write.option("compression", "gzip") if gzip else lines.write).text(path)
    return files.read_fastq(t.spark, path)


def _fastq(t, gzip: bool = False):
    return _written(t, _reads(t).where("length(seq) >= 30").withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), gzip)


@query("fastq_scan", f"WITH {FASTQ} SELECT qname, seq, qual FROM f")
def fastq_scan(t):
    return _fastq(t)


@query("fastq_gzip_scan", f"WITH {FASTQ} SELECT count(*) AS reads, sum(length(seq))::BIGINT AS letters, sum(length(qual))::BIGINT AS qualities FROM f")
def fastq_gzip_scan(t):
    return _fastq(t, True).agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("letters"), F.sum(F.length("qual")).alias("qualities"))


@query("trimmed_reads", f"""WITH {FASTQ}, u AS (SELECT concat(qname, '_', substr(seq, 1, 12)) AS qname, substr(seq, 13) AS s FROM f), c AS (SELECT qname, CASE WHEN regexp_matches(s, 'A{{10}}') THEN substr(s, 1, length(regexp_extract(s, '^(.*?)A{{10}}', 1))) ELSE s END AS s FROM u)
    SELECT qname, s AS seq, length(s) AS n FROM c WHERE length(s) >= 15""")
def trimmed_reads(t):
    return files.trim_reads(_fastq(t), adapters=("A{10}",)).select("qname", "seq", F.length("qual").cast("long").alias("n"))


@query("pileup_scan", """SELECT 'lib_i' AS sample, concat('t', l_suppkey) AS chr, CAST(l_linenumber AS INTEGER) AS pos, 'A' AS ref_base, count(*) AS depth, count(*) FILTER (l_returnflag = 'N') AS c, count(*) FILTER (l_returnflag = 'R') AS t FROM lineitem GROUP BY 2, 3""")
def pileup_scan(t):
    path = _place(t, "x")
    counts = t.lineitem.groupBy(F.concat(F.lit("t"), F.col("l_suppkey")).alias("chr"), F.col("l_linenumber").alias("pos")).agg(F.count("*").alias("d"), F.count_if(F.col("l_returnflag") == "N").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("t"))
    packed = F.concat_ws(",", "d", F.lit(0), "c", F.lit(0), "t", *[F.lit(0)] * 5)
    counts.select("chr", "pos", F.lit("a").alias("b"), packed.alias("p")).coalesce(1).write.csv(path, sep="\t", quote="")
    part = next(f for f in files.bam_files(t.spark, path) if "part-" in f)
    target = f"{path}/lib_i.pileup.txt"
    files.move(t.spark, part, target)
    return files.read_pileup(t.spark, target).select("sample", "chr", "pos", "ref_base", F.col("depth").cast("long").alias("depth"), F.col("C").cast("long").alias("c"), F.col("T").cast("long").alias("t"))


@query("counts_sink", "SELECT concat('f', feature) AS transcript, CAST(sum(count) AS DOUBLE) / 8 AS cnt FROM {cnt} GROUP BY 1")
def counts_sink(t):
    path = _place(t, "L1i")
    files.write_counts(t.cnt.groupBy(F.concat(F.lit("f"), F.col("feature")).alias("transcript")).agg((F.sum("count") / 8).alias("count")), path)
    return files.read_counts(t.spark, path).select("transcript", F.col("count").alias("cnt"))


@query("matrix_scan", "SELECT CAST(feature AS VARCHAR) AS feature, sample, CAST(count AS DOUBLE) AS cnt FROM {cnt}")
def matrix_scan(t):
    path = _place(t, "m")
    names = [r["sample"] for r in t.cnt.select("sample").distinct().orderBy("sample").collect()]  # a name for each library
    wide = t.cnt.groupBy("feature").pivot("sample", names).agg(F.first("count"))
    wide.write.csv(path, header=True, nullValue="NA")
    return files.read_matrix(t.spark, path).where("count is not null").select("feature", "sample", F.col("count").alias("cnt"))


@query("key_values_scan", "SELECT concat('b', l_suppkey) AS label, l_returnflag AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def key_values_scan(t):
    path = _place(t, "kv")
    rows = t.lineitem.groupBy(F.concat(F.lit("b"), F.col("l_suppkey")).alias("label"), F.col("l_returnflag").alias("key")).agg(F.count("*").alias("v"))
    rows.write.csv(path, sep="\t")
    return files.read_key_values(t.spark, path)


@query("sorted_sink", f"WITH {RECORDS} SELECT rname, pos, qname, nm FROM rec")
def sorted_sink(t):
    path = _place(t, "s")
    files.write_sorted(_records(t), path)
    return t.spark.read.parquet(path).select("rname", "pos", "qname", "nm")


@query("pileup_of_files", f"""WITH {RECORDS}, b AS (SELECT rname, pos, CASE WHEN cigar = '12M' THEN 0 ELSE 2 END AS skip, seq FROM rec WHERE flag <> 4),
    x AS (SELECT rname AS chr, CAST(pos + k AS INTEGER) AS pos, substr(seq, CAST(skip + k + 1 AS INTEGER), 1) AS base FROM (SELECT *, unnest(range(0, 12 - skip)) AS k FROM b))
    SELECT chr, pos, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM x GROUP BY 1, 2""")
def pileup_of_files(t):
    path = _place(t, "a.bam")
    files.write_bam_parts(_records(t).where("flag <> 4"), path, _header(t))
    rows = V.pileup(files.read_bam(t.spark, path))
    return rows.select("chr", "pos", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.lower()) for c in ("depth", "A", "C", "G", "T")])
