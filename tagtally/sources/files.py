"""Scans and sinks of the domain's files: alignments, reads, sequences, pileups, matrices, settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtally import schemas
from tagtally.operators.variants import unpack
from tagtally.sources.bam import files_of as bam_files
from tagtally.sources.bam import move, read_bam, read_header, read_region, stream_bam, write_bam, write_bam_parts, write_bam_sorted  # noqa: F401
from tagtally.sources.reads import read_fastq  # noqa: F401


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text as alignments. ``ord`` grows with the place in the file, which is semantic for first-record rules."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    p = F.split("value", "\t")
    tags = F.array_join(F.slice(p, F.lit(12), F.greatest(F.size(p) - 11, F.lit(0))), "\t")
    tag = lambda name, kind, pattern: F.nullif(F.regexp_extract(tags, rf"(?:^|\t){name}:{kind}:({pattern})", 1), F.lit(""))
    number = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return rows.select(
        p[0].alias("qname"), number(1).alias("flag"), F.get(p, F.lit(2)).alias("rname"), number(3).alias("pos"), number(4).alias("mapq"), F.get(p, F.lit(5)).alias("cigar"),
        F.get(p, F.lit(6)).alias("rnext"), number(7).alias("pnext"), number(8).alias("tlen"), F.get(p, F.lit(9)).alias("seq"), F.get(p, F.lit(10)).alias("qual"),
        tag("AS", "i", r"-?\d+").try_cast("int").alias("as"), tag("NM", "i", r"-?\d+").try_cast("int").alias("nm"), tag("RX", "Z", r"[^\t]+").alias("rx"), tags.alias("tags"), "ord",
    )


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of SAM text, some for each reference sequence."""
    return [r["value"] for r in spark.read.text(path).where(F.col("value").rlike(r"^@[A-Za-z][A-Za-z](\t|$)")).collect()]


#: What every assigned record says about how its transcript was chosen: a fixed value.
ASSIGNED_BY = "hard_assign"


def tagged(rows: DataFrame, set_tags: bool = True) -> DataFrame:
    """Rows with all their optional fields in ``tags``: those they came with, and the pick's HP, HC and HB instead of older ones."""
    if "tags" in rows.columns:
        old = F.coalesce("tags", F.lit(""))
    else:
        known = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:{k}:"), F.col(c).cast("string"))) for c, t, k in (("as", "AS", "i"), ("nm", "NM", "i"), ("rx", "RX", "Z")) if c in rows.columns]
        old = F.concat_ws("\t", *known)
    if set_tags and "posterior" in rows.columns:
        new = [F.concat(F.lit("HP:f:"), F.col("posterior").cast("string")), F.concat(F.lit("HC:i:"), F.col("tie_count").cast("string")), F.lit(f"HB:Z:{ASSIGNED_BY}")]
        kept = F.filter(F.split(old, "\t"), lambda x: (F.length(x) > 0) & ~x.rlike("^H[PCB]:"))
        old = F.array_join(F.concat(kept, F.array(*new)), "\t")
    return rows.withColumn("tags", old)


def program_line(header: list[str], command: str, version: str = "0.2") -> list[str]:
    """The header with a line for this program."""
    return [*header, f"@PG\tID:tagtally\tPN:tagtally\tVN:{version}\tCL:{command}"]


def write_sam(rows: DataFrame, path: str, header: list[str] | None = None, set_tags: bool = True) -> None:
    """Alignments as SAM text; the header is the beginning of the first part, so that parts in order are one file."""
    rows = tagged(rows, set_tags)
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in rows.columns else F.lit(d)
    line = F.concat_ws("\t", *[text(c, d) for c, d in (("qname", "*"), ("flag", "0"), ("rname", "*"), ("pos", "0"), ("mapq", "255"), ("cigar", "*"), ("rnext", "*"), ("pnext", "0"), ("tlen", "0"), ("seq", "*"), ("qual", "*"))], F.when(F.length("tags") > 0, F.col("tags")))
    out = rows.select(line.alias("value"))
    if header:
        out = rows.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).unionByName(out)
    out.write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records ``id, seq``: the identifier up to the first white space, the sequence without line ends.

    A record begins with ">" at the begin of a line; elsewhere that letter is part of a name's description.
    """
    rows = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    value = F.regexp_replace("value", "^>", "")  # the first record of a file has no line end before it
    head = F.substring_index(value, "\n", 1)
    body = F.substring(value, F.length(head) + 2, F.length(value))
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def trim_reads(reads: DataFrame, umi: int = 12, adapters: tuple[str, ...] = ("A{10}", "G{10}"), least_quality: int = 20, least_length: int = 15) -> DataFrame:
    """Tag moved into the name, 3' adapters and low-quality ends cut, short reads dropped.

    Adapters are patterns that must match; error-tolerant alignment stays with the external trimmers.
    """
    rows = reads.select(F.concat_ws("_", "qname", F.substring("seq", 1, umi)).alias("qname"), F.substring("seq", umi + 1, 1 << 30).alias("seq"), F.substring("qual", umi + 1, 1 << 30).alias("qual"))
    for a in adapters:
        hit = F.regexp_instr("seq", F.lit(f"({a}).*$"))
        keep = F.when(hit > 0, hit - 1).otherwise(F.length("seq"))
        rows = rows.select("qname", F.substring("seq", F.lit(1), keep).alias("seq"), F.substring("qual", F.lit(1), keep).alias("qual"))
    if least_quality:
        good = F.regexp_replace("qual", f"[{chr(33)}-{chr(32 + least_quality)}]+$", "")
        rows = rows.select("qname", F.substring("seq", F.lit(1), F.length(good)).alias("seq"), good.alias("qual"))
    return rows.where(F.length("seq") >= least_length)


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Packed pileups as named counts, with the library from the file's name."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.PILEUP).withColumn("sample", _stem())
    return unpack(rows.withColumn("ref_base", F.upper("ref_base")))


def _stem():
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``transcript, count, sample`` of tab-separated files; the sample is the file's stem."""
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.COUNTS, nullValue="NA").withColumn("sample", _stem())


def write_counts(counts: DataFrame, path: str) -> None:
    """Transcripts in order with six decimals, one file: a row for each transcript."""
    counts.orderBy("transcript").select("transcript", F.format_string("%.6f", F.col("count")).alias("count")).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_rarefaction(rows: DataFrame, path: str, sample: str | None = None) -> None:
    rows = rows.orderBy("fraction").select(F.format_string("%.3f", "fraction").alias("fraction"), "reads_included", "unique_umi_seq", F.format_string("%.6f", "saturation").alias("saturation"))
    rows = rows if sample is None else rows.withColumn("sample", F.lit(sample))
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_matrix(spark: SparkSession, path: str, key: str = "feature", sep: str = ",") -> DataFrame:
    """A wide matrix as long rows ``feature, sample, count``; NA is NULL."""
    wide = spark.read.csv(path, sep=sep, header=True, nullValue="NA")
    first, rest = wide.columns[0], wide.columns[1:]
    values = [F.col(f"`{c}`").try_cast("double").alias(c) for c in rest]
    return wide.select(F.col(f"`{first}`").alias(key), *values).unpivot([key], rest, "sample", "count")


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A delimited file by an explicit schema, NA as NULL."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, nullValue="NA", enforceSchema=False)


def read_key_values(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=False, schema="label string, key string, value double", nullValue="NA")


def write_sorted(rows: DataFrame, path: str, chr_column: str = "rname", pos: str = "pos") -> None:
    """Coordinate-sorted Parquet: ranges over the key, sorted within files."""
    rows.repartitionByRange(chr_column, pos).sortWithinPartitions(chr_column, pos).write.mode("overwrite").parquet(path)


def write_by_name(rows: DataFrame, path: str, name: str = "qname") -> None:
    """Name-sorted Parquet: all records of a read lie together in one file."""
    rows.repartitionByRange(name).sortWithinPartitions(name).write.mode("overwrite").parquet(path)


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file's text through Spark's file system; None if there is no such file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return None
    stream = store.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_marker(spark: SparkSession, path: str, meta: dict) -> None:
    """Completion marker with the run's parameters, beside its tables in their store; it gets its name when it is whole."""
    jvm = spark.sparkContext._jvm
    p, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = store.create(draft, True)
    stream.write(bytearray(("completed\n" + json.dumps(meta, sort_keys=True)).encode()))
    stream.close()
    store.delete(p, False)
    store.rename(draft, p)


def read_marker(spark: SparkSession, path: str) -> dict | None:
    """Parameters of a finished run; NULL without a marker, empty if its parameters cannot be read."""
    text = _text(spark, path)
    if text is None or text.partition("\n")[0] != "completed":
        return None
    try:
        return json.loads(text.partition("\n")[2])
    except ValueError:
        return {}


class Settings:
    """Nested settings with dotted paths, typed getters and ``{name}`` templates."""

    def __init__(self, values: dict):
        self.values = values

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Settings":
        import yaml

        text = _text(spark, path)
        if text is None:
            raise FileNotFoundError(path)
        return cls(yaml.safe_load(text) or {})

    def get(self, path: str, default=None):
        at = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at or at[part] is None:
                return default
            at = at[part]
        return at

    def number(self, path: str, default: float) -> float:
        return float(self.get(path, default))

    def integer(self, path: str, default: int) -> int:
        return int(self.get(path, default))

    def flag(self, path: str, default: bool = False) -> bool:
        value = self.get(path, default)
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")

    def template(self, path: str, default: str = "", **names) -> str:
        return str(self.get(path, default)).format(**names)


def sniff_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file; only its header is read."""
    return spark.read.csv(path, sep=sep, header=True).limit(0).columns


def write_once(rows: DataFrame, path: str, meta: dict | None = None) -> bool:
    """Write Parquet unless a finished write with the same parameters is there already; returns whether it wrote.

    Finished is what has Spark's success file and, with ``meta``, a marker beside it with the same parameters.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    whole = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if whole and (meta is None or read_marker(spark, f"{path}.done") == json.loads(json.dumps(meta))):
        return False
    rows.write.mode("overwrite").parquet(path)
    if meta is not None:
        write_marker(spark, f"{path}.done", meta)
    return True


def read_inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header, its types inferred from all rows, NA as NULL."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, nullValue="NA")


def found_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder whose names a regular expression finds, in order of name."""
    import re

    return sorted((f for f in bam_files(spark, folder) if re.search(pattern, f.rsplit("/", 1)[-1])), key=lambda f: f.rsplit("/", 1)[-1])


def read_found(spark: SparkSession, folder: str, pattern: str, group: str, schema: str, sep: str = "\t") -> DataFrame:
    """All found files in one scan, with ``group``: the first group of that expression in the file's name."""
    files = found_files(spark, folder, pattern)
    if not files:
        return spark.createDataFrame([], f"{schema}, `group` string")
    rows = spark.read.csv(files, sep=sep, header=True, schema=schema, nullValue="NA")
    return rows.withColumn("group", F.regexp_extract(F.col("_metadata.file_name"), group, 1))


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None, sep: str = ",") -> None:
    """Rows as delimited text with a header, NULL as NA; in one order over all parts if asked for."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="NA")


def save_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """Several tables that belong together, each as Parquet under its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
