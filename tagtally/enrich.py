"""Command line: tables of counts to calls, pileups to tested sites.

``python -m tagtally.enrich calls --counts MATRIX.csv --metadata META.csv --annotation ANN.csv --out FOLDER`` writes for each
group of the metadata both contrasts, all features with their flags, the directional ones and the true positives.
``python -m tagtally.enrich sites --pileups PATTERN --metadata META.csv --out FOLDER`` writes tested variant sites; with
``--fasta`` also their sequence context, log-odds of the hits' bases and the GC permutation null.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tagtally.operators import calls as K
from tagtally.operators import counts as C
from tagtally.operators import statistics as S
from tagtally.operators import variants as V
from tagtally.session import session
from tagtally.sources import files

#: Suffixes of libraries by condition, and families whose counts normalise: fixed values.
SUFFIXES = {"i": "Input", "p": "IP", "h": "Control"}
LONG_RRNA = ["45S ribosomal RNA", "28S ribosomal RNA", "18S ribosomal RNA", "l-rRNA", "s-rRNA"]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    calls = commands.add_parser("calls")
    for name in ("counts", "metadata", "annotation", "out"):
        calls.add_argument(f"--{name}", required=True)
    calls.add_argument("--least-change", type=float, default=0.5)
    calls.add_argument("--alpha", type=float, default=0.05)
    sites = commands.add_parser("sites")
    for name in ("pileups", "metadata", "out"):
        sites.add_argument(f"--{name}", required=True)
    sites.add_argument("--fasta")
    sites.add_argument("--observed", default="total_variant")
    sites.add_argument("--least-depth", type=int, default=20)
    sites.add_argument("--least-pairs", type=int, default=4)
    return p.parse_args(argv)


def _trimmed(rows, *columns: str):
    for c in columns:
        rows = rows.withColumn(c, F.trim(F.col(c).cast("string")))
    return rows


def libraries(metadata):
    """A row for each declared library: ``group_name, sample, replicate, condition``."""
    rows = _trimmed(metadata, "sample_name", "group_name").withColumnRenamed("replicates", "replicate")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("condition")) for k, v in SUFFIXES.items()])
    rows = rows.withColumn("x", F.explode(kinds))
    return rows.select("group_name", F.concat("sample_name", "x.k").alias("sample"), F.col("replicate").cast("string").alias("replicate"), "x.condition").distinct()


def calls(spark, a: argparse.Namespace) -> None:
    counts = files.read_matrix(spark, a.counts).where("count is not null")
    declared = libraries(spark.read.csv(a.metadata, header=True, nullValue="NA"))
    long = files.read_inferred(spark, a.annotation).where(F.col("family").isin(LONG_RRNA)).select(F.col("transcript_id").alias("feature")).distinct()
    rows = counts.join(long.withColumn("__long", F.lit(True)), "feature", "left")
    whole = C.complete_groups(declared, counts)
    for group in [r["group_name"] for r in whole.orderBy("group_name").collect()]:  # each group is a design of its own
        own = rows.join(declared.where(F.col("group_name") == group).drop("group_name"), "sample").withColumn("__long", F.coalesce("__long", F.lit(False)))
        kept, factors = K.prepared(own, F.col("__long"))
        files.write_csv(factors, f"{a.out}/size_factors_{group}", ["sample"])
        factors = files.read_inferred(spark, f"{a.out}/size_factors_{group}")
        if factors.where("size_factor is null or size_factor <= 0").count():
            print(f"skipping {group}: a library has no counts of the normalising families", file=sys.stderr)
            continue
        # The fits are written once and read by all that follows; a run that finds them whole does not fit again.
        files.write_once(S.nb_contrasts(kept, factors, K.PAIRS), f"{a.out}/fits_{group}")
        fits = spark.read.parquet(f"{a.out}/fits_{group}")
        for name in K.PAIRS:
            files.write_csv(fits.where(F.col("contrast") == name).drop("contrast"), f"{a.out}/contrast_{name}_{group}", ["padj", "feature"])
        scaled = own.select("sample", "replicate", "condition").distinct().join(factors, "sample")
        files.write_once(K.called(fits, scaled, a.least_change, a.alpha), f"{a.out}/calls_{group}")
        called = spark.read.parquet(f"{a.out}/calls_{group}")
        for name, some in (("all", called), ("directional", called.where("directionality")), ("true_positives", called.where("tp"))):
            files.write_csv(some, f"{a.out}/{name}_{group}", ["padj_delta", "feature"])


def sites(spark, a: argparse.Namespace) -> None:
    rows = V.project(files.read_pileup(spark, a.pileups))
    declared = libraries(spark.read.csv(a.metadata, header=True, nullValue="NA")).select("sample", F.col("replicate").alias("pair"), "condition")
    rows = rows.join(declared, "sample").where("condition in ('IP', 'Input')").withColumn("site", F.concat_ws(":", "chr", "pos", "ref_base"))
    places = rows.select("site", F.col("chr").alias("transcript_id"), "pos", "ref_base").distinct()
    tested = K.variant_sites(V.site_sums(rows, a.observed, "depth"), a.least_depth, a.least_pairs)
    files.write_once(tested.join(places.drop("transcript_id"), "site"), f"{a.out}/sites")
    tested = spark.read.parquet(f"{a.out}/sites")
    files.write_csv(tested, f"{a.out}/sites_csv", ["padj", "site"])
    if a.fasta:
        found = K.motif_sites(tested.select("site", "beta", "padj", "hit"), places.withColumnRenamed("ref_base", "stratum"), files.read_fasta(spark, a.fasta), stratum="stratum")
        for name, part in found.items():
            part.write.mode("overwrite").parquet(f"{a.out}/motif_{name}")


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    {"calls": calls, "sites": sites}[a.command](session(), a)


if __name__ == "__main__":
    main()
