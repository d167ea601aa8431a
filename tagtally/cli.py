"""Command line: abundances, assignment, deduplication and rarefaction of alignment files.

``python -m tagtally.cli ALIGNMENTS --phase em|dedup|all|rarefy ...``; ALIGNMENTS is SAM text, BAM or Parquet.
``--out-bam -`` writes to standard output; ``--out-sorted FOLDER`` writes files in the order of places, with indexes.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import functions as F

from tagtally.functions.strings import uniform_udf
from tagtally.operators import reads as R
from tagtally.session import session, shared_folder
from tagtally.sources import files

GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("alignments")
    p.add_argument("--phase", choices=["em", "dedup", "all", "rarefy"], default="all")
    for name in ("out-counts", "out-groups", "out-hard", "out-bam", "out-sam", "out-sorted", "keep-unassigned-bam", "out-unassigned", "rarefy-out"):
        p.add_argument(f"--{name}")
    p.add_argument("--min-mapq", type=int, default=0)
    p.add_argument("--umi-from", choices=["qname", "RX"], default="qname")
    p.add_argument("--qname-umi-split", default="_")
    p.add_argument("--umi-length", type=int)
    p.add_argument("--weight-mode", choices=["AS", "NM"], default="AS")
    p.add_argument("--beta", type=float, default=0.1)
    p.add_argument("--gamma", type=float, default=1.0)
    p.add_argument("--max-iters", type=int, default=200)
    p.add_argument("--tol", type=float, default=1e-6)
    p.add_argument("--posterior-eps", type=float, default=1e-12)
    p.add_argument("--assigned-mapq", type=int, default=255)
    p.add_argument("--perread-topk", type=int, default=0)
    p.add_argument("--perread-delta-as", type=int)
    p.add_argument("--perread-delta-nm", type=int)
    p.add_argument("--rarefy-fractions", type=lambda s: [float(x) for x in s.split(",")], default=GRID)
    p.add_argument("--rarefy-seed", type=int, default=1)
    p.add_argument("--rarefy-one-per-read", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--no-tags", action="store_true")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    needs = {"em": [["out_counts"]], "all": [["out_counts"], ["out_bam", "out_sam", "out_sorted"]], "dedup": [["out_bam", "out_sam", "out_sorted"]], "rarefy": [["rarefy_out"]]}[a.phase]
    if missing := [n for n in needs if not any(getattr(a, x) for x in n)]:
        p.error(f"--phase {a.phase} needs --" + ", --".join(" or --".join(x.replace("_", "-") for x in n) for n in missing))
    return a


def header_of(spark, path: str) -> list[str]:
    return files.read_header(spark, path) if path.endswith(".bam") else files.sam_header(spark, path) if path.endswith(".sam") else []


def with_references(header: list[str], rows) -> list[str]:
    """A header whose sequence lines name all references of the rows; lengths that no line states are those of the rows."""
    known = {x.split("SN:", 1)[1].split("\t")[0] for x in header if x.startswith("@SQ") and "SN:" in x}
    ends = rows.where("rname <> '*'").groupBy("rname").agg(F.max(F.col("pos") + F.length("seq")).alias("n")).orderBy("rname").collect()
    return [*header, *[f"@SQ\tSN:{r['rname']}\tLN:{max(1, r['n'] or 1)}" for r in ends if r["rname"] not in known]]


def write_alignments(rows, header: list[str], a, bam: str | None, sam: str | None) -> None:
    if bam == "-":
        files.stream_bam(files.tagged(rows, not a.no_tags), sys.stdout.buffer, f"{shared_folder(rows.sparkSession)}/out-{uuid.uuid4().hex}", header)
    elif bam:
        files.write_bam(files.tagged(rows, not a.no_tags), bam, header)
    if sam:
        files.write_sam(rows, sam, header, not a.no_tags)


def scan(spark, path: str):
    if path.endswith(".bam"):
        return files.read_bam(spark, path)
    return files.read_sam(spark, path) if path.endswith(".sam") else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = session()
    ingested = R.ingest(scan(spark, a.alignments), a.min_mapq, a.umi_from, a.qname_umi_split, a.umi_length)
    mode = a.weight_mode
    rows = R.prune_delta(R.kept(ingested), mode, a.perread_delta_as if mode == "AS" else a.perread_delta_nm)
    if a.phase == "rarefy":
        if a.rarefy_one_per_read:
            rows = R.top_candidates(rows, 1, mode)
        files.write_rarefaction(R.rarefy(rows, a.rarefy_fractions, uniform_udf(a.rarefy_seed)(F.col("qname")), None if a.rarefy_one_per_read else "qname"), a.rarefy_out)
        return
    best = R.best_per_key(R.top_candidates(rows, a.perread_topk, mode)).persist()
    edges = R.weighted(best, mode, a.beta, a.gamma)
    counts = R.estimate(edges, a.max_iters, a.tol)
    if a.out_counts:
        files.write_counts(counts, a.out_counts)
    # Assignment uses the counts as they are written.
    post = R.posterior(edges, counts.withColumn("count", F.round("count", 6)))
    if a.out_groups:
        R.posterior_text(post).write.mode("overwrite").csv(a.out_groups, sep="\t", header=True)
    picks = R.hard_pick(post, mode, a.posterior_eps).persist()
    if a.out_hard:
        R.assigned(best, picks).write.mode("overwrite").csv(a.out_hard, sep="\t", header=True)
    if a.phase in ("dedup", "all"):
        header = with_references(files.program_line(header_of(spark, a.alignments), " ".join(["tagtally", *(argv or sys.argv[1:])])), ingested)
        kept = R.deduplicate(R.named(ingested), picks, ["ord"], a.assigned_mapq).persist()
        write_alignments(kept.orderBy("ord"), header, a, a.out_bam, a.out_sam)
        if a.out_sorted:
            files.write_bam_sorted(files.tagged(kept, not a.no_tags), a.out_sorted, header)
        if not a.quiet:
            print(f"kept {kept.count()} records", file=sys.stderr)
        kept.unpersist()
        if a.out_unassigned or a.keep_unassigned_bam:
            gone = ingested.where("skip_reason is not null and skip_reason not in ('no_score', 'no_rname')").unionByName(R.unassigned(R.named(ingested), picks))
            write_alignments(gone, header, a, a.keep_unassigned_bam, a.out_unassigned)
    picks.unpersist()
    best.unpersist()


if __name__ == "__main__":
    main()
