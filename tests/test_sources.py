"""Scans and sinks round trip, and the command line end to end."""

import gzip
import struct

import pytest

from tagtally.schemas import MissingColumns, require_columns
from tagtally.sources import files

SAM = "@HD\tVN:1.6\nr1_AAC\t0\tt1\t5\t30\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:-3\tNM:i:1\nr1_AAC\t256\tt2\t9\t30\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:2\tRX:Z:GGG\tAS:i:-3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\n"


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    rows = files.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()
    assert [(r.qname, r["as"], r.nm, r.rx) for r in rows] == [("r1_AAC", -3, 1, None), ("r1_AAC", -3, 2, "GGG"), ("r2", None, None, None)]
    files.write_sam(files.read_sam(spark, str(tmp_path / "a.sam")), str(tmp_path / "out"))
    assert files.read_sam(spark, str(tmp_path / "out")).count() == 3


def test_bam(spark, tmp_path):
    name, seq = b"r1_AAC\0", "ACGT"
    packed = bytes([(1 << 4) | 2, (4 << 4) | 8])
    tags = b"ASc" + struct.pack("<b", -3) + b"NMC" + bytes([2]) + b"RXZGGG\0" + b"XBBc" + struct.pack("<i", 2) + b"\1\2"
    body = struct.pack("<iiBBHHHiiii", 0, 4, len(name), 30, 0, 1, 0, len(seq), -1, -1, 0) + name + struct.pack("<I", 4 << 4) + packed + bytes([40] * 4) + tags
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"t1\0" + struct.pack("<i", 100) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    r = files.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (r.qname, r.rname, r.pos, r.cigar, r.seq, r.qual, r["as"], r.nm, r.rx) == ("r1_AAC", "t1", 5, "4M", "ACGT", "IIII", -3, 2, "GGG")


def test_sequences_and_reads(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nT\n>y\nGG\n")
    assert {(r.id, r.seq) for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("x", "ACGT"), ("y", "GG")}
    text = "@q1 c\n" + "ACGTACGTACGT" + "C" * 20 + "A" * 12 + "\n+\n" + "I" * 44 + "\n@q2\nACGT\n+\n@III\n"
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write(text)
    reads = files.read_fastq(spark, str(tmp_path / "a.fastq.gz"))
    assert {(r.qname, len(r.seq), len(r.qual)) for r in reads.collect()} == {("q1", 44, 44), ("q2", 4, 4)}
    assert [(r.qname, r.seq) for r in files.trim_reads(reads).collect()] == [("q1_ACGTACGTACGT", "C" * 20)]


def test_tables(spark, tmp_path):
    (tmp_path / "L1i.tsv").write_text("transcript\tcount\na\t1.5\nb\tNA\n")
    assert {(r["transcript"], r["count"], r["sample"]) for r in files.read_counts(spark, str(tmp_path / "L1i.tsv")).collect()} == {("a", 1.5, "L1i"), ("b", None, "L1i")}
    (tmp_path / "spk_1i.txt").write_text("t\t1\ta\t9,1,2,3,3,0,0,0,0,0\n")
    r = files.read_pileup(spark, str(tmp_path / "spk_1i.txt")).first()
    assert (r.sample, r.ref_base, r.depth, r.T) == ("spk_1i", "A", 9, 3)
    (tmp_path / "m.csv").write_text("id,s 1,s2\nx,1,NA\n")
    assert {(r["feature"], r["sample"], r["count"]) for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("x", "s 1", 1.0), ("x", "s2", None)}
    (tmp_path / "kv.tsv").write_text("l\tk\t2\n")
    assert files.read_key_values(spark, str(tmp_path / "kv.tsv")).first().value == 2.0
    with pytest.raises(MissingColumns):
        require_columns(spark.range(1), "x")


def test_settings_and_markers(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: 3\n  f: yes\n  t: '{name}_x'\n")
    c = files.Settings.load(spark, f"file://{tmp_path}/c.yaml")
    assert c.integer("a.b", 0) == 3 and c.flag("a.f") and c.template("a.t", name="q") == "q_x" and c.get("a.z.q", 7) == 7
    with pytest.raises(FileNotFoundError):
        files.Settings.load(spark, f"file://{tmp_path}/none.yaml")
    m = f"file://{tmp_path}/done"
    assert files.read_marker(spark, m) is None
    files.write_marker(spark, m, {"k": 1})
    files.write_marker(spark, m, {"k": 2})
    assert files.read_marker(spark, m) == {"k": 2}
    (tmp_path / "other").write_text("completed\nnot json")
    assert files.read_marker(spark, f"file://{tmp_path}/other") == {}
    (tmp_path / "half").write_text("compl")
    assert files.read_marker(spark, f"file://{tmp_path}/half") is None
    once = f"file://{tmp_path}/once"
    assert files.write_once(spark.range(3), once, {"p": [1]}) and not files.write_once(spark.range(4), once, {"p": [1]}) and files.write_once(spark.range(5), once, {"p": [2]})
    assert spark.read.parquet(once).count() == 5


def test_command_line(spark, tmp_path):
    from tagtally import cli

    lines = []
    for i in range(40):
        lines.append(f"r{i}_U{i % 9}\t0\tt{i % 3}\t5\t30\t4M\t*\t0\t0\tACG{'ACGT'[i % 4]}\tIIII\tAS:i:{-i % 4}\tNM:i:1")
        lines.append(f"r{i}_U{i % 9}\t256\tt{(i + 1) % 3}\t5\t30\t4M\t*\t0\t0\tACG{'ACGT'[i % 4]}\tIIII\tAS:i:-1\tNM:i:1")
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    a = str(tmp_path / "a.sam")
    cli.main([a, "--phase", "all", "--out-counts", str(tmp_path / "c"), "--out-sam", str(tmp_path / "d"), "--out-hard", str(tmp_path / "h"), "--out-groups", str(tmp_path / "g")])
    counts = files.read_counts(spark, str(tmp_path / "c")).agg({"count": "sum"}).first()[0]
    molecules = 36
    assert counts == pytest.approx(molecules, abs=1e-4) and files.read_sam(spark, str(tmp_path / "d")).count() == molecules
    cli.main([a, "--phase", "rarefy", "--rarefy-out", str(tmp_path / "r")])
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 11
    with pytest.raises(SystemExit):
        cli.arguments([a, "--phase", "em"])


def test_bam_files_are_read_in_splits(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(9000):
        n = rng.randrange(1, 60)
        seq, qual = "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(33 + rng.randrange(0, 41)) for _ in range(n))
        rows.append((f"r{i}_A", rng.choice([0, 16, 2048, 4]), rng.choice(["t1", "t2"]), rng.randrange(1, 9000), i % 255, rng.choice([f"{n}M", "*"]), rng.choice(["=", "*"]), i % 500, i % 300 - 150, seq, rng.choice(["*", qual]), f"AS:i:{-(i % 30)}\tXN:Z:a b\tXB:B:s,1,-2,3\tXA:A:q\tXF:f:0.5"))
    frame = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string").repartition(3)
    header = ["@HD\tVN:1.6", "@SQ\tSN:t1\tLN:10000", "@SQ\tSN:t2\tLN:10000"]
    path = str(tmp_path / "x.bam")
    files.write_bam(frame, path, files.program_line(header, "x"))
    assert files.read_header(spark, path) == files.program_line(header, "x")
    whole = gzip.decompress((tmp_path / "x.bam").read_bytes())
    assert whole[:4] == b"BAM\1" and sorted(map(tuple, files.read_bam(spark, path).select(*frame.columns).collect())) == sorted(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = files.read_bam(spark, path)
        assert read.rdd.getNumPartitions() > 3 and sorted(map(tuple, read.select(*frame.columns).collect())) == sorted(rows)
        (tmp_path / "r.fastq").write_text("".join(f"@q{i} c\n{'ACGT' * (1 + i % 9)}\n+\n{'@I@I' * (1 + i % 9)}\n" for i in range(9000)))
        reads = files.read_fastq(spark, str(tmp_path / "r.fastq"))
        assert reads.count() == 9000 and reads.where("length(seq) <> length(qual) or qname not like 'q%'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # A file with other block headers is read whole.
    (tmp_path / "y.bam").write_bytes(gzip.compress(whole[:5000]) + gzip.compress(whole[5000:]))
    assert files.read_bam(spark, str(tmp_path / "y.bam")).count() == 9000


def test_assigned_alignments(spark, tmp_path):
    """Records without a score may stand for a molecule; fields pass through; the picks' fields replace older ones."""
    from tagtally import cli

    lines = [
        "@SQ\tSN:t1\tLN:50", "@SQ\tSN:t2\tLN:60",
        "a_U1\t256\tt1\t5\t30\t4M\t=\t9\t7\tACGT\tIIII\tXX:Z:first\tHB:Z:old", "b_U1\t0\tt1\t6\t30\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:-1\tNM:i:0",
        "c_U2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII", "d_U3\t0\tt2\t7\t30\t4M\t*\t0\t0\tGGGG\tIIII", "e\t0\tt2\t8\t30\t4M\t*\t0\t0\tGGGA\tIIII\tAS:i:0",
    ]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    out = {k: str(tmp_path / k) for k in ("c", "k.bam", "u.bam", "s")}
    cli.main([str(tmp_path / "a.sam"), "--out-counts", out["c"], "--out-bam", out["k.bam"], "--keep-unassigned-bam", out["u.bam"], "--out-sam", out["s"], "--quiet"])
    kept = files.read_bam(spark, out["k.bam"]).collect()
    assert [(r.qname, r.flag, r.rname, r.mapq, r.rnext, r.pnext, r.tlen, r.tags) for r in kept] == [("a_U1", 0, "t1", 255, "=", 9, 7, "XX:Z:first\tHP:f:1\tHC:i:1\tHB:Z:hard_assign")]
    assert files.read_header(spark, out["k.bam"])[:2] == lines[:2] and files.read_header(spark, out["k.bam"])[2].startswith("@PG\tID:tagtally")
    assert {r.qname for r in files.read_bam(spark, out["u.bam"]).collect()} == {"c_U2", "d_U3", "e"}
    text = "".join((tmp_path / "s" / f).read_text() for f in sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("part-")))
    assert text.startswith("@SQ") and "HB:Z:hard_assign" in text
    cli.main([str(tmp_path / "a.sam"), "--phase", "dedup", "--out-sam", out["s"], "--no-tags", "--quiet"])
    assert files.read_sam(spark, out["s"]).first().tags == "XX:Z:first\tHB:Z:old"


def test_small_sinks(spark, tmp_path):
    assert files.write_once(spark.range(3), str(tmp_path / "once")) and not files.write_once(spark.range(9), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    (tmp_path / "h.csv").write_text("a,b\n1,2\n")
    assert files.sniff_columns(spark, str(tmp_path / "h.csv")) == ["a", "b"]
    files.write_sorted(spark.range(50).selectExpr("concat('c', id % 3) rname", "cast(50 - id as int) pos"), str(tmp_path / "sorted"))
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 50
