"""Files of reads and sequences in ranges of any size."""

import gzip
import random

import pytest

from tagtally.sources import blocks, files, reads, stores


def written(rng, n, end="\n"):
    rows, text = [], []
    for i in range(n):
        k = rng.randrange(0, 80)
        seq, qual = "".join(rng.choices("ACGTN", k=k)), "".join(rng.choices("@+I#", k=k))
        name = f"q{i}" + rng.choice(["@1", "", "/1"])
        rows.append((name, seq, qual))
        text.append(f"@{name}{rng.choice(['', ' @x + y', ' 1'])}{end}{seq}{end}+{rng.choice(['', name])}{end}{qual}{end}")
    return rows, "".join(text)


def ranged(path, span):
    size, out = path.stat().st_size, []
    for a in range(0, size, span):
        with stores.opened(str(path)) as stream:
            head = bytes(stream.read(4))
            b = min(a + span, size)
            pieces = reads.block_pieces(blocks.Blocks(stream, size, "x"), a, b) if head[:2] == b"\x1f\x8b" else reads.plain_pieces(stream, size, a, b)
            for batch in reads.reads_of(pieces, a == 0, "x"):
                out += [tuple(r.values()) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("kind", ["plain", "crlf", "blocks", "no last end"])
def test_every_range_size_gives_the_same_reads(tmp_path, kind):
    rng = random.Random(3)
    rows, text = written(rng, 300, "\r\n" if kind == "crlf" else "\n")
    data = text.encode()
    if kind == "no last end":
        data = data.rstrip(b"\n") if rows[-1][2] else data
    if kind == "blocks":
        at, out = 0, []
        while at < len(data):
            n = rng.randrange(1, 700)
            out.append(blocks.block(data[at : at + n]))
            at += n
        data = b"".join(out) + blocks.END
    path = tmp_path / "x.fastq"
    path.write_bytes(data)
    for span in (len(data) + 1, 5000, 333, 61, 7):
        assert ranged(path, span) == rows, span


def test_read_files_need_no_shuffle(spark, tmp_path):
    rng = random.Random(4)
    rows, text = written(rng, 2000)
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text.encode()[:999]) + gzip.compress(text.encode()[999:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = files.read_fastq(spark, str(tmp_path))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, df.collect())) == sorted(rows + rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("bad", ["@a\nACG\n+\nII\n", "a\nACG\n+\nIII\n", "@a\nACG\n+\n", "@a\nACG\nx\nIII\n"])
def test_what_is_no_read_is_an_error(spark, tmp_path, bad):
    (tmp_path / "x.fastq").write_text("@ok\nA\n+\nI\n" + bad)
    with pytest.raises(Exception, match="read"):
        files.read_fastq(spark, str(tmp_path / "x.fastq")).count()


def test_sequences_begin_at_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a desc A->G here > there\nACGT\nAC\n>b\r\nGG\r\n\n>c only\n")
    (tmp_path / "y.fa.gz").write_bytes(gzip.compress(b">d x>y\nTT\n"))
    got = sorted((r.id, r.seq) for r in files.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("a", "ACGTAC"), ("b", "GG"), ("c", ""), ("d", "TT")]
