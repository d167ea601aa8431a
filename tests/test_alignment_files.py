"""Alignment files of any writer, in ranges of any size; damage; sorted files with an index."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest

from tagtally.sources import bam, blocks, files, stores

HEADER = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:t1\tLN:1000000", "@SQ\tSN:t2\tLN:50000"]
COLUMNS = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string"


def made(rng, n, size):
    out = []
    for i in range(n):
        k = size(rng)
        seq = "".join(rng.choices("ACGTN", k=k))
        qual = rng.choice(["*", "".join(rng.choices("!5I~", k=k))])
        out.append((f"r{i}_A", rng.choice([0, 16, 256]), rng.choice(["t1", "t2", "*"]), rng.randrange(0, 40_000), i % 250, rng.choice([f"{k}M", "*", f"2S{k - 2}M"]), "*", 0, i - 50, seq, qual, f"AS:i:{-i}\tXZ:Z:{'x' * (i % 7)}\tXB:B:c,1,-2"))
    return out


def raw_of(rows):
    head, at = bam.header_bytes(HEADER)
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    return head + b"".join(bam.encoded(dict(zip(names, r)), at)[0] for r in rows)


def cut(data, rng, sizes, filled=False):
    """Blocks of any lengths and headers, records across their borders."""
    out, at = [], 0
    while at < len(data):
        n = 65_000 if filled else sizes(rng)
        part, at = data[at : at + n], at + n
        made = zlib.compressobj(rng.choice([1, 9]), zlib.DEFLATED, -15)
        packed = made.compress(part) + made.flush()
        more = rng.choice([b"", b"XY\x03\x00abc"])
        head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", rng.choice([0, 99]), rng.choice([0, 2, 4]), rng.choice([3, 255])) + struct.pack("<H", 6 + len(more)) + more + b"BC\x02\x00"
        out.append(head + struct.pack("<H", len(head) + 2 + len(packed) + 8 - 1) + packed + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + blocks.END


def ranged(path, span):
    size = path.stat().st_size
    out = []
    for a in range(0, size, span):
        with stores.opened(str(path)) as stream:
            for batch in bam.range_records(blocks.Blocks(stream, size, str(path)), a, min(a + span, size)):
                out += batch.to_pylist()
    return out


def plain(rows):
    return [tuple(r[c.split(" ")[0]] for c in COLUMNS.split(", ")) for r in rows]


@pytest.mark.parametrize("kind", ["short", "filled", "long", "tiny blocks"])
def test_every_range_size_gives_the_same_rows(tmp_path, kind):
    rng = random.Random(4)
    rows = made(rng, 12, lambda r: r.randrange(100_000, 200_000)) if kind == "long" else made(rng, 3000, lambda r: r.randrange(3, 90))
    path = tmp_path / "x.bam"
    path.write_bytes(cut(raw_of(rows), rng, (lambda r: r.randrange(1, 400)) if kind == "tiny blocks" else (lambda r: r.randrange(1, 60_000)), kind == "filled"))
    size = path.stat().st_size
    for span in (size + 1, 65536, 10_007, max(size // 3, 1)):
        assert plain(ranged(path, span)) == rows, span


def test_the_source_reads_other_writers_files(spark, tmp_path):
    rng = random.Random(5)
    rows = made(rng, 3000, lambda r: r.randrange(3, 90))
    (tmp_path / "a b.bam").write_bytes(cut(raw_of(rows), rng, lambda r: r.randrange(1, 60_000)))
    (tmp_path / "c.bam").write_bytes(gzip.compress(raw_of(rows)[:70_001]) + gzip.compress(raw_of(rows)[70_001:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = files.read_bam(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        assert plain(sorted(read.collect(), key=lambda r: r.ord)) == rows + rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert files.read_header(spark, str(tmp_path / "c.bam")) == files.read_header(spark, str(tmp_path / "a b.bam")) == HEADER


def test_damage_is_an_error(spark, tmp_path):
    rng = random.Random(6)
    whole = cut(raw_of(made(rng, 500, lambda r: 50)), rng, lambda r: 9000)
    path = tmp_path / "x.bam"
    for bad in (whole[:-28], whole[:-40], whole[: len(whole) // 2], whole[:5000] + bytes([whole[5000] ^ 255]) + whole[5001:]):
        path.write_bytes(bad)
        for span in (len(bad), 9_000):
            with pytest.raises(blocks.Damaged):
                ranged(path, span)
    with pytest.raises(Exception, match="block|record"):
        files.read_bam(spark, str(path)).count()
    path.write_bytes(whole[:-28])
    assert files.read_bam(spark, str(path), lenient=True).count() == 500


def test_more_operations_than_a_record_counts(tmp_path):
    cigar = "1M1I" * 40_000
    row = ("long", 0, "t1", 5, 9, cigar, "*", 0, 0, "AC" * 40_000, "*", "NM:i:3")
    path = tmp_path / "x.bam"
    path.write_bytes(cut(raw_of([row]), random.Random(1), lambda r: 60_000))
    assert plain(ranged(path, 70_000)) == [row]


def test_sorted_files_and_regions(spark, tmp_path):
    rng = random.Random(7)
    rows = [r for r in made(rng, 6000, lambda r: r.randrange(3, 90))] + [(f"hot{i}", 0, "t1", 777, 1, "10M", "*", 0, 0, "ACGTACGTAC", "*", "") for i in range(3000)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    path = str(tmp_path / "s")
    files.write_bam_sorted(frame, path, HEADER)
    back = files.read_bam(spark, path).orderBy("ord").collect()
    assert sorted(plain(back)) == sorted(rows) and files.read_header(spark, path)[0] == "@HD\tVN:1.6\tSO:coordinate"
    order = [({"t1": 0, "t2": 1, "*": 2}[r.rname], r.pos) for r in back]
    assert order == sorted(order)
    for name, a, b in (("t1", 700, 800), ("t2", 1, 20_000), ("t1", 39_000, 90_000), ("t2", 45_000, 50_000), ("none", 1, 5)):
        import re

        span = lambda r: sum(int(n) for n, o in re.findall(r"(\d+)([MDN])", r[5])) or 1
        want = [r for r in rows if r[2] == name and max(r[3], 1) <= b and max(r[3], 1) + span(r) - 1 >= a and r[3] > 0]
        got = [r for r in plain(files.read_region(spark, path, name, a, b).collect()) if r[3] > 0]
        assert sorted(got) == sorted(want), (name, a, b)


def test_a_region_reads_only_its_blocks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("concat('r', id) qname", "0 flag", "'t1' rname", "cast(id * 16 + 1 as int) pos", "'10M' cigar", "repeat('ACGTA', 2) seq", "repeat('I', 10) qual", "concat('XX:Z:', sha2(cast(id as string), 256)) tags")
    path = tmp_path / "s"
    files.write_bam_sorted(rows.coalesce(1), str(path), HEADER)
    asked, found, all_blocks = 0, 0, 0
    for part in sorted(path.glob("*.bam")):
        with stores.opened(str(part)) as stream:
            of = blocks.Blocks(stream, part.stat().st_size, str(part))
            index = blocks.Index.loads((path / f"{part.name}.bai").read_bytes())
            found += sum(b.num_rows for b in bam.region_records(of, index, "t1", 500_000, 501_000))
            asked += of.asked
            all_blocks += sum(b.num_rows for b in bam.range_records(of, 0, of.size)) and of.asked - asked
    assert found == len([i for i in range(60_000) if i * 16 < 501_000 and i * 16 + 10 > 500_000]) and asked * 10 < all_blocks


def test_one_file_and_empty_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = made(rng, 400, lambda r: r.randrange(3, 90))
    frame = spark.createDataFrame(rows, COLUMNS).repartition(4)
    files.write_bam(frame, str(tmp_path / "one.bam"), HEADER)
    assert (tmp_path / "one.bam").is_file() and (tmp_path / "one.bam").read_bytes().endswith(blocks.END)
    assert sorted(plain(files.read_bam(spark, str(tmp_path / "one.bam")).collect())) == sorted(rows)
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    for write, name in ((files.write_bam, "e.bam"), (files.write_bam_parts, "e"), (files.write_bam_sorted, "es")):
        write(frame.limit(0), str(tmp_path / name), HEADER)
        assert files.read_bam(spark, str(tmp_path / name)).count() == 0 and files.read_header(spark, str(tmp_path / name))[1:] == HEADER[1:]
    assert files.read_region(spark, str(tmp_path / "es"), "t1", 1, 100).count() == 0
    files.write_bam_parts(frame, str(tmp_path / "p"), HEADER)
    files.write_bam_parts(frame.limit(7).coalesce(1), str(tmp_path / "p"), HEADER)
    assert files.read_bam(spark, str(tmp_path / "p")).count() == 7


def test_standard_output_and_sorted_output(spark, tmp_path, monkeypatch):
    import io
    import sys

    from tagtally import cli

    (tmp_path / "a.sam").write_text("".join(f"r{i}_U{i % 50}\t0\tt{i % 3}\t{90 - i % 80}\t30\t4M\t*\t0\t0\tACG{'ACGT'[i % 4]}\tIIII\tAS:i:0\tNM:i:1\n" for i in range(200)))

    class Out:
        buffer = io.BytesIO()

    monkeypatch.setattr(sys, "stdout", Out)
    cli.main([str(tmp_path / "a.sam"), "--phase", "dedup", "--out-bam", "-", "--out-sorted", str(tmp_path / "s"), "--quiet"])
    monkeypatch.undo()
    (tmp_path / "b.bam").write_bytes(Out.buffer.getvalue())
    got = files.read_bam(spark, str(tmp_path / "b.bam")).collect()
    assert len(got) == len({(r.qname.split("_")[1], r.seq) for r in got}) > 50
    assert sorted(r.qname for r in got) == sorted(r.qname for r in files.read_bam(spark, str(tmp_path / "s")).collect())
    places = [(r.rname, r.pos) for r in files.read_bam(spark, str(tmp_path / "s")).orderBy("ord").collect()]
    assert places == sorted(places)


def _made_up_rows(n):
    import random

    rng = random.Random(5)
    tags = ["AS:i:-5\tXN:Z:kept as it is\tNM:i:3\tRX:Z:RX12", "", "NM:i:300\tXA:A:q\tXF:f:0.1", "AS:Z:x\tRX:i:7", "XB:B:s,1,-2\tAS:i:4", "XH:H:1AE3\tNM:i:1\tNM:i:2", "XZ:Z:\tRX:Z:\u00e4"]
    cigars = ["12M", "2S10M", "*", "3M2D4M1I4M", "5M100000N7M"]
    out = []
    for i in range(n):
        length = rng.choice([0, 1, 7, 12])
        out.append((rng.choice([None, "*", f"q{i}", "q"]), rng.choice([None, 0, 16, 4]), rng.choice(["a", "b", "*", None, "zz"]), rng.choice([0, None, 1, 16384, 70_000 + i]), rng.choice([None, 0, 60]), rng.choice(cigars), rng.choice(["=", "*", "b", None]), rng.choice([None, 0, 9]), rng.choice([None, -4, 52]),
                    "".join(rng.choice("ACGTNacgt=R") for _ in range(length)) or rng.choice(["*", "", None]), rng.choice(["*", None, "".join(rng.choice("!I5~") for _ in range(length))]), rng.choice(tags)))
    return out


def test_batches_of_records_are_those_of_rows():
    import pyarrow as pa

    from tagtally.sources import bam
    from tagtally.sources.blocks import Index

    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    rows, at = _made_up_rows(900), {"a": 0, "b": 1}
    for own in (rows, [r for r in rows if "B:s" not in r[-1]], rows[:1], []):
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], t) for k, t in enumerate(kinds)], names)
        each = [bam.encoded(r, at) for r in batch.to_pylist()]
        data, ends, ref, begin, end = bam.encoded_batch(batch, at)
        assert data == b"".join(e[0] for e in each)
        assert ends.tolist() == [sum(len(e[0]) for e in each[: i + 1]) for i in range(len(each))]
        assert list(zip(ref.tolist(), begin.tolist(), end.tolist())) == [e[1:] for e in each]
        if not own:
            continue
        starts = [0, *ends.tolist()[:-1]]
        got = bam.decoded(data, starts, ["a", "b"]).to_pydict()
        for k, start in enumerate(starts):
            fixed = np.frombuffer(data[start : start + 36], bam._FIXED)[0]
            behind = start + 36 + int(fixed["lname"]) + 4 * int(fixed["ncig"]) + (int(fixed["lseq"]) + 1) // 2 + int(fixed["lseq"])
            fields = bam.fields_text(data, behind, int(ends[k]))
            found = {f[:2]: f[5:] for f in fields if f[3] in "iZ"}
            assert (got["tags"][k], got["as"][k], got["nm"][k], got["rx"][k]) == ("\t".join(fields), bam._whole(found.get("AS")), bam._whole(found.get("NM")), found.get("RX"))
        # An index of many records at once is that of one after the other.
        order = np.lexsort((begin, ref % 3))
        one, many, places = Index(2), Index(2), np.arange(len(own)) * 7
        for i, k in enumerate(order.tolist()):
            one.add(int(ref[k]), int(begin[k]), int(end[k]), i * 7, (i + 1) * 7)
        last = many.add_many(ref[order], begin[order], end[order], places)
        many.add(*last, len(own) * 7)
        assert many.dumps() == one.dumps()


def test_records_go_into_blocks_as_one_by_one(tmp_path):
    from tagtally.sources.blocks import BLOCK, Writer

    sizes = [5, BLOCK - 5, 1, 2 * BLOCK + 3, 40, BLOCK, 59_000, 999, 1, 1, *([137] * 1500)]
    data, ends = bytes(i % 251 for i in range(sum(sizes))), np.cumsum(sizes)
    one, many = Writer(open(tmp_path / "one", "wb")), Writer(open(tmp_path / "many", "wb"))
    places = []
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        one.room(b - a)
        places.append(one.place())
        one.write(data[a:b])
    assert many.write_many(data, ends).tolist() == places
    one.finish()
    many.finish()
    assert (tmp_path / "one").read_bytes() == (tmp_path / "many").read_bytes()


def test_header_of_very_many_references():
    import time

    from tagtally.sources import bam

    begun = time.monotonic()
    head, at = bam.header_bytes([f"@SQ\tSN:t{i}\tLN:9" for i in range(200_000)])  # by appending to a text it copied some terabytes
    assert len(at) == 200_000 and bam.references(head)[1][-1] == "t199999"
    known = []  # a scan in steps begins where the last one ended
    for stop in range(1 << 16, len(head) + (1 << 16), 1 << 16):
        found = bam.header_end(head[:stop], known)
    assert found == len(head) == bam.header_end(head) and known == [len(head), 0]
    assert time.monotonic() - begun < 30
