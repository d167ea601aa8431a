"""Reads of four lines each, from ranges of plain or block-compressed files, without a shuffle.

A read belongs to the range that holds the line end before it (the first read to the first range), so a range skips to
its first line end, finds which of the next four lines is a name, and reads on past its end until its last read is whole. A line is a name
if it begins with "@", the line two below begins with "+", and sequence and quality between and below are equally long;
a quality line that begins with "@" never passes, since no sequence begins with "+".
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagtally.sources import stores
from tagtally.sources.bam import listed, size_of
from tagtally.sources.blocks import Blocks, Damaged, header_size

#: Bytes read at once, and of the reads of a batch.
PIECE, CHUNK = 1 << 20, 4 << 20


class _Range(InputPartition):
    def __init__(self, file: str, size: int, start: int, end: int):
        self.file, self.size, self.start, self.end = file, size, start, end


def plain_pieces(stream, size: int, start: int, end: int):
    """The bytes of a file from a place on, and whether each piece lies in the range."""
    at = start
    stream.seek(start)
    while at < size:
        data = bytes(stream.read(min(PIECE, end - at) if at < end else PIECE))
        if not data:
            return
        yield data, at < end
        at += len(data)


def block_pieces(blocks: Blocks, start: int, end: int):
    """The data of blocks from the first that begins in the range on."""
    at = 0 if start == 0 else blocks.next_block(start, end)
    while at is not None and at < blocks.size:
        own = at < end
        data, at = blocks.block(at)
        yield data, own


def gzip_pieces(stream, name: str):
    """The data of a file of gzip members without block sizes."""
    made, raw = zlib.decompressobj(31), b""
    while raw := raw or bytes(stream.read(PIECE)):
        if made.eof:
            made = zlib.decompressobj(31)
        yield made.decompress(raw), True
        raw = made.unused_data
    if not made.eof:
        raise Damaged(f"{name}: the file ends within compressed data")


def _names_at(lines: list[bytes], k: int) -> bool:
    return lines[k][:1] == b"@" and lines[k + 2][:1] == b"+" and len(lines[k + 1].rstrip(b"\r")) == len(lines[k + 3].rstrip(b"\r"))


def _batch(lines: list[bytes], name: str) -> pa.RecordBatch:
    """Reads of complete groups of four lines."""
    lines = [x[:-1] if x[-1:] == b"\r" else x for x in lines]
    names, seqs, marks, quals = (lines[i::4] for i in range(4))
    for n, s, m, q in zip(names, seqs, marks, quals):
        if n[:1] != b"@" or m[:1] != b"+" or len(s) != len(q):
            raise Damaged(f"{name}: not a read: {n[:80]!r}")
    ids = [n[1:].split(None, 1)[0] if n[1:].strip() else b"" for n in names]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).cast(pa.string()) for x in (ids, seqs, quals)], ["qname", "seq", "qual"])


def reads_of(pieces, first: bool, name: str):
    """Batches of the reads of a range; ``first`` says that it begins with a read."""
    pieces, held, owned, done = iter(pieces), bytearray(), 0, False

    def pull() -> bool:
        nonlocal owned, done
        for data, own in pieces:
            held.extend(data)
            if own:
                owned = len(held)
            return True
        done = True
        return False

    def line_end(at: int) -> int:
        """The end of the line at a place; the file's end counts as one."""
        while (k := held.find(b"\n", at)) < 0:
            at = len(held)
            if not pull():
                return len(held)
        return k

    at, before = 0, -1  # where a read may begin, and the line end before it
    if not first:
        before = line_end(0)
        if before >= owned:
            return
        at = before + 1
        ends = []
        p = at
        for _ in range(8):
            ends.append((p, line_end(p)))
            p = ends[-1][1] + 1
            if p > len(held):
                break
        lines = [bytes(held[a:b]) for a, b in ends if a < len(held)]
        found = next((k for k in range(min(4, len(lines) - 3)) if _names_at(lines, k)), None)
        if found is None:
            if any(x.strip() for x in lines[3:]):
                raise Damaged(f"{name}: no read within {lines[:4]!r}")
            return  # the last read's lines
        at, before = ends[found][0], ends[found][0] - 1
    lines: list[bytes] = []
    size = 0
    while True:
        if at >= len(held) and not pull():
            break
        if before >= owned and not (first and before < 0):
            break
        group = []
        for _ in range(4):
            if at >= len(held) and not pull():
                break
            end = line_end(at)
            group.append(bytes(held[at:end]))
            before, at = end, end + 1
        if len(group) < 4:
            if any(x.strip() for x in group):
                raise Damaged(f"{name}: the file ends within a read")
            break
        if not group[0].strip() and not any(x.strip() for x in group):
            continue
        lines += group
        size += sum(map(len, group))
        if size > CHUNK:
            yield _batch(lines, name)
            lines, size = [], 0
        if at > 4 * PIECE:
            del held[:at]
            owned, before, at = owned - at, before - at, 0
            first = False
    if lines:
        yield _batch(lines, name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.span = json.loads(options["files"]), int(options["span"])

    def partitions(self):
        out = []
        for f, size in self.files:
            with stores.opened(f) as stream:
                head = bytes(stream.read(1 << 16))
            step = max(size, 1) if head[:2] == b"\x1f\x8b" and header_size(head) is None else self.span
            out += [_Range(f, size, a, min(a + step, size)) for a in range(0, size, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range):
        if not partition.file:
            return
        size, start, end = partition.size, partition.start, partition.end
        with stores.opened(partition.file) as stream:
            head = bytes(stream.read(1 << 16))
            stream.seek(0)
            if head[:2] != b"\x1f\x8b":
                pieces = plain_pieces(stream, size, start, end)
            elif header_size(head) is None:
                pieces = gzip_pieces(stream, partition.file)
            else:
                pieces = block_pieces(Blocks(stream, size, partition.file), start, end)
            yield from reads_of(pieces, start == 0, partition.file)


class ReadSource(DataSource):
    """``tagtally_fastq``: options ``files`` (names and sizes) and ``span``."""

    @classmethod
    def name(cls) -> str:
        return "tagtally_fastq"

    def schema(self) -> str:
        return "qname string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads ``qname, seq, qual`` of plain, gzip or block-gzip files, four lines each; all but gzip are read in ranges.

    A line that should be a name and is not, a sequence and quality of different lengths, and a file that ends within a
    read are errors; empty lines at a file's end are none.
    """
    spark.dataSource.register(ReadSource)
    span = size_of(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return spark.read.format("tagtally_fastq").options(files=json.dumps(listed(spark, path)), span=str(span)).load()
