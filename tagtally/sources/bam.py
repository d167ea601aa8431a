"""Binary alignment files: records and optional fields, and a data source over ranges of bytes.

A file is a series of gzip blocks. A range of a file begins at the first block whose header and checksum hold, and in it
at the first place from which a chain of records is sound; it reads on past its end until its last record is whole. So
blocks may have any header, records any length, and every record is read by the range in which its first block begins.
What does not agree with its checksum, or ends early, is an error.

Files are written by tasks: each makes one whole file of a folder, or a part of one file without header and end. With
an index, a part holds the records of its stretch of the order, and a region is read from the blocks its index names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tagtally import schemas
from tagtally.sources import stores
from tagtally.sources.blocks import BLOCK, END, Blocks, Damaged, Index, Writer, bin_of, bins_at, block, header_size

# Fixed values of the format: the letters of records and what numbers optional fields hold.
MAGIC = b"BAM\x01"
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCALARS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Sound records in a row that show where records begin, and uncompressed bytes that are decoded at once.
CHAIN, CHUNK = 8, 2 << 20

_FIELDS = [x.strip().split(" ")[0] for x in schemas.ALIGNMENTS.split(", ")]
_READ = [c for c in _FIELDS if c != "ord"]
_SCHEMA = ", ".join(x for x in schemas.ALIGNMENTS.split(", ") if not x.strip().startswith("ord "))


def header_end(data: bytes, known: list[int] | None = None) -> int | None:
    """Where records begin; None if the header does not end within the data.

    ``known`` keeps a place and how many references come from there, so that a call with more data goes on where the last one ended.
    """
    if data[:4] != MAGIC:
        raise ValueError("not a BAM file")
    known = [] if known is None else known
    try:
        if not known:
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            known += [at + 4, struct.unpack_from("<i", data, at)[0]]
        at, left = known
        while left:
            at += 8 + struct.unpack_from("<i", data, at)[0]
            left -= 1
            known[:] = at, left
    except struct.error:
        return None
    return at if at <= len(data) else None


def references(data: bytes) -> tuple[str, list[str]]:
    """Header text and names of the reference sequences."""
    size = struct.unpack_from("<i", data, 4)[0]
    at = 8 + size
    count, names = struct.unpack_from("<i", data, at)[0], []
    at += 4
    for _ in range(count):
        k = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    return data[8 : 8 + size].rstrip(b"\0").decode(), names


def fields_text(data: bytes, at: int, end: int) -> list[str]:
    """Optional fields as they stand in text files."""
    out = []
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            out.append(f"{tag}:{kind}:{data[at:stop].decode()}")
            at = stop + 1
        elif kind == "A":
            out.append(f"{tag}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            sub, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = f"<{count}{SCALARS[sub]}"
            values = struct.unpack_from(form, data, at + 5)
            out.append(f"{tag}:B:{sub}," + ",".join(f"{v:.9g}" if sub == "f" else str(v) for v in values))
            at += 5 + struct.calcsize(form)
        else:
            value = struct.unpack_from("<" + SCALARS[kind], data, at)[0]
            out.append(f"{tag}:f:{value:.9g}" if kind == "f" else f"{tag}:i:{value}")
            at += struct.calcsize("<" + SCALARS[kind])
    return out


def fields_bytes(text: str) -> bytes:
    """Optional fields of a text line in binary form."""
    out = []
    for field in text.split("\t") if text else []:
        tag, kind, value = field.split(":", 2)
        head = tag.encode()
        if kind == "i":
            out.append(head + b"i" + struct.pack("<i", int(value)))
        elif kind == "f":
            out.append(head + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(head + b"A" + value.encode()[:1])
        elif kind == "B":
            sub, *values = value.split(",")
            number = float if sub == "f" else int
            out.append(head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{SCALARS[sub]}", len(values), *map(number, values)))
        else:
            out.append(head + kind.encode() + value.encode() + b"\0")
    return b"".join(out)


# ---------------------------------------------------------------- records to columns

_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("lname", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ncig", "<u2"), ("flag", "<u2"), ("lseq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("span", "<i4")])
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
_CODES = {c: i for i, c in enumerate(BASES)}
_HEX = {c: f"{_CODES.get(chr(c).upper(), 15):x}" for c in range(128)}
_SHIFTED = bytes(min(255, q + 33) for q in range(256))
_UNSHIFTED = bytes(max(0, q - 33) for q in range(256))


def sound(data: bytes, at: int, references: int) -> int | None:
    """Bytes of the record at a place, with its size field, if its fixed fields make sense; None if they do not."""
    size, ref, pos, lname, _, _, ncig, _, lseq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (size >= 33 and -1 <= ref < references and pos >= -1 and lname >= 1 and lseq >= 0 and -1 <= mate < references and mate_pos >= -1):
        return None
    return 4 + size if 32 + lname + 4 * ncig + (lseq + 1) // 2 + lseq <= size else None


def _ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of an array one after the other, and where each begins (one entry more)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])], ends


def _texts(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _starred(texts: pa.Array, missing: np.ndarray) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pa.array(missing), "*", texts) if missing.any() else texts


def _cigar(data: bytes) -> str:
    return "".join(f"{v >> 4}{OPERATIONS[v & 15]}" for v in struct.unpack(f"<{len(data) // 4}I", data)) or "*"


def decoded(data: bytes, starts: list[int], names: list[str]) -> pa.RecordBatch:
    """The records at places in the data as columns of ``ALIGNMENTS`` without ``ord``."""
    flat, at = np.frombuffer(data, np.uint8), np.array(starts, np.int64)
    fixed = flat[at[:, None] + np.arange(36)].reshape(-1).view(_FIXED)
    lname, ncig, lseq, ref, mate = (fixed[c].astype(np.int64) for c in ("lname", "ncig", "lseq", "ref", "mate"))
    if len(at) and max(ref.max(), mate.max()) >= len(names):
        raise Damaged("a record names a reference that the header does not have")
    p = at + 36
    qname = _texts(*_ragged(flat, p, lname - 1))
    p = p + lname
    known: dict[bytes, str] = {}
    cigars = []
    for a, n in zip(p.tolist(), (4 * ncig).tolist()):
        raw = data[a : a + n]
        if raw not in known:
            known[raw] = _cigar(raw)
        cigars.append(known[raw])
    p = p + 4 * ncig
    packed, ends = _ragged(flat, p, (lseq + 1) // 2)
    seq = _texts(*_ragged(_PAIRS[packed].reshape(-1), 2 * ends[:-1], lseq))
    p = p + (lseq + 1) // 2
    quality, ends = _ragged(flat, p, lseq)
    bare = lseq == 0
    none = bare.copy()
    none[~bare] = quality[ends[:-1][~bare]] == 255
    if none.any():
        quality = np.where(np.repeat(none, lseq), 0, quality)
    if len(quality) and quality.max() > 93:
        raise Damaged("a quality is beyond 93")
    qual = _texts(quality + 33, ends)
    stop = at + 4 + fixed["size"]
    fields, rare = _fields_columns(flat, p + lseq, stop)
    for k in rare.tolist():  # lists, and what is not as the format has it
        own = fields_text(data, int(p[k] + lseq[k]), int(stop[k]))
        found = {f[:2]: f[5:] for f in own if f[3] in "iZ"}
        if ncig[k] == 2 and (longer := next((f for f in own if f.startswith("CG:B:I,")), None)):
            # More operations than the fixed field can count: they stand in an optional field.
            cigars[k] = "".join(f"{int(v) >> 4}{OPERATIONS[int(v) & 15]}" for v in longer[7:].split(","))
            own.remove(longer)
        for c, v in (("tags", "\t".join(own)), ("AS", _whole(found.get("AS"))), ("NM", _whole(found.get("NM"))), ("RX", found.get("RX"))):
            fields[c][k] = v
    tags, scores, edits, marks = (fields[c] for c in ("tags", "AS", "NM", "RX"))
    named = pa.array([*names, "*"], pa.string())
    place = lambda i: named.take(pa.array(np.where(i < 0, len(names), i)))
    rnext = place(mate)
    same = (mate >= 0) & (mate == ref)
    if same.any():
        import pyarrow.compute as pc

        rnext = pc.if_else(pa.array(same), "=", rnext)
    ints = lambda c, more=0: pa.array(fixed[c].astype(np.int32) + more, pa.int32())
    return pa.RecordBatch.from_arrays([
        qname, ints("flag"), place(ref), ints("pos", 1), ints("mapq"), pa.array(cigars, pa.string()), rnext, ints("mate_pos", 1), ints("span"), _starred(seq, bare), _starred(qual, none),
        *[c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in ((scores, pa.int32()), (edits, pa.int32()), (marks, pa.string()), (tags, pa.string()))]], _READ)


def _fields_columns(flat: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[dict, np.ndarray]:
    """Optional fields of many records: ``tags`` as text, ``AS``, ``NM``, ``RX``; and the rows left out, whose fields need a closer look.

    All records' first fields are taken together, then their second ones and so on, by tag and kind. Where rows are left out, the
    columns are lists.
    """
    import pyarrow.compute as pc

    n, at, live = len(begin), begin.copy(), np.flatnonzero(begin < stop)
    rare, zeros, columns = np.zeros(n, bool), np.flatnonzero(flat == 0), []
    numbers = {c: (np.zeros(n, np.int64), np.zeros(n, bool)) for c in ("AS", "NM")}
    marks, marked, mark_at = [pa.array([], pa.string())], 0, np.full(n, -1, np.int64)
    while len(live):
        short = at[live] + 4 > stop[live]
        rare[live[short]] = True
        live = live[~short]
        heads = flat[at[live][:, None] + np.arange(3)].astype(np.int64)
        code = heads[:, 0] << 16 | heads[:, 1] << 8 | heads[:, 2]
        parts, rows = [], []
        for c in np.unique(code).tolist():
            own = live[code == c]
            tag, kind = chr(c >> 16) + chr(c >> 8 & 255), chr(c & 255)
            v = at[own] + 3
            if kind in "ZH":
                last = zeros[np.minimum(np.searchsorted(zeros, v), len(zeros) - 1)] if len(zeros) else v - 1
                sound = (last >= v) & (last < stop[own])
                size = last - v + 1
            elif kind in SCALARS or kind == "A":
                size = np.full(len(own), 1 if kind == "A" else struct.calcsize("<" + SCALARS[kind]))
                sound = v + size <= stop[own]
            else:
                sound, size = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
            rare[own[~sound]] = True
            own, v, size = own[sound], v[sound], size[sound]
            if not len(own):
                continue
            values = None
            if kind in "ZH":
                text = _texts(*_ragged(flat, v, size - 1))
            elif kind == "A":
                text = pa.array([chr(x) for x in flat[v].tolist()], pa.string())
            else:
                width = int(size[0])
                values = flat[v[:, None] + np.arange(width)].reshape(-1).view("<" + {"b": "i1", "B": "u1", "h": "i2", "H": "u2", "i": "i4", "I": "u4", "f": "f4"}[SCALARS[kind]])
                if kind == "f":
                    known, place = np.unique(values.view("<u4"), return_inverse=True)
                    text = pa.array([f"{x:.9g}" for x in known.view("<f4").tolist()], pa.string()).take(pa.array(place.reshape(-1)))
                else:
                    text = pa.array(values.astype(np.int64)).cast(pa.string())
            whole = kind in SCALARS and kind != "f"
            if kind == "Z" or whole:
                if tag in numbers:
                    number, has = numbers[tag]
                    if whole:
                        number[own], has[own] = values, True
                    else:
                        found = [_whole(x) for x in text.to_pylist()]
                        number[own], has[own] = [x or 0 for x in found], [x is not None for x in found]
                elif tag == "RX":
                    mark_at[own] = marked + np.arange(len(own))
                    marked += len(own)
                    marks.append(text)
            head = ("\t" if columns else "") + f"{tag}:{'i' if whole else kind}:"
            parts.append(pc.binary_join_element_wise(pa.scalar(head), text, ""))
            rows.append(own)
            at[own] = v + size
        place = np.full(n, -1, np.int64)
        if rows:
            live = np.concatenate(rows)
            place[live] = np.arange(len(live))
            column = pa.concat_arrays(parts)
            column.validate(full=True)
            columns.append(pc.fill_null(column.take(pa.array(place, mask=place < 0)), ""))
            live = np.sort(live[at[live] < stop[live]])
        else:
            live = live[:0]
    tags = pc.binary_join_element_wise(*columns, "") if columns else pa.array([""] * n, pa.string())
    out = {"tags": tags, "RX": pa.concat_arrays(marks).take(pa.array(mark_at, mask=mark_at < 0)), **{c: pa.array(v, mask=~has) for c, (v, has) in numbers.items()}}
    rare = np.flatnonzero(rare)
    return ({c: v.to_pylist() for c, v in out.items()} if len(rare) else out), rare


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


_OPS: dict[str, tuple[bytes, int]] = {}


def _packed_cigar(text: str) -> tuple[bytes, int]:
    """Operations in binary form, and the letters of the reference they cover."""
    import re

    if text not in _OPS:
        if len(_OPS) > 10_000:
            _OPS.clear()
        ops = [] if text == "*" else [(int(n), OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]
        _OPS[text] = b"".join(struct.pack("<I", n << 4 | o) for n, o in ops), sum(n for n, o in ops if OPERATIONS[o] in "MDN=X")
    return _OPS[text]


def encoded(row: dict, at: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A record with its size, its reference's number and the range it covers; ``row`` has the columns of ``ALIGNMENTS``."""
    text = lambda c: row.get(c) if row.get(c) not in (None, "") else "*"
    cigar, length = _packed_cigar(text("cigar"))
    fields = fields_bytes(row.get("tags") or "")
    seq = "" if text("seq") == "*" else row["seq"]
    if len(cigar) // 4 > 65535:
        fields += b"CGBI" + struct.pack("<i", len(cigar) // 4) + cigar
        cigar = struct.pack("<II", len(seq) << 4 | 4, length << 4 | 3)
    codes = seq.translate(_HEX)
    packed = bytes.fromhex(codes + "0" * (len(codes) % 2))
    qual = b"\xff" * len(seq) if text("qual") == "*" else row["qual"].encode().translate(_UNSHIFTED)
    ref = at.get(text("rname"), -1)
    mate = ref if text("rnext") == "=" else at.get(text("rnext"), -1)
    pos = (row.get("pos") or 0) - 1
    begin, end = max(pos, 0), max(pos, 0) + (length or 1)
    name = text("qname").encode() + b"\0"
    mapq = 255 if row.get("mapq") is None else row["mapq"]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, bin_of(begin, end), len(cigar) // 4, row.get("flag") or 0, len(seq), mate, (row.get("pnext") or 0) - 1, row.get("tlen") or 0)
    body += name + cigar + packed + qual + fields
    return struct.pack("<i", len(body)) + body, ref, begin, end


_NIBBLES = np.array([int(_HEX.get(c, "f"), 16) for c in range(256)], np.uint8)
_LOWERED = np.frombuffer(_UNSHIFTED, np.uint8)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, where each begins, and its length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def _put(out: np.ndarray, at: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy stretches of one array to places of another."""
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + step] = flat[np.repeat(begin, length) + step]


def _fields_packed(tags: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """Optional fields of many texts in binary form, and the bytes of each row; None if one of them needs a closer look."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(tags, "\t")
    fields, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    some = pc.not_equal(tags, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(tags)), counts)
    if not some.all():
        keep = some[owner]
        fields, owner = fields.filter(pa.array(keep)), owner[keep]
    flat, begin, length = _letters(fields)
    if not len(fields):
        return np.zeros(0, np.uint8), np.zeros(len(tags), np.int64)
    if length.min() < 5 or (flat[begin + 2] != 58).any() or (flat[begin + 4] != 58).any():
        return None
    kind, size = flat[begin + 3], np.zeros(len(fields), np.int64)
    four, one = (kind == ord("i")) | (kind == ord("f")), kind == ord("A")
    if (kind == ord("B")).any() or (length[one] < 6).any() or (kind > 127).any():
        return None
    size = np.where(four, 7, np.where(one, 4, 3 + length - 5 + 1))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k, source in ((0, 0), (1, 1), (2, 3)):
        out[at + k] = flat[begin + source]
    try:
        for letter, dtype, wide in (("i", pa.int32(), "<i4"), ("f", pa.float32(), "<f4")):
            own = np.flatnonzero(kind == ord(letter))
            if len(own):
                # By way of doubles, as numbers of the language are.
                numbers = _texts(*_ragged(flat, begin[own] + 5, length[own] - 5)).cast(pa.float64() if letter == "f" else dtype).to_numpy(zero_copy_only=False).astype(wide)
                out[at[own][:, None] + 3 + np.arange(4)] = numbers.view(np.uint8).reshape(-1, 4)
    except pa.ArrowInvalid:
        return None
    out[at[one] + 3] = flat[begin[one] + 5]
    rest = ~four & ~one
    _put(out, at[rest] + 3, flat, begin[rest] + 5, length[rest] - 5)
    return out, np.bincount(owner, size, len(tags)).astype(np.int64)


def encoded_batch(batch: pa.RecordBatch, at: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``encoded`` of all rows of a batch: the records' bytes, where each ends, references' numbers and the ranges they cover."""
    import pyarrow.compute as pc

    n = batch.num_rows
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    text = lambda c: pc.if_else(pc.fill_null(pc.equal(column(c), ""), True), "*", column(c))
    whole = lambda c, instead=0: pc.fill_null(column(c), instead).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = text("cigar").dictionary_encode()
    ops = [_packed_cigar(c) for c in coded.dictionary.to_pylist()]
    packed_fields = _fields_packed(pc.fill_null(column("tags"), ""))
    seq = text("seq")
    bases, b_begin, b_size = _letters(pc.if_else(pc.equal(seq, "*"), "", seq))
    if packed_fields is None or any(len(c) // 4 > 65535 for c, _ in ops) or (len(bases) and bases.max() > 127):
        rows = [encoded(row, at) for row in batch.to_pylist()]
        ends, ref, begin, end = (np.cumsum([len(r[0]) for r in rows]), *(np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3)))
        return b"".join(r[0] for r in rows), ends, ref, begin, end
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    c_flat, c_each = np.frombuffer(b"".join(c for c, _ in ops), np.uint8), np.array([len(c) for c, _ in ops] or [0], np.int64)
    c_begin, c_size, covered = (np.cumsum(c_each) - c_each)[which], c_each[which], np.array([k for _, k in ops] or [0], np.int64)[which]
    number = lambda c: (lambda d: np.array([at.get(x, -1) for x in d.dictionary.to_pylist()] or [-1], np.int64)[d.indices.to_numpy(zero_copy_only=False)])(text(c).dictionary_encode())
    ref, mate = number("rname"), number("rnext")
    mate = np.where(pc.equal(text("rnext"), "=").to_numpy(zero_copy_only=False), ref, mate)
    pos = whole("pos") - 1
    begin = np.maximum(pos, 0)
    end = begin + np.where(covered > 0, covered, 1)
    names, n_begin, n_size = _letters(text("qname"))
    qual = text("qual")
    bare = pc.equal(qual, "*").to_numpy(zero_copy_only=False)
    quality, q_begin, q_size = _letters(qual)
    q_size = np.where(bare, b_size, q_size)
    fields, f_size = packed_fields
    half = (b_size + 1) // 2
    head = np.zeros(n, _FIXED)
    size = 32 + n_size + 1 + c_size + half + q_size + f_size
    for c, v, low, high in (
        ("size", size, 0, 2**31), ("ref", ref, -1, 2**31), ("pos", pos, -(2**31), 2**31), ("lname", n_size + 1, 0, 256), ("mapq", whole("mapq", 255), 0, 256), ("bin", bins_at(begin, end), 0, 65536), ("ncig", c_size // 4, 0, 65536),
        ("flag", whole("flag"), 0, 65536), ("lseq", b_size, 0, 2**31), ("mate", mate, -1, 2**31), ("mate_pos", whole("pnext") - 1, -(2**31), 2**31), ("span", whole("tlen"), -(2**31), 2**31)):
        if n and (v.min() < low or v.max() >= high):
            raise struct.error(f"{c} of a record is beyond what the format holds")
        head[c] = v
    ends = np.cumsum(size + 4)
    out, p = np.zeros(int(ends[-1]) if n else 0, np.uint8), ends - size - 4
    out[p[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
    p = p + 36
    _put(out, p, names, n_begin, n_size)
    p = p + n_size + 1
    _put(out, p, c_flat, c_begin, c_size)
    p = p + c_size
    step = np.arange(int(b_size.sum())) - np.repeat(np.cumsum(b_size) - b_size, b_size)
    nibble, to = _NIBBLES[bases[np.repeat(b_begin, b_size) + step]], np.repeat(p, b_size) + step // 2
    even = step % 2 == 0
    out[to[even]] = nibble[even] << 4
    out[to[~even]] |= nibble[~even]
    p = p + half
    _put(out, p[~bare], _LOWERED[quality], q_begin[~bare], q_size[~bare])
    if bare.any():
        _put(out, p[bare], np.full(int(q_size[bare].max()), 255, np.uint8), np.zeros(int(bare.sum()), np.int64), q_size[bare])
    p = p + q_size
    _put(out, p, fields, np.cumsum(f_size) - f_size, f_size)
    return out.tobytes(), ends, ref, begin, end


# ---------------------------------------------------------------- the data source


class _Range(InputPartition):
    def __init__(self, file: str, size: int, start: int, end: int, places: list | None = None):
        self.file, self.size, self.start, self.end, self.places = file, size, start, end, places


def _header_of(blocks: Blocks) -> tuple[bytes, int]:
    """Data from the begin of a file to the end of its header or beyond, and where the next block begins."""
    held, offset, known = bytearray(), 0, []
    while len(held) < 12 or header_end(held, known) is None:
        if offset >= blocks.size:
            raise Damaged(f"{blocks.name}: the file ends within its header")
        data, offset = blocks.block(offset)
        held += data
    return bytes(held), offset


def range_records(blocks: Blocks, start: int, end: int, lenient: bool = False):
    """Batches of the records whose first block begins in [start, end)."""
    header, _ = _header_of(blocks)
    names, size = references(header)[1], blocks.size
    offset = 0 if start == 0 else blocks.next_block(start, min(end, size))
    if offset is None:
        return
    held, owned, empty = bytearray(), 0, False

    def pull() -> bool:
        nonlocal offset, owned, empty
        if offset >= size:
            return False
        data, after = blocks.block(offset)
        held.extend(data)
        if offset < end:
            owned = len(held)
        offset, empty = after, not data
        return True

    def reach(n: int) -> bool:
        while len(held) < n:
            if not pull():
                return False
        return True

    def chain(p: int) -> bool:
        for _ in range(CHAIN):
            if not reach(p + 36):
                return p == len(held)
            step = sound(held, p, len(names))
            last_of_name = p + 35 + held[p + 12]
            if step is None or not reach(last_of_name + 1) or held[last_of_name] != 0:
                return False
            p += step
        return True

    def owned_place(p: int) -> bool:
        while p >= owned and offset < min(end, size):
            pull()
        return p < owned

    p = header_end(header) if start == 0 else 0
    if start == 0:
        reach(p)
    else:
        while owned_place(p) and not chain(p):
            p += 1
    starts: list[int] = []
    while True:
        while owned_place(p):
            if not reach(p + 4):
                raise Damaged(f"{blocks.name}: the file ends within a record")
            step = 4 + struct.unpack_from("<i", held, p)[0]
            if step < 36 or not reach(p + step):
                raise Damaged(f"{blocks.name}: the file ends within a record")
            starts.append(p)
            p += step
            if p > CHUNK:
                break
        if starts:
            yield decoded(bytes(held[:p]), starts, names)
        if not owned_place(p):
            break
        del held[:p]
        owned, p, starts = owned - p, 0, []
    if end >= size and not lenient:
        while pull():
            pass
        if not empty:
            raise Damaged(f"{blocks.name}: the file has no end block, so it may be cut off")


def region_records(blocks: Blocks, index: Index, name: str, begin: int, end: int):
    """Batches of the records that overlap [begin, end) of a reference, from the blocks that the index names."""
    names = references(_header_of(blocks)[0])[1]
    if name not in names:
        return
    ref = names.index(name)
    for start, stop in index.chunks(ref, begin, end):
        offset, p = start >> 16, start & 0xFFFF
        held, marks = bytearray(), []
        at = [(offset, 0)]  # offset of each block and where its data begins in what is held
        while offset < stop >> 16 or (offset == stop >> 16 and stop & 0xFFFF):
            data, offset = blocks.block(offset)
            held.extend(data)
            at.append((offset, len(held)))
            if offset > stop >> 16:
                break
        limit = next((b + (stop & 0xFFFF) for o, b in at if o == stop >> 16), len(held))
        while p < limit:
            while len(held) < p + 36 or len(held) < p + 4 + struct.unpack_from("<i", held, p)[0]:
                data, offset = blocks.block(offset)
                held.extend(data)
            size, own, pos, lname, _, _, ncig = struct.unpack_from("<iiiBBHH", held, p)
            ops = struct.unpack_from(f"<{ncig}I", held, p + 36 + lname)
            covered = sum(v >> 4 for v in ops if OPERATIONS[v & 15] in "MDN=X") or 1
            if own == ref and pos < end and pos + covered > begin:
                marks.append(p)
            p += 4 + size
        if marks:
            yield decoded(bytes(held), marks, names)


def _gzip_records(stream, name: str):
    """Batches of the records of a file that is gzip without block sizes: one task reads it, member by member."""
    made, held, raw = zlib.decompressobj(31), bytearray(), b""
    names, p = None, 0
    while True:
        raw = raw or bytes(stream.read(1 << 20))
        if raw:
            if made.eof:
                made = zlib.decompressobj(31)
            held.extend(made.decompress(raw))
            raw = made.unused_data
        elif not made.eof:
            raise Damaged(f"{name}: the file ends within compressed data")
        done = not raw and made.eof and not (raw := bytes(stream.read(1 << 20)))
        if names is None:
            if len(held) < 12 or header_end(held) is None:
                if done:
                    raise Damaged(f"{name}: the file ends within its header")
                continue
            names, p = references(bytes(held[: header_end(held)]))[1], header_end(held)
        starts = []
        while p + 4 <= len(held) and p + 4 + (size := struct.unpack_from("<i", held, p)[0]) <= len(held):
            starts.append(p)
            p += 4 + size
        if starts:
            yield decoded(bytes(held[:p]), starts, names)
        del held[:p]
        p = 0
        if done:
            if held:
                raise Damaged(f"{name}: the file ends within a record")
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.span = int(options.get("span", 64 << 20))
        self.lenient = options.get("lenient", "false") == "true"
        self.region = json.loads(options["region"]) if "region" in options else None

    def partitions(self):
        if self.region:
            return [_Range(f, size, 0, size) for f, size in self.files] or [_Range("", 0, 0, 0)]
        out = []
        for f, size in self.files:
            with stores.opened(f) as stream:
                split = header_size(bytes(stream.read(1 << 16))) is not None
            step = self.span if split else max(size, 1)
            out += [_Range(f, size, a, min(a + step, size)) for a in range(0, max(size, 1), step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range):
        if not partition.file:
            return
        with stores.opened(partition.file) as stream:
            head = header_size(bytes(stream.read(1 << 16)))
            stream.seek(0)
            if head is None:
                yield from _gzip_records(stream, partition.file)
                return
            blocks = Blocks(stream, partition.size, partition.file)
            if self.region:
                with stores.opened(f"{partition.file}.bai") as found:
                    index = Index.loads(bytes(found.read()))
                yield from region_records(blocks, index, *self.region)
            else:
                yield from range_records(blocks, partition.start, partition.end, self.lenient)


class _Part(WriterCommitMessage):
    def __init__(self, part: int, draft: str, name: str):
        self.part, self.draft, self.name = part, draft, name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.header = options["path"].rstrip("/"), json.loads(options["header"])
        self.bare, self.index = options.get("bare", "false") == "true", options.get("index", "false") == "true"

    def write(self, batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, draft = f"part-{part:05d}.bam", f"{self.folder}/.{uuid.uuid4().hex}.bam"
        head, at = header_bytes(self.header)
        writer = Writer(stores.create(draft))
        if not self.bare:
            writer.write(head)
            writer.room(BLOCK)
        index, last = Index(len(at)), None
        for batch in batches:
            data, ends, *placed = encoded_batch(batch, at)
            places = writer.write_many(data, ends)
            if self.index and len(ends):
                if last is not None:
                    index.add(*last, int(places[0]))
                last = index.add_many(*placed, places)
        if last is not None:
            index.add(*last, writer.place())
        writer.finish(not self.bare)
        if self.index:
            with stores.create(f"{draft}.bai") as out:
                out.write(index.dumps())
        return _Part(part, draft, name)

    def commit(self, messages) -> None:
        """The parts that were committed get their names. Drafts of lost attempts keep hidden names, which no scan lists."""
        made = [m for m in messages if m is not None]
        if not made and not self.bare:
            writer = Writer(stores.create(f"{self.folder}/part-00000.bam"))
            writer.write(header_bytes(self.header)[0])
            writer.finish()
        for m in made:
            stores.rename(m.draft, f"{self.folder}/{m.name}")
            if self.index:
                stores.rename(f"{m.draft}.bai", f"{self.folder}/{m.name}.bai")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                stores.remove(m.draft)


class AlignmentSource(DataSource):
    """``tagtally_bam``: options ``files`` (names and sizes), ``span``, ``lenient``, ``region``; ``path``, ``header``, ``bare``, ``index`` to write."""

    @classmethod
    def name(cls) -> str:
        return "tagtally_bam"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


def header_bytes(header: list[str]) -> tuple[bytes, dict[str, int]]:
    """A file's first data, and the number of each reference that the sequence lines name."""
    lines = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header if line.startswith("@SQ")]
    text = ("\n".join(header) + "\n").encode() if header else b""
    head = [MAGIC, struct.pack("<i", len(text)), text, struct.pack("<i", len(lines))]
    for line in lines:
        name = line["SN"].encode() + b"\0"
        head += [struct.pack("<i", len(name)), name, struct.pack("<i", int(line["LN"]))]
    return b"".join(head), {line["SN"]: i for i, line in enumerate(lines)}


# ---------------------------------------------------------------- scans and sinks


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    p, store = _store(spark, path)
    found = store.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    files = [x for f in found for x in (store.listStatus(f.getPath()) if f.isDirectory() else [f])]
    return sorted((x.getPath().toString(), x.getLen()) for x in files if not x.isDirectory() and not x.getPath().getName().startswith(("_", ".")) and not x.getPath().getName().endswith(".bai"))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, a pattern or a folder."""
    return [f for f, _ in listed(spark, path)]


def move(spark: SparkSession, old: str, new: str) -> None:
    p, store = _store(spark, old)
    store.rename(p, _store(spark, new)[0])


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of the first file; only the beginning of the file is read."""
    file, size = listed(spark, path)[0]
    with stores.opened(file) as stream:
        if header_size(bytes(stream.read(1 << 16))) is None:
            stream.seek(0)
            made, data = zlib.decompressobj(31), b""
            while len(data) < 12 or header_end(data) is None:
                if not (raw := bytes(stream.read(1 << 16))) and made.eof:
                    raise Damaged(f"{file}: the file ends within its header")
                while raw:
                    made = zlib.decompressobj(31) if made.eof else made
                    data += made.decompress(raw)
                    raw = made.unused_data
        else:
            data = _header_of(Blocks(stream, size, file))[0]
    return [x for x in references(data)[0].split("\n") if x]


def _scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(AlignmentSource)
    rows = spark.read.format("tagtally_bam").options(files=json.dumps(listed(spark, path)), **options).load()
    return rows.withColumn("ord", F.monotonically_increasing_id())


def size_of(text: str) -> int:
    """A size as Spark's settings write it."""
    text = text.strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


def read_bam(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Files as rows of ``ALIGNMENTS``, all fields kept; ranges of ``spark.sql.files.maxPartitionBytes`` are read by tasks of their own.

    A file without an end block is an error, unless ``lenient``. A file that is gzip without block sizes is read by one task.
    """
    span = size_of(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    return _scan(spark, path, span=str(span), lenient=str(lenient).lower())


def read_region(spark: SparkSession, path: str, name: str, begin: int, end: int) -> DataFrame:
    """Rows that overlap [begin, end] of a reference (from 1), by the indexes beside the files; only blocks that they name are read."""
    return _scan(spark, path, region=json.dumps([name, begin - 1, end]))


def _write(rows: DataFrame, folder: str, header: list[str], **options: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(AlignmentSource)
    p, store = _store(spark, folder)
    store.delete(p, True)
    columns = dict(x.strip().split(" ") for x in _SCHEMA.split(","))
    known = [F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]
    rows.select(*known).write.format("tagtally_bam").mode("append").options(path=p.makeQualified(store.getUri(), store.getWorkingDirectory()).toString(), header=json.dumps(header), **options).save()


def write_bam(rows: DataFrame, path: str, header: list[str]) -> None:
    """Rows as one file with a header, whose sequence lines number the references.

    Tasks write parts of the file's blocks. A store that can concatenate files joins them itself; otherwise their compressed
    bytes are copied behind each other. A file of the same name is replaced when the new one is whole.
    """
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    _write(rows, folder, header, bare="true")
    join_parts(rows.sparkSession, folder, path, header)


def stream_bam(rows: DataFrame, out, folder: str, header: list[str]) -> None:
    """Rows as one file into an open binary stream; tasks write its blocks as parts of a folder that goes afterwards."""
    spark = rows.sparkSession
    _write(rows, folder, header, bare="true")
    out.write(block_run(header_bytes(header)[0]))
    p, store = _store(spark, folder)
    for part in files_of(spark, folder) if store.exists(p) else []:
        with stores.opened(part) as held:
            while data := held.read(4 << 20):
                out.write(data)
    out.write(END)
    out.flush()
    store.delete(p, True)


def join_parts(spark: SparkSession, folder: str, path: str, header: list[str]) -> None:
    """Bare parts of a folder as one file; the folder goes."""
    target, store = _store(spark, path)
    place = _store(spark, folder)[0]
    parts = [f for f in (files_of(spark, folder) if store.exists(place) else [])]
    head = block_run(header_bytes(header)[0])
    edges = []
    for name, data in (("head", head), ("tail", END)):
        p, _ = _store(spark, f"{folder}/.{name}")
        stream = store.create(p, True)
        stream.write(bytearray(data))
        stream.close()
        edges.append(p)
    whole = [edges[0], *[_store(spark, f)[0] for f in parts], edges[1]]
    try:
        jvm = spark.sparkContext._jvm
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(whole) - 1)
        for i, p in enumerate(whole[1:]):
            rest[i] = p
        store.concat(whole[0], rest)
        draft = whole[0]
    except UnsupportedOperationException:  # most stores have no such call
        draft = _store(spark, f"{folder}/.whole")[0]
        out = store.create(draft, True)
        for p in whole:
            stream = store.open(p)
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 4 << 20, False)
            stream.close()
        out.close()
    store.delete(target, True)
    store.rename(draft, target)
    store.delete(place, True)


def block_run(data: bytes) -> bytes:
    return b"".join(block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))


def write_bam_parts(rows: DataFrame, path: str, header: list[str]) -> None:
    """Rows as a folder of numbered files, each whole with header and end, in the order of the rows."""
    _write(rows, path, header)


def write_bam_sorted(rows: DataFrame, path: str, header: list[str]) -> None:
    """Rows in the order of their places, as a folder of numbered files, each with an index beside it; rows without a place come last.

    Stretches of the order are cut by place and name, so that a place with very many records still spreads over tasks.
    """
    spark = rows.sparkSession
    at = header_bytes(header)[1]
    known = spark.createDataFrame(list(at.items()) or [("", 0)], "rname string, __ref int")
    header = [_ordered(x) if x.startswith("@HD") else x for x in header]
    key = [F.coalesce("__ref", F.lit(2**31 - 1)).alias("__ref"), "pos", "qname", "flag"]
    placed = rows.join(known, "rname", "left").withColumn("__ref", key[0])
    placed = placed.repartitionByRange("__ref", "pos", "qname").sortWithinPartitions("__ref", "pos", "qname", "flag")
    _write(placed, path, header, index="true")


def _ordered(line: str) -> str:
    """The header's first line with the order of the records."""
    return "\t".join([*[x for x in line.split("\t") if not x.startswith("SO:")], "SO:coordinate"])
