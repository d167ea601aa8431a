"""Compressed blocks of alignment files: reading from any byte on, writing with places, and the index over places."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np

# Fixed values of the format: a block's first bytes, its usual header up to its size, and the empty block at the end of a file.
MARK = b"\x1f\x8b\x08\x04"
HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END = HEAD + b"\x1b\x00\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Uncompressed bytes of a block that is written.
BLOCK = 60_000
#: Bytes that a reader asks the store for at once.
AHEAD = 1 << 20


class Damaged(ValueError):
    """A file ends early or does not hold what its blocks say."""


def block(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = made.compress(data) + made.flush()
    return HEAD + struct.pack("<H", len(HEAD) + 2 + len(packed) + 8 - 1) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def header_size(raw: bytes, at: int = 0) -> tuple[int, int] | None:
    """Bytes of a block's header and of the block, by the header's fields whatever else they hold; None if no block begins here."""
    if raw[at : at + 4] != MARK or len(raw) < at + 18:
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    p, stop = at + 12, at + 12 + extra
    while p + 4 <= min(stop, len(raw)):
        size = struct.unpack_from("<H", raw, p + 2)[0]
        if raw[p : p + 2] == b"BC" and size == 2 and p + 6 <= len(raw):
            return 12 + extra, struct.unpack_from("<H", raw, p + 4)[0] + 1
        p += 4 + size
    return None


class Blocks:
    """Blocks of one open file; ``asked`` counts the blocks that were inflated."""

    def __init__(self, stream, size: int, name: str):
        self.stream, self.size, self.name, self.asked = stream, size, name, 0
        self.at, self.held = 0, b""

    def raw(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes from an offset on."""
        if not (self.at <= offset and offset + n <= self.at + len(self.held)):
            self.stream.seek(offset)
            self.at, self.held = offset, bytes(self.stream.read(max(n, AHEAD)))
        return self.held[offset - self.at : offset - self.at + n]

    def block(self, offset: int) -> tuple[bytes, int]:
        """The data of the block at an offset, and where the next one begins; checksum and length must agree."""
        found = header_size(self.raw(offset, 1 << 16))
        if found is None:
            raise Damaged(f"{self.name}: no block at byte {offset}")
        head, size = found
        whole = self.raw(offset, size)
        if len(whole) < size:
            raise Damaged(f"{self.name}: the block at byte {offset} is cut off")
        crc, length = struct.unpack_from("<II", whole, size - 8)
        made = zlib.decompressobj(-15)
        try:
            data = made.decompress(whole[head : size - 8]) + made.flush()
        except zlib.error as e:
            raise Damaged(f"{self.name}: the block at byte {offset} cannot be inflated: {e}") from None
        if not made.eof or made.unused_data or len(data) != length or zlib.crc32(data) != crc:
            raise Damaged(f"{self.name}: the block at byte {offset} does not agree with its checksum and length")
        self.asked += 1
        return data, offset + size

    def next_block(self, start: int, end: int) -> int | None:
        """Where the first block begins that begins in [start, end): its checksum must agree."""
        at = start
        while at < end:
            window = self.raw(at, 1 << 16)
            found = window.find(MARK)
            if found < 0:
                at += max(1, len(window) - 3)
                continue
            at += found
            if at < end:
                try:
                    self.block(at)
                    return at
                except Damaged:
                    at += 1
        return None


class Writer:
    """Data as blocks of a file whose records have places: offset of their block << 16 | offset within it."""

    def __init__(self, stream):
        self.stream, self.done, self.open = stream, 0, bytearray()

    def place(self) -> int:
        """Where the next byte comes; a full block is closed first."""
        if len(self.open) >= BLOCK:
            self._close(BLOCK if len(self.open) > BLOCK else len(self.open))
        return self.done << 16 | len(self.open)

    def write(self, data: bytes) -> None:
        """A record goes whole into a block, if one can hold it."""
        if self.open and len(self.open) + len(data) > BLOCK:
            self._close(len(self.open))
        self.open += data
        while len(self.open) > BLOCK:
            self._close(BLOCK)

    def write_many(self, data, ends: np.ndarray) -> np.ndarray:
        """Records that end at ``ends`` of the data, each as ``write`` does it after ``room``; the places where they begin."""
        view, starts = memoryview(data), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        places, i, n = np.empty(len(ends), np.int64), 0, len(ends)
        while i < n:
            begin = int(starts[i])
            j = int(np.searchsorted(ends, begin + BLOCK - len(self.open), "right"))
            if j <= i and self.open:
                self._close(len(self.open))
                continue
            j = max(j, i + 1)
            places[i:j] = (self.done << 16) + len(self.open) + starts[i:j] - begin
            self.write(view[begin : int(ends[j - 1])])
            i = j
        return places

    def room(self, size: int) -> None:
        """Close the block that has no room for a record of this size, so that ``place`` is where it will begin."""
        if self.open and len(self.open) + size > BLOCK:
            self._close(len(self.open))

    def _close(self, n: int) -> None:
        made = block(bytes(self.open[:n]))
        self.stream.write(made)
        self.done += len(made)
        del self.open[:n]

    def finish(self, end: bool = True) -> None:
        if self.open:
            self._close(len(self.open))
        if end:
            self.stream.write(END)
        self.stream.close()


def bin_of(begin: int, end: int) -> int:
    """The smallest bin of the index that holds a range."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def bins_at(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``bin_of`` of many ranges."""
    out = np.zeros(len(begin), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(begin >> shift == (end - 1) >> shift, first + (begin >> shift), out)
    return out


def bins_of(begin: int, end: int) -> list[int]:
    """All bins that may hold what overlaps a range."""
    out = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out += range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)
    return out


class Index:
    """Chunks by bin and first places by window of 16 KB, for each reference; ``loads`` and ``dumps`` are the format's."""

    MAGIC, WINDOW = b"BAI\x01", 14

    def __init__(self, references: int):
        self.bins = [defaultdict(list) for _ in range(references)]
        self.linear: list[list[int]] = [[] for _ in range(references)]
        self.placeless = 0

    def add(self, ref: int, begin: int, end: int, start: int, stop: int) -> None:
        """A record on [begin, end) of a reference, at places [start, stop). Records come in order."""
        if ref < 0:
            self.placeless += 1
            return
        chunks = self.bins[ref][bin_of(begin, end)]
        if chunks and chunks[-1][1] == start:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        windows, last = self.linear[ref], (end - 1) >> self.WINDOW
        while len(windows) <= last:
            windows.append(start)

    def add_many(self, ref: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray) -> tuple[int, int, int, int] | None:
        """Records in order, each at places up to the next one's; what ``add`` lacks of the last ones, whose end is not known yet.

        Neighbours of one bin and window make one chunk, so only the first of them is added.
        """
        if not len(ref):
            return None
        key = np.stack([ref, np.where(ref < 0, np.arange(len(ref)), bins_at(begin, end)), (end - 1) >> self.WINDOW])
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        rows = list(zip(*(c[first].tolist() for c in (ref, begin, end, places))))
        for row, following in zip(rows, rows[1:]):
            self.add(*row, following[3])
        return rows[-1]

    def chunks(self, ref: int, begin: int, end: int) -> list[list[int]]:
        """Places that may hold records overlapping [begin, end), in order and without overlaps."""
        if not 0 <= ref < len(self.bins):
            return []
        windows = self.linear[ref]
        least = windows[begin >> self.WINDOW] if begin >> self.WINDOW < len(windows) else (windows[-1] if windows else 0)
        out: list[list[int]] = []
        for start, stop in sorted(c for b in bins_of(begin, end) for c in self.bins[ref].get(b, [])):
            if stop <= least:
                continue
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return out

    def dumps(self) -> bytes:
        out = [self.MAGIC, struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.linear):
            out.append(struct.pack("<i", len(bins)))
            for number in sorted(bins):
                out.append(struct.pack("<Ii", number, len(bins[number])))
                out += [struct.pack("<QQ", *c) for c in bins[number]]
            out.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join([*out, struct.pack("<Q", self.placeless)])

    @classmethod
    def loads(cls, data: bytes) -> "Index":
        if data[:4] != cls.MAGIC:
            raise Damaged("not an index")
        at, (count,) = 8, struct.unpack_from("<i", data, 4)
        made = cls(count)
        for ref in range(count):
            (bins,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(bins):
                number, n = struct.unpack_from("<Ii", data, at)
                flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                at += 8 + 16 * n
                if number != 37450:  # a bin of other writers that holds counts
                    made.bins[ref][number] = [list(c) for c in zip(flat[::2], flat[1::2])]
            (n,) = struct.unpack_from("<i", data, at)
            made.linear[ref] = list(struct.unpack_from(f"<{n}Q", data, at + 4))
            at += 4 + 8 * n
        return made
