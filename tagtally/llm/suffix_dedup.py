"""Removal of byte strings that occurred before, by distributed difference-cover suffix sorting.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier (in a document of smaller id, or
earlier in the same document). Equal strings must meet, so the suffixes to sort are dealt out by content:

1. every string of ``LENGTH`` bytes names the least fingerprint of its ``GRAM``-byte grams; strings of consecutive
   starts that name the same one form a run. Equal strings name equal fingerprints, so a fingerprint that only one
   run has proves its strings unique. The fingerprints are counted in packed arrays dealt by range;
2. the documents that hold runs of repeated fingerprints send the text of these runs to the fingerprint's bucket;
3. a bucket keeps one copy of equal run texts, and sorts the suffixes of the distinct ones by the difference-cover
   algorithm: sort the triples at positions 1 and 2 modulo 3, recurse on their names until they are
   distinct, sort the remaining suffixes by first symbol and rank, merge, and compare the prefixes of
   adjacent suffixes; of equal prefixes the earliest stays;
4. the starts found go back to their documents, which cut the union of the strings out.

A run has a bounded number of starts, so a long periodic text is many runs of one fingerprint. A fingerprint that many
runs share keeps spreading: its runs are sorted where they lie, in pieces of bounded size, by the same algorithm, and
only the earliest place of each string goes on, to the bucket of the string's own digest. So no sort ever takes more
than ``STARTS * SPREAD`` strings of one fingerprint, whatever the texts are. Equal run texts of a batch of documents are
sent once as well. Copies of a whole document (equal SHA-256) are settled first: all but the smallest id are removed
whole, if they have ``LENGTH`` bytes.

Sorting all suffixes in one order over all tasks takes a shuffled row for each byte in each round, many times the
input; the difference cover is therefore distributed by dealing its suffixes out by content, and each sort is local.

Fingerprints of a long text are made slice by slice, each with the ``LENGTH - 1`` bytes behind it, so what grows with a text
is the text itself and its runs.

Defined results: a null text has no bytes; rows equal in id and text are one document, each with its result; rows
of one id with different texts are ordered by a 64-bit hash of their digests; a null id comes after all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.llm._common import bounded_batches, durable, planes, shuffle_width, text_slices, trim, unplanes
from tagtally.llm._words import Words, mix

LENGTH, GRAM = 100, 50
#: A run has so many starts at most (a longer one is several), and a fingerprint with more runs than ``SPREAD`` has its
#: strings dealt out one by one: a bucket never holds more than the product of both for one fingerprint.
STARTS, SPREAD = 2048, 2000
#: Bytes of texts that one task of an exchange takes, about.
HOME_BYTES = 32 << 20
#: Bytes that one suffix sort takes together (a larger group of one fingerprint is sorted alone).
SORT_BYTES = 256 << 10

#: Bytes of texts whose fingerprints are made at once.
SLICE = 256 << 10

_LAST = 2**63 - 1


# ---------------------------------------------------------------- runs


def _sliding(h: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = least(h[:-span], h[span:])
        span *= 2
    return least(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


class Runs:
    """Runs of the texts of a batch: per text their first starts, lengths, fingerprints and self-overlap."""

    def __init__(self):
        self.words = Words(seed=4242, fold=False)

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """Arrays ``text, start, size, print, own`` over all runs, start within the text."""
        out, i, most = [], 0, SLICE
        while i < len(offsets) - 1:
            j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
            if j <= i:
                # A long text slides by: each slice holds the strings that start in it, so only its runs grow with the text.
                for at in range(0, int(offsets[i + 1] - offsets[i]), most):
                    part = data[offsets[i] + at : min(offsets[i] + at + most + LENGTH - 1, offsets[i + 1])]
                    found = self._of(part, np.array([0, len(part)]))
                    if found is not None:
                        found[0] += i
                        found[1] += at
                        out.append(found)
                i += 1
                continue
            found = self._of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if found is not None:
                found[0] += i
                out.append(found)
            i = j
        if not out:
            return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool)]
        return [np.concatenate(x) for x in zip(*out)]

    def _of(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        starts = offsets[:-1][np.diff(offsets) >= LENGTH]
        if not len(starts):
            return None
        self.words._tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.values[data] * self.words.powers[:n], out=sums[1:])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * self.words.inverse[: n - GRAM + 1])
        window = LENGTH - GRAM + 1
        v = _sliding(h, window, np.minimum)  # of the string that starts here
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(v)]
        inside = offsets[1:][text] - np.arange(len(v)) >= LENGTH
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
        # Grams that are the least of some string; two equal ones a window apart or less are in one run.
        held = np.where(inside, v, np.uint64(0))
        most = _sliding(np.concatenate([np.zeros(window - 1, np.uint64), held, np.zeros(window - 1, np.uint64)]), window, np.maximum)[: len(h)]
        chosen = np.flatnonzero(most == h)
        twice = np.zeros(len(chosen) + 1, np.int64)
        np.cumsum((h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= window), out=twice[2:])
        lo, hi = np.searchsorted(chosen, first), np.searchsorted(chosen, stop - 1 + window)
        own = (twice[np.maximum(hi, 1)] - twice[np.minimum(lo + 1, len(chosen))] > 0) & (hi - lo > 1)
        if (stop - first).max(initial=0) > STARTS:
            cut = -(-(stop - first) // STARTS)
            nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
            first, stop, own = np.repeat(first, cut) + nth * STARTS, np.repeat(stop, cut), np.repeat(own, cut)
            stop = np.minimum(stop, first + STARTS)
        # Least values lie low; mixed again (one to one) they spread evenly over the ranges that deal them out.
        return [text[first].copy(), first - offsets[text[first]], stop - first, mix(v[first]), own]


# ---------------------------------------------------------------- suffix sorting


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of the keys, and the number of distinct ones."""
    turn = np.argsort(keys)
    ordered = keys[turn]
    rank = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[turn] = rank
    return out, int(rank[-1]) if len(keys) else 0


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key that orders like the pair (a, b)."""
    top_a, top_b = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
    if top_a * top_b < 2**62:
        return a * top_b + b
    return _names(a)[0] * top_b + b


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (integers from 1) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _names(_joined(_joined(padded[sample], padded[sample + 1]), padded[sample + 2]))
    order = suffix_order(names) if distinct < len(sample) else np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    key = _joined(padded, np.append(rank[1:], 0))  # (symbol, rank after it)
    zero = zero[np.argsort(key[zero], kind="stable")]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    after = np.append(key[1:], 0)
    both = _joined(padded, after)  # (symbol, symbol, rank after both)
    place = np.arange(len(zero)) + np.searchsorted(key[ones], key[zero]) + np.searchsorted(both[twos], both[zero])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = ordered
    return out


def equal_prefixes(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal strings of ``length`` bytes among the first ``counts[i]`` starts of each text.

    Returns ``group, text, start`` of all these starts, in suffix order.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    order = suffix_order(joined.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inner = np.arange(len(joined)) - begin[owner]
    order = order[(inner < counts[owner])[order]]
    new = np.ones(len(order), bool)
    windows = np.lib.stride_tricks.sliding_window_view(joined, length) if len(joined) >= length else np.zeros((0, length), np.uint8)
    for k in range(0, len(order) - 1, 32768):
        rows = windows[order[k : k + 32769]]
        new[k + 1 : k + len(rows)] = (rows[1:] != rows[:-1]).any(1)
    return np.cumsum(new) - 1, owner[order], inner[order]


# ---------------------------------------------------------------- the job

_SENT = "part int, home int, kind int, bid long, a binary, b binary, c binary, d binary"
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["part", "home", "kind", "bid", "a", "b", "c", "d"]
_PRINT, _DOCS, _HIT = 0, 1, 2


def _emit(rows: list[tuple], at: int = 0):
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS[at:])]


def _edges(parts: int) -> np.ndarray:
    span = 2**64 // parts + 1
    return np.array([min(p * span, 2**64 - 1) for p in range(parts)], np.uint64)


def _ids(batch) -> np.ndarray:
    ids = batch.column(batch.schema.get_field_index("doc"))
    return ids.to_numpy(zero_copy_only=False)


def _repeated(docs: DataFrame, homes: int) -> DataFrame:
    """``doc, uid, runs, often``: for each document the ordinals of its runs whose fingerprint repeats, and whether it is very frequent."""
    parts = 4 * homes

    def scatter(batches):
        runs = Runs()
        for batch in batches:
            ids, uids = _ids(batch), batch.column(batch.schema.get_field_index("uid")).to_numpy()
            for first, data, offsets in text_slices(batch, "text", 3 << 20):
                last = first + len(offsets) - 1
                own_ids, own_uids = ids[first:last], uids[first:last]
                text, _, _, prints, own = runs.of(data, offsets)
                if not len(text):
                    continue
                begin = np.searchsorted(text, np.arange(last - first + 1))
                ordinal = (np.arange(len(text)) - begin[text]).astype(np.uint32)
                bid = int(mix(np.array([int((mix(own_uids.view(np.uint64)) * np.arange(1, last - first + 1, dtype=np.uint64)).sum()) ^ len(text)], np.uint64)).view(np.int64)[0])
                rows = [(bid % parts, bid % homes, _DOCS, bid, planes(own_ids), planes(own_uids), b"", b"")]
                turn = np.argsort(prints)
                edges = _edges(parts)
                cut = np.searchsorted(prints[turn], edges).tolist() + [len(turn)]
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    pick = turn[cut[p] : cut[p + 1]]
                    # Sorted prints of a range travel as differences, whose high bytes are zeros.
                    rows.append((p, bid % homes, _PRINT, bid, planes(np.diff(prints[pick], prepend=edges[p])), planes(text[pick].astype(np.uint32)), planes(ordinal[pick]), np.packbits(own[pick]).tobytes()))
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays(_emit(rows[k : k + 64]), _NAMES)
            data = batch = None  # before the next one is read
            trim()

    def count(group: pa.Table) -> pa.Table:
        trim()  # what the group before left
        which = group["kind"].to_numpy()
        passed = group.filter(pa.array(which == _DOCS)).select(_NAMES[1:])
        mine = group.filter(pa.array(which == _PRINT))
        rows: list[tuple] = []
        if mine.num_rows:
            lists = [[unplanes(x.as_py(), t) for x in mine[c]] for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.uint32))]
            lists[0] = [np.cumsum(x) + _edges(parts)[mine["part"][0].as_py()] for x in lists[0]]
            prints, text, ordinal = map(np.concatenate, lists)
            own = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(mine["d"], lists[0])])
            chunk = np.repeat(np.arange(mine.num_rows), [len(x) for x in lists[0]])
            turn = np.argsort(prints)
            ordered = prints[turn]
            edge = np.append(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), len(turn))
            sizes = np.repeat(np.diff(edge), np.diff(edge))
            keep = (sizes > 1) | (own[turn] > 0)
            turn, many = turn[keep], (sizes > SPREAD)[keep]
            by_chunk = np.argsort(chunk[turn], kind="stable")
            turn, many = turn[by_chunk], many[by_chunk]
            cut = np.searchsorted(chunk[turn], np.arange(mine.num_rows + 1))
            bids, target = mine["bid"].to_numpy(), mine["home"].to_numpy()
            for i in np.flatnonzero(np.diff(cut)).tolist():
                pick = turn[cut[i] : cut[i + 1]]
                rows.append((int(target[i]), _HIT, int(bids[i]), planes(text[pick]), planes(ordinal[pick]), np.packbits(many[cut[i] : cut[i + 1]]).tobytes(), b""))
        made = pa.Table.from_arrays(_emit(rows, 1), _NAMES[1:])
        return pa.concat_tables([passed.cast(made.schema), made])

    def gather(group: pa.Table) -> pa.Table:
        trim()  # what the group before left
        which, bids = group["kind"].to_numpy(), group["bid"].to_numpy()
        a, b, c = (group[x].to_pylist() for x in "abc")
        out: list[list] = [[], [], [], []]
        heads = {int(bids[i]): i for i in np.flatnonzero(which == _DOCS)}
        hits: dict[int, list[int]] = {}
        for i in np.flatnonzero(which == _HIT).tolist():
            hits.setdefault(int(bids[i]), []).append(i)
        for bid, chunks in hits.items():
            ids, uids = unplanes(a[heads[bid]], np.int64), unplanes(b[heads[bid]], np.int64)
            text = np.concatenate([unplanes(a[i], np.uint32) for i in chunks]).astype(np.int64)
            ordinal = np.concatenate([unplanes(b[i], np.uint32) for i in chunks]).astype(np.int32)
            many = np.concatenate([np.unpackbits(np.frombuffer(c[i], np.uint8), count=len(a[i]) // 4) for i in chunks])
            turn = np.lexsort((ordinal, text))
            text, ordinal, many = text[turn], ordinal[turn], many[turn]
            # A batch that stands in the table twice reports each run twice.
            once = np.r_[True, (text[1:] != text[:-1]) | (ordinal[1:] != ordinal[:-1])]
            text, ordinal, many = text[once], ordinal[once], many[once]
            cut = np.append(np.flatnonzero(np.r_[True, text[1:] != text[:-1]]), len(text))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                out[0].append(int(ids[text[lo]]))
                out[1].append(int(uids[text[lo]]))
                out[2].append(ordinal[lo:hi])
                out[3].append(ordinal[lo:hi][many[lo:hi] > 0])
        ints = pa.list_(pa.int32())
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], ints), pa.array(out[3], ints)], ["doc", "uid", "runs", "often"])

    return (
        docs.mapInArrow(scatter, _SENT).repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(count, _SENT.split(", ", 1)[1])
        .repartitionById(homes, F.col("home")).groupBy("home").applyInArrow(gather, "doc long, uid long, runs array<int>, often array<int>")
    )


def _once(runs: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of runs ``(place, body, starts)`` in order of place: each string's earliest ``(run, start)``, and the others as
    ``(run, first start, end)``."""
    g, t, k = equal_prefixes([r[1] for r in runs], np.array([r[2] for r in runs]))
    turn = np.lexsort((k, t, g))
    new = np.r_[True, g[turn][1:] != g[turn][:-1]]
    firsts, others = turn[new], turn[~new]
    others = others[np.lexsort((k[others], t[others]))]
    cut = np.flatnonzero(np.r_[True, (t[others][1:] != t[others][:-1]) | (np.diff(k[others]) != 1)]) if len(others) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(others)) - 1
    return list(zip(t[firsts].tolist(), k[firsts].tolist())), list(zip(t[others[cut]].tolist(), k[others[cut]].tolist(), (k[others[ends]] + 1).tolist())) if len(others) else []


def _removed(docs: DataFrame, homes: int) -> DataFrame:
    """``doc, uid, lo, hi``: runs of starts of strings that also start earlier; ``docs`` has texts and their repeated runs."""
    parts = 8 * homes
    cuts = "doc long, uid long, lo int, hi int"
    sent = f"part int, print long, body binary, n int, own boolean, {cuts}"

    def scatter(batches):
        runs = Runs()
        for batch in batches:
            ids, uids = _ids(batch), batch.column(batch.schema.get_field_index("uid")).to_numpy()
            wanted, frequent = batch.column(batch.schema.get_field_index("runs")), batch.column(batch.schema.get_field_index("often"))
            for first, data, offsets in text_slices(batch, "text", 2 << 20):
                last = first + len(offsets) - 1
                text, start, size, prints, own = runs.of(data, offsets)
                begin = np.searchsorted(text, np.arange(last - first + 1))
                pick = np.concatenate([begin[i] + np.asarray(wanted[first + i].values, np.int64) for i in range(last - first) if wanted[first + i].is_valid] or [np.zeros(0, np.int64)])
                whole = set(np.concatenate([begin[i] + np.asarray(frequent[first + i].values, np.int64) for i in range(last - first) if frequent[first + i].is_valid] or [np.zeros(0, np.int64)]).tolist())
                raw = data.tobytes()
                rows: list[tuple] = []

                def sure(place: tuple, n: int) -> None:
                    rows.append((place[0] % parts, 0, None, 0, False, *place, place[2] + n))

                # Equal texts of the batch go once, with their earliest place; the other places repeat it for sure.
                kept: dict[tuple, list] = {}
                spread: list[tuple] = []
                for r in pick.tolist():
                    t = int(text[r])
                    at, n = int(offsets[t] + start[r]), int(size[r])
                    place = (int(ids[first + t]), int(uids[first + t]), int(start[r]))
                    if r in whole:
                        spread.append((place, raw[at : at + n - 1 + LENGTH], n))
                    else:
                        kept.setdefault((int(prints[r]), raw[at : at + n - 1 + LENGTH], n, bool(own[r])), []).append(place)
                for (p, body, n, twice), places in kept.items():
                    places = sorted(set(places))  # rows equal in id and text are one document
                    for place in places[1:]:
                        sure(place, n)
                    rows.append((p % parts, p - 2**63, body, n, twice, *places[0], places[0][2] + n))
                # Strings of frequent fingerprints are sorted here, so that each goes on its own but once.
                spread, taken = sorted(set(spread)), 0
                while taken < len(spread):
                    upto, held = taken, 0
                    while upto < len(spread) and (held < SORT_BYTES or upto == taken):
                        held += len(spread[upto][1])
                        upto += 1
                    some = spread[taken:upto]
                    taken = upto
                    strings, later = _once(some)
                    for i, lo, hi in later:
                        place = some[i][0]
                        sure((place[0], place[1], place[2] + lo), hi - lo)
                    for i, k in strings:
                        place, body = some[i][0], some[i][1][k : k + LENGTH]
                        where = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
                        rows.append((where % parts, where - 2**63, body, 1, False, place[0], place[1], place[2] + k, place[2] + k + 1))
                for k in range(0, len(rows), 20000):
                    out = rows[k : k + 20000]
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["part", "print", "body", "n", "own", "doc", "uid", "lo", "hi"])
            data = wanted = frequent = batch = None  # before the next one is read
            trim()

    def sort(group: pa.Table) -> pa.Table:
        trim()  # what the group before left
        known = group["body"].is_null()  # places that repeat for sure
        sure = group.filter(known).select(["doc", "uid", "lo", "hi"])
        group = group.filter(pc.invert(known))
        prints, bodies, counts = group["print"].to_numpy(), group["body"].to_pylist(), group["n"].to_numpy()
        twice = group["own"].to_numpy(zero_copy_only=False)
        doc, uid, lo = group["doc"].to_numpy(), group["uid"].to_numpy(), group["lo"].to_numpy()
        out = []
        # One copy of equal texts: the earliest; the others go whole.
        turn = np.lexsort((lo, uid, doc))
        best: dict[tuple, int] = {}
        for i in turn.tolist():
            b = best.setdefault((int(prints[i]), bodies[i], int(counts[i])), i)
            if (doc[b], uid[b], lo[b]) != (doc[i], uid[i], lo[i]):
                out.append((int(doc[i]), int(uid[i]), int(lo[i]), int(lo[i]) + int(counts[i])))
        groups: dict[int, list[int]] = {}
        for (p, _, _), i in best.items():
            groups.setdefault(p, []).append(i)
        run: list[int] = []

        def settle(run: list[int]) -> None:
            g, t, s = equal_prefixes([bodies[i] for i in run], counts[run])
            row = np.array(run)[t]
            start = lo[row] + s
            order = np.lexsort((start, uid[row], doc[row], g))
            later = np.r_[False, g[order][1:] == g[order][:-1]]
            hit = order[later]
            if len(hit):
                hit = hit[np.lexsort((start[hit], row[hit]))]
                cut = np.append(np.flatnonzero(np.r_[True, (row[hit][1:] != row[hit][:-1]) | (np.diff(start[hit]) != 1)]), len(hit))
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    i = int(row[hit[x]])
                    out.append((int(doc[i]), int(uid[i]), int(start[hit[x]]), int(start[hit[y - 1]]) + 1))

        size = 0
        for members in groups.values():
            # A single text repeats itself only if the gram that its strings name stands in it twice.
            if len(members) == 1 and not twice[members[0]]:
                continue
            run += members
            size += sum(len(bodies[i]) for i in members)
            if size >= SORT_BYTES:
                settle(run)
                run, size = [], 0
        if run:
            settle(run)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        made = pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["doc", "uid", "lo", "hi"])
        return pa.concat_tables([sure.cast(made.schema), made])

    return docs.mapInArrow(scatter, sent).repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(sort, cuts)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if asked for)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("doc", F.coalesce("id", F.lit(_LAST))).withColumn("uid", F.xxhash64("sha"))
    brief = rows.select("doc", "uid", "sha", F.octet_length("text").cast("long").alias("size"))
    firsts = durable(brief.groupBy("sha").agg(F.min("doc").alias("doc"), F.max("size").alias("size")).select("doc", F.xxhash64("sha").alias("uid"), "size", F.lit(True).alias("first")))
    # Exchanges are as wide as the distinct texts ask for.
    homes = max(shuffle_width(docs.sparkSession), -(-(firsts.agg(F.sum("size")).first()[0] or 0) // HOME_BYTES))
    firsts = firsts.drop("size")

    repeated = durable(_repeated(rows.where(F.octet_length("text") >= LENGTH).select("doc", "uid", "text"), homes)).dropDuplicates(["doc", "uid"])
    wanted = repeated.join(firsts, ["doc", "uid"], "left_semi")
    # Both joins take the same columns of the texts, so these are exchanged once.
    texts = rows.select("id", "doc", "uid", "text")
    holders = texts.join(wanted, ["doc", "uid"]).select("id", "doc", "uid", "text", "runs", "often")
    cuts = _removed(holders, homes)
    spans = cuts.groupBy("doc", "uid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))
    found = firsts.join(spans, ["doc", "uid"], "left")

    def cut(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            texts, first, cuts = column("text"), column("first"), column("cuts")
            out: list[tuple] = []
            for i in range(batch.num_rows):
                data = texts[i].as_py().encode()
                if not first[i].as_py():  # a later copy of a whole document
                    spans = [(0, len(data))] if len(data) >= LENGTH else []
                elif cuts[i].is_valid:
                    pairs = np.array([(x["lo"], x["hi"]) for x in cuts[i].as_py()], np.int64)
                    lo, hi = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] - 1 + LENGTH)
                    new = np.r_[True, lo[1:] > hi[:-1]]
                    spans = list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)].tolist()))
                else:
                    spans = []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if keep_text else 4]
            made = [pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column("id"), *made], [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds) + 1])

    joined = texts.join(found, ["doc", "uid"], "left")
    schema = f"`{id_column}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return joined.select("id", "text", "first", "cuts").mapInArrow(cut, schema)
