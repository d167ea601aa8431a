"""Byte-level BPE encoding and decoding with a public vocabulary, in batched numpy merge rounds.

Words that no earlier batch of the task has met are encoded together: the symbols of all of them stand in one
flat array, with the word of each symbol beside it. A round looks every adjacent pair of a word up by binary
search over the sorted pair keys, finds the lowest rank of each word, and merges all its occurrences from left
to right; rounds go on until no word has a pair that merges. Since a merged symbol's own merges have higher
ranks, this is the order in which a word's merges apply one by one. Words repeat, so the encoded bytes of a
word are kept, up to a bounded number of words; clearing them changes nothing but time.

Texts are cut where a space precedes something that is no white space: a pre-token never crosses such a cut,
so a piece between cuts can be looked up whole. A text in which white space stands where a piece begins is
split by the pre-token pattern itself. Special tokens are matched in the text first, leftmost and longest.

A text of more than ``SLICE`` characters is encoded in slices that end where a pre-token begins; its ids, digests and decoded
text are those of the whole. Only a run without such a place, such as one word of many megabytes, is worked on in one piece.

Defined results: a null text is empty, an empty text has no tokens; texts of any length are encoded whole;
repeated rows give repeated results; other columns are kept by ``encode`` and not read by ``digests``.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagtally.llm._common import bounded_batches, trim

#: The pre-token pattern of byte-level BPE, a fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose encoding a task keeps at most, and characters that are encoded at once.
KEEP, SLICE = 200_000, 1 << 20

_PLACES = re.compile(r" (?=\w)|(?<=\S)\n(?=\w)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Arrays of a tokenizer file, small enough to broadcast: their size is that of the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        names = byte_symbols()
        back = {c: b for b, c in enumerate(names)}
        vocab = made["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = np.array([vocab[c] for c in names], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made_ids = np.array([vocab[a + b] for a, b in merges], np.int64)
        turn = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[turn], turn.astype(np.int64), made_ids[turn]
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    @classmethod
    def of(cls, state: dict) -> "Vocabulary":
        """A vocabulary from the plain ``vars`` of another, which travel without this module."""
        made = cls.__new__(cls)
        vars(made).update(state)
        return made


def merge_rounds(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word's begin (one entry more)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.first[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    none = len(v.keys)
    while len(symbols):
        pairs = symbols[:-1] * v.size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, pairs), none - 1)
        own = owner[:-1]
        rank = np.where((v.keys[at] == pairs) & (own == owner[1:]), v.ranks[at], none)
        # Symbols of a word stand together, and its last one is paired with the next word's first.
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(own)))) if len(own) else rank
        live = np.append(low < none, len(own) > 0 and owner[-1] == own[-1] and low[-1] < none)
        if not live.all():
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
            if not live.any():
                break
            # Whole words leave, so the pairs inside the words that stay keep their places.
            sel = np.flatnonzero(live)
            rank, low = np.append(rank, none)[sel][:-1], np.append(low, none)[sel][:-1]
            at = np.append(at, 0)[sel][:-1]
            symbols, owner = symbols[sel], owner[sel]
        hit = np.flatnonzero((rank < none) & (rank == low))
        # In a run of overlapping occurrences every second one merges, from the left.
        begins = np.r_[True, np.diff(hit) != 1]
        place = np.arange(len(hit))
        place -= np.maximum.accumulate(np.where(begins, place, 0))
        hit = hit[place % 2 == 0]
        symbols[hit] = v.made[at[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    symbols, owner = np.concatenate([*done_symbols, symbols[:0]]), np.concatenate([*done_owner, owner[:0]])
    turn = np.argsort(owner, kind="stable")
    return symbols[turn], np.searchsorted(owner[turn], np.arange(len(words) + 1))


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, v: Vocabulary):
        import regex

        self.v, self.split = v, regex.compile(PATTERN).findall
        self.kept: dict[str, bytes] = {}
        # Longest first: among special tokens that begin at one place the longest matches.
        found = sorted(v.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.texts = [(t, i.to_bytes(4, "little")) for t, i in v.special.items()]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are new; a piece is a run of whole pre-tokens."""
        if len(self.kept) + len(pieces) > KEEP:
            self.kept.clear()
        fresh, words = list(pieces), {}
        cuts = [self.split(p) for p in fresh]
        for cut in cuts:
            for w in cut:
                words.setdefault(w, len(words))
        ids, bounds = merge_rounds([w.encode() for w in words], self.v)
        data = ids.astype("<u4").tobytes()
        of = [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for p, cut in zip(fresh, cuts):
            self.kept[p] = b"".join([of[words[w]] for w in cut])

    def pieces(self, text: str) -> list[str]:
        parts = text.split(" ")
        first, rest = parts[0], parts[1:]
        for p in set(rest):
            if not p or p[0].isspace() or p[0] in "\x1c\x1d\x1e\x1f\x85":
                return self.split(text)
        cut = [" " + p for p in rest]
        return [first, *cut] if first else cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a bounded batch of texts."""
        plain: list[list] = []
        for text in texts:
            if self.special is not None and any(t in text for t, _ in self.texts):
                out, at = [], 0
                for m in self.special.finditer(text):
                    out += [self.pieces(text[at : m.start()]), self.v.special[m[0]].to_bytes(4, "little")]
                    at = m.end()
                plain.append([*out, self.pieces(text[at:])])
            else:
                plain.append([self.pieces(text)])
        kept = self.kept
        new = {p for runs in plain for run in runs if type(run) is list for p in run if p not in kept}
        if new:
            if len(kept) + len(new) > KEEP:
                new = {p for runs in plain for run in runs if type(run) is list for p in run}
            self.learn(new)
            kept = self.kept
        get = kept.__getitem__
        return [b"".join([b"".join(map(get, run)) if type(run) is list else run for run in runs]) for runs in plain]


def slices(text: str, special: list[str]):
    """A long text in slices that no pre-token and no special token crosses.

    A pre-token begins wherever a space, or a line end behind no white space, stands before a letter, digit or underscore: with the space, or
    behind the line end. A slice without such a place grows until it has one.
    """
    reach = max(map(len, special), default=0)
    at = 0
    while at < len(text):
        stop, step, seen = at + SLICE, SLICE, max(at + 1, at + SLICE - 4096)
        while stop < len(text):
            places = [m.end() if m[0] == "\n" else m.start() for m in _PLACES.finditer(text, seen, stop)]
            places = [p for p in places if p > at and not any(p - reach < k < p < k + len(t) for t in special for k in _found(t, text, p - reach, p + reach))]
            if places:
                stop = places[-1]
                break
            step *= 2
            seen, stop = max(at + 1, stop - 2), at + step
        yield text[at:stop]
        at = stop


def _found(what: str, text: str, lo: int, hi: int) -> list[int]:
    """Where something begins in a stretch of a text."""
    out, at = [], text.find(what, max(lo, 0), hi)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1, hi)
    return out


class Decoder:
    """Ids back to text: the bytes of the tokens, joined; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, v: Vocabulary):
        self.get = v.bytes.__getitem__

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _batches(column: pa.Array):
    """Texts of a column, in runs of about ``SLICE`` characters; a longer text comes alone."""
    run, size, most = [], 0, SLICE
    for text in column:
        text = text.as_py() or ""
        if len(text) > most and run:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _applied(docs: DataFrame, path: str, text_column: str, keep: list[str], schema: str, with_ids: bool) -> DataFrame:
    bounded_batches(docs.sparkSession, 8 << 20)  # smaller ones cost more rounds and give little memory back
    table = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        v = Vocabulary.of(table.value)
        encoder, decoder = Encoder(v), Decoder(v)
        for batch in batches:
            column, done = batch.column(batch.schema.get_field_index(text_column)), 0
            for texts in _batches(column):
                parts = [slices(texts[0], list(v.special))] if len(texts[0]) > SLICE else [[t] for t in texts]
                # Short texts are encoded together; the slices of a long one one after the other.
                known = None if len(texts[0]) > SLICE else iter(encoder.encode(texts))
                rows_made = []
                for run_of in parts:
                    n, of_ids, of_text, held = 0, hashlib.sha256(), hashlib.sha256(), []
                    for part in run_of:
                        ids = next(known) if known is not None else encoder.encode([part])[0]
                        n += len(ids) // 4
                        of_ids.update(ids)
                        of_text.update(decoder.decode(ids).encode())
                        if with_ids:
                            held.append(ids)
                    rows_made.append((n, of_ids.hexdigest(), of_text.hexdigest(), b"".join(held)))
                kinds_made = [pa.int64(), pa.string(), pa.string(), pa.binary()][: 4 if with_ids else 3]
                made = [pa.array([r[i] for r in rows_made], k) for i, k in enumerate(kinds_made)]
                rows = batch.slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], *made], [*keep, *names])
                done += len(texts)
            trim()

    kinds = dict(docs.dtypes)
    columns = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], schema])
    return docs.select(*dict.fromkeys([*keep, text_column])).mapInArrow(run, columns)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return _applied(docs, path, text_column, [id_column], "n_tokens long, ids_sha256 string, decoded_sha256 string", False)


def encode(docs: DataFrame, path: str, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, ``n_tokens``, digests, and ``ids``: little-endian unsigned 32-bit integers."""
    return _applied(docs, path, text_column, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary", True)


def decode(rows: DataFrame, path: str, ids_column: str = "ids", out_column: str = "text") -> DataFrame:
    """Rows with the text of their packed ids in ``out_column`` (a null stays null)."""
    table = rows.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches):
        decoder = Decoder(Vocabulary.of(table.value))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            texts = pa.array([None if x is None else decoder.decode(x) for x in ids.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out_column])

    columns = ", ".join([*[f"`{c}` {k}" for c, k in rows.dtypes], f"`{out_column}` string"])
    return rows.mapInArrow(run, columns)
