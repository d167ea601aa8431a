"""How far the sources of each language differ in their words, in exact integers.

Terms are runs of ASCII letters and of characters from U+0080 on, with A-Z lower-cased. A first pass counts in how many
documents of its language each term occurs and keeps those with ``LEAST`` or more. A second pass counts the occurrences
of kept terms with an Aho-Corasick automaton whose words are kept terms between delimiters, run over texts whose
delimiters are single spaces' worth of padding; tasks add up before anything is shuffled.

The vocabulary has no bound. The terms in most documents, ``SHARD_BYTES`` of them, are broadcast and counted where the
texts lie. All other terms are dealt by hash into shards of about ``SHARD_BYTES``, and the words that are not among the
frequent ones are sent, as texts, to the shard of their hash, where the shard's automaton counts them; no word that is
left is frequent, so no shard is hot, and each shard is split further by salts while there are fewer shards than tasks.
So a text is scanned once, whatever the vocabulary, and no task holds more than a shard. A term's probability in a group is p = 1 + floor(10^9 (count + 1) / (N + V)), with N the group's occurrences of kept
terms and V the language's kept terms.

The divergence of two groups sums f(p, q) = floor((p - q)^2 / q) over all kept terms, but most have no count in either. The sum is taken
from sparse postings: V times the value of two zero counts; what the terms of one side change against a zero on the other, from that group's
histogram of counts; and what terms that both hold change beyond that, from blocks of terms in which the sources of a
language meet in tiles of ``TILE``. A block adds up a table of tile x tile numbers; no pair leaves it for a single term.

Defined results: null texts, languages and sources are ''. Repeated rows count each time. A language without kept terms has
pairs of value 0 and no terms. A language with one source has no pairs. An empty table gives no rows. Words of any
length are whole; texts are read in slices that end between words. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtally.llm._common import bounded_batches, durable, hinted, shuffle_width, trim

LEAST, TOP, UNIT = 3, 200, 1_000_000_000
#: Bytes of the terms of a shard, 16 more counted for each (a worker's strings, automaton and set take some nine times as much), of a slice of
#: a text, and of the texts that wait for a shard; keys that a task adds up before it passes them on.
SHARD_BYTES, SLICE, WAITING, HELD = 32 << 20, 1 << 20, 4 << 20, 500_000
#: Sources of a tile, and postings of a block of terms.
TILE, BLOCK_ROWS = 256, 200_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None):
    """Slices of a text in UTF-8 that end between words, folded: letters small, all else spaces."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        stop = at + SLICE
        if stop < len(data):
            cut = data.rfind(b" ", at, stop)
            stop = cut + 1 if cut > at else data.find(b" ", stop) + 1 or len(data)
        yield data[at:stop]
        at = stop


def _rows(found: dict, kinds: list) -> pa.RecordBatch:
    """Keys (tuples of texts) and counts as a batch."""
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(kinds) - 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], kinds)


def _documents(docs: DataFrame, text_column: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_column, "text"), ("lang", "lang"), ("source", "source"))])


def document_frequencies(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``lang, term, n``: documents of the language that hold the term."""

    def count(batches):
        found: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
                terms: set[bytes] = set()
                for data in folded(text.as_py()):
                    terms.update(data.split())
                found.setdefault(lang, Counter()).update(terms)
            held = sum(map(len, found.values()))
            if held >= HELD:
                yield _flat(found)
                found = {}
        yield _flat(found)
        trim()

    def _flat(found):
        return _rows({(lang, t.decode()): n for lang, terms in found.items() for t, n in terms.items()}, ["lang", "term", "n"])

    rows = _documents(docs, text_column).select("text", "lang").mapInArrow(count, "lang string, term string, n bigint")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = LEAST, text_column: str = "text") -> DataFrame:
    """``lang, term, n`` of the terms in at least so many documents of the language."""
    return durable(document_frequencies(docs, text_column).where(F.col("n") >= least))


def _built(terms):
    """An automaton whose words are terms between delimiters."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(f" {t} ", t)
    made.make_automaton()
    return made


def _found(automaton, words: str):
    """The terms of an automaton that occur in folded text, one for each occurrence."""
    return map(itemgetter(1), automaton.iter(f" {words} "))


#: The frequent terms' automata and sets that this worker holds, by language, for one broadcast.
_HELD: dict = {}


def _frequent(name: int, terms: dict[str, list[str]], lang: str, rest: bool):
    if _HELD.get("name") != name:
        _HELD.clear()
        _HELD["name"] = name
    if lang not in _HELD:
        own = terms.get(lang, [])
        _HELD[lang] = (_built(own) if own else None, set(own) if rest else set())
    return _HELD[lang]


_COUNTS = "key int, kind int, lang string, source string, term string, n bigint"


def scanned(docs: DataFrame, frequent: dict[str, list[str]], shards: int, salts: int, text_column: str) -> DataFrame:
    """``key, kind, lang, source, term, n``: counts of frequent terms (kind 2), added up within tasks, and texts of all other words by shard (kind 1)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    name = held._jbroadcast.id()

    def count(batches):
        found: dict[tuple, Counter] = {}
        rest: dict[tuple, list[bytes]] = {}
        salt = kept = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
                automaton, own = _frequent(name, held.value, lang, shards > 0)
                mine = found.setdefault((lang, source), Counter())
                for data in folded(text.as_py()):
                    words = data.decode()
                    if automaton is not None:
                        mine.update(_found(automaton, words))
                    if shards:
                        for w in words.split(" "):
                            if w and w not in own:
                                rest.setdefault((crc32(w.encode()) % shards, lang, source), []).append(w)
                                kept += len(w) + 1
                    if kept > WAITING:
                        yield _texts(rest, salt, salts)
                        rest, kept, salt = {}, 0, salt + 1
            if sum(map(len, found.values())) >= HELD:
                yield _flat(found)
                found = {}
        yield _texts(rest, salt, salts)
        yield _flat(found)
        trim()

    def _flat(found):
        rows = _rows({(*g, t): n for g, terms in found.items() for t, n in terms.items()}, ["lang", "source", "term", "n"])
        same = lambda v: pa.array(np.full(rows.num_rows, v, np.int32))
        return pa.RecordBatch.from_arrays([same(0), same(2), *rows.columns], ["key", "kind", "lang", "source", "term", "n"])

    def _texts(rest, salt, salts):
        rows = list(rest.items())
        column = lambda i, kind: pa.array([k[i] for k, _ in rows], kind)
        keys = pa.array([k[0] * salts + salt % salts for k, _ in rows], pa.int32())
        texts = pa.array([" ".join(w) for _, w in rows], pa.string())
        return pa.RecordBatch.from_arrays([keys, pa.array([1] * len(rows), pa.int32()), column(1, pa.string()), column(2, pa.string()), texts, pa.array([0] * len(rows), pa.int64())], ["key", "kind", "lang", "source", "term", "n"])

    return _documents(docs, text_column).mapInArrow(count, _COUNTS)


def _recount(batches):
    """Counts of the terms of shards; rows come by shard, the terms (kind 0) before the texts (kind 1)."""
    key, terms, automata, found = None, {}, {}, {}

    def out():
        return _rows({(*g, t): n for g, c in found.items() for t, n in c.items()}, ["lang", "source", "term", "n"])

    for batch in batches:
        for k, kind, lang, source, term in zip(*(batch[c].to_pylist() for c in ("key", "kind", "lang", "source", "term"))):
            if k != key:
                key, terms, automata = k, {}, {}
            if kind == 0:
                terms.setdefault(lang, []).append(term)
                continue
            if lang not in automata:
                automata[lang] = _built(terms.pop(lang)) if lang in terms else None
            if automata[lang] is not None:
                found.setdefault((lang, source), Counter()).update(_found(automata[lang], term))
        if sum(map(len, found.values())) >= HELD:
            yield out()
            found = {}
    yield out()
    trim()


def postings(docs: DataFrame, kept: DataFrame, text_column: str = "text") -> DataFrame:
    """``lang, source, term, n, all_n`` of all kept terms that occur."""
    spark = docs.sparkSession
    weight = F.octet_length("term") + 16
    size, rows = kept.agg(F.sum(weight), F.count("*")).first()
    size = size or 0
    frequent: dict[str, list[str]] = {}
    split = kept.select("lang", "term").where("false")
    if size <= SHARD_BYTES:
        top = kept
    else:
        # The frequent terms are those in most documents: so many that they hold SHARD_BYTES, by the sizes for each number of documents.
        sizes = kept.groupBy("n").agg(F.sum(weight).alias("s")).orderBy(F.desc("n")).limit(SHARD_BYTES // 17).collect()
        total, least = 0, None
        for r in sizes:
            total += r["s"]
            if total > SHARD_BYTES:
                break
            least = r["n"]
        top = kept.where(F.col("n") >= least) if least is not None else kept.where("false")
        split = kept.where(F.col("n") < least) if least is not None else kept
    for lang, term in zip(*top.select("lang", "term").toArrow().to_pydict().values()):
        frequent.setdefault(lang, []).append(term)
    held = sum(len(t.encode()) + 16 for terms in frequent.values() for t in terms)
    shards = -(-(size - held) // SHARD_BYTES) if size > held else 0
    salts = max(1, -(-shuffle_width(spark) // shards)) if shards else 1
    both = scanned(docs, frequent, shards, salts, text_column)
    if not shards:
        return _summed(both)
    both = durable(both)
    places = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    words = split.select((F.crc32(F.col("term").cast("binary")) % shards).cast("int").alias("shard"), "lang", "term").withColumn("salt", places)
    words = words.select((F.col("shard") * salts + F.col("salt")).cast("int").alias("key"), F.lit(0).alias("kind"), "lang", F.lit("").alias("source"), "term", F.lit(0).cast("long").alias("n"))
    texts = both.where("kind = 1").unionByName(words).repartition(shards * salts, "key").sortWithinPartitions("key", "kind")
    counted = texts.mapInArrow(_recount, "lang string, source string, term string, n bigint")
    return _summed(both.where("kind = 2").select("lang", "source", "term", "n").unionByName(counted))


def _summed(counted: DataFrame) -> DataFrame:
    """``lang, source, term, n, all_n``: sums of the tasks' counts, and of all the language's sources; one exchange, by term, serves both.

    A term has at most a row for each source and task, which are added up before the sort of its window.
    """
    rows = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return durable(rows.withColumn("all_n", F.sum("n").over(Window.partitionBy("lang", "term"))))


def _chance(count, total, terms):
    """p of a count: exact in decimals, since a billion times a count may be beyond a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.expr("1") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(count) + F.lit(1).cast("decimal(1,0)")), wide(total) + wide(terms))


def _value(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _tiles(rows: DataFrame) -> DataFrame:
    """``lang, a, b, more``: for each two numbered sources of a language that share terms, what sharing adds to the value of b seen from a.

    ``rows`` has ``lang, block, ta, tb, side, number, term, p, zero``: postings of one block of terms and two tiles,
    ``side`` 0 for tile ta and 1 for tile tb (one tile stands on both sides with side 0 alone).
    """

    def add(table: pa.Table) -> pa.Table:
        lang, ta, tb = table["lang"][0].as_py(), table["ta"][0].as_py(), table["tb"][0].as_py()
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        side, number, p, zero = (table[c].to_numpy() for c in ("side", "number", "p", "zero"))
        left = np.flatnonzero(side == 0)
        right = left if ta == tb else np.flatnonzero(side == 1)
        left, right = left[np.argsort(term[left], kind="stable")], right[np.argsort(term[right], kind="stable")]
        lo, hi = np.searchsorted(term[right], term[left], "left"), np.searchsorted(term[right], term[left], "right")
        sums = np.zeros((2, TILE * TILE), np.int64)
        ends, at = np.cumsum(hi - lo), 0
        while at < len(left):  # pairs of postings of one term, some million at a time
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
            n = (hi - lo)[at:stop]
            i = np.repeat(left[at:stop], n)
            j = right[np.repeat(lo[at:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            cell = number[i] % TILE * TILE + number[j] % TILE
            np.add.at(sums[0], cell, _beyond(p[i], p[j], zero[i], zero[j]))
            if ta != tb:
                np.add.at(sums[1], cell, _beyond(p[j], p[i], zero[j], zero[i]))
            at = stop
        out = []
        for k, (x, y) in enumerate(((ta, tb), (tb, ta))[: 1 if ta == tb else 2]):
            cell = np.flatnonzero(sums[k])
            a, b = cell // TILE, cell % TILE
            out.append((a + ta * TILE, b + tb * TILE, sums[k][cell]) if k == 0 else (b + tb * TILE, a + ta * TILE, sums[k][cell]))
        a, b, more = (np.concatenate(v) for v in zip(*out))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a.astype(np.int32), "b": b.astype(np.int32), "more": more})

    made = rows.groupBy("lang", "block", "ta", "tb").applyInArrow(add, "lang string, a int, b int, more bigint")
    return made.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _beyond(p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term in both groups adds beyond the changes that each side makes alone."""
    return _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_column: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence from each other source, and the terms a source has more of than its language."""
    spark = docs.sparkSession
    kept = kept_terms(docs, least, text_column)
    found = postings(docs, kept, text_column)
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    shapes = found.groupBy("lang", "source", "n").agg(F.count("*").alias("c"))
    shapes = shapes.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("c")).alias("total"), F.collect_list(F.struct("n", "c")).alias("counts"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(terms, "lang", "left").join(shapes, ["lang", "source"], "left")
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = groups.select("lang", "source", (F.row_number().over(numbered) - 1).alias("number"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("counts", F.array().cast("array<struct<n: bigint, c: bigint>>")).alias("counts"))
    chance = lambda n: F.when(F.col("terms") > 0, _chance(n, F.col("total"), F.col("terms"))).otherwise(1)
    groups = groups.withColumn("zero", chance(F.lit(0)))
    groups = durable(groups.withColumn("counts", F.transform("counts", lambda x: F.struct(chance(x["n"]).alias("p"), x["c"].alias("c")))))

    # Groups are counted, so that a broadcast of them is one of known size.
    many = groups.count()
    small = hinted(groups.select("lang", "source", "number", "terms", "total", "zero"), many)
    langs = hinted(groups.groupBy("lang").agg(F.sum("total").alias("all_total"), (F.max("number") / TILE).cast("int").alias("last")), many)
    placed = found.join(small, ["lang", "source"]).join(langs, "lang").withColumn("p", _chance(F.col("n"), F.col("total"), F.col("terms")))
    blocks = max(1, -(-found.count() // BLOCK_ROWS))
    tiled = placed.select("lang", "term", "number", "p", "zero", "last", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block"), (F.col("number") / TILE).cast("int").alias("tile"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiled = tiled.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "number", "term", "p", "zero")
    shared = _tiles(tiled)

    a = groups.select("lang", "source", F.col("number").alias("a"), "terms", F.col("counts").alias("own"), F.col("zero").alias("p0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("counts").alias("others"), F.col("zero").alias("q0"))
    pairs = a.join(b, "lang").where("a <> b").join(shared, ["lang", "a", "b"], "left")
    base = _value("p0", "q0")
    value = f"""if(terms = 0, 0L, terms * {base} + coalesce(more, 0L)
        + aggregate(own, 0L, (s, x) -> s + x.c * ({_value("x.p", "q0")} - {base}))
        + aggregate(others, 0L, (s, x) -> s + x.c * ({_value("p0", "x.p")} - {base})))"""
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(value).alias("value"))

    q = _chance(F.col("all_n"), F.col("all_total"), F.col("terms"))
    ranked = placed.withColumn("q", q).where("p > q")
    ranked = ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_value("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(ranked)
