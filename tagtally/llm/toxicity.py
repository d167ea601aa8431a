"""Toxicity scores by a convolutional text classifier trained in numpy.

Words are runs of letters and digits (ASCII case folded). They are hashed twice into a table of embeddings, and
their first ``STEM`` bytes once; the sum of the three is a word's vector, so that one collision alone does not make
a word look like another and forms of a word share a part. Filters of widths 1, 2 and 3 run over the word vectors;
each filter's greatest response in the whole text (max pooling, over texts of any length) goes into a logistic
layer. Embeddings start from the smoothed log-odds of their words over the training texts and are trained with the
filters by Adam.

All labelled texts train. They are dealt by hash into groups of some ``GROUP_ROWS`` texts, each of one fold of two. Every
group starts from the log-odds that are counted over all texts of its fold and trains by itself; the groups' weights are
averaged by their texts, a word's embedding by the texts of the fold that hold the word, and then those of the folds. Slope and offset of the
logits and the thresholds come from the logits of all these texts, each by the weights of the other fold. Tables have a
fixed size, so nothing that a task or the driver holds grows with the corpus. A threshold for each language is calibrated
on a grid of logits, ``GRID`` to one; it decides ``flagged``, never the score.

A text of any length is read in slices and pooled part by part; its words' fingerprints are what grows with it.

Defined results: a null or empty text has the score of no words (below every threshold); repeated rows have
equal scores, and each row of a labelled id teaches; rows with null labels teach nothing; without any usable labels all scores are 0. Scores do not
depend on the other rows of a batch. ``score`` keeps all columns of its input, whatever their names; one that is
called ``score`` gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.llm._common import bounded_batches, durable, hinted, text_slices, trim
from tagtally.llm._words import Words, mix

#: Texts of a group on average, and the bytes of texts that train together at most; what a group has beyond them trains by itself.
GROUP_ROWS, SAMPLE_BYTES = 2000, 32 << 20
BUCKETS, SIZE, FILTERS, WIDTHS, STEM = 1 << 18, 4, 4, (1, 2, 3), 6
THRESHOLD = 0.7
#: Words whose responses are made at once, table rows that are added up in one task, and places of thresholds in a unit of logits.
PART, BLOCK, GRID = 100_000, 1 << 13, 1024

_PAD = 0


def _folded() -> Words:
    """Word fingerprints that see letters and digits only: other ASCII characters count as white space."""
    words = Words(seed=977)
    for b in range(128):
        if not chr(b).isalnum():
            words.solid[b] = False
    return words


def _buckets(h: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three table rows of each word; row 0 is kept for padding."""
    a = (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    b = (mix(h ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    c = (mix(stems ^ np.uint64(0xC13FA9A902A6328F)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return a, b, c


def _responses(tables: list[list[np.ndarray]], a: np.ndarray, b: np.ndarray, c: np.ndarray, bounds: np.ndarray, windows: int | None = None) -> np.ndarray:
    """Max-pooled responses (texts x filters of all widths); of a part of one text, those of the first ``windows`` words.

    ``tables[w][j]`` is the response of each table row as the j-th word under filters of the w-th width.
    """
    texts = len(bounds) - 1
    pooled = []
    lengths = np.diff(bounds)
    some = lengths > 0
    for table in tables:
        k = len(table)
        r = table[0][a] + table[0][b] + table[0][c]
        inside = np.repeat(bounds[1:], lengths) if k > 1 else None
        for j in range(1, k):
            x = np.zeros_like(r)
            x[: len(r) - j] = table[j][a[j:]] + table[j][b[j:]] + table[j][c[j:]]
            x[np.arange(len(r)) + j >= inside] = 0  # words past the end are padding, whose embedding is zero
            r = r + x
        top = np.zeros((texts, r.shape[1]), np.float32)
        if some.any():
            top[some] = np.maximum.reduceat(r[:windows], bounds[:-1][some])
        pooled.append(np.maximum(top, 0))
    return np.concatenate(pooled, 1)


class Classifier:
    """Embeddings, filters and the logistic layer, with what training needs."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS, SIZE), np.float32)
        self.filters = [[rng.normal(0, 0.15, (SIZE, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        for f in self.filters:
            for j in range(len(f)):
                f[j][0] = 1.0 / len(f) + rng.uniform(-0.1, 0.1, FILTERS)
        self.weights = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.float32(-2.0)
        self.rng = rng

    def state(self) -> dict:
        """What scoring needs; small beside the tables that a worker makes of it."""
        return {"embedding": self.embedding, "filters": self.filters, "bias": float(self.bias), "weights": [float(w) for w in self.weights]}

    def begin(self, counts: np.ndarray, n: np.ndarray) -> None:
        """First coordinate: log-odds of the word's row over texts, by the texts of each label that hold it; the others: small noise on rows that occur."""
        rate = (counts + 0.5) / (np.maximum(n, 1)[:, None] + 1.0)
        odds = np.log(rate[1] / rate[0])
        seen = counts.sum(0)
        # A row that few texts have says little: shrink towards zero.
        self.embedding[:, 0] = odds * seen / (seen + 4) / 2
        self.embedding[:, 1:] = self.rng.normal(0, 0.02, (BUCKETS, SIZE - 1)) * (seen > 1)[:, None]
        self.embedding[seen == 0] = 0
        self.embedding[_PAD] = 0

    def train(self, texts: list[tuple[np.ndarray, ...]], labels: np.ndarray, share: float, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> None:
        groups = [[self.embedding], *self.filters, [self.weights], [np.zeros(1, np.float32)]]
        flat = [p for g in groups for p in g]
        flat[-1][0] = self.bias
        first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
        share = min(max(share, 1e-3), 0.999)
        # Classes weigh between their share of all texts and an even split.
        weight = np.where(labels == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
        step = 0
        for _ in range(epochs):
            turn = self.rng.permutation(len(texts))
            for lo in range(0, len(turn), batch):
                pick = turn[lo : lo + batch]
                a, b, c = (np.concatenate([texts[i][s] for i in pick]) for s in (0, 1, 2))
                bounds = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in pick])])
                grads = self._gradients(a, b, c, bounds, labels[pick], weight[pick], flat)
                step += 1
                scale = rate * (1 - 0.95**step) ** 0.5 if step < 50 else rate
                for p, m, v, (rows, g) in zip(flat, first, second, grads):
                    if rows is None:
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        p -= scale * m / (np.sqrt(v) + 1e-3)
                    elif len(rows):
                        m[rows] += 0.1 * (g - m[rows])
                        v[rows] += 0.01 * (g * g - v[rows])
                        p[rows] -= scale * m[rows] / (np.sqrt(v[rows]) + 1e-3)
                self.embedding[_PAD] = 0
        self.bias = np.float32(flat[-1][0])

    def _vectors(self, a, b, c):
        return self.embedding[a] + self.embedding[b] + self.embedding[c]

    def _peaks(self, a, b, c, bounds):
        """Greatest response of each filter in each text (0 without words) and for each width the word where it begins; by parts of ``PART`` words."""
        n, texts = len(a), len(bounds) - 1
        pooled = np.full((texts, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        peaks = [np.zeros((texts, FILTERS), np.int64) for _ in WIDTHS]
        for lo in range(0, n, PART):
            hi = min(lo + PART, n)
            own = slice(lo, min(hi + max(WIDTHS) - 1, n))
            vectors = self._vectors(a[own], b[own], c[own])
            first, last = int(np.searchsorted(bounds, lo, "right")) - 1, int(np.searchsorted(bounds, hi, "left"))
            edge = np.clip(bounds[first : last + 1], lo, hi) - lo
            end = np.repeat(bounds[first + 1 : last + 1] - lo, np.diff(edge))
            some = np.flatnonzero(np.diff(edge) > 0)
            for k, f in enumerate(self.filters):
                r = (vectors @ f[0])[: hi - lo]
                for j in range(1, len(f)):
                    x = np.zeros_like(r)
                    y = vectors[j : hi - lo + j] @ f[j]
                    x[: len(y)] = y
                    x[np.arange(hi - lo) + j >= end] = 0
                    r += x
                at = np.zeros((len(edge) - 1, FILTERS), np.int64)
                for i in some:
                    at[i] = edge[i] + r[edge[i] : edge[i + 1]].argmax(0)
                top = np.full(at.shape, -np.inf, np.float32)
                top[some] = np.take_along_axis(r, at[some], 0)
                held = pooled[first:last, k * FILTERS : (k + 1) * FILTERS]
                peaks[k][first:last] = np.where(top > held, at + lo, peaks[k][first:last])
                np.maximum(held, top, out=held)
        pooled[np.diff(bounds) == 0] = 0
        return pooled, peaks

    def _gradients(self, a, b, c, bounds, y, weight, flat):
        texts = len(bounds) - 1
        pooled, peaks = self._peaks(a, b, c, bounds)
        empty = np.diff(bounds) == 0
        active = pooled > 0
        z = np.where(active, pooled, 0) @ self.weights + flat[-1][0]
        error = weight * (1 / (1 + np.exp(-z)) - y) / texts
        g_weights = np.where(active, pooled, 0).T @ error + 2e-4 * self.weights
        g_bias = np.array([error.sum()], np.float32)
        g_pooled = error[:, None] * self.weights * active
        rows, values, out = [], [], []
        for k, f in enumerate(self.filters):
            g = g_pooled[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(f)):
                g_f = np.zeros_like(f[j])
                for i in range(FILTERS):
                    at = peaks[k][:, i] + j
                    ok = ~empty & (at < bounds[1:]) & (g[:, i] != 0)
                    if ok.any():
                        g_f[:, i] = self._vectors(a[at[ok]], b[at[ok]], c[at[ok]]).T @ g[ok, i]
                        back = g[ok, i][:, None] * f[j][:, i]
                        rows += [a[at[ok]], b[at[ok]], c[at[ok]]]
                        values += [back, back, back]
                out.append((None, g_f))
        if rows:
            rows, values = np.concatenate(rows), np.concatenate(values)
            distinct, place = np.unique(rows, return_inverse=True)
            g_e = np.zeros((len(distinct), SIZE), np.float32)
            np.add.at(g_e, place, values)
        else:
            distinct, g_e = np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32)
        return [(distinct, g_e), *out, (None, g_weights.astype(np.float32)), (None, g_bias)]


def _tables(model: dict) -> list[list[np.ndarray]]:
    """Response of each table row as each word of each filter width."""
    return [[(model["embedding"] @ w).astype(np.float32) for w in f] for f in model["filters"]]


def _logits(model: dict, tables: list[list[np.ndarray]], words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    h, bounds = words.words(data, offsets)
    stems = words.beginnings(data, offsets, STEM)
    out, i = [], 0
    while i < len(bounds) - 1:  # texts of some 100,000 words at a time; a longer text in parts, with the words that the last windows reach into
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART, "right")) - 1)
        if bounds[j] - bounds[i] > PART:
            pooled = None
            for at in range(int(bounds[i]), int(bounds[j]), PART):
                own = slice(at, min(at + PART + max(WIDTHS) - 1, bounds[j]))
                part = _responses(tables, *_buckets(h[own], stems[own]), np.array([0, own.stop - at]), PART)
                pooled = part if pooled is None else np.maximum(pooled, part)
        else:
            own = slice(bounds[i], bounds[j])
            pooled = _responses(tables, *_buckets(h[own], stems[own]), bounds[i : j + 1] - bounds[i])
        # Sums in a fixed order, so that a text's score does not depend on the texts beside it.
        z = np.full(j - i, model["bias"], np.float64)
        for c, w in enumerate(model["weights"]):
            z += pooled[:, c].astype(np.float64) * w
        out.append(z)
        i = j
    return np.concatenate(out) if out else np.zeros(0)


def _best_cut(low: np.ndarray, high: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> float:
    """The threshold with the best F1 over places in descending order, each with its lowest and highest logit and its texts of label 1 and 0."""
    h, m = np.cumsum(hits), np.cumsum(misses)
    i = int((2 * h / np.maximum(h + m + hits.sum(), 1)).argmax())
    return float((low[i] + high[i + 1]) / 2 if i + 1 < len(low) else low[i])


def _training(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``__y, __t, __g, __h`` and ``lang``: the rows of all labelled ids whose crc32(id) mod 3 is not 1, by group; groups with even numbers are one fold."""
    taught = lambda c: F.crc32(c.cast("string").cast("binary")) % 3 != 1
    wanted = labels.select(F.col(id_column).alias("__id"), F.col("toxic").cast("int").alias("__y"))
    wanted = wanted.where("__y in (0, 1) and __id is not null").where(taught(F.col("__id")))
    wanted = durable(wanted.groupBy("__id").agg(F.max("__y").alias("__y")))  # an id that is labelled twice is toxic if once
    n = wanted.count()
    groups = 2 * max(1, -(-n // (2 * GROUP_ROWS)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(taught(F.col(id_column))).select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__t"), lang.alias("lang"))
    rows = rows.join(hinted(wanted, n), "__id").withColumn("__h", F.xxhash64("__id", "__t"))
    rows = rows.select("__y", "__t", "lang", "__h", F.pmod("__h", F.lit(groups)).cast("int").alias("__g"))
    # In an order of its own, so that reruns train alike.
    return durable(rows.repartitionById(groups, F.col("__g")).sortWithinPartitions("__g", "__h", "__y"))


def _rows_of(batch, words: Words):
    """The table rows of the words of each text of a batch."""
    for _, data, offsets in text_slices(batch, "__t", 4 << 20):
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own, bounds = data[lo:hi], np.array([0, hi - lo])
            yield _buckets(words.words(own, bounds)[0], words.beginnings(own, bounds, STEM))


_SUMS = "model int, block int, turn long, at binary, v binary"


def _sparse(model: int, values: np.ndarray, turn: int = 0):
    """A batch with the rows of ``values`` that are not zero, by block."""
    at = np.flatnonzero(values.any(1))
    edge = np.searchsorted(at, np.arange(0, len(values) + BLOCK, BLOCK))
    blocks = np.flatnonzero(np.diff(edge))
    cut = [slice(edge[b], edge[b + 1]) for b in blocks]
    column = lambda v, kind: pa.array(np.full(len(blocks), v), kind)
    columns = [column(model, pa.int32()), pa.array(blocks.astype(np.int32)), column(turn, pa.int64()), pa.array([at[x].astype(np.int32).tobytes() for x in cut], pa.binary()), pa.array([values[at[x]].tobytes() for x in cut], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["model", "block", "turn", "at", "v"])


def _added(parts: DataFrame, width: int, dtype) -> dict[int, np.ndarray]:
    """Sums of ``_sparse`` tables by model: a block is added up in one task, row by row in the order of ``turn``."""

    def add(batches):
        key, total = None, None
        out = lambda: _sparse(key[0], total).set_column(1, "block", pa.array([key[1]], pa.int32()))
        for batch in batches:
            for model, block, _, at, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (model, block) != key:
                    if key is not None:
                        yield out()
                    key, total = (model, block), np.zeros((BLOCK, width), dtype)
                total[np.frombuffer(at, np.int32) - block * BLOCK] += np.frombuffer(v, dtype).reshape(-1, width)
        if key is not None and total.any():
            yield out()

    blocks = -(-BUCKETS // BLOCK) + 1
    made = parts.repartition(blocks, "block").sortWithinPartitions("model", "block", "turn").mapInArrow(add, _SUMS)
    tables: dict[int, np.ndarray] = {}
    for r in made.collect():  # tables of fixed size
        own = tables.setdefault(r["model"], np.zeros((blocks * BLOCK, width), dtype))
        own[np.frombuffer(r["at"], np.int32) + r["block"] * BLOCK] = np.frombuffer(r["v"], dtype).reshape(-1, width)
    return tables


def _counted(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold a row by fold and label (fold x label x row), and texts (fold x label)."""

    def count(batches):
        words, counts = _folded(), np.zeros((BUCKETS + 1, 4), np.int64)
        for batch in batches:
            kind = batch["__g"].to_numpy() % 2 * 2 + batch["__y"].to_numpy()
            for k, rows in zip(kind.tolist(), _rows_of(batch, words)):
                counts[np.unique(np.concatenate(rows)), k] += 1
                counts[BUCKETS, k] += 1
            trim()
        yield _sparse(0, counts)

    sums = _added(training.mapInArrow(count, _SUMS), 4, np.int64).get(0, np.zeros((BUCKETS + 1, 4), np.int64))
    return np.ascontiguousarray(sums[:BUCKETS].T).reshape(2, 2, BUCKETS), sums[BUCKETS].reshape(2, 2)


def _start(counts: np.ndarray, n: np.ndarray) -> Classifier:
    """The weights from which the groups of a fold start."""
    made = Classifier()
    made.begin(counts, n)
    return made


def _small(c: Classifier) -> np.ndarray:
    """Filters, weights and bias in one row."""
    return np.concatenate([*[w.ravel() for f in c.filters for w in f], c.weights, [c.bias]]).astype(np.float64)


def _models(training: DataFrame, counts: np.ndarray, n: np.ndarray) -> list[dict]:
    """For each fold the averaged weights of its groups."""
    held = training.sparkSession.sparkContext.broadcast((counts.astype(np.int32), n))

    def train(batches):
        counts, n = held.value
        words = _folded()

        def trained(group, turn, texts, y):
            seen = np.zeros((BUCKETS, 1))
            for rows in texts:
                seen[np.unique(np.concatenate(rows)), 0] += 1
            fold = group % 2
            c = _start(counts[fold], n[fold])
            before = c.embedding.astype(np.float64)
            c.train(texts, np.array(y), n[fold][1] / n[fold].sum())
            table, row = np.zeros((BUCKETS + BLOCK, SIZE)), _small(c) * len(texts)
            table[:BUCKETS] = (c.embedding - before) * seen
            table[BUCKETS:].ravel()[: len(row)] = row
            yield _sparse(fold, table, turn)
            trim()

        group, part, size, texts, y = None, 0, 0, [], []
        for batch in batches:
            sizes = pc.binary_length(batch["__t"]).to_pylist()
            for g, label, length, rows in zip(batch["__g"].to_pylist(), batch["__y"].to_pylist(), sizes, _rows_of(batch, words)):
                if texts and (g != group or size + length > SAMPLE_BYTES or len(texts) >= 2 * GROUP_ROWS):
                    yield from trained(group, group * 2**32 + part, texts, y)
                    part, size, texts, y = part + 1, 0, [], []
                group = g
                texts.append(rows)
                y.append(label)
                size += length
        if texts:
            yield from trained(group, group * 2**32 + part, texts, y)

    sums = _added(training.mapInArrow(train, _SUMS), SIZE, np.float64)
    out = []
    for fold in range(2):
        c = _start(counts[fold], n[fold])
        if fold in sums:
            c.embedding += (sums[fold][:BUCKETS] / np.maximum(counts[fold].sum(0), 1)[:, None]).astype(np.float32)
            row, at = (sums[fold][BUCKETS:].ravel() / n[fold].sum()).astype(np.float32), 0
            for f in c.filters:
                for j, w in enumerate(f):
                    f[j] = row[at : at + w.size].reshape(w.shape)
                    at += w.size
            c.weights, c.bias = row[at : at + len(c.weights)], row[at + len(c.weights)]
        out.append(c.state())
    return out


def _averaged(models: list[dict], n: np.ndarray) -> dict:
    """One model of those of the folds, by their texts; its logits are about as large as theirs, whose thresholds it gets."""
    own = (n.sum(1) / n.sum()).tolist()
    mean = lambda get: sum(get(m) * x for m, x in zip(models, own))
    filters = [[mean(lambda m: m["filters"][k][j]).astype(np.float32) for j in range(w)] for k, w in enumerate(WIDTHS)]  # noqa: B023
    weights = [mean(lambda m: m["weights"][i]) for i in range(FILTERS * len(WIDTHS))]  # noqa: B023
    return {"embedding": mean(lambda m: m["embedding"]).astype(np.float32), "filters": filters, "bias": mean(lambda m: m["bias"]), "weights": weights}


def _calibrated(training: DataFrame, models: list[dict]) -> dict:
    """Per language (None: all) the best threshold of the logits, their spread and the toxic texts, from all texts by the weights of the other fold."""
    held = training.sparkSession.sparkContext.broadcast(models)

    def logits(batches):
        models, words = held.value, _folded()
        tables = [_tables(m) for m in models]
        for batch in batches:
            odd = batch["__g"].to_numpy() % 2 == 1
            z = np.zeros(batch.num_rows)
            for first, data, offsets in text_slices(batch, "__t", 4 << 20):
                own = odd[first : first + len(offsets) - 1]
                found = [_logits(m, t, words, data, offsets) if here.any() else 0.0 for m, t, here in zip(models, tables, (own, ~own))]
                z[first : first + len(own)] = np.where(own, *found)
            trim()
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["__y"], pa.array(z)], ["lang", "y", "z"])

    def cut(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "descending")])
        low, high, hits, misses, place = (group[c].to_numpy() for c in ("low", "high", "hits", "misses", "place"))
        texts = hits + misses
        mean = (place * texts).sum() / texts.sum()
        spread = float(np.sqrt(((place - mean) ** 2 * texts).sum() / texts.sum()) / GRID)
        return pa.table({"general": group["general"][:1], "lang": group["lang"][:1], "cut": [_best_cut(low, high, hits, misses)], "spread": [spread], "hits": pa.array([int(hits.sum())], pa.int64())})

    found = training.select("__t", "__y", "__g", "lang").mapInArrow(logits, "lang string, y int, z double")
    adding = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses")]
    ones = found.select("lang", F.floor(F.col("z") * GRID).alias("place"), F.col("z").alias("low"), F.col("z").alias("high"), F.col("y").cast("long").alias("hits"), (1 - F.col("y")).cast("long").alias("misses"))
    places = durable(ones.groupBy("lang", "place").agg(*adding))
    general = places.groupBy("place").agg(*adding).select(F.lit(True).alias("general"), F.lit(None).cast("string").alias("lang"), "place", "low", "high", "hits", "misses")
    both = general.unionByName(places.where("lang is not null").select(F.lit(False).alias("general"), "*"))
    rows = both.groupBy("general", "lang").applyInArrow(cut, "general boolean, lang string, cut double, spread double, hits long").collect()
    return {r["lang"]: (r["cut"], r["spread"], r["hits"]) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """A model of fixed size from all labelled rows whose crc32(id) mod 3 is not 1."""
    bounded_batches(docs.sparkSession)
    training = _training(docs, labels, id_column, text_column)
    counts, n = _counted(training)
    if not n.sum(0).all():
        return {"embedding": None, "filters": [], "bias": 0.0, "weights": [], "cuts": {}}
    folds = _models(training, counts, n)
    found = _calibrated(training, folds)
    model = _averaged(folds, n)
    cut, spread, _ = found[None]
    # A slope and an offset that puts the best threshold at THRESHOLD.
    slope = float(np.clip(3.0 / max(spread, 1e-6), 0.2, 5.0))
    offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)
    model["bias"] = model["bias"] * slope + offset
    model["weights"] = [w * slope for w in model["weights"]]
    model["cuts"] = {lang: float(1 / (1 + np.exp(-(z * slope + offset)))) for lang, (z, _, hits) in found.items() if lang is None or hits >= 10}
    trim()
    return model


def score(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1)."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, words = held.value, _folded()
        tables = None if model["embedding"] is None else _tables(model)
        for batch in batches:
            out = []
            for _, data, offsets in text_slices(batch, text_column, 4 << 20):
                if tables is None:
                    out.append(np.zeros(len(offsets) - 1))
                else:
                    out.append(1 / (1 + np.exp(-np.clip(_logits(model, tables, words, data, offsets), -500, 500))))
            done = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, done], [*batch.schema.names, "score"])

    kept = [c for c in docs.columns if c != "score"]
    kinds = dict(docs.dtypes)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "score double"]))


def cut_of(model: dict, lang: str = "lang"):
    """Column: the threshold of a row's language, the general one where the language has none."""
    general = model["cuts"].get(None, THRESHOLD)
    out = F.lit(float(general))
    for name, cut in model["cuts"].items():
        if name is not None:
            out = F.when(F.col(lang) == name, F.lit(float(cut))).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (score of 0.7 or more) and flagged (threshold of the language)."""
    model = fit(docs, labels, id_column, text_column)
    has_lang = "lang" in docs.columns
    rows = score(docs.select(id_column, text_column, *(["lang"] if has_lang else [])), model, text_column)
    held = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    cut = cut_of(model) if has_lang else F.lit(float(model["cuts"].get(None, THRESHOLD)))
    return rows.select(id_column, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
