"""Document quality from labelled lines: a linear-chain conditional random field trained in numpy.

A line is a run of bytes between line ends that holds more than white space. The chain gives each line one of two
labels, good or bad. A line's potential is linear in features of the line itself, of the line before and of the line
after; two more weights reward neighbours of equal label. Forward and backward messages are log-odds, so the marginal
of a line is the sum of two recursions. A document's evidence is the mean of its lines' marginals, each weighted by the
line's bytes, and a logistic curve that is fitted on texts the weights have not seen turns it into ``score``.

Labels come for documents, so lines begin with the label of their document. After a first fit, lines of bad documents
that the chain itself finds good become good, except that at least half of the bytes of a bad document stay bad; the
second fit learns from these labels.

Training rows are a bounded sample of labelled rows: of each label the ids whose hash lies in a share that holds
``SAMPLE_ROWS`` texts on average (all, if there are fewer), and of their whole texts at most ``SAMPLE_BYTES``, where a
line counts ``LINE_COST`` bytes more; each label has half of it, filled in hash order, and only a text that does not fit
into what is left is passed over (where none fits, the shortest is taken). Scoring covers all rows and whole texts in
slices, with memory for the numbers of a text's lines but not for features of its bytes.

Defined results: a null or empty text, or one of white space only, has the evidence of a text whose lines are all bad.
Repeated rows have equal scores, and a score does not depend on the rows beside it. Rows with null ids are scored and
never teach; an id that is labelled twice is bad if once. Without labels of both kinds all scores are 0.5. A word of
more than ``SLICE`` bytes counts as several words. ``score`` keeps all columns of its input; one called ``score`` gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.llm._common import bounded_batches, text_slices, trim
from tagtally.llm._words import Words

SAMPLE_ROWS, SAMPLE_BYTES, LINE_COST = 3000, 24 << 20, 100
SLICE = 256 << 10
THRESHOLD = 0.5

#: Classes of bytes; those not named are letters of other scripts (128 and more) or controls.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".", b",;:", b"!", b"?'\"()-", b"|/\\_~", b"#$%&*@^`", b"<>=+{}[]"]
_OTHER, _CONTROL = len(_CLASSES), len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
_END = 255
_LETTERS = (0, 1, _OTHER)
_MARKS = (6, 8, 9, 10)


def _table() -> np.ndarray:
    kinds = np.full(256, _CONTROL, np.uint8)
    kinds[128:] = _OTHER
    for k, of in enumerate(_CLASSES):
        kinds[list(of)] = k
    kinds[[10, 13]] = _END
    return kinds


_KIND = _table()

#: Sums of a line: bytes by class, words, words equal to the word before, words in capitals, words that end with a mark.
_SUMS = _KINDS + 4
#: Features of a line.
_WIDTH = _KINDS + 10


class Lines:
    """Sums of lines, text by text and slice by slice; keeps what crosses the border of two slices."""

    def __init__(self):
        self.words = Words(seed=311, fold=False)

    def sums(self, data: np.ndarray, offsets: np.ndarray, last_word: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        """Sums of every run between line ends, the text of each run, and the last word's fingerprint.

        Runs without a byte are kept, so that the first and last run of a slice can be joined to its neighbours'.
        ``last_word`` is the word before the first text.
        """
        n, texts = len(data), len(offsets) - 1
        kinds = _KIND[data]
        ends = np.flatnonzero(kinds == _END)
        # A run begins with each text and behind each line end; a text's first run may have no byte.
        begins = np.concatenate([offsets[:-1], ends + 1])
        owner = np.concatenate([np.arange(texts), np.searchsorted(offsets, ends, "right") - 1])
        order = np.lexsort((begins, owner))
        begins, owner = begins[order], owner[order]
        runs = len(begins)
        last = np.append(owner[1:] != owner[:-1], True)
        stops = np.append(begins[1:] - 1, 0)
        stops[last] = offsets[owner[last] + 1]
        out = np.zeros((runs, _SUMS), np.int64)
        keep = kinds != _END
        where = np.repeat(np.arange(runs), stops - begins)
        out[:, :_KINDS] = np.bincount(where * _KINDS + kinds[keep], minlength=runs * _KINDS).reshape(runs, _KINDS)
        s, e, bounds = self.words.spans(data, offsets)
        if len(s):
            h, _ = self.words.words(data, offsets)
            of = np.searchsorted(begins, s, "right") - 1
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            starts = bounds[:-1][np.diff(bounds) > 0]
            same[starts] = False
            if last_word is not None and bounds[1] > 0:
                same[0] = int(h[0]) == last_word
            upper = np.concatenate([[0], np.cumsum(kinds == 1)])
            lower = np.concatenate([[0], np.cumsum(kinds == 0)])
            capitals = (upper[e] - upper[s] > 1) & (lower[e] == lower[s])
            marked = np.isin(kinds[e - 1], _MARKS)
            for k, x in enumerate((np.ones(len(s), bool), same, capitals, marked)):
                out[:, _KINDS + k] = np.bincount(of[x], minlength=runs)
            last_word = int(h[-1])
        return out, owner, begins, last_word

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the lines of many texts, and for each text where its lines begin (one entry more)."""
        parts, counts, i, texts = [], [], 0, len(offsets) - 1
        while i < texts:
            j = int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1
            if j <= i:
                lines = self._long(data[offsets[i] : offsets[i + 1]])
                parts.append(lines)
                counts.append([len(lines)])
                i += 1
                continue
            out, owner, _, _ = self.sums(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            full = _filled(out)
            parts.append(out[full])
            counts.append(np.bincount(owner[full], minlength=j - i))
            i = j
        bounds = np.cumsum(np.concatenate([[0], *counts])).astype(np.int64)
        return (np.concatenate(parts) if parts else np.zeros((0, _SUMS), np.int64)), bounds

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Sums of the lines of one long text, slice by slice; slices end behind white space, if they hold any."""
        done, open_line, word, at = [], np.zeros(_SUMS, np.int64), None, 0
        while at < len(data):
            stop = min(at + SLICE, len(data))
            if stop < len(data):
                spaces = np.flatnonzero(~self.words.solid[data[at:stop]])
                stop = at + int(spaces[-1]) + 1 if len(spaces) else stop
            out, _, _, word = self.sums(data[at:stop], np.array([0, stop - at]), word)
            out[0] += open_line
            open_line = out[-1].copy()
            out = out[:-1]
            done.append(out[_filled(out)])
            at = stop
        out = open_line[None]
        return np.concatenate([*done, out[_filled(out)]])


def _filled(sums: np.ndarray) -> np.ndarray:
    """Which runs are lines: they hold a word."""
    return sums[:, _KINDS] > 0


def features(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and bytes of lines by their sums."""
    size = sums[:, :_KINDS].sum(1)
    x = np.zeros((len(sums), _WIDTH), np.float64)
    x[:, :_KINDS] = sums[:, :_KINDS] / np.maximum(size, 1)[:, None]
    words = np.maximum(sums[:, _KINDS], 1)
    rates = sums[:, _KINDS + 1 :] / words[:, None]
    k = _KINDS
    x[:, k : k + 3] = rates
    x[:, k + 3 : k + 6] = rates > 0.3  # most of the line is so
    x[:, k + 6] = np.minimum(np.log1p(size), 12) / 12
    x[:, k + 7] = np.minimum(sums[:, list(_LETTERS)].sum(1) / words, 40) / 10
    x[:, k + 8] = words < 4
    x[:, k + 9] = 1  # the line is there: as a neighbour's feature it says whether there is a neighbour
    return x, size


def _beside(values: np.ndarray, bounds: np.ndarray, step: int) -> np.ndarray:
    """Values of the line before (-1) or after (1) in the same text; zeros where there is none."""
    out = np.zeros_like(values)
    some = np.diff(bounds) > 0
    if step < 0:
        out[1:] = values[:-1]
        out[bounds[:-1][some]] = 0
    else:
        out[:-1] = values[1:]
        out[bounds[1:][some] - 1] = 0
    return out


def _weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` in a fixed order, so that a line's sum does not depend on the lines beside it."""
    out = np.zeros(len(x))
    for j, v in enumerate(w.tolist()):
        out += x[:, j] * v
    return out


def _step(r: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Log-odds that a neighbour with log-odds ``r`` sends; ``both`` are the weights of two bad and of two good lines."""
    return np.logaddexp(0, r + both[1]) - np.logaddexp(both[0], r)


def messages(potentials: np.ndarray, bounds: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with a line's own potential) and backward log-odds (without it) of all lines."""
    ahead, back = potentials.astype(np.float64), np.zeros(len(potentials))
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(most + 1), "left")  # texts with more than t lines
    for t in range(1, most):
        at = first[: active[t]] + t
        ahead[at] += _step(ahead[at - 1], both)
    last = first + sizes - 1
    for t in range(1, most):
        at = last[: active[t]] - t
        back[at] = _step(potentials[at + 1] + back[at + 1], both)
    return ahead, back


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def marginals(model: dict, sums: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the chance that it is good, and its bytes."""
    x, size = features(sums)
    w = np.array(model["weights"]).reshape(3, _WIDTH)
    z = _weighted(x, w[0]) + _weighted(_beside(x, bounds, -1), w[1]) + _weighted(_beside(x, bounds, 1), w[2])
    ahead, back = messages(z, bounds, np.array(model["both"]))
    return _logistic(ahead + back), size


def evidence(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of each text; 0 for texts without lines."""
    total = np.zeros(len(bounds) - 1)
    weight = np.zeros(len(bounds) - 1)
    some = np.diff(bounds) > 0
    if some.any():
        total[some] = np.add.reduceat(good * size, bounds[:-1][some])
        weight[some] = np.add.reduceat(size, bounds[:-1][some])
    return total / np.maximum(weight, 1)


def train(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, rounds: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> dict:
    """Weights by Adam on the mean conditional log-likelihood of the lines' labels ``y`` (0 bad, 1 good)."""
    near = np.concatenate([x, _beside(x, bounds, -1), _beside(x, bounds, 1)], 1).astype(np.float32)
    w, both = np.zeros(near.shape[1]), np.zeros(2)
    follows = np.ones(len(y), bool)
    follows[bounds[:-1][np.diff(bounds) > 0]] = False
    pairs = np.flatnonzero(follows)
    seen = np.array([np.sum((y[pairs] == 0) & (y[pairs - 1] == 0)), np.sum((y[pairs] == 1) & (y[pairs - 1] == 1))], float)
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    n = max(len(y), 1)
    for k in range(1, rounds + 1):
        z = (near @ w.astype(np.float32)).astype(np.float64)
        ahead, back = messages(z, bounds, both)
        g_w = near.T @ (y - _logistic(ahead + back)).astype(np.float32) / n - shrink * w
        r, s = ahead[pairs - 1], z[pairs] + back[pairs]
        parts = np.stack([np.full(len(pairs), both[0]), both[1] + r + s, r, s])
        parts = np.exp(parts - parts.max(0))
        expected = (parts[:2] / parts.sum(0)).sum(1)
        g = np.concatenate([g_w, (seen - expected) / n - shrink * both])
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
        w, both = w + step[:-2], both + step[-2:]
    return {"weights": w.tolist(), "both": both.tolist()}


def relabelled(good: np.ndarray, size: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Line labels for the second fit: lines of bad texts that look good become good, worst lines first staying bad for half of the bytes."""
    out = np.repeat(y, np.diff(bounds)).astype(np.int64)
    for d in np.flatnonzero(y == 0):
        a, b = bounds[d], bounds[d + 1]
        order = a + np.argsort(good[a:b], kind="stable")
        before = np.cumsum(size[order]) - size[order]
        out[order[(before * 2 >= size[a:b].sum()) & (good[order] > 0.5)]] = 1
    return out


def curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over evidence; the slope is held to 40 where labels are parted."""
    slope, offset = 8.0, -4.0
    for _ in range(50):
        p = _logistic(slope * m + offset)
        g = np.array([(weight * (y - p) * m).sum() - 1e-3 * slope, (weight * (y - p)).sum() - 1e-3 * offset])
        q = weight * p * (1 - p)
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    if not 1.0 <= slope <= 40.0:  # the middle stays where it is
        middle = -offset / slope if slope > 0 else 0.5
        slope = float(np.clip(slope, 1.0, 40.0))
        offset = -slope * middle
    return float(slope), float(offset)


def _taken(rows) -> list:
    """Ids of ``__id, __y, __h, __size`` whose texts fill each label's half of ``SAMPLE_BYTES`` in hash order."""
    ids = []
    for _, own in rows.sort_values(["__h", "__id"]).groupby("__y"):
        left, taken = SAMPLE_BYTES // 2, []
        for i, size in zip(own["__id"].tolist(), own["__size"].tolist()):
            if size <= left:
                taken.append(i)
                left -= size
        ids += taken or [own["__id"].tolist()[int(own["__size"].to_numpy().argmin())]]
    return ids


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> dict | None:
    """A model of fixed size from a bounded sample of labelled rows whose crc32(id) mod 3 is not 1; None without both labels."""
    wanted = labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("__y"))
    wanted = wanted.where("__y in (0, 1) and __id is not null").where(F.crc32(F.col("__id").cast("string").cast("binary")) % 3 != 1)
    wanted = wanted.groupBy("__id").agg(F.min("__y").alias("__y"))
    totals = {r["__y"]: r["count"] for r in wanted.groupBy("__y").count().collect()}
    share = F.when(F.col("__y") == 1, SAMPLE_ROWS / max(totals.get(1, 1), 1)).otherwise(SAMPLE_ROWS / max(totals.get(0, 1), 1))
    wanted = wanted.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < share * float(1 << 40))
    sample = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__t")).join(F.broadcast(wanted), "__id")
    cost = F.octet_length("__t") + LINE_COST * (F.length("__t") - F.length(F.translate("__t", "\n\r", "")) + 1)
    sizes = sample.groupBy("__id", "__y").agg(F.max(cost.cast("long")).alias("__size")).withColumn("__h", F.xxhash64("__id")).toArrow().to_pandas()
    within = _taken(sizes)
    taken = sample.where(F.col("__id").isin(within)) if len(within) < len(sizes) else sample
    rows = taken.groupBy("__id").agg(F.min("__y").alias("__y"), F.min("__t").alias("__t")).toArrow().sort_by("__id")
    y = rows["__y"].to_numpy().astype(np.int64)
    if not len(y) or y.all() or not y.any():
        return None
    made, parts, counts = Lines(), [], []
    for t in rows["__t"]:
        data = np.frombuffer(t.as_py().encode(), np.uint8)
        lines, _ = made.of_texts(data, np.array([0, len(data)]))
        parts.append(lines)
        counts.append(len(lines))
    del rows
    turn = np.random.default_rng(5).permutation(len(y))
    kept, aside = np.sort(turn[: len(turn) * 4 // 5]), np.sort(turn[len(turn) * 4 // 5 :])

    def of(pick):
        return np.concatenate([parts[i] for i in pick]), np.cumsum([0, *[counts[i] for i in pick]])

    def trained(pick):
        sums, bounds = of(pick)
        x, size = features(sums)
        model = train(x, np.repeat(y[pick], np.diff(bounds)), bounds)
        good, _ = marginals(model, sums, bounds)
        return train(x, relabelled(good, size, bounds, y[pick]), bounds)

    def found(model, pick):
        sums, bounds = of(pick)
        return evidence(*marginals(model, sums, bounds), bounds)

    model = trained(np.arange(len(y)))
    # The curve comes from texts that the weights of a trial have not seen; each label weighs what it weighs among all labels.
    m, t = (found(trained(kept), aside), y[aside]) if 0 < y[aside].sum() < len(aside) else (found(model, np.arange(len(y))), y)
    weight = np.where(t == 1, totals[1] / max(t.sum(), 1), totals[0] / max((1 - t).sum(), 1))
    model["slope"], model["offset"] = curve(m, t, weight * len(t) / weight.sum())
    trim()
    return model


def score(docs: DataFrame, model: dict | None, text_column: str = "text", lines: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1); with ``lines`` also an array of each line's bytes and chance to be good, in order."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", *(["lines"] if lines else []))]

    def run(batches):
        made = Lines()
        for batch in batches:
            scores, found, counts = [], [], []
            for _, data, offsets in text_slices(batch, text_column, 1 << 20):
                if model is None and not lines:
                    scores.append(np.full(len(offsets) - 1, 0.5))
                    continue
                sums, bounds = made.of_texts(data, offsets)
                good, size = marginals(model, sums, bounds) if model else (np.full(len(sums), 0.5), features(sums)[1])
                m = evidence(good, size, bounds)
                scores.append(_logistic(model["slope"] * m + model["offset"]) if model else np.full(len(m), 0.5))
                if lines:
                    found.append((size, good))
                    counts.append(np.diff(bounds))
            columns, names = [*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], [*batch.schema.names, "score"]
            if lines:
                fields = [pa.array(np.concatenate([np.zeros(0, kind), *[f[k] for f in found]])) for k, kind in ((0, np.int64), (1, np.float64))]
                ends = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["n_bytes", "good"])))
                names.append("lines")
            trim()
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(docs.dtypes)
    schema = [*[f"`{c}` {kinds[c]}" for c in kept], "score double", *(["lines array<struct<n_bytes: bigint, good: double>>"] if lines else [])]
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, ", ".join(schema))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (score of 0.5 or more)."""
    rows = score(docs.select(id_column, text_column), fit(docs, labels, id_column, text_column), text_column)
    held = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select(id_column, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
