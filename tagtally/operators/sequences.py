"""k-mers, base frequencies by position, motif log-odds, and resampling matched by position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtally.functions.strings import center_kmer, valid_kmer
from tagtally.operators.counts import ratio
from tagtally.session import shared_folder


#: Letters of a tile of a sequence.
TILE = 1 << 16


def tiles(fasta: DataFrame, flank: int, size: int = TILE) -> DataFrame:
    """``id, tile, text, letters``: sequences in pieces of ``size`` letters with ``flank`` more on both sides, N beyond the ends.

    A sequence is cut in one pass; what sites join is a piece, however long the sequence. ``size`` is more than ``flank``.
    """
    held = F.array(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    pads = "N" * flank
    before = f"if(i = 0, '{pads}', right(p[i - 1], {flank}))" if flank else "''"
    after = f"if(i + 1 < size(p), rpad(left(concat(p[i + 1], coalesce(get(p, i + 2), '')), {flank}), {flank}, 'N'), '{pads}')" if flank else "''"
    made = F.expr(f"transform(__p[0], (x, i) -> named_struct('text', concat({before.replace('p[', '__p[0][')}, x, {after.replace('(p[', '(__p[0][').replace('size(p)', 'size(__p[0])').replace('get(p,', 'get(__p[0],')}), 'letters', length(x)))")
    rows = fasta.where("length(seq) > 0").withColumn("__p", held).select("id", F.posexplode(made).alias("tile", "x"))
    return rows.select("id", "tile", "x.text", "x.letters")


def with_context(sites: DataFrame, fasta: DataFrame, flank: int = 7, key: str = "transcript_id", size: int = TILE) -> DataFrame:
    """Sites with the bases around them and the base itself; NULL where the sequence is unknown or too short."""
    pieces = tiles(fasta, flank, size).select(F.col("id").alias(key), F.col("tile").alias("__tile"), F.col("text").alias("__text"), F.col("letters").alias("__letters"))
    rows = sites.withColumn("__tile", F.when(F.col("pos") >= 1, F.floor((F.col("pos") - 1) / size).cast("int")))
    rows = rows.join(pieces, [key, "__tile"], "left")
    at = (F.col("pos") - 1) % size + 1
    rows = rows.withColumn("sequence_context", F.when(at <= F.col("__letters"), F.substring("__text", at.cast("int"), F.lit(2 * flank + 1))))
    return rows.withColumn("ref_base", F.substring("sequence_context", flank + 1, 1)).drop("__tile", "__text", "__letters")


def kmers(rows: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows with the centre k-mer, those with a valid one only."""
    # The k-mer is made once a row: a condition on what a generator gives is not pushed below it, where the sequence would be made again.
    middle = F.transform(F.array(F.col(seq)), lambda s: F.upper(center_kmer(s, k)))
    return rows.select(*[c for c in rows.columns if c != "kmer"], F.explode_outer(middle).alias("kmer")).where(valid_kmer(F.col("kmer"), k))


def positions(rows: DataFrame, kmer: str = "kmer") -> DataFrame:
    """One row a base: ``k_pos`` from 1 and ``base``."""
    keep = [c for c in rows.columns if c != kmer]
    return rows.select(*keep, F.posexplode(F.split(F.col(kmer), "")).alias("__i", "base")).withColumn("k_pos", F.col("__i") + 1).drop("__i")


def _shares(rows: DataFrame, by: list[str], sets: dict[str, str]) -> DataFrame:
    """``by, k_pos, n`` and for each entry of ``sets`` the share of k-mers with one of its letters at the position.

    Equal k-mers are counted first, so what is taken apart by position is their number and not the rows'.
    """
    counted = rows.groupBy(*by, "kmer").agg(F.count("*").alias("__n"))
    bases = counted.select(*by, "__n", F.posexplode(F.split("kmer", "")).alias("__i", "__base"))
    share = lambda letters: F.sum(F.when(F.col("__base").isin(*letters), F.col("__n")).otherwise(0)) / F.sum("__n")
    return bases.groupBy(*by, (F.col("__i") + 1).alias("k_pos")).agg(F.sum("__n").alias("n"), *[share(x).alias(c) for c, x in sets.items()])


def gc_by_position(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _shares(rows, by or [], {"gc": "GC"}).select(*(by or []), "k_pos", "gc", "n")


def base_frequencies(rows: DataFrame) -> DataFrame:
    """``k_pos`` and the share of each base."""
    return _shares(rows, [], {b: b for b in "ACGT"}).select("k_pos", *"ACGT")


def log_odds(hit: DataFrame, background: DataFrame, eps: float = 1e-6) -> DataFrame:
    """log2 of the shares of hits over those of the background."""
    a, b = base_frequencies(hit), base_frequencies(background)
    b = b.select("k_pos", *[F.col(x).alias(f"{x}_bg") for x in "ACGT"])
    return a.join(b, "k_pos").select("k_pos", *[F.log2((F.col(x) + eps) / (F.col(f"{x}_bg") + eps)).alias(x) for x in "ACGT"])


def matched_gc(hit: DataFrame, background: DataFrame, stratum: str) -> DataFrame:
    """Background GC by position, strata weighing as they do among the hits."""
    weights = hit.groupBy(stratum).agg(F.count("*").alias("h"))
    curves = gc_by_position(background, [stratum]).join(weights, stratum)
    return curves.groupBy("k_pos").agg(ratio(F.sum(F.col("h") * F.col("gc")), F.sum("h")).alias("gc"))


def _patterns(rows: DataFrame, stratum: str, *counts: Column) -> DataFrame:
    """Counts by stratum and by which positions of the k-mer are G or C: at most 2 ** k rows a stratum stand for all its rows."""
    pattern = F.translate(F.upper("kmer"), "GCATN", "11000").alias("pattern")
    return rows.select(stratum, pattern, "*").groupBy(stratum, "pattern").agg(*counts)


def _hypergeometric(rng, good: int, bad: int, taken: int) -> int:
    """One draw of a hypergeometric number of any size: inversion from the mode outwards, by exact ratios of neighbours.

    Chances are relative to the mode's; the walk takes some standard deviations' steps.
    """
    import numpy as np

    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    mode = min(max((taken + 1) * (good + 1) // (good + bad + 2), low), high)
    ratio = lambda x: ((good - x) / (x + 1)) * ((taken - x) / (bad - taken + x + 1))  # noqa: E731  chance of x + 1 over that of x
    spread = math.sqrt(max(taken * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - taken) / max(good + bad - 1, 1)), 1.0))
    n = int(12 * spread) + 40  # beyond it lies less than 1e-30
    up, down = np.arange(mode, min(high, mode + n)), np.arange(mode - 1, max(low, mode - n) - 1, -1)
    weights = np.concatenate([[1.0], np.cumprod(ratio(up.astype(float))) if len(up) else [], np.cumprod(1 / ratio(down.astype(float))) if len(down) else []])
    values = np.concatenate([[mode], up + 1, down]).astype(np.int64)
    return int(values[np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right").clip(0, len(values) - 1)])


def _drawn(rng, colors, n: int, rounds: int):
    """``rounds`` draws of ``n`` without replacement from counts: rounds x colors, one color after the other."""
    import numpy as np

    rest, left = int(colors.sum()), np.full(rounds, n, np.int64)
    out = np.zeros((rounds, len(colors)), np.int64)
    for i, good in enumerate(colors.tolist()):
        bad = rest - good
        if rest < 10**9:  # as far as the generator goes
            out[:, i] = rng.hypergeometric(good, bad, left) if rest else 0
        else:
            out[:, i] = [_hypergeometric(rng, good, bad, int(x)) for x in left]
        left, rest = left - out[:, i], bad
    return out


def _by_round(counted: DataFrame, stratum: str, draw, rounds: int) -> DataFrame:
    """``b, k_pos`` and the sums over strata of what ``draw(rng, pandas group)`` says: columns of (rounds x positions) arrays."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        import numpy as np

        pdf = pdf.sort_values("pattern")
        rng = np.random.default_rng([zlib.crc32(repr(pdf[stratum].iloc[0]).encode()), rounds])
        bits = np.array([[c == "1" for c in p] for p in pdf["pattern"]], np.int64)
        out = {c: np.broadcast_to(v, (rounds, bits.shape[1])).ravel() for c, v in draw(rng, pdf, bits).items()}
        b, k = np.meshgrid(np.arange(rounds), np.arange(1, bits.shape[1] + 1), indexing="ij")
        return pd.DataFrame({"b": b.ravel(), "k_pos": k.ravel(), "gc_a": 0.0, "n_a": 0.0, "gc_z": 0.0, "n_z": 0.0} | out)

    rows = counted.groupBy(stratum).applyInPandas(run, "b int, k_pos int, gc_a double, n_a double, gc_z double, n_z double")
    return rows.groupBy("b", "k_pos").agg(*[F.sum(c).alias(c) for c in ("gc_a", "n_a", "gc_z", "n_z")])


def bootstrap_gc(hit: DataFrame, background: DataFrame, stratum: str, rounds: int = 500, seed: int = 7, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """GC of hits minus GC of position-matched background samples, with its interval over ``rounds`` samples.

    Every round draws as many background rows of a stratum as it has hits: without replacement where the pool suffices,
    with replacement otherwise. Only counts matter, so a stratum is its counts by pattern, and a round draws from them by
    the multivariate hypergeometric or multinomial distribution; work grows with rounds x strata, not with rows.
    """
    weights = hit.groupBy(stratum).agg(F.count("*").alias("h"))
    counted = _patterns(background, stratum, F.count("*").alias("n")).join(weights, stratum)

    def draw(rng, pdf, bits):
        import numpy as np

        n, h = pdf["n"].to_numpy(), int(pdf["h"].iloc[0])
        rng = np.random.default_rng([seed, *rng.integers(0, 2**32, 2).tolist()])
        taken = _drawn(rng, n, h, rounds) if n.sum() >= h else rng.multinomial(h, n / n.sum(), rounds)
        return {"gc_a": taken @ bits, "n_a": h}

    drawn = _by_round(counted, stratum, draw, rounds).select("b", "k_pos", (F.col("gc_a") / F.col("n_a")).alias("gc_bg"))
    own = gc_by_position(hit).select("k_pos", F.col("gc").alias("gc_hit"))
    rows = drawn.join(own, "k_pos").withColumn("d", F.col("gc_hit") - F.col("gc_bg"))
    return rows.groupBy("k_pos").agg(F.avg("d").alias("delta_gc"), F.percentile("d", low).alias("lo"), F.percentile("d", high).alias("hi"))


def permutation_gc(rows: DataFrame, stratum: str, rounds: int = 500, seed: int = 11) -> DataFrame:
    """By position: observed GC difference of hits and others, and how often shuffled labels reach it.

    Labels move within strata that have more rows than hits, so the hits' patterns are a draw without replacement from
    the stratum's; p = (1 + reached) / (rounds + 1), BH over positions.
    """
    from tagtally.operators.counts import benjamini_hochberg

    label = F.col("hit").cast("int")
    shared_folder(rows.sparkSession)
    counted = _patterns(rows, stratum, F.count("*").alias("n"), F.sum(label).alias("hits")).checkpoint()  # the rows are read once
    sizes = counted.groupBy(stratum).agg(F.sum("hits").alias("h"), F.sum("n").alias("m")).where("m > h and h > 0")
    counted = counted.join(sizes, stratum)

    def draw(rng, pdf, bits):
        import numpy as np

        n, h = pdf["n"].to_numpy(), int(pdf["h"].iloc[0])
        taken = _drawn(np.random.default_rng([seed, *rng.integers(0, 2**32, 2).tolist()]), n, h, rounds)
        return {"gc_a": taken @ bits, "n_a": h, "gc_z": (n - taken) @ bits, "n_z": int(n.sum()) - h}

    difference = F.col("gc_a") / F.col("n_a") - F.col("gc_z") / F.col("n_z")
    null = _by_round(counted, stratum, draw, rounds).select("b", "k_pos", difference.alias("d"))
    at = counted.select("n", "hits", F.posexplode(F.split("pattern", "")).alias("i", "bit")).withColumn("bit", F.col("bit").cast("int"))
    side = lambda n: F.sum(n * F.col("bit")) / F.sum(n)
    observed = at.groupBy((F.col("i") + 1).alias("k_pos")).agg((side(F.col("hits")) - side(F.col("n") - F.col("hits"))).alias("observed"))
    out = null.join(F.broadcast(observed), "k_pos").groupBy("k_pos")  # k rows
    out = out.agg(F.first("observed").alias("observed"), ((1 + F.count_if(F.abs("d") >= F.abs("observed") - 1e-12)) / F.lit(rounds + 1.0)).alias("p"))
    return benjamini_hochberg(out, "p", "q")
