"""Reads without adapters: error-tolerant alignment of an adapter to the end of a read, many reads at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adapter_matches(reads: list[bytes], adapter: bytes, rate: float, overlap: int) -> np.ndarray:
    """Equal letters, errors and begin of a 3' adapter in each read; -1, 0 and the read's length where there is none.

    The adapter may lose its end at the read's end, and has at most ``rate`` errors (exchanged, missing or extra
    letters) for each of its aligned letters, of which there are ``overlap`` or more. Of all such places the one with most
    equal letters counts, then the one with fewest errors, then the first.
    """
    n, m = len(reads), len(adapter)
    sizes = np.fromiter(map(len, reads), np.int64, n)
    order = np.argsort(-sizes, kind="stable")  # the longest first: reads that still go on are a prefix
    lengths = sizes[order]
    wide = int(lengths.max(initial=0))
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    text = np.frombuffer(b"".join(reads), np.uint8)
    # A place is one number: errors, missing equal letters, which step led here, begin. The least of three steps is the best,
    # and equal ones go to the step named first.
    held = wide.bit_length() + 1
    step, letter = 1 << held, 1 << (held + 2)
    error = letter << (2 * m + 1).bit_length()
    top, any_step = m * letter, ~(3 * step)
    column = np.empty((m + 1, n), np.int64)
    column[:] = (np.arange(m + 1) * error + top)[:, None]
    fits = {x: np.where(np.arange(256) == x, -letter, error) for x in set(adapter)}
    best = np.stack([np.full(n, -1), np.zeros(n, np.int64), lengths], 1)  # equal letters, errors, start

    def offer(rows: slice, size: int) -> None:
        places = column[size, rows]
        ok = np.flatnonzero(places < (int(rate * size) + 1) * error)
        if not len(ok):
            return
        places, old = places[ok], best[rows][ok]
        c, e, s = places // error, m - places % error // letter, places & (step - 1)
        better = (e > old[:, 0]) | ((e == old[:, 0]) & (c < old[:, 1]))
        best[rows.start + ok[better]] = np.stack([e, c, s], 1)[better]

    live = n
    for j in range(wide):
        live = int(np.searchsorted(-lengths[:live], -j, "left"))  # those with more than j letters
        here = text[begins[:live] + j]
        costs = {x: table[here] for x, table in fits.items()}
        diagonal, column[0, :live] = column[0, :live].copy(), top + j + 1
        for i in range(1, m + 1):
            place = column[i, :live]
            moved = diagonal + costs[adapter[i - 1]]
            np.minimum(moved, column[i - 1, :live] + (error + step), out=moved)
            np.minimum(moved, place + (error + 2 * step), out=moved)
            moved &= any_step
            diagonal = place.copy()
            place[:] = moved
        offer(slice(0, live), m)
        last = slice(int(np.searchsorted(-lengths[:live], -(j + 1), "left")), live)
        if last.start < last.stop:
            for i in range(overlap, m):
                offer(last, i)
    out = np.empty_like(best)
    out[order] = best
    return out


def adapter_starts(reads: list[bytes], adapters: list[bytes], rate: float, overlap: int) -> np.ndarray:
    """Where the one adapter that fits a read best begins: most equal letters, then fewest errors, then the first named."""
    best = None
    for adapter in adapters:
        found = adapter_matches(reads, adapter, rate, overlap)
        if best is None:
            best = found
        else:
            better = (found[:, 0] > best[:, 0]) | ((found[:, 0] == best[:, 0]) & (found[:, 1] < best[:, 1]))
            best = np.where(better[:, None], found, best)
    return best[:, 2] if best is not None else np.fromiter(map(len, reads), np.int64, len(reads))


def without_adapter(reads: DataFrame, adapters: str | tuple[str, ...], rate: float = 0.1, overlap: int = 3) -> DataFrame:
    """Reads cut where the best of the adapters begins, once; ``seq`` and ``qual`` keep the same length."""
    named = [a.encode() for a in ([adapters] if isinstance(adapters, str) else adapters)]

    def start(seqs: pd.Series) -> pd.Series:
        return pd.Series(adapter_starts([s.encode() if s else b"" for s in seqs], named, rate, overlap))

    at = F.pandas_udf(start, "int")
    rows = reads.withColumn("__at", at(F.coalesce("seq", F.lit(""))))
    cut = lambda c: F.substring(c, F.lit(1), F.col("__at")).alias(c)
    return rows.select(*[cut(c) if c in ("seq", "qual") else F.col(c) for c in reads.columns])


def good_parts(quals: list[str], quality: int = 20) -> np.ndarray:
    """Letters of each read up to the place from which the sum of (quality - limit) to the end is least.

    From the end on: the running sum, its least value, and where that is; a read is done when its sum is positive.
    """
    sizes = np.fromiter(map(len, quals), np.int64, len(quals))
    ends, letters = np.cumsum(sizes), np.frombuffer("".join(quals).encode("utf-32-le"), "<u4").astype(np.int64)
    total, low, cut = np.zeros(len(quals), np.int64), np.zeros(len(quals), np.int64), sizes.copy()
    going, taken = np.flatnonzero(sizes > 0), 0
    while len(going):
        taken += 1
        sums = total[going] + letters[ends[going] - taken] - 33 - quality
        going, sums = going[sums <= 0], sums[sums <= 0]
        total[going] = sums
        less = sums < low[going]
        at = going[less]
        low[at], cut[at] = sums[less], sizes[at] - taken
        going = going[sizes[going] > taken]
    return cut


def without_poor_end(reads: DataFrame, quality: int = 20) -> DataFrame:
    """Reads cut at the place from which the sum of (quality - limit) to the end is least; nothing is cut if no sum is negative."""

    def keep(quals: pd.Series) -> pd.Series:
        return pd.Series(good_parts(quals.fillna("").tolist(), quality)).astype("Int32").mask(quals.isna())

    at = F.pandas_udf(keep, "int")
    rows = reads.withColumn("__cut", at("qual"))
    cut = lambda c: F.substring(c, F.lit(1), F.col("__cut")).alias(c)
    return rows.select(*[cut(c) if c in ("seq", "qual") else F.col(c) for c in reads.columns])


def _cut_front(reads: DataFrame, size: int, to_name: bool) -> DataFrame:
    rest = lambda c: F.substring(c, size + 1, 1 << 30).alias(c)
    name: Column = F.concat_ws("_", "qname", F.substring("seq", 1, size)) if to_name else F.col("qname")
    return reads.select(name.alias("qname"), rest("seq"), rest("qual"))


def first_pass(reads: DataFrame, umi: int = 12, adapters: tuple[str, ...] = ("A" * 10, "G" * 10), rate: float = 0.2, overlap: int = 8, quality: int = 20, least: int = 15) -> DataFrame:
    """The tag moves into the name; poor ends, then the homopolymer adapter that fits best, then short reads go."""
    rows = without_adapter(without_poor_end(_cut_front(reads, umi, True), quality), adapters, rate, overlap)
    return rows.where(F.length("seq") >= least)


def second_pass(reads: DataFrame, front: int = 3, adapter: str = "AGATCGGAAGAG", rate: float = 0.1, overlap: int = 12, quality: int = 20, least: int = 15) -> DataFrame:
    """The first letters go for good; poor ends, the sequencing adapter, short reads."""
    return without_adapter(without_poor_end(_cut_front(reads, front, False), quality), adapter, rate, overlap).where(F.length("seq") >= least)
