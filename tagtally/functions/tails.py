"""Special functions and distribution tails in numpy, for the few numbers that the driver finishes and for batches of models."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(x: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal."""
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) if v == v else math.nan for v in np.asarray(x, float).ravel()]).reshape(np.shape(x))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return math.nan if x != x else float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t; infinite degrees give the normal."""
    if t != t or df != df or df <= 0:
        return math.nan
    if math.isinf(df):
        return 0.5 * math.erfc(t / math.sqrt(2))
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5) if t else 0.5
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of Fisher's F."""
    if f != f or f <= 0:
        return math.nan if f != f else 1.0
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 12).any():
        out = np.where(low, out + 1 / (x * x), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def trigamma_inverse(v: float) -> float:
    """The x whose trigamma is v, by Newton steps on the reciprocal."""
    if v > 1e7:
        return 1 / math.sqrt(v)
    if v < 1e-6:
        return 1 / v
    y = 0.5 + 1 / v
    for _ in range(60):
        t = float(trigamma(y))
        slope = (float(trigamma(y * (1 + 1e-6))) - t) / (y * 1e-6)
        step = t * (1 - t / v) / slope
        y += step
        if -step / y < 1e-12:
            break
    return y


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_pmf(k: int, good: int, bad: int, drawn: int) -> float:
    if k < max(0, drawn - bad) or k > min(good, drawn):
        return 0.0
    return math.exp(log_choose(good, k) + log_choose(bad, drawn - k) - log_choose(good + bad, drawn))


def hypergeometric_sf(k: int, good: int, bad: int, drawn: int) -> float:
    """P(X >= k)."""
    return min(1.0, math.fsum(hypergeometric_pmf(x, good, bad, drawn) for x in range(max(k, 0), min(good, drawn) + 1)))


def hypergeometric_row(good: int, bad: int, drawn: int) -> tuple[int, np.ndarray]:
    """All chances of a hypergeometric number that floats can hold, from its first value on.

    Exact ratios of neighbours lead from the mode outwards. The number is a sum of independent draws of 0 and 1, so by
    Bernstein's bound what lies beyond 40 standard deviations and 1000 steps has less than exp(-750), a float's 0.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    whole = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (whole + 2), low), high)
    spread = math.sqrt(drawn * (good / whole) * (bad / whole) * ((whole - drawn) / max(whole - 1, 1))) if whole else 0.0
    n = int(40 * spread) + 1000
    up, down = np.arange(mode, min(high, mode + n), dtype=float), np.arange(mode - 1, max(low, mode - n) - 1, -1, dtype=float)
    above = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    below = np.cumprod((down + 1) * (bad - drawn + down + 1) / ((good - down) * (drawn - down)))
    row = np.concatenate([below[::-1], [1.0], above])
    return mode - len(below), row / row.sum()


def intersection_pmf(universe: int, sizes: list[int]) -> np.ndarray:
    """Distribution of the size of the intersection of random sets of given sizes; folds set by set, smallest first.

    A fold takes some standard deviations' sizes by as many: in proportion to the sets, not to their square.
    """
    sizes = sorted(sizes)
    pmf = np.zeros(sizes[0] + 1)
    pmf[sizes[0]] = 1.0
    for m in sizes[1:]:
        new = np.zeros_like(pmf)
        for x in np.flatnonzero(pmf > 0).tolist():
            at, row = hypergeometric_row(x, universe - x, m)
            new[at : at + len(row)] += pmf[x] * row
        pmf = new
    return pmf
