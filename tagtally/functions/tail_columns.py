"""Distribution tails as Spark expressions: series and continued fractions as folds of bounded length, no Python worker.

Each is NULL where an argument is NULL or NaN. Values agree with ``functions.tails`` to some 12 digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the fraction of the normal tail; steps of the beta fraction, enough for parameters up to ``LARGE``, and of one of its runs.
SERIES, FRACTION, STEPS, RUN, LARGE = 60, 80, 400, 10, 1e5

_SHIFT = 10
_TINY = 1e-300


def bound(body, *arguments: Column) -> Column:
    """``body`` of the arguments, each computed once; NULL where one is NULL or NaN."""
    names = [f"a{i}" for i in range(len(arguments))]
    known = F.struct(*[a.cast("double").alias(n) for n, a in zip(names, arguments)])
    missing = F.lit(False)
    for a in arguments:
        missing = missing | a.isNull() | F.isnan(a.cast("double"))
    return F.when(~missing, F.element_at(F.transform(F.array(known), lambda s: body(*[s[n] for n in names])), 1))


def normal_sf(x: Column) -> Column:
    """Upper tail of the standard normal."""

    def tail(x: Column) -> Column:
        z = F.abs(x) / math.sqrt(2.0)
        # Near 0: 1 - erf by a series of positive terms; beyond: the continued fraction of erfc from its end.
        first = F.struct((z * 1.0).alias("t"), (z * 1.0).alias("s"))
        grown = lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s"))
        near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), first, grown)["s"]
        below = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / (2 * a))
        far = F.exp(-z * z) / (math.sqrt(math.pi) * below)
        half = F.when(z < 2, near).when(z < 40, far).otherwise(0.0) / 2
        return F.when(x >= 0, half).otherwise(1 - half)

    return bound(tail, x)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series behind a shift."""

    def value(x: Column) -> Column:
        z = x + _SHIFT
        q = 1 / (z * z)
        stirling = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12.0 - q * (1 / 360.0 - q * (1 / 1260.0 - q * (1 / 1680.0 - q / 1188.0)))) / z
        product = x
        for k in range(1, _SHIFT):
            product = product * (x + k)
        return stirling - F.ln(product)

    return bound(lambda x: F.when(x > 1e25, x * F.ln(x) - x).otherwise(value(x)), x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its begin on until it stands."""
    kept = lambda v: F.when(F.abs(v) > _TINY, v).otherwise(_TINY)
    with_ = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  what a step names is computed once, not at each use

    def half(state: Column, number: Column) -> Column:
        raw = lambda n: F.struct((1 + n * state["d"]).alias("u"), (1 + n / state["c"]).alias("v"))
        pair = lambda r: F.struct(kept(r["v"]).alias("c"), (1 / kept(r["u"])).alias("d"))
        new = lambda q: F.struct(q["c"].alias("c"), q["d"].alias("d"), (state["h"] * q["c"] * q["d"]).alias("h"), (F.abs(q["c"] * q["d"] - 1) < 1e-15).alias("done"))
        return with_(with_(with_(number, raw), pair), new)

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(state["done"], state).otherwise(with_(half(state, even), lambda s: half(s, odd)))

    d = 1 / kept(1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done"))
    # In runs, so that a fraction that stands costs one look a run and not one a step.
    run = lambda state, at: F.when(state["done"], state).otherwise(F.aggregate(F.sequence(at, at + (RUN - 1)), state, step))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS), F.lit(RUN)), first, run)["h"]


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function, for parameters up to ``LARGE``."""

    def value(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
        low = front * _fraction(a, b, x) / a
        high = 1 - front * _fraction(b, a, 1 - x) / b
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)

    return bound(value, x, a, b)


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of Fisher's F."""
    return bound(lambda f, d1, d2: F.when(f <= 0, 1.0).otherwise(beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)), f, d1, d2)


def t_two_sided(t: Column, df: Column) -> Column:
    """Both tails of Student's t; many degrees by the normal that agrees to the order of their square. NULL without degrees."""

    def tails(t: Column, df: Column) -> Column:
        close = F.when(df > 1e300, F.abs(t)).otherwise((8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t * t / df)))
        exact = beta_cdf(df / (df + t * t), df / 2, F.lit(0.5))
        return F.when(df <= 0, F.lit(None).cast("double")).when(df > LARGE, 2 * normal_sf(close)).otherwise(F.least(F.lit(1.0), exact))

    return bound(tails, t, df)
