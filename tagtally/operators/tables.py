"""Whole-table steps: chains of joins, rows by position, maps of literals, matrices over common names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtally.operators.ordered import running, stretched


def inner_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables joined one after the other on a key that each has; columns of the same name count from the first table.

    The tables are first cut to the keys that all have, so that no wide intermediate row is made in vain.
    """
    common = reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), tables[1:], tables[0].select(key).distinct())
    out = tables[0].join(common, key, "left_semi")
    for table in tables[1:]:
        out = out.join(table.select(key, *[c for c in table.columns if c not in out.columns]), key)
    return out


def numbered(rows: DataFrame, order: str, out: str = "row") -> DataFrame:
    """Rows with their place from 1 by a column of distinct values."""
    return running(stretched(rows, order).withColumn("__one", F.lit(1)), order, "__one", out).drop("__one", "__b")


def bind_columns(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables side by side by their places in two orders; a table that is shorter ends the result."""
    left, right = numbered(a, order_a, "__row"), numbered(b, order_b, "__row")
    return left.join(right.select("__row", *[c for c in b.columns if c not in a.columns]), "__row").drop("__row")


def looked_up(column: Column, names: dict, default=None) -> Column:
    """The value of a map of literals; ``default`` for other keys."""
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[column]
    return found if default is None else F.coalesce(found, F.lit(default))


def aligned(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Two long matrices cut to the names (row names, column names) that both have."""
    for k in keys:
        both = a.select(k).distinct().join(b.select(k).distinct(), k, "left_semi")
        a, b = a.join(both, k, "left_semi"), b.join(both, k, "left_semi")
    return a, b


def number_or_zero(text: Column) -> Column:
    """A text as a number; what is none counts as zero."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def facet_peaks(rows: DataFrame, value: str, *facets: str) -> DataFrame:
    """Greatest value of each facet and of all facets together."""
    peaks = rows.groupBy(*facets).agg(F.max(value).alias("peak"))
    return peaks.join(F.broadcast(rows.agg(F.max(value).alias("overall"))))  # one row
