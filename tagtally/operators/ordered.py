"""Running sums and minima over one global order, without one task that sees all rows.

Values are cut into stretches at approximate quantiles. A window runs within each stretch, and what comes from the
stretches before it is an aggregate of one row for each, joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch, about; fewer rows than this are one stretch.
STRETCH_ROWS = 1_000_000


def stretched(rows: DataFrame, order: str, rows_each: int = STRETCH_ROWS) -> DataFrame:
    """Rows with ``__b``, the number of their stretch: greater values of ``order`` never have a smaller one."""
    n = -(-rows.count() // rows_each)
    cuts = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    if not cuts:
        return rows.withColumn("__b", F.lit(0))
    values = F.array(*[F.lit(c) for c in cuts])
    return rows.withColumn("__b", F.size(F.filter(values, lambda c: c < F.col(order))))


def running(rows: DataFrame, order: str, value: str, out: str, how: str = "sum", descending: bool = False) -> DataFrame:
    """``out``: sum or least of ``value`` over all rows up to this one; ``order`` is distinct and ``rows`` are stretched."""
    total = F.sum if how == "sum" else F.min
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    earlier = rows.groupBy("__b").agg(total(value).alias("__t")).select("__b", total("__t").over(before).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", total(value).over(inside)).join(F.broadcast(earlier), "__b")
    both = F.col("__own") + F.coalesce("__before", F.lit(0)) if how == "sum" else F.least("__own", "__before")
    return rows.withColumn(out, both).drop("__own", "__before")
