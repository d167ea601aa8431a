"""Exact quantiles of many groups at once, without a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtally.session import shared_folder

#: Values of a stretch that one task puts in order; a longer stretch is cut at ``CUTS`` approximate quantiles first.
STRETCH, CUTS = 1_000_000, 256


def ranked_values(values: DataFrame, ranks: DataFrame, stretch: int | None = None) -> DataFrame:
    """``g, k, v``: of each group the value of each wanted rank (from 0). ``values`` are ``g, v``; ``ranks`` ``g, k``.

    All groups and ranks narrow together: a stretch of a group with too many values is cut at approximate quantiles from a
    sketch, exact counts between the cuts say which piece holds a rank, and only these pieces go on. A cut is a
    piece of its own, so ties end there. What is left is put in order piece by piece.
    """
    limit = stretch or STRETCH
    shared_folder(values.sparkSession)
    rows = values.select("g", F.lit(0).cast("long").alias("s"), "v")
    want = ranks.select("g", F.lit(0).cast("long").alias("s"), "k", F.col("k").alias("at"))
    done = None
    while True:
        # Only stretches that are too long are cut: one for ``limit`` values at most, so they and their cuts fit a broadcast,
        # and no task gets all values of one group.
        long_ = rows.groupBy("g", "s").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g", "s").checkpoint()
        if long_.isEmpty():
            break
        grid = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
        own = rows.join(F.broadcast(long_), ["g", "s"])
        cuts = own.groupBy("g", "s").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", grid, F.lit(10_000)))).alias("cuts")).checkpoint()
        rest = rows.join(F.broadcast(long_), ["g", "s"], "left_anti")
        still = want.join(F.broadcast(long_), ["g", "s"], "left_anti")
        # How many cuts are below, by halves.
        steps = F.array(*[F.lit(1 << i) for i in range(CUTS.bit_length() - 1, -1, -1)])
        below = F.aggregate(steps, F.lit(0), lambda a, x: F.when(F.get("cuts", a + x - 1) < F.col("v"), a + x).otherwise(a))
        placed = rows.join(F.broadcast(cuts), ["g", "s"]).withColumn("below", below)
        placed = placed.select("g", "s", "v", (2 * F.col("below") + F.coalesce(F.get("cuts", F.col("below")) == F.col("v"), F.lit(False)).cast("int")).alias("b"))
        counted = placed.groupBy("g", "s", "b").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("g", "s").orderBy("b")) - F.col("n")  # pieces of a stretch
        counted = counted.withColumn("before", before)
        found = want.join(counted, ["g", "s"]).where("at >= before and at < before + n")
        found = found.join(cuts, ["g", "s"]).select("g", "s", "k", "b", (F.col("at") - F.col("before")).alias("at"), F.get("cuts", F.floor(F.col("b") / 2).cast("int")).alias("cut")).checkpoint()
        # An odd piece is one value; the others become stretches of their own.
        known = found.where("b % 2 = 1").select("g", "k", F.col("cut").alias("v"))
        done = known if done is None else done.unionByName(known)
        piece = (F.col("s") * (2 * CUTS + 4) + F.col("b") + 1).alias("s")
        open_ = found.where("b % 2 = 0")
        # Pieces with a wanted rank: few for each long stretch.
        rows = placed.join(F.broadcast(open_.select("g", "s", "b").distinct()), ["g", "s", "b"], "left_semi").select("g", piece, "v").unionByName(rest).checkpoint()
        want = open_.select("g", piece, "k", "at").unionByName(still).checkpoint()
    counted = rows.groupBy("g", "s", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "s").orderBy("v"))
    last = want.join(counted.withColumn("upto", upto), ["g", "s"]).where("at < upto and at >= upto - n").select("g", "k", "v")
    return last if done is None else done.unionByName(last)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], stretch: int | None = None) -> DataFrame:
    """``by`` and a column for each named share: the exact quantile of the group's values, linear between neighbours (type 7).

    Null and NaN values do not count; a group without values has no row. Null keys are a group.
    """
    g: Column = F.struct(*by) if by else F.struct(F.lit(1).alias("__all"))
    x = F.col(value).cast("double")
    values = rows.where(x.isNotNull() & ~F.isnan(x)).select(g.alias("g"), x.alias("v"))
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()]))
    counted = values.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", places.alias("x"))
    counted = counted.select("g", F.col("x.name").alias("name"), ((F.col("n") - 1) * F.col("x.p")).alias("place"), "n")
    counted = counted.withColumn("low", F.floor("place")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    ranks = counted.select("g", F.explode(F.array("low", "high")).alias("k")).distinct()
    found = ranked_values(values, ranks, stretch)
    both = counted.join(found.select("g", F.col("k").alias("low"), F.col("v").alias("a")), ["g", "low"]).join(found.select("g", F.col("k").alias("high"), F.col("v").alias("b")), ["g", "high"])
    exact = F.col("a") + (F.col("place") - F.col("low")) * (F.col("b") - F.col("a"))
    out = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(exact))).alias(n) for n in shares])
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], *shares)
