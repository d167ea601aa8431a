"""Set algebra over rows ``set_name, item``, overlap categories, and over-representation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_items(sets: DataFrame) -> DataFrame:
    return sets.where("item is not null").select("set_name", "item").distinct()


def union(sets: DataFrame) -> DataFrame:
    return distinct_items(sets).select("item").distinct()


def intersection(sets: DataFrame, names: list[str]) -> DataFrame:
    """Items that are in all the named sets: one aggregation, however many sets."""
    rows = distinct_items(sets).where(F.col("set_name").isin(names))
    return rows.groupBy("item").agg(F.count("*").alias("k")).where(F.col("k") == len(set(names))).select("item")


def difference(sets: DataFrame, a: str, b: str) -> DataFrame:
    rows = distinct_items(sets)
    return rows.where(F.col("set_name") == a).select("item").join(rows.where(F.col("set_name") == b).select("item"), "item", "left_anti")


def multiplicity(sets: DataFrame) -> DataFrame:
    """In how many sets each item is."""
    return distinct_items(sets).groupBy("item").agg(F.count("*").alias("n_sets"))


def membership(sets: DataFrame, names: list[str]) -> DataFrame:
    """A boolean column for each named set."""
    rows = distinct_items(sets).withColumn("k", F.lit(1)).groupBy("item").pivot("set_name", names).agg(F.sum("k"))
    return rows.select("item", *[F.coalesce(F.col(f"`{n}`") > 0, F.lit(False)).alias(n) for n in names])


def categories(sets: DataFrame, names: list[str]) -> DataFrame:
    """Items by the exact combination of named sets they are in, with the combination's size."""
    rows = distinct_items(sets).where(F.col("set_name").isin(names))
    return rows.groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("set_name")), "&").alias("category"))


def align(items: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items inside the universe, and those dropped."""
    known = universe.select("item").distinct()
    return items.join(known, "item", "left_semi"), items.join(known, "item", "left_anti")


def sizes(sets: DataFrame, names: list[str], universe: DataFrame) -> dict[str, int]:
    """Sizes of the named sets in the universe, of their intersection (``&``) and of the universe (empty name)."""
    known = universe.select("item").distinct()
    rows = distinct_items(sets).where(F.col("set_name").isin(names)).join(known, "item", "left_semi")
    out = {r["set_name"]: r["count"] for r in rows.groupBy("set_name").count().collect()}  # a row for each set
    return {n: out.get(n, 0) for n in names} | {"&": intersection(rows, names).count(), "": known.count()}


def over_representation(sets: DataFrame, a: str, b: str, universe: DataFrame) -> DataFrame:
    """One row: sizes, overlap and P(overlap or more) of two sets drawn from the universe."""
    from tagtally.functions.tails import hypergeometric_sf

    n = sizes(sets, [a, b], universe)
    p = hypergeometric_sf(n["&"], n[b], n[""] - n[b], n[a])
    return universe.sparkSession.createDataFrame([(n[a], n[b], n["&"], n[""], float(p))], "n_a long, n_b long, overlap long, universe long, p double")


def _expected(n: dict[str, int], names: list[str]) -> float:
    expected = 1.0
    for x in names:
        expected *= n[x] / (n[""] if n[""] else 1)
    return float(expected * n[""])


def expected_intersection(sets: DataFrame, names: list[str], universe: DataFrame) -> DataFrame:
    """One row: the expected size of the intersection of several sets drawn from the universe; needs their sizes alone."""
    known = universe.select("item").distinct()
    rows = distinct_items(sets).where(F.col("set_name").isin(names)).join(known, "item", "left_semi")
    found = {r["set_name"]: r["count"] for r in rows.groupBy("set_name").count().collect()}  # a row for each set
    n = {x: found.get(x, 0) for x in names} | {"": known.count()}
    return universe.sparkSession.createDataFrame([(_expected(n, names),)], "expected double")


def exact_intersection(sets: DataFrame, names: list[str], universe: DataFrame) -> DataFrame:
    """One row: observed and expected size of the intersection of several sets, enrichment and P(observed or more)."""
    from tagtally.functions.tails import intersection_pmf

    n = sizes(sets, names, universe)
    k, expected = n["&"], _expected(n, names)
    pmf = intersection_pmf(n[""], [n[x] for x in names])
    return universe.sparkSession.createDataFrame([(k, expected, float(k / expected) if expected else None, float(min(1.0, pmf[k:].sum())))], "observed long, expected double, enrichment double, p double")


def display_names(sources: list[DataFrame], keys: DataFrame) -> DataFrame:
    """``key, display``: the name from the first source that has the key (first of its rows by ``ord``), else the key, prettified."""
    from tagtally.functions.strings import sentence_case

    ranked = None
    for i, s in enumerate(sources):
        rows = s.select("key", "display", F.lit(i).alias("priority"), "ord")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy("key").agg(F.min_by("display", F.struct("priority", "ord", "display")).alias("display"))
    return keys.join(best, "key", "left").select("key", F.coalesce("display", sentence_case(F.col("key"))).alias("display"))
