"""Predicates, classifications and small lookups that several arms share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def library_names(ids: DataFrame, column: str = "sample_name", suffixes: tuple[str, ...] = ("i", "p", "h")) -> DataFrame:
    """One row a library: each id with each condition letter."""
    letter = F.explode(F.array(*[F.lit(s) for s in suffixes]))
    return ids.withColumn("suffix", letter).withColumn("library", F.concat(F.trim(column), "suffix"))


def classify(value: Column, classes: dict[str, list[str]], substring: bool = False) -> Column:
    """Label of the first class that lists the value (or a part of it, in the order given); NULL without one."""
    out = F.lit(None).cast("string")
    for label, names in reversed(list(classes.items())):
        if substring:
            hit = value.rlike("|".join(re.escape(n) for n in names)) if names else F.lit(False)
        else:
            hit = value.isin(names)
        out = F.when(hit, label).otherwise(out)
    return out


def without_prefixes(rows: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose key starts with none of the prefixes."""
    if not prefixes:
        return rows
    return rows.where(~F.coalesce(F.col(column).rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")"), F.lit(False)))


def containing(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows one of whose columns has the text, whatever the case; the text is no pattern."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def complete_cases(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.dropna(subset=list(columns) or None)


def members(rows: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) among the ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def length_of(rows: DataFrame, by: str, length: str, pos: str) -> DataFrame:
    """Most common length of each group, but no less than its greatest position."""
    from tagtally.operators.variants import mode_of

    return mode_of(rows, [by], length, "common").join(rows.groupBy(by).agg(F.max(pos).alias("top")), by, "right").select(by, F.greatest("common", "top").alias("length"))


def snap(value: Column, grid: list[float]) -> Column:
    """Nearest of the given values; the smaller one of two equally near."""
    pairs = F.array(*[F.struct(F.abs(value - g).alias("d"), F.lit(float(g)).alias("g")) for g in grid])
    return F.when(value.isNotNull(), F.array_min(pairs)["g"])


def flag_counts(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """Counts of records by flag bit: all, mapped, secondary, supplementary, reverse."""
    bit = lambda b: F.col(flag).bitwiseAND(b) != 0
    return rows.agg(F.count("*").alias("total"), F.count_if(~bit(4)).alias("mapped"), F.count_if(bit(0x100)).alias("secondary"), F.count_if(bit(0x800)).alias("supplementary"), F.count_if(bit(0x10)).alias("reverse"))


def stage_of(name: Column) -> tuple[Column, Column]:
    """Metric and group that a hit or stage file's name carries; NULL for other names."""
    pattern = r"^Annotated_(?:hits|stage[12])_(sgidshare|variant_rate|sgid|total)_(.+?)(?:_FAST)?\.csv$"
    metric = F.regexp_extract(name, pattern, 1)
    metric = F.when(metric == "sgidshare", "sgid").when(metric == "variant_rate", "total").when(metric != "", metric)
    return metric, F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))


def measured_percent(g: Column, f: Column) -> Column:
    return F.when(g + f > 0, 100.0 * g / (g + f))


def standard_error(value: str) -> Column:
    """Aggregate: sample deviation over the root of the count."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))
