"""Count matrices in long form: normalisation, filters, paired contrasts, hits and roll-ups.

Counts are rows ``feature, sample, count`` with ``replicate`` and ``condition``; matrices are made only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtally.operators.ordered import running, stretched
from tagtally.session import shared_folder


def guarded(f, *columns: Column) -> Column:
    """``greatest``/``least`` that are NULL if any argument is, unlike the built-in ones."""
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, f(*columns))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or NULL."""
    return F.when(b != 0, a / b)


def matrix(counts: DataFrame, samples: list[str], rows: str = "feature", columns: str = "sample", value: str = "count") -> DataFrame:
    """Wide counts with a column for each named sample and 0 where there is none: one shuffle, whatever their number."""
    return counts.groupBy(rows).pivot(columns, samples).agg(F.sum(value)).fillna(0)


def long_form(wide: DataFrame, key: str, columns: list[str], name: str = "sample", value: str = "count") -> DataFrame:
    return wide.unpivot([key], columns, name, value)


def rounded(column: Column) -> Column:
    """Half to even, as the counts are rounded elsewhere."""
    return F.bround(column, 0)


def expressed(counts: DataFrame, least: int = 2, conditions: tuple[str, ...] = ("Input", "IP")) -> DataFrame:
    """Features with a count in at least ``least`` libraries of each condition."""
    have = counts.groupBy("feature").agg(*[F.count_if((F.col("condition") == c) & (F.col("count") > 0)).alias(f"n_{c}") for c in conditions])
    for c in conditions:
        have = have.where(F.col(f"n_{c}") >= least)
    return have.select("feature")


def complete_groups(declared: DataFrame, present: DataFrame, group: str = "group_name", sample: str = "sample") -> DataFrame:
    """Groups all of whose declared libraries are present."""
    here = present.select(sample).distinct().withColumn("here", F.lit(True))
    found = declared.join(here, sample, "left").groupBy(group).agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("whole"))
    return found.where("whole").select(group)


def size_factors(counts: DataFrame, normalisers: Column) -> DataFrame:
    """``sample, size_factor``: a library's sum over normaliser features, relative to the mean over libraries."""
    sums = counts.groupBy("sample").agg(F.sum(F.when(normalisers, F.col("count")).otherwise(0)).alias("total"))
    mean = F.avg("total").over(Window.partitionBy())  # a row for each library
    return sums.select("sample", ratio(F.col("total"), mean).alias("size_factor"))


def log_normalised(counts: DataFrame, factors: DataFrame) -> DataFrame:
    return counts.join(factors, "sample").withColumn("value", F.log2(ratio(F.col("count"), F.col("size_factor")) + 1))


def replicate_offsets(factors: DataFrame, how: str = "median") -> DataFrame:
    """One row: median (or mean) over replicates of ``-log2(control / ip)``, where each has exactly one of both.

    ``factors`` are ``replicate, condition, size_factor``.
    """
    pick = lambda c: F.when(F.count_if(F.col("condition") == c) == 1, F.max(F.when(F.col("condition") == c, F.col("size_factor"))))
    each = factors.groupBy("replicate").agg(pick("Control").alias("c"), pick("IP").alias("p"))
    each = each.withColumn("x", F.when((F.col("c") > 0) & (F.col("p") > 0), -F.log2(F.col("c") / F.col("p"))))
    return each.agg((F.median("x") if how == "median" else F.avg("x")).alias("offset"), F.count("x").alias("replicates"))


def contrast(counts: DataFrame, a: str, b: str, suffix: str) -> DataFrame:
    """Moment contrast of two conditions by feature: mean difference of log2 values over replicates, and its error."""
    value = lambda c: F.when(F.col("condition") == c, F.col("value"))
    stats = counts.groupBy("feature").agg(*[f(value(c)).alias(f"{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("v", F.var_samp), ("k", F.count))])
    rows = stats.where((F.col(f"k_{a}") > 1) & (F.col(f"k_{b}") > 1))
    se = F.sqrt(F.col(f"v_{a}") / F.col(f"k_{a}") + F.col(f"v_{b}") / F.col(f"k_{b}"))
    return rows.select("feature", (F.col(f"m_{a}") - F.col(f"m_{b}")).alias(f"lfc_{suffix}"), se.alias(f"se_{suffix}"))


def delta_wald(pulled: DataFrame, control: DataFrame, offset: float = 0.0) -> DataFrame:
    """Difference of two contrasts ``lfc_pI, se_pI`` and ``lfc_cI, se_cI`` by feature: delta, its error and z."""
    rows = pulled.join(control, "feature", "full")
    rows = rows.withColumn("delta", F.col("lfc_pI") - F.col("lfc_cI") + offset)
    rows = rows.withColumn("se_delta", F.sqrt(F.col("se_pI") * F.col("se_pI") + F.col("se_cI") * F.col("se_cI")))
    return rows.withColumn("z_delta", ratio(F.col("delta"), F.col("se_delta")))


def null_sd(rows: DataFrame, z: str = "z_delta") -> DataFrame:
    """One row: spread of the z values near 0: within 0.5, within 1 if fewer than ten are, else 0.3."""
    near = lambda r: F.when(F.abs(F.col(z)) < r, F.col(z))
    got = rows.agg(F.count(near(0.5)).alias("n1"), F.stddev_samp(near(0.5)).alias("s1"), F.count(near(1.0)).alias("n2"), F.stddev_samp(near(1.0)).alias("s2"))
    return got.select(F.when(F.col("n1") >= 10, F.col("s1")).when(F.col("n2") >= 10, F.col("s2")).otherwise(0.3).alias("sd"), F.col("n1").alias("n_half"), F.col("n2").alias("n_one"))


def with_wald_p(rows: DataFrame, sd: float, z: str = "z_delta") -> DataFrame:
    """One-sided p of z over the null spread, and its BH adjustment."""
    from tagtally.functions.tail_columns import normal_sf

    return benjamini_hochberg(rows.withColumn("pval_delta", normal_sf(F.col(z) / sd)), "pval_delta", "padj_delta")


def benjamini_hochberg(rows: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Adjusted p values over all rows (or within ``by``); NULLs neither count nor get one.

    Distinct p values with their counts are aggregated first. Their ranks need one order, which ``ordered`` cuts into
    stretches; within ``by`` a window orders each group's distinct values. The rows are written once and read back: sums
    that a shuffle adds up in another order would give other last digits, and such rows would not find their rank.
    """
    keys = [*by, p]
    shared_folder(rows.sparkSession)
    rows = rows.checkpoint()
    distinct = rows.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__k"))
    if by:
        up = Window.partitionBy(*by).orderBy(F.col(p).asc())
        down = Window.partitionBy(*by).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = distinct.withColumn("__r", F.sum("__k").over(up)).withColumn("__n", F.sum("__k").over(Window.partitionBy(*by)))
        ranked = ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down)))
    else:
        whole = distinct.agg(F.sum("__k")).first()[0]
        ranked = running(stretched(distinct, p), p, "__k", "__r").withColumn("__q", F.col(p) * F.lit(whole) / F.col("__r"))
        ranked = running(ranked, p, "__q", out, "min", descending=True)
        ranked = ranked.withColumn(out, F.least(F.lit(1.0), out))
    return rows.join(ranked.select(*keys, out), keys, "left")


def call_flags(rows: DataFrame, lfc: str = "lfc_pI", padj: str = "padj_pI", z: str = "z_delta", padj_delta: str = "padj_delta", least: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Directionality, significance against input and control, and their conjunction; unknown is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("directionality", yes(F.col(lfc) > least))
    rows = rows.withColumn("vs_input", yes((F.col(lfc) > least) & (F.col(padj) < alpha)))
    rows = rows.withColumn("vs_control", yes((F.col(z) > 0) & (F.col(padj_delta) < alpha)))
    return rows.withColumn("tp", F.col("vs_input") & F.col("vs_control"))


def neg_log10(p: Column) -> Column:
    """-log10 with 300 for zero."""
    return F.when(p == 0, F.lit(300.0)).when(p > 0, -F.log10(p))


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: mean of x by w over rows that have x."""
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def stouffer(z: Column, w: Column) -> Column:
    """Aggregate: weighted combination of z values. Weights of rows without z stay in the denominator."""
    return F.when((F.count(z) > 0) & (F.count(w) > 0), ratio(F.sum(z * w), F.sqrt(F.sum(w * w))))


def family_rollup(rows: DataFrame, lfc: str, padj: str, z: str, weight: str, family: str = "family") -> DataFrame:
    """By family: weighted means of the change and of -log10 padj, and the combined z."""
    rows = rows.withColumn("__l", neg_log10(F.col(padj)))
    return rows.groupBy(family).agg(weighted_mean(F.col(lfc), F.col(weight)).alias("avg_log2FC"), weighted_mean(F.col("__l"), F.col(weight)).alias("avg_log10padj"), stouffer(F.col(z), F.col(weight)).alias("combined_zscore"), F.count("*").alias("n"))


def annotate(rows: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension; the planner broadcasts it while it is small and shuffles it beyond."""
    return rows.join(annotation, key, "left")


def with_missing_levels(rows: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """The rows, and a NULL row for each level that has none."""
    return rows.unionByName(levels.select(level).distinct().join(rows.select(level).distinct(), level, "left_anti"), allowMissingColumns=True)


def level_counts(rows: DataFrame, levels: list[str], column: str, other: str = "others") -> DataFrame:
    """Count and percent of each level, all levels present, unknown ones as ``other``; labelled from five percent."""
    spark = rows.sparkSession
    known = [*levels, *([other] if other not in levels else [])]
    table = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(known)], f"{column} string, level int"))
    value = F.when(F.col(column).isin(known), F.col(column)).otherwise(other)
    got = rows.withColumn(column, F.coalesce(value, F.lit(other))).groupBy(column).agg(F.count("*").alias("n"))
    out = table.join(got, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("percent", ratio(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())))
    return out.withColumn("labelled", F.coalesce(F.col("percent") >= 5, F.lit(False)))


def top_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def merge_features(counts: DataFrame, sources: list[str], into: str) -> DataFrame:
    """Counts with the source features summed into one."""
    named = F.when(F.col("feature").isin(sources), F.lit(into)).otherwise(F.col("feature"))
    others = [c for c in counts.columns if c not in ("feature", "count")]
    return counts.withColumn("feature", named).groupBy("feature", *others).agg(F.sum("count").alias("count"))
