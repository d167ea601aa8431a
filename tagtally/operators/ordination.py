"""Scaling, distances, ordination and classification of a few groups over many features.

Long rows ``group, feature, value`` stay in Spark until a table of groups by groups (or by few axes) is left.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtally.operators.quantiles import quantiles
from tagtally.session import shared_folder


def finite(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def min_presence(rows: DataFrame, least: int) -> DataFrame:
    """Features present in at least ``least`` groups."""
    have = finite(rows).groupBy("feature").agg(F.countDistinct("group").alias("k")).where(F.col("k") >= least).select("feature")
    return rows.join(have, "feature", "left_semi")


def batch_residual(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """value - mean of its batch + mean over batches; unchanged where a feature has fewer than 3 values or 2 batches."""
    f, b = Window.partitionBy("feature"), Window.partitionBy("feature", batch)
    ok = (F.count("value").over(f) >= 3) & (F.size(F.collect_set(batch).over(f)) >= 2)
    return rows.withColumn("value", F.when(ok, F.col("value") - F.avg("value").over(b) + F.avg("value").over(f)).otherwise(F.col("value")))


def zscore(rows: DataFrame) -> DataFrame:
    """Centred and scaled by feature; a spread of 0 (or none) counts as 1."""
    f = Window.partitionBy("feature")
    sd = F.coalesce(F.nullif(F.stddev_samp("value").over(f), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("value", (F.col("value") - F.avg("value").over(f)) / sd)


#: Features of a dense block, and groups up to which a task's table of sums is dense; more groups are joined by feature.
GRAM_BLOCK, GRAM_GROUPS = 512, 4096


def gram(rows: DataFrame) -> DataFrame:
    """``g1, g2, xy, xx, yy`` for g1 <= g2 that share a feature: sums of x y, x x and y y over the features both have.

    Features are dealt over tasks; a task makes dense blocks of them, with how often each group has a feature beside the values,
    and adds up three tables of groups by groups, which are all that is exchanged again. ``rows`` are finite.
    """
    rows = rows.where("group is not null")
    groups = sorted(r["group"] for r in rows.select("group").distinct().limit(GRAM_GROUPS + 1).collect())
    if len(groups) > GRAM_GROUPS:
        a = rows.select(F.col("group").alias("g1"), "feature", F.col("value").alias("x"))
        b = rows.select(F.col("group").alias("g2"), "feature", F.col("value").alias("y"))
        both = a.join(b, "feature").where("g1 <= g2").groupBy("g1", "g2")
        return both.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind, held = dict(rows.dtypes)["group"], to_arrow_type(rows.schema["group"].dataType)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        n, names = len(groups), pa.array(groups, held)
        values, squares, times = (np.zeros((GRAM_BLOCK, n)) for _ in range(3))
        xy, xx, shared = (np.zeros((n, n)) for _ in range(3))
        last, at = None, -1

        def settle():
            nonlocal xy, xx, shared
            xy += values.T @ values
            xx += squares.T @ times
            shared += times.T @ times
            for m in (values, squares, times):
                m[:] = 0

        for batch in batches:
            features = batch["feature"].to_pylist()
            where = pc.index_in(batch["group"], names).to_numpy()
            x = batch["value"].to_numpy(zero_copy_only=False)
            place = np.zeros(len(features), np.int64)
            begin = 0
            for i, f in enumerate(features):  # sorted by feature
                if f != last:
                    last, at = f, at + 1
                    if at == GRAM_BLOCK:
                        _put(values, squares, times, place[begin:i], where[begin:i], x[begin:i])
                        settle()
                        begin, at = i, 0
                place[i] = at
            _put(values, squares, times, place[begin:], where[begin:], x[begin:])
        settle()
        i, j = np.nonzero(np.triu(shared > 0))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(xy[i, j]), pa.array(xx[i, j]), pa.array(xx[j, i])], ["g1", "g2", "xy", "xx", "yy"])

    dealt = rows.where("feature is not null").select("group", "feature", F.col("value").cast("double").alias("value")).repartition("feature").sortWithinPartitions("feature")
    parts = dealt.mapInArrow(run, f"g1 {kind}, g2 {kind}, xy double, xx double, yy double")
    return parts.groupBy("g1", "g2").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])


def _put(values, squares, times, place, where, x) -> None:
    np.add.at(values, (place, where), x)
    np.add.at(squares, (place, where), x * x)
    np.add.at(times, (place, where), 1.0)


def cosine_distances(rows: DataFrame) -> DataFrame:
    """``g1, g2, d`` for g1 <= g2 over the features both have; 1 where they share none or one has no length.

    Pairs that share nothing come from the short list of groups, whose number is that of the ordination.
    """
    s = gram(finite(rows).select("group", "feature", "value"))
    s = s.select("g1", "g2", F.when((F.col("xx") > 0) & (F.col("yy") > 0), 1 - F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(1.0).alias("d"))
    names = rows.select("group").distinct().groupBy().agg(F.sort_array(F.collect_set("group")).alias("n"))
    pairs = names.select(F.explode(F.expr("flatten(transform(n, (x, i) -> transform(slice(n, i + 1, size(n) - i), y -> named_struct('g1', x, 'g2', y))))")).alias("p")).select("p.*")
    return pairs.join(s, ["g1", "g2"], "left").select("g1", "g2", F.coalesce("d", F.lit(1.0)).alias("d"))


def distance_matrix(distances: DataFrame) -> tuple[list, np.ndarray]:
    """Names and square matrix of long distances: for the few groups of an ordination."""
    rows = distances.collect()
    names = sorted({r["g1"] for r in rows} | {r["g2"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["g1"]], at[r["g2"]]] = d[at[r["g2"]], at[r["g1"]]] = r["d"] if r["g1"] != r["g2"] else 0.0
    return names, d


def mds(names: list, d: np.ndarray, k: int = 9) -> np.ndarray:
    """Classical scaling: coordinates of the k greatest positive eigenvalues."""
    n = len(names)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = [i for i in np.argsort(-values)[:k] if values[i] > 1e-12]
    return vectors[:, order] * np.sqrt(values[order])


def axes_kept(x: np.ndarray, share: float = 0.05) -> int:
    """How many axes hold at least that share of the variance."""
    v = x.var(axis=0, ddof=1)
    return int((v / v.sum() >= share).sum()) if v.sum() > 0 else 0


def pca(rows: DataFrame, k: int = 2) -> tuple[list, np.ndarray, np.ndarray]:
    """Names, scores and variance shares of groups over standardised features.

    The Gram matrix of groups (their number squared) is all that leaves Spark; constant features drop out.
    """
    f = Window.partitionBy("feature")
    r = finite(rows).withColumn("m", F.avg("value").over(f)).withColumn("s", F.stddev_samp("value").over(f)).where("s > 0")
    r = r.select("group", "feature", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    sums = gram(r.select("group", "feature", F.col("z").alias("value"))).select("g1", "g2", F.col("xy").alias("d")).collect()
    names = sorted({q["g1"] for q in sums} | {q["g2"] for q in sums})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for q in sums:
        m[at[q["g1"]], at[q["g2"]]] = m[at[q["g2"]], at[q["g1"]]] = q["d"]
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    values = np.maximum(values[order], 0)
    return names, vectors[:, order[:k]] * np.sqrt(values[:k]), values / values.sum()


def hulls(points: DataFrame, group: str = "cluster") -> DataFrame:
    """Convex hull of each cluster of at least 3 points: its corners in order. Points are one row a sample."""
    import pandas as pd

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(float(x), float(y)) for x, y in zip(pdf["x"], pdf["y"])})
        if len(pts) < 3:
            return pd.DataFrame({group: [], "corner": [], "x": [], "y": []})

        def half(seq):
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = half(pts) + half(pts[::-1])
        return pd.DataFrame({group: pdf[group].iloc[0], "corner": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    kind = dict(points.dtypes)[group]
    return points.select(group, "x", "y").groupBy(group).applyInPandas(hull, f"{group} {kind}, corner int, x double, y double")


def cluster_order(names: list, d: np.ndarray) -> list:
    """Leaves in the order of hierarchical clustering by Ward's criterion on the distances."""
    groups = {i: [i] for i in range(len(names))}
    m = {(i, j): d[i, j] ** 2 for i in groups for j in groups if i < j}
    while len(groups) > 1:
        i, j = min(m, key=lambda k: (m[k], k))
        ni, nj = len(groups[i]), len(groups[j])
        for k in groups:
            if k not in (i, j):
                nk = len(groups[k])
                a, b = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                m[a] = ((ni + nk) * m[a] + (nj + nk) * m[b] - nk * m[i, j]) / (ni + nj + nk)
        groups[i] += groups.pop(j)
        m = {k: v for k, v in m.items() if j not in k}
    return [names[i] for i in next(iter(groups.values()), [])]


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Soft-margin linear classifier by dual coordinate descent; y is -1 or 1; the offset is a constant feature."""
    z = np.column_stack([x, np.ones(len(x))])
    a, w = np.zeros(len(y)), np.zeros(z.shape[1])
    q = (z**2).sum(1)
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            g = y[i] * (w @ z[i]) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost)
            if new != a[i]:
                w += (new - a[i]) * y[i] * z[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-8:
            break
    return w[:-1], float(w[-1])


def loocv_svm(spark, names: list, x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> DataFrame:
    """``name, label, score``: each sample scored by a classifier trained on the others; a task for each fold."""
    import pandas as pd

    data, labels, ids = x.tolist(), y.tolist(), [str(n) for n in names]

    def folds(batches):
        z, t = np.array(data), np.array(labels)
        for pdf in batches:
            out = []
            for i in pdf["id"].astype(int):
                own = np.arange(len(t)) != i
                m, s = z[own].mean(0), z[own].std(0, ddof=1)
                s[s == 0] = 1
                w, b = linear_svm((z[own] - m) / s, np.where(t[own] == 1, 1.0, -1.0), cost)
                out.append((ids[i], int(t[i]), float(((z[i] - m) / s) @ w + b)))
            yield pd.DataFrame(out, columns=["name", "label", "score"])

    return spark.range(len(y)).mapInPandas(folds, "name string, label int, score double")


def permanova(spark, d: np.ndarray, y: list, permutations: int = 4999, seed: int = 1) -> DataFrame:
    """One row: F, R2 and p of a grouping of a distance matrix; permutations are rows of a range, scored in batches."""
    import pandas as pd

    d2, levels = (d**2).tolist(), sorted(set(y))
    codes = [levels.index(v) for v in y]

    def stat(q: np.ndarray, c: np.ndarray) -> tuple[float, float]:
        n, k = len(c), len(levels)
        total = q[np.triu_indices(n, 1)].sum() / n
        within = 0.0
        for g in range(k):
            own = np.flatnonzero(c == g)
            if len(own) > 1:
                within += q[np.ix_(own, own)][np.triu_indices(len(own), 1)].sum() / len(own)
        return ((total - within) / (k - 1)) / (within / (n - k)) if within > 0 else math.inf, 1 - within / total

    f, r2 = stat(np.array(d2), np.array(codes))

    def run(batches):
        q, c = np.array(d2), np.array(codes)
        for pdf in batches:
            yield pd.DataFrame({"f": [stat(q, np.random.default_rng([seed, int(i)]).permutation(c))[0] for i in pdf["id"]]})

    reached = 0 if not permutations else spark.range(permutations).mapInPandas(run, "f double").where(F.col("f") >= f - 1e-12).count()
    return spark.createDataFrame([(float(f), float(r2), (1 + reached) / (permutations + 1))], "f double, r2 double, p double")


def neighbour_embedding(names: list, d: np.ndarray, neighbours: int = 7, min_dist: float = 0.17, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """Two-dimensional layout that keeps neighbourhoods: a fuzzy neighbour graph, laid out by attraction and repulsion."""
    n = len(names)
    k = max(2, min(neighbours, n - 1))
    w = np.zeros((n, n))
    for i in range(n):
        near = np.argsort(d[i])[1 : k + 1]
        rho = d[i, near[0]]
        lo, hi, s = 0.0, math.inf, 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d[i, near] - rho, 0) / s).sum()
            if total > math.log2(k):
                hi, s = s, (lo + s) / 2
            else:
                lo, s = s, s * 2 if hi == math.inf else (s + hi) / 2
        w[i, near] = np.exp(-np.maximum(d[i, near] - rho, 0) / max(s, 1e-9))
    w = w + w.T - w * w.T
    start = mds(names, d, 2)
    y = np.zeros((n, 2))
    y[:, : start.shape[1]] = start
    y = y / max(np.abs(y).max(), 1e-9) * 5 + np.random.default_rng(seed).normal(0, 1e-3, (n, 2))
    for step in range(rounds):
        diff = y[:, None] - y[None]
        q = (diff**2).sum(-1)
        pull = -w / (1 + q)
        push = 0.1 * (1 - w) / ((min_dist**2 + q) * (1 + q))
        np.fill_diagonal(push, 0)
        force = ((pull + push)[:, :, None] * diff).sum(1)
        y = y + (1 - step / rounds) * np.clip(force, -4, 4) * 0.5
    return y


def correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation over rows that have both, and their number."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))


def most_variable(rows: DataFrame, n: int = 500) -> DataFrame:
    return rows.groupBy("feature").agg(F.var_samp("value").alias("variance")).orderBy(F.desc_nulls_last("variance"), "feature").limit(n)


def winsorised(rows: DataFrame, value: str, p: float) -> DataFrame:
    """Values clipped to their exact p and 1 - p quantiles."""
    q = quantiles(rows, [], value, {"lo": p, "hi": 1 - p}).first()
    return rows if q is None else rows.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.lit(float(q["lo"]))), F.lit(float(q["hi"])))))


#: Groups whose quartiles fit a broadcast.
FEW_GROUPS = 100_000


def box_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers (the outermost values within 1.5 ranges)."""
    q = quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    shared_folder(rows.sparkSession)
    q = q.checkpoint()  # a row for each group, read twice
    r = rows.join(F.broadcast(q) if q.count() <= FEW_GROUPS else q, by)  # by exchange, few groups would be few tasks
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    w = r.groupBy(*by).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count(value).alias("n"))
    return q.join(w, by)


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


