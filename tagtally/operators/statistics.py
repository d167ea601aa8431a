"""Tests and regressions whose sums Spark makes and whose few numbers the driver finishes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.operators.counts import ratio
from tagtally.operators.ordered import running, stretched


def welch(rows: DataFrame, by: list[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t by group: means, t, Satterthwaite degrees and two-sided p."""
    from tagtally.functions.tail_columns import t_two_sided

    v = lambda g: F.when(F.col(group) == g, F.col(value))
    s = rows.groupBy(*by).agg(*[f(v(g)).alias(n + x) for x, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s = s.where("na > 1 and nb > 1").withColumn("ea", F.col("va") / F.col("na")).withColumn("eb", F.col("vb") / F.col("nb"))
    s = s.withColumn("t", ratio(F.col("ma") - F.col("mb"), F.sqrt(F.col("ea") + F.col("eb"))))
    df = ratio((F.col("ea") + F.col("eb")) * (F.col("ea") + F.col("eb")), F.col("ea") * F.col("ea") / (F.col("na") - 1) + F.col("eb") * F.col("eb") / (F.col("nb") - 1))
    s = s.withColumn("df", df).select(*by, F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), "t", "df")
    return s.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def paired_t(rows: DataFrame, by: list[str], pair: str, group: str, value: str, a: str, b: str) -> DataFrame:
    """Paired t by group over pairs that have both sides."""
    from tagtally.functions.tail_columns import t_two_sided

    v = lambda g: F.max(F.when(F.col(group) == g, F.col(value)))
    d = rows.groupBy(*by, pair).agg(v(a).alias("a"), v(b).alias("b")).withColumn("d", F.col("a") - F.col("b"))
    s = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("s"), F.count("d").alias("n")).where("n > 1")
    s = s.withColumn("t", ratio(F.col("mean_diff"), F.col("s") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double")).drop("s")
    return s.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def slopes(rows: DataFrame, by: list[str], y: str, x: str, least: int = 3) -> DataFrame:
    """Ordinary slope by group with enough rows."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)


def inverse_variance_fit(rows: DataFrame, y: str, x: str, se: str) -> dict:
    """Weighted line with w = 1/se^2: slope, intercept, their errors, p, and what a band needs."""
    from tagtally.functions.tails import t_sf

    w = 1 / (F.col(se) * F.col(se))
    s = rows.where(F.col(se) > 0).agg(*[F.sum(e).alias(n) for n, e in (("w", w), ("x", w * F.col(x)), ("y", w * F.col(y)), ("xx", w * F.col(x) * F.col(x)), ("xy", w * F.col(x) * F.col(y)), ("yy", w * F.col(y) * F.col(y)))], F.count("*").alias("n")).first()
    mx, my = s["x"] / s["w"], s["y"] / s["w"]
    sxx, sxy, syy = s["xx"] - s["w"] * mx * mx, s["xy"] - s["w"] * mx * my, s["yy"] - s["w"] * my * my
    slope = sxy / sxx
    df = s["n"] - 2
    var = max(0.0, (syy - slope * sxy) / df) if df > 0 else math.nan
    error = math.sqrt(var / sxx)
    t = slope / error if error else math.inf
    return {"slope": slope, "intercept": my - slope * mx, "se": error, "t": t, "df": df, "p": 2 * t_sf(abs(t), df) if error else 0.0, "mean_x": mx, "sxx": sxx, "sw": s["w"], "var": var}


def band(spark, fit: dict, grid: list[float], level: float = 0.95) -> DataFrame:
    """The line with its interval for the mean over a grid."""
    from tagtally.functions.tails import t_ppf

    q = t_ppf(0.5 + level / 2, fit["df"])
    out = []
    for g in grid:
        y = fit["intercept"] + fit["slope"] * g
        e = q * math.sqrt(fit["var"] * (1 / fit["sw"] + (g - fit["mean_x"]) ** 2 / fit["sxx"]))
        out.append((float(g), y, y - e, y + e))
    return spark.createDataFrame(out, "x double, y double, lo double, hi double")


def blocked_fit(rows: DataFrame, y: str, x: str, block: str) -> dict:
    """y ~ x + block by least squares: within-block sums give the slope, its p and the adjusted R^2."""
    from tagtally.functions.tails import t_sf

    by = rows.groupBy(block).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    s = by.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.expr("xx - x * x / n")).alias("sxx"), F.sum(F.expr("xy - x * y / n")).alias("sxy"), F.sum(F.expr("yy - y * y / n")).alias("syy"), F.sum("y").alias("y"), F.sum("yy").alias("yy")).first()
    slope = s["sxy"] / s["sxx"]
    rss = s["syy"] - slope * s["sxy"]
    df = s["n"] - s["k"] - 1
    total = s["yy"] - s["y"] ** 2 / s["n"]
    error = math.sqrt(rss / df / s["sxx"])
    return {"slope": slope, "se": error, "p": 2 * t_sf(abs(slope / error), df) if error else 0.0, "adj_r2": 1 - (rss / df) / (total / (s["n"] - 1)), "df": df}


def enrichment_log2(rows: DataFrame, spike: str, base: str, by: list[str]) -> DataFrame:
    """log2 of (spike / base) in IP over that in Input; rows have ``condition`` and both counts."""
    v = lambda c, x: F.sum(F.when(F.col("condition") == c, F.col(x)))
    s = rows.groupBy(*by).agg(v("IP", spike).alias("sp"), v("IP", base).alias("bp"), v("Input", spike).alias("si"), v("Input", base).alias("bi"))
    x = ratio(ratio(F.col("sp"), F.col("bp")), ratio(F.col("si"), F.col("bi")))
    return s.select(*by, F.when(x > 0, F.log2(x)).alias("enrichment"))


def detection_offset(rows: DataFrame, by: list[str], efficiency_in: float, efficiency_ip: float) -> DataFrame:
    """Mean over replicates of log2[(gp/b + fp)/(gi/e + fi)] - log2[(gp + fp)/(gi + fi)]."""
    a = (F.col("gp") / efficiency_ip + F.col("fp")) / (F.col("gi") / efficiency_in + F.col("fi"))
    b = (F.col("gp") + F.col("fp")) / (F.col("gi") + F.col("fi"))
    return rows.where("gi + fi > 0 and gp + fp > 0").groupBy(*by).agg(F.avg(F.log2(a) - F.log2(b)).alias("offset"))


def roc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Curve by descending score: ties are one step. Distinct scores are aggregated first, and ordered in stretches."""
    steps = scores.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    whole = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    cut = running(running(stretched(steps, score), score, "pos", "p", descending=True), score, "neg", "n", descending=True)
    return cut.select(score, (F.col("p") / F.lit(whole["p"])).alias("tpr"), (F.col("n") / F.lit(whole["n"])).alias("fpr"))


def auc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the curve by rank sums; ties share their middle rank."""
    steps = scores.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    ranked = running(stretched(steps, score), score, "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"), F.col("p").cast("long").alias("n_pos"), (F.col("n") - F.col("p")).cast("long").alias("n_neg"))


# ---------------------------------------------------------------- negative binomial


def _trend(mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Local linear regression of log dispersion on log mean, evaluated at every mean (tricube over 70 % of points)."""
    ok = (alpha > 1e-7) & (mean > 0)
    x, y = np.log(mean[ok]), np.log(alpha[ok])
    if len(x) < 4:
        return np.full_like(mean, np.exp(y.mean()) if len(y) else 0.1)
    grid = np.quantile(x, np.linspace(0, 1, min(60, len(x))))
    span = max(4, int(0.7 * len(x)))
    fit = []
    for g in grid:
        d = np.abs(x - g)
        h = max(np.partition(d, span - 1)[span - 1], 1e-9)
        w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3
        mx = (w * x).sum() / w.sum()
        my = (w * y).sum() / w.sum()
        sxx = (w * (x - mx) ** 2).sum()
        fit.append(my + ((w * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-12 else 0.0) * (g - mx))
    return np.exp(np.interp(np.log(np.maximum(mean, 1e-300)), grid, fit))


def _fit_beta(y, x, sf, alpha, rounds: int = 50):
    """IRLS of negative-binomial models with a light ridge, a row of ``y`` each: coefficients (natural log), covariances, means."""
    mu = np.maximum(y, 0.1)
    beta = np.linalg.lstsq(x, np.log(mu / sf).T, rcond=None)[0].T
    ridge = 1e-6 * np.eye(x.shape[1])
    mean = lambda b: np.maximum(sf * np.exp(np.clip(b @ x.T, -30, 30)), 1e-6)
    live = np.arange(len(y))
    for _ in range(rounds):
        m = mean(beta[live])
        w = m / (1 + alpha[live, None] * m)
        z = np.log(m / sf) + (y[live] - m) / m
        new = np.linalg.solve(np.einsum("ij,bi,ik->bjk", x, w, x) + ridge, ((w * z) @ x)[..., None])[..., 0]
        moving = np.abs(new - beta[live]).max(1) >= 1e-8
        beta[live] = new
        live = live[moving]
        if not len(live):
            break
    mu = mean(beta)
    w = mu / (1 + alpha[:, None] * mu)
    return beta, np.linalg.inv(np.einsum("ij,bi,ik->bjk", x, w, x) + ridge), mu


def _gamma_step(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """ln gamma(r + v) - ln gamma(r) without the loss of digits of a difference of large numbers."""
    z = r + 8
    tail = lambda q: 1 / (12 * q) - 1 / (360 * q**3) + 1 / (1260 * q**5)
    out = (z - 0.5) * np.log1p(v / z) + v * np.log(z + v) - v + tail(z + v) - tail(z)
    for k in range(8):
        out = out - np.log1p(v / (r + k))
    return out


def _profile(y, mu, x, log_alpha) -> np.ndarray:
    """Cox-Reid adjusted log-likelihood of each row's dispersion, but for terms without it."""
    a = np.exp(log_alpha)[:, None]
    r = 1 / a
    ll = (_gamma_step(r, y) - r * np.log1p(mu * a) + y * np.log(mu / (r + mu))).sum(1)
    w = mu / (1 + a * mu)
    return ll - 0.5 * np.linalg.slogdet(np.einsum("ij,bi,ik->bjk", x, w, x) + 1e-12 * np.eye(x.shape[1]))[1]


def _best_dispersion(y, mu, x, prior=None) -> np.ndarray:
    """Greatest (penalised) profile of each row over a grid of log dispersions, refined by golden section."""
    def value(v):
        return _profile(y, mu, x, v) - (0 if prior is None else (v - prior[0]) ** 2 / (2 * prior[1]))

    n = len(y)
    grid = np.linspace(math.log(1e-8), math.log(max(10.0, y.shape[1])), 25)
    best = np.stack([value(np.full(n, v)) for v in grid]).argmax(0)
    lo, hi = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = value(a), value(b)
    for _ in range(18):
        up = fa < fb
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
        a, b = np.where(up, b, hi - g * (hi - lo)), np.where(up, lo + g * (hi - lo), a)
        f = value(np.where(up, b, a))
        fa, fb = np.where(up, fb, f), np.where(up, f, fa)
    return np.exp((lo + hi) / 2)


def _lowess(x: np.ndarray, y: np.ndarray, share: float = 0.2, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear fit at every x, with bisquare weights against outliers."""
    k, robust, fit = max(2, int(share * len(x) + 1e-7)), np.ones(len(x)), np.zeros(len(x))
    for turn in range(rounds + 1):
        for i, at in enumerate(x):
            d = np.abs(x - at)
            h = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = robust * np.where(d < 0.999 * h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            sxx = (w * (x - mx) ** 2).sum()
            fit[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (at - mx) if sxx > 1e-12 else 0.0)
        left = np.abs(y - fit)
        scale = 6 * np.median(left)
        if turn == rounds or scale < 1e-7 * left.mean() or scale == 0:
            break
        robust = np.where(left < 0.999 * scale, (1 - np.minimum(left / scale, 1) ** 2) ** 2, 0)
    return fit


def filter_threshold(mean: np.ndarray, p: np.ndarray, zeros: int = 0, alpha: float = 0.1) -> float:
    """Independent filtering: the least mean of a feature that is adjusted, from the rejections at 50 quantiles of the means.

    ``zeros`` are features without any count; p may be NaN.
    """
    if not len(mean):
        return 0.0
    every = np.concatenate([np.zeros(zeros), mean])
    low = zeros / len(every)
    theta = np.linspace(low, 0.95 if low < 0.95 else 1.0, 50)
    cuts = np.quantile(every, theta)

    turn = np.argsort(p, kind="stable")[: int((~np.isnan(p)).sum())]
    p, at = p[turn], mean[turn]  # sorted once for all cuts

    def rejected(cut):
        own = p[at >= cut]
        below = np.flatnonzero(own * len(own) / np.arange(1, len(own) + 1) < alpha)
        return below[-1] + 1.0 if len(below) else 0.0

    number = np.array([rejected(c) for c in cuts])
    if number.max() <= 10:
        return float(cuts[0])
    fit = _lowess(theta, number)
    spread = np.sqrt(np.mean((number - fit)[number > 0] ** 2))
    for least in (fit.max() - spread, 0.9 * fit.max(), 0.8 * fit.max()):
        if (number > least).any():
            return float(cuts[np.flatnonzero(number > least)[0]])
    return float(cuts[0])


def _robust_dispersion(q: np.ndarray, cells: list[np.ndarray]) -> float:
    """Method of moments from the largest trimmed variance of a cell of three or more libraries; 0.04 or more."""
    def trimmed(v, share):
        cut = int(len(v) * share)
        return float(np.sort(v)[cut : len(v) - cut].mean())

    variance = 0.0
    for at in cells:
        share, scale = (1 / 3, 2.04) if len(at) <= 3 else (1 / 4, 1.86) if len(at) <= 23 else (1 / 8, 1.51)
        variance = max(variance, scale * trimmed((q[at] - trimmed(q[at], share)) ** 2, share))
    return max((variance - q.mean()) / q.mean() ** 2, 0.04)


class _Design:
    """Libraries of two conditions: the model ``~ replicate + condition``, its cells of equal rows, and limits of Cook's distance."""

    #: Cells of so many libraries can judge one of theirs, and can lend it a replacement.
    JUDGE, REPLACE = 3, 7

    def __init__(self, rows, test: str, base: str):
        from tagtally.functions.tails import f_sf

        rows = rows[rows["condition"].isin([test, base])].sort_values("sample")
        reps = sorted(rows["replicate"].astype(str).unique())
        self.x = np.column_stack([np.ones(len(rows)), *[(rows["replicate"].astype(str) == r).to_numpy(float) for r in reps[1:]], (rows["condition"] == test).to_numpy(float)])
        self.factors = rows["size_factor"].to_numpy(float)
        self.at = {s: i for i, s in enumerate(rows["sample"])}
        m, p = self.x.shape
        cells = [np.flatnonzero((self.x == row).all(1)) for row in np.unique(self.x, axis=0)] if m else []
        self.cells = [c for c in cells if len(c) >= self.JUDGE and m > p]  # the others have no Cook's distance to judge
        self.large = np.zeros(m, bool)
        for c in self.cells:
            self.large[c] = len(c) >= self.REPLACE
        lo, self.far = 0.0, 1e9
        for _ in range(100 if self.cells else 0):
            mid = (lo + self.far) / 2
            lo, self.far = (lo, mid) if f_sf(mid, p, m - p) < 0.01 else (mid, self.far)

    def dense(self, lists) -> np.ndarray:
        """Counts by library from flat lists: a library's number before each count."""
        y = np.zeros((len(lists), len(self.at)))
        flat = np.concatenate([np.zeros(0), *lists]).reshape(-1, 2)
        k, row = self.place[flat[:, 0].astype(np.int64)], np.repeat(np.arange(len(lists)), [len(v) // 2 for v in lists])
        y[row[k >= 0], k[k >= 0]] = flat[k >= 0, 1]
        return np.round(y)

    def cook(self, y, mu, alpha, cov) -> np.ndarray:
        """Cook's distances of a feature's libraries; 0 in cells too small to judge."""
        out = np.zeros(len(y))
        if self.cells:
            h = mu / (1 + alpha * mu) * np.einsum("ij,jk,ik->i", self.x, cov, self.x)
            distance = (y - mu) ** 2 / (mu + _robust_dispersion(y / self.factors, self.cells) * mu**2) / self.x.shape[1] * h / (1 - h) ** 2
            for c in self.cells:
                out[c] = distance[c]
        return out

    def rough(self, y) -> tuple[np.ndarray, np.ndarray]:
        """Means of normalised counts, and each row's own dispersion."""
        mean = (y / self.factors).mean(1)
        rough = np.maximum(1e-4, ((y / self.factors).var(1, ddof=1) - mean * (1 / self.factors).mean()) / mean**2)
        return mean, _best_dispersion(y, _fit_beta(y, self.x, self.factors, rough)[2], self.x)

    def fitted(self, y, mean, alpha, trend: dict):
        """Dispersions towards the trend, coefficients, their covariances and means."""
        t = np.interp(np.log(mean), trend["knots"], trend["values"])
        mu = _fit_beta(y, self.x, self.factors, alpha)[2]
        shrunk = _best_dispersion(y, mu, self.x, (t, trend["prior"]))
        final = np.where(np.log(np.maximum(alpha, 1e-8)) > t + 2 * math.sqrt(trend["spread"]), alpha, shrunk)
        return (final, *_fit_beta(y, self.x, self.factors, final))

    def replaced(self, y, distances) -> np.ndarray:
        """Counts with outlying ones of large cells at the trimmed mean of the feature's normalised counts, a fifth off each end."""
        out = y.copy()
        q = np.sort(y / self.factors, 1)
        cut = int(0.2 * q.shape[1])
        middle = q[:, cut : q.shape[1] - cut].mean(1)
        rows, at = np.nonzero((distances > self.far) & self.large)
        out[rows, at] = np.floor(middle[rows] * self.factors[at])
        return out


def _dispersion_trend(mean: np.ndarray, alpha: np.ndarray, free: int) -> dict:
    """Trend of log dispersions by log means at up to 200 knots, the spread around it, and the prior's variance."""
    from tagtally.functions.tails import trigamma

    keep = np.sort(np.unique(np.quantile(mean, np.linspace(0, 1, 200)))) if len(mean) else np.array([1.0])
    fit = _trend_at(mean, alpha, keep) if len(mean) else np.ones(1)
    line = np.interp(mean, keep, fit) if len(mean) else mean
    left = np.log(np.maximum(alpha, 1e-8)) - np.log(line)
    spread = float((1.4826 * np.median(np.abs(left - np.median(left)))) ** 2) if len(left) else 1.0
    prior = max(spread - float(trigamma(np.array(max(1, free) / 2.0))), 0.25)
    values = np.log(fit)
    return {"knots": np.log(keep), "values": values, "spread": spread, "prior": prior}


def nb_contrasts(counts: DataFrame, factors: DataFrame, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """Negative-binomial models ``~ replicate + condition`` by feature, one for each named pair (test, base) of conditions.

    ``contrast, feature, baseMean, dispersion, log2FoldChange, lfcSE, stat, pvalue, padj, outliers``. ``counts`` are
    ``feature, sample, replicate, condition, count``; ``factors`` ``sample, size_factor``. Each pair is fitted to its own
    libraries, and all pairs of a feature in the same passes: its counts are gathered once. The dispersion trend of a pair
    and its prior need one number pair of each feature on the driver: their number is that of the features.

    Counts whose Cook's distance is beyond the 99 % quantile of F are replaced where their cell (equal rows of the design) has
    seven or more libraries, and the feature is fitted again; ``outliers`` counts them. In cells of three to six
    libraries they make ``pvalue`` NULL instead; ``padj`` is NULL there and below the threshold of independent filtering.
    """
    import pandas as pd

    from tagtally.functions.tails import normal_sf
    from tagtally.operators.counts import benjamini_hochberg
    from tagtally.session import shared_folder

    shared_folder(counts.sparkSession)
    used = sorted({c for pair in contrasts.values() for c in pair})
    libraries = counts.where(F.col("condition").isin(used)).select("sample", "replicate", "condition").distinct().join(factors, "sample").toPandas()
    designs = {name: _Design(libraries, *pair) for name, pair in contrasts.items()}
    samples = sorted(set(libraries["sample"]))
    for d in designs.values():
        d.place = np.array([d.at.get(x, -1) for x in samples] or [-1])
    rows = counts.where(F.col("condition").isin(used)).groupBy("feature", "sample").agg(F.sum("count").alias("count"))
    known = counts.sparkSession.createDataFrame([(str(x), float(i)) for i, x in enumerate(samples)], "__sample string, __number double")
    rows = rows.join(F.broadcast(known), F.col("sample").cast("string") == F.col("__sample"))  # a row for each library
    pair = F.array("__number", F.col("count").cast("double"))
    vectors = rows.groupBy("feature").agg(F.flatten(F.sort_array(F.collect_list(pair))).alias("v")).checkpoint()
    # Features with equal counts have equal fits, so each list of counts is fitted once and stands for ``many``.
    lists = vectors.groupBy("v").agg(F.count("*").alias("many")).withColumn("list", F.monotonically_increasing_id()).checkpoint()

    def first(batches):
        for pdf in batches:
            for name, d in designs.items():
                y = d.dense(pdf["v"])
                some = y.sum(1) > 0
                if some.any():
                    mean, alpha = d.rough(y[some])
                    yield pd.DataFrame({"contrast": name, "list": pdf["list"][some], "many": pdf["many"][some], "mean": mean, "alpha": alpha})

    genewise = lists.mapInPandas(first, "contrast string, list long, many long, mean double, alpha double").checkpoint()
    trends = {}
    for name, d in designs.items():
        table = genewise.where(F.col("contrast") == name).select("mean", "alpha", "many").toArrow().to_pandas()
        table = table.loc[table.index.repeat(table["many"])]
        trends[name] = _dispersion_trend(table["mean"].to_numpy(float), table["alpha"].to_numpy(float), d.x.shape[0] - d.x.shape[1])

    def second(batches):
        for pdf in batches:
            for name, own in pdf.groupby("contrast"):
                d, trend = designs[name], trends[name]
                y, mean, alpha = d.dense(own["v"]), own["mean"].to_numpy(float), own["alpha"].to_numpy(float)
                final, beta, cov, mu = d.fitted(y, mean, alpha, trend)
                distances = np.array([d.cook(*row) for row in zip(y, mu, final, cov)]).reshape(y.shape)
                far = distances > d.far
                outliers = (far & d.large).sum(1)
                again = np.flatnonzero(outliers)
                if len(again):
                    z = d.replaced(y[again], distances[again])
                    live = z.sum(1) > 0
                    again, z = again[live], z[live]
                if len(again):
                    m, a = d.rough(z)
                    final[again], beta[again], cov[again], _ = d.fitted(z, m, a, trend)
                    mean = mean.copy()
                    mean[again] = m
                se = np.sqrt(cov[:, -1, -1])
                stat = beta[:, -1] / se
                chance = np.where((far & ~d.large).any(1), np.nan, 2 * normal_sf(np.abs(stat)))
                yield pd.DataFrame({"contrast": name, "list": own["list"], "many": own["many"], "baseMean": mean, "dispersion": final, "log2FoldChange": beta[:, -1] / math.log(2), "lfcSE": se / math.log(2), "stat": stat, "pvalue": chance, "outliers": outliers})

    schema = "contrast string, list long, many long, baseMean double, dispersion double, log2FoldChange double, lfcSE double, stat double, pvalue double, outliers int"
    fitted = lists.drop("many").join(genewise, "list").mapInPandas(second, schema).checkpoint()
    every = counts.select("feature").distinct().count()
    least = F.lit(None).cast("double")
    for name in designs:  # a number pair of each feature, as above
        tested = fitted.where(F.col("contrast") == name).select("baseMean", "pvalue", "many").toArrow().to_pandas()
        tested = tested.loc[tested.index.repeat(tested["many"])]
        cut = filter_threshold(tested["baseMean"].to_numpy(float), tested["pvalue"].to_numpy(float), every - len(tested))
        least = F.when(F.col("contrast") == name, F.lit(cut)).otherwise(least)
    own = vectors.join(lists.select("v", "list"), "v").select("feature", "list")
    fitted = own.join(fitted, "list").select("contrast", "feature", *[c for c in fitted.columns if c not in ("contrast", "list", "many")]).checkpoint()
    fitted = fitted.withColumn("pvalue", F.when(~F.isnan("pvalue"), F.col("pvalue")))
    return benjamini_hochberg(fitted.withColumn("__p", F.when(F.col("baseMean") >= least, F.col("pvalue"))), "__p", "padj", "contrast").drop("__p")


def nb_wald(counts: DataFrame, factors: DataFrame, test: str = "IP", base: str = "Input") -> DataFrame:
    """``nb_contrasts`` for one pair of conditions."""
    return nb_contrasts(counts, factors, {"": (test, base)}).drop("contrast")


def _trend_at(mean: np.ndarray, alpha: np.ndarray, at: np.ndarray) -> np.ndarray:
    full = _trend(mean, alpha)
    order = np.argsort(mean)
    return np.interp(at, mean[order], full[order])


def variance_stabilised(counts: DataFrame, factors: DataFrame, alpha: float) -> DataFrame:
    """Closed form of the variance-stabilising transform for one dispersion, in log2."""
    x = F.col("count") / F.col("size_factor")
    value = (2 * F.asinh(F.sqrt(F.lit(alpha) * x)) - F.lit(math.log(alpha)) - F.lit(math.log(4.0))) / F.lit(math.log(2.0))
    return counts.join(factors, "sample").withColumn("value", value)
