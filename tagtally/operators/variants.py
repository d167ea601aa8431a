"""Per-position pileups: projection, paired differences, hits, base conversion, spikes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtally.operators.counts import ratio

BASES = ["A", "C", "G", "T"]
#: Fields of a packed pileup, in order: a fixed value of the format.
PACKED = ["depth", "A", "C", "G", "T", "N", "Skip", "Gap", "Insert", "Delete"]


def unpack(rows: DataFrame, packed: str = "packed") -> DataFrame:
    """Columns of the packed comma list; missing or unreadable fields are 0."""
    parts = F.split(F.col(packed), ",")
    return rows.select(*[c for c in rows.columns if c != packed], *[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(PACKED)])


def project(rows: DataFrame, depth: str = "depth", ref: str = "ref_base") -> DataFrame:
    """SGID, REF, the mismatches by base, their sums, and the rest of the depth."""
    sgid = F.col("Skip") + F.col("Gap") + F.col("Insert") + F.col("Delete")
    is_ref = {b: F.coalesce(F.upper(F.col(ref)) == b, F.lit(False)) for b in BASES}
    reference = F.lit(0)
    for b in BASES:
        reference = F.when(is_ref[b], F.col(b)).otherwise(reference)
    rows = rows.withColumn("SGID", sgid).withColumn("REF", reference)
    for b in BASES:
        rows = rows.withColumn(f"{b}_star", F.when(is_ref[b], 0).otherwise(F.col(b)))
    rows = rows.withColumn("mismatches", sum((F.col(f"{b}_star") for b in BASES[1:]), F.col("A_star")))
    rows = rows.withColumn("total_variant", F.col("mismatches") + F.col("SGID"))
    return rows.withColumn("nonvariant", F.greatest(F.col(depth) - F.col("total_variant"), F.lit(0)))


def site_sums(rows: DataFrame, k: str, n: str) -> DataFrame:
    """K and N of each site, pair and condition."""
    return rows.groupBy("site", "pair", "condition").agg(F.coalesce(F.sum(k), F.lit(0)).alias("K"), F.coalesce(F.sum(n), F.lit(0)).alias("N"))


def paired(sums: DataFrame, least: int = 20) -> DataFrame:
    """Both conditions of a pair side by side, missing as 0; pairs below the depth go, K never exceeds N."""
    pick = lambda c, x: F.coalesce(F.sum(F.when(F.col("condition") == c, F.col(x))), F.lit(0))
    rows = sums.groupBy("site", "pair").agg(*[pick(c, x).alias(f"{x}_{c}") for c in ("IP", "Input") for x in ("K", "N")])
    rows = rows.where((F.col("N_IP") >= least) & (F.col("N_Input") >= least))
    for c in ("IP", "Input"):
        rows = rows.withColumn(f"K_{c}", F.least(F.col(f"K_{c}"), F.col(f"N_{c}")))
    return rows


def elogit(k: Column, n: Column) -> Column:
    return F.ln((k + 0.5) / (n - k + 0.5))


def binomial_weight(k: Column, n: Column) -> Column:
    p = (k + 0.5) / (n + 1.0)
    return F.greatest(n * p * (1 - p), F.lit(1e-6))


def paired_logits(pairs: DataFrame) -> DataFrame:
    """``delta`` (IP minus Input) and ``w``, the mean of both weights; only finite differences with weight."""
    rows = pairs.withColumn("delta", elogit(F.col("K_IP"), F.col("N_IP")) - elogit(F.col("K_Input"), F.col("N_Input")))
    rows = rows.withColumn("w", (binomial_weight(F.col("K_IP"), F.col("N_IP")) + binomial_weight(F.col("K_Input"), F.col("N_Input"))) / 2)
    return rows.where(F.col("delta").isNotNull() & ~F.isnan("delta") & (F.abs("delta") < float("inf")) & (F.col("w") > 0))


def weighted_fit(logits: DataFrame, least: int = 4, pairs_in_all: int | None = None) -> DataFrame:
    """Of each site with enough pairs the weighted mean difference, its variance and what an adjustment needs.

    ``amean`` is the plain mean over ``pairs_in_all`` cells, missing ones as 0 (over the site's own if not given).
    """
    sums = logits.groupBy("site").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("delta")).alias("swd"), F.sum(F.col("w") * F.col("delta") * F.col("delta")).alias("swdd"), F.sum("delta").alias("sd"))
    rows = sums.where(F.col("n") >= least).withColumn("beta", F.col("swd") / F.col("sw"))
    # Equal differences have no variance: what rounding leaves of it turns on the order of the sums, and its logarithm would move the trend of all sites.
    left = F.col("swdd") - F.col("sw") * F.col("beta") * F.col("beta")
    rows = rows.withColumn("s2", F.when(left > 1e-12 * F.col("swdd"), ratio(left, F.col("n") - 1)).otherwise(0.0))
    return rows.withColumn("amean", F.col("sd") / (F.lit(pairs_in_all) if pairs_in_all else F.col("n"))).select("site", "n", "sw", "beta", "s2", "amean")


def order_statistics(rows: DataFrame, column: str, ranks: list[int], bins: int = 1024) -> list[float]:
    """Values of given ranks (from 0) of a column without nulls, by counts in bins that narrow around each; the driver sees counts."""
    n, least, most = rows.agg(F.count("*"), F.min(column), F.max(column)).first()
    found, live = {}, {k: (0, n, least, most) for k in set(ranks)}
    while live:
        for k, (below, inside, lo, hi) in list(live.items()):
            if lo == hi or k in (below, below + inside - 1):
                found[k] = lo if k == below else hi
                del live[k]
        if not live:
            break
        x = F.col(column)
        bin_of = lambda lo, hi: F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        each = F.array(*[F.when(x.between(lo, hi), F.struct(F.lit(k).alias("k"), bin_of(lo, hi).alias("bin"))) for k, (_, _, lo, hi) in live.items()])
        parts = rows.select(x, F.explode(each).alias("at")).where("at is not null").groupBy("at.k", "at.bin").agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        counted = sorted(parts.collect(), key=lambda r: r["bin"])
        for k, (below, *_) in list(live.items()):
            for r in (r for r in counted if r["k"] == k):
                if k < below + r["c"]:
                    live[k] = (below, r["c"], r["lo"], r["hi"])
                    break
                below += r["c"]
    return [float(found[k]) for k in ranks]


def moderated(fit: DataFrame) -> DataFrame:
    """Moderated t of each site: variances shrink to a trend over ``amean`` (empirical Bayes), BH over all sites.

    The trend, its prior and the degrees of freedom are fitted over all sites: Spark sums the products that the few
    spline coefficients need, and the knots are exact quantiles; the driver sees sums and counts.
    """
    import numpy as np

    from tagtally.functions.tail_columns import t_two_sided
    from tagtally.functions.tails import digamma, trigamma, trigamma_inverse
    from tagtally.operators.counts import benjamini_hochberg

    fit = fit.persist()  # the sums over all pairs are made once
    usable = fit.where("s2 > 0").select("s2", "n", "amean")
    tally = usable.groupBy("n").count().orderBy("n").collect()  # a row for each number of pairs
    many = sum(r["count"] for r in tally)
    rows = fit
    if many < 3:
        rows = rows.withColumn("s2_post", F.col("s2")).withColumn("df", (F.col("n") - 1).cast("double"))
    else:
        d, times = np.array([r["n"] - 1.0 for r in tally]), np.array([float(r["count"]) for r in tally])
        size = 1 + (many >= 3) + (many >= 6) + (many >= 30)
        places = np.linspace(0, 1, size + 1) * (many - 1)
        whole = np.floor(places).astype(int).tolist()
        value = dict(zip(near := sorted({*whole, *[min(w + 1, many - 1) for w in whole]}), order_statistics(usable, "amean", near)))
        knots = np.unique([value[w] + (q - w) * (value[min(w + 1, many - 1)] - value[w]) for w, q in zip(whole, places)])
        _, at = spline_basis(knots, knots)
        shift_of = F.create_map(*[F.lit(v) for r, g in zip(tally, np.log(d / 2) - digamma(d / 2)) for v in (r["n"], float(g))])
        terms = usable.select((F.ln("s2") + shift_of[F.col("n")]).alias("e"), F.lit(1.0).alias("x0"), *[c.alias(f"x{i + 1}") for i, c in enumerate(at(F.col("amean")))])
        names = [c for c in terms.columns if c != "e"]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = terms.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[F.sum(F.col(c) * F.col("e")) for c in names]).first()
        square = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, sums):
            square[i, j] = square[j, i] = v
        scale = 1 / np.sqrt(np.maximum(np.diag(square), 1e-300))
        coef = scale * np.linalg.lstsq(square * scale * scale[:, None], np.array(sums[len(pairs) :]) * scale, rcond=1e-13)[0]
        left = F.col("e") - sum((float(c) * F.col(x) for c, x in zip(coef, names)), F.lit(0.0))
        rest = terms.agg(F.sum(left * left)).first()[0]
        v = float(rest / max(1, many - len(names)) - (trigamma(d / 2) * times).sum() / many)
        d0 = 2 * trigamma_inverse(v) if v > 0 else float("inf")
        shift = float(digamma(np.array(d0 / 2)) - np.log(d0 / 2)) if v > 0 else 0.0
        trend = F.lit(float(coef[0]))
        for c, term in zip(coef[1:], at(F.col("amean"))):
            trend = trend + float(c) * term
        prior = F.exp(trend + shift)
        if v > 0:
            rows = rows.withColumn("s2_post", (F.lit(d0) * prior + (F.col("n") - 1) * F.col("s2")) / (F.lit(d0) + F.col("n") - 1))
            rows = rows.withColumn("df", F.least(F.col("n") - 1 + F.lit(d0), F.lit(float((d * times).sum()))))
        else:
            rows = rows.withColumn("s2_post", prior).withColumn("df", F.lit(float((d * times).sum())))
    rows = rows.withColumn("t", ratio(F.col("beta") * F.sqrt("sw"), F.sqrt("s2_post")))
    adjusted = benjamini_hochberg(rows.withColumn("p", t_two_sided(F.col("t"), F.col("df"))), "p", "padj")
    fit.unpersist()  # the adjustment has written its rows
    return adjusted


def spline_basis(x, knots):
    """Natural cubic basis (constant first) at x, and the same terms as expressions of a column."""
    import numpy as np

    inner, (lo, hi) = knots[1:-1], (knots[0], knots[-1]) if len(knots) > 1 else (knots[0], knots[0] + 1)
    cube = lambda u: np.maximum(u, 0) ** 3
    piece = lambda u, k: (cube(u - k) - cube(u - hi)) / (hi - k)
    columns = [np.ones_like(x), x] + [piece(x, k) - piece(x, lo) for k in inner]
    c_cube = lambda u: F.pow(F.greatest(u, F.lit(0.0)), 3)
    c_piece = lambda u, k: (c_cube(u - float(k)) - c_cube(u - float(hi))) / float(hi - k)
    return np.column_stack(columns), lambda u: [u, *[c_piece(u, k) - c_piece(u, lo) for k in inner]]


def hits(rows: DataFrame, effect: str, padj: str, least: float, alpha: float = 0.05) -> DataFrame:
    """Rows over the effect and below the error rate, both strictly."""
    return rows.where(F.col(padj).isNotNull() & (F.col(effect) > least) & (F.col(padj) < alpha))


def nonhits(sites: DataFrame, hit: DataFrame, key: str = "site") -> DataFrame:
    return sites.join(hit.select(key), key, "left_anti")


def conversion(rows: DataFrame, observed: list[str], by: list[str]) -> DataFrame:
    """Fractions of what is observed, by ``by`` and condition, and IP minus Input: ``observed, fraction_IP, fraction_Input, delta``."""
    sums = rows.groupBy(*by, "condition").agg(*[F.sum(c).alias(c) for c in observed])
    total = sum((F.col(c) for c in observed[1:]), F.col(observed[0]))
    for c in observed:
        sums = sums.withColumn(f"f_{c}", ratio(F.col(c).cast("double"), total))
    long = sums.select(*by, "condition", *[F.col(f"f_{c}").alias(c) for c in observed]).unpivot([*by, "condition"], observed, "observed", "fraction")
    wide = long.groupBy(*by, "observed").pivot("condition", ["IP", "Input"]).agg(F.first("fraction"))
    return wide.select(*by, "observed", F.col("IP").alias("fraction_IP"), F.col("Input").alias("fraction_Input"), (F.col("IP") - F.col("Input")).alias("delta"))


def first_rows(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group by a total order."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__at = 1").drop("__at")


def mode_of(rows: DataFrame, by: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value of each group, ties to the smaller value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("__k")).alias("k"), F.col(value).alias("v"))).alias("x")).select(*by, F.col("x.v").alias(out), (-F.col("x.k")).alias(f"{out}_n"))


def spikes(rows: DataFrame, by: list[str], score: str, base: str) -> DataFrame:
    """By group: mean score, most frequent upper-case base, number of rows."""
    rows = rows.withColumn("__b", F.upper(F.col(base)))
    return rows.groupBy(*by).agg(F.avg(score).alias("score"), F.count("*").alias("n")).join(mode_of(rows, by, "__b", "ref_base"), by, "left")


def normalised_coverage(rows: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """Depth over its mean in the group."""
    return rows.withColumn("cov_norm", ratio(F.col(depth), F.avg(depth).over(Window.partitionBy(*by))))


def five_retention(rows: DataFrame, by: list[str], first: int = 5, present: bool = False) -> DataFrame:
    """Mean normalised coverage of the first positions: by position number, or of the first present ones (then all are needed)."""
    rows = normalised_coverage(rows, by)
    if not present:
        return rows.groupBy(*by).agg(F.avg(F.when(F.col("pos") <= first, F.col("cov_norm"))).alias("five_retention"))
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("__at") <= first)
    return rows.groupBy(*by).agg(F.avg("cov_norm").alias("five_retention"), F.count("*").alias("n")).where(F.col("n") >= first).drop("n")


#: Reference positions of a tile.
TILE = 1 << 12

_STEP = {"M": 0, "=": 0, "X": 0, "I": 1, "D": 2, "N": 3, "S": 4, "H": 5, "P": 5}
_AT = {b: PACKED.index(n) - 1 for b, n in (*zip("ACGT", "ACGT"), ("N", "N"), ("skip", "Skip"), ("gap", "Gap"), ("insert", "Insert"), ("delete", "Delete"))}


def _events(batch, least_quality: int):
    """What a batch of reads in tiles shows: row, position and kind (a place in ``PACKED`` after the depth) of each event within the row's tile."""
    import re

    import numpy as np

    bases = np.full(256, _AT["N"], np.int64)
    for b in BASES:
        bases[[ord(b), ord(b.lower())]] = _AT[b]
    coded = batch["cigar"].dictionary_encode()
    walks = []
    for text in coded.dictionary.to_pylist():
        at = i = 0
        walk = []
        for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text):
            n, step = int(n), _STEP[o]
            if step < 4:
                walk.append((step, at, i, n))
            at += n if step in (0, 2, 3) else 0
            i += n if step in (0, 1, 4) else 0
        walks.append(walk)
    counts = np.array([len(w) for w in walks] or [0])
    flat = np.array([x for w in walks for x in w], np.int64).reshape(-1, 4)
    first = np.cumsum(counts) - counts
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(which)), counts[which])
    own = np.arange(len(row)) - np.repeat(np.cumsum(counts[which]) - counts[which], counts[which]) + np.repeat(first[which], counts[which])
    step, at, i, n = flat[own].T
    low = batch["tile"].to_numpy().astype(np.int64) * TILE
    at = at + batch["pos"].to_numpy().astype(np.int64)[row]

    def letters(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets

    # Steps along the reference, cut to the tile, position by position.
    along = step != 1
    skipped = np.where(along, np.maximum(low[row] - at, 0), 0)
    size = np.where(along, np.minimum(at + n, low[row] + TILE) - at - skipped, 0).clip(0)
    k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(skipped, size)
    e = np.repeat(np.arange(len(row)), size)
    e_row, e_pos, e_step, base = row[e], at[e] + k, step[e], i[e] + k
    kind = np.select([e_step == 2, e_step == 3], [_AT["gap"], _AT["skip"]], -1)
    seq, s_at = letters(batch["seq"])
    qual, q_at = letters(batch["qual"])
    read = np.flatnonzero((e_step == 0) & (base < (s_at[1:] - s_at[:-1])[e_row]))
    r = e_row[read]
    # No quality at all counts; letters beyond its end do not.
    length = (q_at[1:] - q_at[:-1])[r]
    bare = (length == 0) | ((length == 1) & (qual[np.minimum(q_at[r], max(len(qual) - 1, 0))] == 42 if len(qual) else True))
    inside = base[read] < length
    good = bare.copy()
    ok = np.flatnonzero(inside & ~bare)
    good[ok] = qual[q_at[r[ok]] + base[read[ok]]].astype(np.int64) - 33 >= least_quality
    read, r = read[good], r[good]
    kind[read] = bases[seq[s_at[r] + base[read]]]
    seen = kind >= 0
    # Insertions at the base before them, deletions at their first position: once each, where the tile holds it.
    once = np.flatnonzero((step == 1) | (step == 2))
    o_pos = np.where(step[once] == 1, at[once] - 1, at[once])
    here = (o_pos >= low[row[once]]) & (o_pos < low[row[once]] + TILE)
    once, o_pos = once[here], o_pos[here]
    o_kind = np.where(step[once] == 1, _AT["insert"], _AT["delete"])
    return np.concatenate([e_row[seen], row[once]]), np.concatenate([e_pos[seen], o_pos]), np.concatenate([kind[seen], o_kind])


def _tile_counts(batches, least_quality: int, max_depth: int):
    """Counts of each position; reads come by tile, and within it by ``ord`` where a depth is given."""
    import numpy as np
    import pyarrow as pa

    width = len(PACKED) - 1
    last, held, reads, latest = None, None, None, None  # the tile that may go on in the next batch: counts, reads seen, last read seen

    def rows(chrs, pos, counts):
        depth = counts[:, :5].sum(1) + counts[:, _AT["gap"]]
        return pa.RecordBatch.from_arrays([pa.array(chrs, pa.string()), pa.array(pos.astype(np.int32)), pa.array(depth), *[pa.array(counts[:, k]) for k in range(width)]], ["chr", "pos", *PACKED])

    def rest():
        some = np.flatnonzero(held.any(1))
        return rows([last[0]] * len(some), some + last[1] * TILE, held[some])

    for batch in batches:
        if not batch.num_rows:
            continue
        chrs = batch["rname"].dictionary_encode("encode")
        names, code, tile = chrs.dictionary.to_pylist(), chrs.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch["tile"].to_numpy().astype(np.int64)
        new = np.r_[True, (code[1:] != code[:-1]) | (tile[1:] != tile[:-1])]
        group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        keys = [(names[code[b]], int(tile[b])) for b in begins.tolist()]
        goes_on = keys[0] == last
        if last is not None and not goes_on:
            yield rest()
        row, pos, kind = _events(batch, least_quality)
        cell = group[row] * TILE + pos - tile[row] * TILE
        if max_depth and len(cell):
            # The place of an event's read among those of its position, in the order of reads; one read has one place.
            order = batch["ord"].to_numpy()[row]
            turn = np.lexsort((order, cell))
            c, o = cell[turn], order[turn]
            start = np.r_[True, c[1:] != c[:-1]]
            fresh = start | np.r_[True, o[1:] != o[:-1]]
            if goes_on:
                mine = np.flatnonzero(start & (c < TILE))
                fresh[mine] = (reads[c[mine]] == 0) | (latest[c[mine]] != o[mine])
            total = np.cumsum(fresh)
            begin = np.flatnonzero(start)
            nth = total - np.repeat(total[begin] - fresh[begin], np.diff(np.r_[begin, len(c)]))
            if goes_on:
                nth = nth + np.where(c < TILE, reads[np.minimum(c, TILE - 1)], 0)
            end = np.r_[begin[1:], len(c)] - 1
            tail = end[c[end] // TILE == len(keys) - 1]
            if not (goes_on and len(keys) == 1):
                reads, latest = np.zeros(TILE, np.int64), np.zeros(TILE, np.int64)
            reads[c[tail] % TILE], latest[c[tail] % TILE] = nth[tail], o[tail]
            cell, kind = c[nth <= max_depth], kind[turn][nth <= max_depth]
        elif max_depth and not (goes_on and len(keys) == 1):
            reads, latest = np.zeros(TILE, np.int64), np.zeros(TILE, np.int64)
        # Sparse sums of the batch's cells; the last tile's wait for the next batch.
        cells, place = np.unique(cell, return_inverse=True)
        counts = np.bincount(place * width + kind, minlength=len(cells) * width).reshape(-1, width)
        at = cells // TILE
        if goes_on:
            first = at == 0
            held[cells[first]] += counts[first]
            if len(keys) == 1:
                continue
            yield rest()
            cells, counts, at = cells[~first], counts[~first], at[~first]
        whole = at < len(keys) - 1
        tiles, owner = np.array([k[1] for k in keys], np.int64), pa.array([k[0] for k in keys], pa.string())
        yield rows(owner.take(pa.array(at[whole])), cells[whole] % TILE + tiles[at[whole]] * TILE, counts[whole])
        last, held = keys[-1], np.zeros((TILE, width), np.int64)
        held[cells[~whole] % TILE] = counts[~whole]
    if last is not None:
        yield rest()


def pileup(alignments: DataFrame, least_quality: int = 10, max_depth: int = 0) -> DataFrame:
    """Packed counts ``chr, pos, depth, A, C, G, T, N, Skip, Gap, Insert, Delete`` from alignments (CIGAR walk).

    Rows ``rname, pos, cigar, seq, qual``; bases below the quality do not count. Insertions count at the base
    before them, Gap at deleted bases, Delete at the first, Skip at skipped ones. With ``max_depth`` no more reads than
    that, the first by ``ord``, count at a position; 0 is no limit.

    Reads, not bases, are shuffled: once to each tile of ``TILE`` positions that they touch. A task takes its tiles one after
    the other, so it holds the counts of one tile and what its batch shows, however many reads a tile has.
    """
    reads = alignments.where("cigar is not null and cigar not in ('', '*') and seq is not null and seq not in ('', '*') and pos is not null")
    order = [F.col("ord").cast("long").alias("ord")] if max_depth else []
    covered = F.expr(r"aggregate(regexp_extract_all(cigar, r'(\d+)[MDN=X]', 1), 0, (s, n) -> s + int(n))")
    # An insertion before the first base counts one position before it.
    tiles = F.sequence(F.floor((F.col("pos") - 1) / TILE).cast("int"), F.floor((F.col("pos") + F.greatest(covered - 1, F.lit(0))) / TILE).cast("int"))
    rows = reads.select("rname", F.col("pos").cast("int").alias("pos"), "cigar", "seq", F.coalesce("qual", F.lit("*")).alias("qual"), *order, F.explode(tiles).alias("tile"))
    rows = rows.repartition("rname", "tile").sortWithinPartitions("rname", "tile", *(["ord"] if max_depth else []))
    schema = ", ".join(["chr string", "pos int", *[f"{c} long" for c in PACKED]])
    return rows.mapInArrow(lambda batches: _tile_counts(batches, least_quality, max_depth), schema)
