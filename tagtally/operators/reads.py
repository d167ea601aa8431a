"""From alignments to molecules: filters, pruning, grouping, abundances, assignment, deduplication, rarefaction.

Candidates are rows ``qname, umi, seq, rname, as, nm`` (a read's alignments share its qname); a molecule is a pair
``(umi, seq)``. Two shuffles do the work: one on the read, one on the molecule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtally.functions.strings import umi_or_tag
from tagtally.schemas import require_columns

GROUP = ["umi", "seq"]

#: Edges of equivalence classes that the driver iterates over in numpy; beyond it iterations are DataFrame jobs.
DRIVER_EDGES = 2_000_000

#: Edges in a row of packed classes, and transcripts whose sums make a row.
PACK, STRETCH = 1_000_000, 8192
#: What such a row holds: transcripts, weights, where each class begins, and the molecules it stands for.
PACKED = {"t": np.int32, "w": np.float64, "begin": np.int64, "many": np.float64}

#: Rows of abundances that are broadcast; more are joined by the planner's choice.
BROADCAST_ROWS = 1_000_000


# ---------------------------------------------------------------- ingest and pruning


def ingest(alignments: DataFrame, min_mapq: int = 0, umi_from: str = "qname", delimiter: str = "_", umi_length: int | None = None) -> DataFrame:
    """Alignments with ``umi`` and ``skip_reason``: the first reason to drop a record, NULL if it stays."""
    require_columns(alignments, "qname", "flag", "rname", "mapq", "seq", "as", "nm")
    tag = F.col("rx") if "rx" in alignments.columns else None
    rows = alignments.withColumn("umi", umi_or_tag(F.col("qname"), tag, umi_from, delimiter, umi_length))
    reason = (
        F.when((F.col("flag").bitwiseAND(4) != 0), "unmapped")
        .when(F.col("mapq") < min_mapq, "low_mapq")
        .when(F.col("seq").isNull() | F.col("seq").isin("", "*"), "no_seq")
        .when(F.col("umi").isNull(), "no_umi")
        .when(F.col("rname").isNull() | F.col("rname").isin("", "*"), "no_rname")
        .when(F.col("as").isNull() & F.col("nm").isNull(), "no_score")
    )
    return rows.withColumn("skip_reason", reason)


def kept(ingested: DataFrame) -> DataFrame:
    return ingested.where("skip_reason is null")


def named(ingested: DataFrame) -> DataFrame:
    """Records that may stand for their molecule: those that stay, and those without a score, which only counting leaves out."""
    return ingested.where("skip_reason is null or skip_reason in ('no_score', 'no_rname')")


def skip_counts(ingested: DataFrame) -> DataFrame:
    return ingested.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def prune_delta(rows: DataFrame, mode: str = "AS", delta: int | None = None, by: str = "qname") -> DataFrame:
    """Of each read the alignments within ``delta`` of its best score (AS) or of its fewest mismatches (NM).

    Rows without the score go even if no delta is given.
    """
    score = F.col("as" if mode == "AS" else "nm")
    rows = rows.where(score.isNotNull())
    if delta is None:
        return rows
    read = Window.partitionBy(by)
    if mode == "AS":
        return rows.withColumn("__best", F.max(score).over(read)).where(score >= F.col("__best") - delta).drop("__best")
    return rows.withColumn("__best", F.min(score).over(read)).where(score <= F.col("__best") + delta).drop("__best")


def candidate_order(mode: str = "AS") -> list[Column]:
    """Order of a read's candidates: by AS a NULL NM counts first and names run backwards; by NM names run forwards."""
    if mode == "AS":
        return [F.col("as").desc_nulls_last(), F.col("nm").asc_nulls_first(), F.col("rname").desc()]
    return [F.col("nm").asc_nulls_last(), F.col("as").desc_nulls_last(), F.col("rname").asc()]


def top_candidates(rows: DataFrame, k: int, mode: str = "AS", by: str = "qname") -> DataFrame:
    """The first ``k`` candidates of each read; 0 keeps all."""
    if not k:
        return rows
    order = Window.partitionBy(by).orderBy(*candidate_order(mode))
    return rows.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= k).drop("__at")


def best_per_key(rows: DataFrame) -> DataFrame:
    """Of each molecule and transcript the best AS and, on its own, the fewest mismatches."""
    return rows.groupBy(*GROUP, "rname").agg(F.max("as").alias("as"), F.min("nm").alias("nm"))


# ---------------------------------------------------------------- abundances


def weighted(best: DataFrame, mode: str = "AS", beta: float = 0.1, gamma: float = 1.0) -> DataFrame:
    """Edges ``umi, seq, rname, as, nm, drop, w, n``: distance from the molecule's best, weight, edges of the molecule."""
    group = Window.partitionBy(*GROUP)
    if mode == "AS":
        rows = best.where("as is not null").withColumn("drop", F.max("as").over(group) - F.col("as"))
        rate = beta
    else:
        rows = best.where("nm is not null").withColumn("drop", F.col("nm") - F.min("nm").over(group))
        rate = gamma
    return rows.withColumn("w", F.exp(F.lit(-float(rate)) * F.col("drop"))).withColumn("n", F.count("*").over(group))


def classes(edges: DataFrame, name: str = "rname") -> DataFrame:
    """Ambiguous molecules with equal edges as one: ``members`` (sorted ``rname, w``) and ``n`` molecules."""
    listed = edges.where("n > 1").groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(name, "w"))).alias("members"))
    return listed.groupBy("members").agg(F.count("*").alias("n"))


def _shares(a: np.ndarray, t: np.ndarray, w: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What one iteration gives each transcript: edges ``t, w`` of classes that begin at ``begin`` and stand for ``many`` molecules."""
    if not len(t):
        return np.zeros(len(a))
    sizes = np.diff(np.append(begin, len(t)))
    x = a[t] * w
    total = np.repeat(np.add.reduceat(x, begin), sizes)
    share = np.where(total > 0, x / np.where(total > 0, total, 1), 1 / np.repeat(sizes, sizes))
    return np.bincount(t, share * np.repeat(many, sizes), len(a))


def _flat(batch) -> tuple[np.ndarray, ...]:
    """Edges of the classes packed in a batch of ``_packed``, for ``_shares``."""
    parts = {c: [np.frombuffer(x.as_buffer(), kind) for x in batch[c]] for c, kind in PACKED.items()}
    shift = np.cumsum([0, *[len(t) for t in parts["t"]]])
    begin = [b + s for b, s in zip(parts["begin"], shift)]
    t, w, begin, many = (np.concatenate(x) if x else np.zeros(0) for x in (parts["t"], parts["w"], begin, parts["many"]))
    return t.astype(np.int64), w, begin.astype(np.int64), many


def _converged(give, single: np.ndarray, usable: int, iterations: int, tol: float) -> np.ndarray:
    """Abundances after iterations of ``give`` (shares for abundances) until they move by less than ``tol`` of the molecules."""
    a = 1.0 + single
    for _ in range(iterations):
        new = single + give(a)
        moved = float(np.abs(new - a).sum())
        a = new
        if moved < (tol * usable if tol < 1 else tol):
            break
    return a


def _packed(groups: DataFrame) -> DataFrame:
    """Classes of numbered transcripts as rows of some ``PACK`` edges: ``edges`` and the arrays of ``PACKED`` as bytes.

    Iterations hand these bytes on as they are; lists would be taken apart and built up again in each.
    """
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            m = batch["members"]
            flat, offsets = m.flatten(), m.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            t, w, many = flat.field("t").to_numpy(), flat.field("w").to_numpy(), batch["n"].to_numpy().astype(float)
            lo = 0
            while lo < len(many):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PACK, "right")) - 1)
                own = slice(offsets[lo], offsets[hi])
                arrays = {"t": t[own], "w": w[own], "begin": offsets[lo:hi] - offsets[lo], "many": many[lo:hi]}
                columns = [pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED.items()]
                yield pa.RecordBatch.from_arrays([pa.array([own.stop - own.start], pa.int64()), *columns], ["edges", *PACKED])
                lo = hi

    return groups.select("n", "members").mapInArrow(pack, "edges long, " + ", ".join(f"{c} binary" for c in PACKED))


def _shares_by_job(packed: DataFrame):
    """One iteration as a job: tasks add up the shares of their classes, stretches of transcripts add up over tasks, and one number for each transcript comes back."""
    import pyarrow as pa

    sc = packed.sparkSession.sparkContext

    def total(rows: pa.Table) -> pa.Table:
        got = sum(np.frombuffer(x.as_buffer()) for x in rows["got"])
        return pa.table({"part": rows["part"][:1], "got": pa.array([got.tobytes()], pa.binary())})

    def give(a: np.ndarray) -> np.ndarray:
        held = sc.broadcast(a)

        def add(batches):
            out = np.zeros(len(held.value))
            for batch in batches:
                out += _shares(held.value, *_flat(batch))
            for part, lo in enumerate(range(0, len(out), STRETCH)):
                own = out[lo : lo + STRETCH]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "got"])

        rows = packed.mapInArrow(add, "part int, got binary").groupBy("part").applyInArrow(total, "part int, got binary").toArrow()
        held.unpersist()
        out = np.zeros(len(a))
        for part, got in zip(rows["part"].to_pylist(), rows["got"]):
            out[part * STRETCH : (part + 1) * STRETCH] = np.frombuffer(got.as_buffer())
        return out

    return give


def estimate(edges: DataFrame, iterations: int = 200, tol: float = 1e-6, driver_edges: int = DRIVER_EDGES, written: bool = False) -> DataFrame:
    """Abundances ``transcript, count`` by expectation-maximisation over the molecules of ``weighted``.

    Molecules with one transcript count as they are. Ambiguous ones compress to classes of equal edges, which give
    the same fixed point; their total size is counted first, and decides where the same iteration runs: over one batch
    on the driver, or over all batches as jobs, whose results are bounded by the number of transcripts.
    Counts sum to the number of usable molecules; without any, there are no rows. Edges that are ``written`` already (a
    checkpoint) are not persisted again.
    """
    import pyarrow as pa

    spark = edges.sparkSession
    own = not written and not edges.is_cached
    if own:
        edges = edges.persist()
    # Bounded by the number of transcripts.
    ones = F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("single")
    single = edges.groupBy("rname").agg(ones, F.sum(1.0 / F.col("n")).alias("part")).toArrow().to_pandas().sort_values("rname")
    usable = int(round(single["part"].sum())) if len(single) else 0
    if not usable:
        if own:
            edges.unpersist()
        return spark.createDataFrame([], "transcript string, count double")
    few = F.broadcast if len(single) <= BROADCAST_ROWS else (lambda rows: rows)
    names, alone = pa.array(single["rname"], pa.string()), single["single"].to_numpy(float)
    numbers = few(spark.createDataFrame(pa.table({"__r": names, "t": pa.array(range(len(names)), pa.int32())})))
    packed = _packed(classes(edges.join(numbers, F.col("rname").eqNullSafe(F.col("__r"))), "t")).persist()
    size = packed.agg(F.sum("edges")).first()[0] or 0
    if size <= driver_edges:
        held = _flat(packed.toArrow().combine_chunks())
        a = _converged(lambda a: _shares(a, *held), alone, usable, iterations, tol)
    else:
        a = _converged(_shares_by_job(packed), alone, usable, iterations, tol)
    a = a * (usable / a.sum()) if a.sum() > 0 else a
    packed.unpersist()
    if own:
        edges.unpersist()
    return few(spark.createDataFrame(pa.table({"transcript": names, "count": a})))


# ---------------------------------------------------------------- posteriors and assignment


def posterior(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Edges with ``p``: abundance times weight, normalised in the molecule; equal shares if all are zero."""
    group = Window.partitionBy(*GROUP)
    rows = edges.join(counts.select(F.col("transcript").alias("rname"), "count"), "rname", "left")
    x = F.coalesce("count", F.lit(0.0)) * F.col("w")
    rows = rows.withColumn("__x", x).withColumn("__t", F.sum("__x").over(group))
    return rows.withColumn("p", F.when(F.col("__t") > 0, F.col("__x") / F.col("__t")).otherwise(1.0 / F.col("n"))).drop("__x", "__t")


def posterior_text(post: DataFrame, digits: int = 6) -> DataFrame:
    """One row a molecule: ``t:p`` pairs by transcript, joined by semicolons."""
    pair = F.struct("rname", F.format_string(f"%s:%.{digits}f", F.col("rname"), F.col("p")).alias("text"))
    listed = post.groupBy(*GROUP).agg(F.sort_array(F.collect_list(pair)).alias("x"))
    return listed.select(*GROUP, F.array_join(F.transform("x", lambda x: x["text"]), ";").alias("posteriors"))


def hard_pick(post: DataFrame, mode: str = "AS", eps: float = 1e-12) -> DataFrame:
    """One transcript a molecule: greatest posterior, then best score, then name.

    ``tie_count`` is how many share the greatest posterior (within ``eps``) and ``tie_break`` what decided.
    """
    group = Window.partitionBy(*GROUP)
    rows = post.withColumn("__tie", F.col("p") >= F.max("p").over(group) - eps)
    tied = rows.where("__tie").withColumn("tie_count", F.count("*").over(group))
    score = F.col("as") if mode == "AS" else -F.col("nm")
    label = "AS" if mode == "AS" else "NM"
    tied = tied.withColumn("__s", score).withColumn("__top", F.max("__s").over(group))
    tied = tied.withColumn("__even", F.sum(F.when(F.col("__s") == F.col("__top"), 1).otherwise(0)).over(group))
    order = group.orderBy(F.col("__s").desc_nulls_last(), F.col("rname").asc())
    broke = F.when(F.col("tie_count") == 1, "posterior").when(F.col("__even") == 1, f"posterior->{label}").otherwise(f"posterior->{label}->lexi_name")
    picked = tied.withColumn("__at", F.row_number().over(order)).where("__at = 1")
    return picked.select(*GROUP, F.col("rname").alias("transcript"), F.col("p").alias("posterior"), F.col("tie_count").cast("int").alias("tie_count"), broke.alias("tie_break"))


def assigned(best: DataFrame, picks: DataFrame) -> DataFrame:
    """All molecules with their pick; those without a usable edge get an empty transcript, zeros and ``NA``."""
    rows = best.select(*GROUP).distinct().join(picks, GROUP, "left")
    return rows.select(*GROUP, F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("posterior", F.lit(0.0)).alias("posterior"), F.coalesce("tie_count", F.lit(0)).alias("tie_count"), F.coalesce("tie_break", F.lit("NA")).alias("tie_break"))


def deduplicate(alignments: DataFrame, picks: DataFrame, order: list[str], mapq: int = 255) -> DataFrame:
    """The first record (by ``order``) of each molecule on its chosen transcript, primary, with its pick's columns.

    ``alignments`` have ``umi``; secondary and supplementary flags are cleared and the mapping quality is set.
    """
    rows = alignments.join(picks.select(*GROUP, F.col("transcript").alias("rname"), "posterior", "tie_count", "tie_break"), [*GROUP, "rname"])
    first = Window.partitionBy(*GROUP).orderBy(*order)
    rows = rows.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    if "flag" in rows.columns:
        rows = rows.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~0x900)))
    if "mapq" in rows.columns:
        rows = rows.withColumn("mapq", F.lit(mapq))
    return rows


def unassigned(alignments: DataFrame, picks: DataFrame) -> DataFrame:
    """Records whose molecule has no pick."""
    return alignments.join(picks.select(*GROUP), GROUP, "left_anti")


# ---------------------------------------------------------------- baselines


def baseline(rows: DataFrame, how: str, by: str = "qname") -> DataFrame:
    """Abundances ``rname, count`` by simple rules over reads.

    ``primary``: a read's first candidate; ``random``: one candidate by the order of a hash; ``top_as``: even shares
    of its best candidates; ``all``: even shares of all; ``unique``: reads with one candidate.
    """
    if how == "random":
        draw = F.min(F.struct(F.md5(F.concat_ws("|", by, "rname")).alias("h"), F.col("rname").alias("r")))
        return rows.groupBy(by).agg(draw.alias("d")).groupBy(F.col("d.r").alias("rname")).agg(F.count("*").cast("double").alias("count"))
    read = Window.partitionBy(by)
    if how == "primary":
        rows = rows.withColumn("x", F.when(F.row_number().over(read.orderBy(*candidate_order())) == 1, 1.0)).where("x is not null")
    elif how == "top_as":
        rows = rows.withColumn("b", F.max("as").over(read)).where("as = b")
        rows = rows.withColumn("x", 1.0 / F.count("*").over(read))
    elif how == "all":
        rows = rows.withColumn("x", 1.0 / F.count("*").over(read))
    elif how == "unique":
        rows = rows.withColumn("x", F.count("*").over(read).cast("double")).where("x = 1")
    else:
        raise ValueError(f"unknown baseline: {how}")
    return rows.groupBy("rname").agg(F.sum("x").alias("count"))


# ---------------------------------------------------------------- rarefaction


def rarefy(reads: DataFrame, fractions: list[float], uniform: Column, read: str | None = None) -> DataFrame:
    """``fraction, reads_included, unique_umi_seq, saturation``: a read counts at every fraction over its uniform number.

    A row is a read, unless ``read`` names the column that tells reads apart: then all keys of a read's rows count.

    One pass: each key by its earliest fraction, counts by fraction, running sums over the few fractions.
    """
    spark = reads.sparkSession
    grid = sorted(fractions)

    def earliest(u: Column) -> Column:
        first = F.lit(None).cast("int")
        for i in range(len(grid) - 1, -1, -1):
            first = F.when(F.lit(grid[i]) > u, F.lit(i)).otherwise(first)
        return first

    # The number is computed once a read, however many fractions look at it.
    rows = reads.withColumn("bin", F.element_at(F.transform(F.array(uniform), earliest), 1)).where("bin is not null")
    per_read = (rows if read is None else rows.select(read, "bin").distinct()).groupBy("bin").agg(F.count("*").alias("r"))
    per_key = rows.groupBy(*GROUP).agg(F.min("bin").alias("bin")).groupBy("bin").agg(F.count("*").alias("u"))
    table = F.broadcast(spark.createDataFrame([(i, float(f)) for i, f in enumerate(grid)], "bin int, fraction double"))
    counts = per_read.join(per_key, "bin", "full")
    counts = table.join(counts, "bin", "left") if len(grid) else table
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each fraction
    out = counts.select("fraction", F.sum(F.coalesce("r", F.lit(0))).over(run).alias("reads_included"), F.sum(F.coalesce("u", F.lit(0))).over(run).alias("unique_umi_seq"))
    return out.withColumn("saturation", F.when(F.col("reads_included") > 0, F.col("unique_umi_seq") / F.col("reads_included")).otherwise(0.0))
