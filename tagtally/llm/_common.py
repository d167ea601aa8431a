"""Shared plumbing of the corpus operators: table access, checkpoints, packed arrays, components."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where that setting is unset a session in one process (tests, notebooks) gets a temporary folder; on a cluster,
    whose executors cannot share one, this is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, set from ``spark.checkpoint.dir`` where it is not yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagtally-checkpoints-"))
    return sc.getCheckpointDir()


#: Rows of a table that may be broadcast by hint; larger ones are left to the planner.
BROADCAST_ROWS = 100_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint, if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Hot keys are the most frequent ones, so many at most, among those with more rows than this; and the bytes that may
#: be broadcast for them.
HOT_MOST, HOT_ROWS, HOT_BYTES = 8192, 256, 64 << 20


def hot_keys(counted: DataFrame, key: str, n: str | None = None) -> DataFrame | None:
    """The hot keys of a table as a table of one column; None if there are none. ``n`` holds counts, where they are known."""
    sizes = counted.groupBy(key).agg(F.count("*").alias("__n")) if n is None else counted.select(key, F.col(n).alias("__n"))
    top = sizes.where(F.col("__n") > HOT_ROWS).where(F.col(key).isNotNull()).orderBy(F.desc("__n")).limit(HOT_MOST).select(key).collect()
    return counted.sparkSession.createDataFrame(top, counted.select(key).schema) if top else None


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner", size: str | None = None) -> DataFrame:
    """``left.join(right, key, how)`` for a right side with one row for each key, and a left side with ``hot`` keys.

    The hot keys' rows of ``right`` are broadcast, and the left rows stay where they are; all other keys are shuffled.
    Rows of ``right`` whose bytes, by the SQL ``size``, are too many are not broadcast.
    """
    if hot is None:
        return left.join(right, key, how)
    hot = hot.toDF(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    if size is not None and (few.agg(F.sum(F.expr(size))).first()[0] or 0) > HOT_BYTES:
        return left.join(right, key, how)  # left to the adaptive join
    warm = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key, how).unionByName(warm)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Limit the bytes of a batch that goes to a Python worker, where the session has Spark's default of 64 MB.

    It bounds memory of executors and workers and changes no result. The setting is read when a plan runs, so it stays
    set for the session; a caller's own value is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, f"{most}b")


def trim() -> None:
    """Give freed memory of a worker back to the system; workers live on and share an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if give is not None:
        give(0)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers as byte planes, so that a codec sees the slowly changing high bytes together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(dtype)


def text_slices(batch, name: str, most: int = 16 << 20):
    """Yield ``(first, bytes, offsets)`` runs of rows of a text column, each of about ``most`` bytes.

    ``bytes`` is a uint8 array over the UTF-8 of the run, ``offsets`` has one entry more than rows.
    Null texts read as empty. A longer text comes alone and whole.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    # A view of the batch's own buffers: texts are not copied.
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Edges of a graph that one task may hold (16 bytes each); a larger one is contracted in rounds until it has no more.
FEW_EDGES = 100_000


def _least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a graph in order, and the smallest node of each one's component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo != hi
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, hi[apart], lo[apart])  # a root gets a smaller one, so there are no circles
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _few_components(live: DataFrame) -> DataFrame:
    """``(label, m)``: the smallest node of each node's component, for a graph of at most ``FEW_EDGES``, in one task."""

    def label(batches):
        import pyarrow as pa

        rows = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
        if rows:
            nodes, least = _least_nodes(*(np.concatenate(c) for c in zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["label", "m"])

    return live.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(label, "label long, m long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; label is the smallest node of the component.

    Each round maps a node to the smallest node of its closed neighbourhood and contracts the graph, so the
    smallest node of a component always survives and the number of rounds is logarithmic. The minimum is
    aggregated before the shuffle, and joins go around hot nodes and labels; nothing is gathered on the driver but counts.
    When no more than ``FEW_EDGES`` are left, one task ends the work, instead of rounds of many jobs on almost nothing.
    """
    live = durable(edges.where("u <> v").select("u", "v").distinct())
    total = None
    while left := live.count():
        if left <= FEW_EDGES:
            step = durable(_few_components(live))
            if total is None:
                return step.toDF("node", "label")
            total = spread_join(total, step, "label", hot_keys(total, "label"), "left")
            return durable(total.select("node", F.coalesce("m", "label").alias("label")))
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree")))
        if total is None:
            total = near.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            step = near.select(F.col("u").alias("label"), "m")
            total = spread_join(total, step, "label", hot_keys(total, "label"), "left").select("node", F.coalesce("m", "label").alias("label"))
        total = durable(total)
        hot = hot_keys(near, "u", "degree")
        a = near.select(F.col("u"), F.col("m").alias("mu"))
        b = near.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        live = durable(
            spread_join(spread_join(live, a, "u", hot), b, "v", hot).where("mu <> mv")
            .select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct()
        )
    if total is None:
        total = live.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return total


def merged_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``connected_components`` of the graph of ``classes`` with more edges: only the labels of their ends are contracted."""
    known = classes.select(F.col("node").alias("n"), F.col("label").alias("l"))
    ends = edges.join(known, F.col("u") == F.col("n"), "left").select(F.coalesce("l", "u").alias("u"), "v")
    ends = ends.join(known, F.col("v") == F.col("n"), "left").select("u", F.coalesce("l", "v").alias("v"))
    joined = connected_components(ends)
    if not joined.take(1):
        return classes
    step = joined.select(F.col("node").alias("label"), F.col("label").alias("final"))
    old = spread_join(classes, step, "label", hot_keys(classes, "label"), "left").select("node", F.coalesce("final", "label").alias("label"))
    # Ends that had no class before come as their own labels.
    return durable(old.unionByName(joined.join(classes.select("node"), "node", "left_anti")))
