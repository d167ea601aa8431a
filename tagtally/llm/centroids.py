"""Centroid clustering of integer vectors, exact at any magnitude.

Vectors are packed once into blocks of rows in a written table. A block's squared distances to all centroids are
|x|^2 - 2 x.c + |c|^2 from one matrix product of doubles. That is exact while every number on the way is an integer
below 2^53; rows whose greatest component, with the centroids' greatest one, bounds these numbers beyond 2^53 are
computed in integers instead: 64 bits while their bound is below 2^62, Python's integers beyond. All rows therefore
have exact distances, and ties go to the smaller centroid number.

A round maps blocks to the sums and counts of their clusters and combines these by ``treeAggregate``: the driver gets
one k x d table of integers, whatever the rows. Sums are integers of any size.

Defined results: vectors that are null, have another number of components, or hold null or non-finite components take
no part. Repeated rows all count. Rows with a null id are clustered, but the first centroids are chosen among the
others; of rows that share an id, and so a hash, the smaller vector comes first. With fewer rows than ``k`` there are
fewer centroids. Distances and sums of distances that a long cannot hold are null; clusters stay exact. An empty table
gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtally.llm._common import bounded_batches, durable, trim

#: Rows of a block.
BLOCK = 2048
_EXACT, _LONG = 2**53, 2**62


def _components(list_array, dim: int) -> np.ndarray:
    return list_array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers: 64 bits where they fit, Python's otherwise."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < _LONG / scale:
        return np.floor(scale * values).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= _EXACT else math.floor(scale * v) for v in values.ravel().tolist()], object).reshape(values.shape)


def _sound(column, dim: int):
    """Whether a vector takes part."""
    return F.coalesce((F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def packed(vectors: DataFrame, dim: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Blocks ``ids, kind, body`` of the vectors that take part; ``kind`` says how integers are held: in 4 or 8 bytes, or as text."""
    bounded_batches(vectors.sparkSession)
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.where(_sound(v, dim)).select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                kind, body = _held(scaled(_components(part["v"], dim), scale))
                ids = pa.array([part["id"].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([body], pa.binary())], ["ids", "kind", "body"])

    return rows.mapInArrow(pack, "ids array<bigint>, kind string, body binary")


def _held(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel())).encode()
    kind = "<i4" if not x.size or np.abs(x).max() < 2**31 else "<i8"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, body: bytes, dim: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(t) for t in bytes(body).decode().split(",")], object).reshape(-1, dim)
    return np.frombuffer(bytes(body), kind).astype(np.int64).reshape(-1, dim)


def _greatest(x: np.ndarray) -> np.ndarray:
    """Greatest magnitude of each row, as doubles rounded up."""
    return np.maximum(np.abs(x.max(1).astype(np.float64)), np.abs(x.min(1).astype(np.float64))) * (1 + 2.0**-50) + 1


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the squared distance; ``x`` and ``c`` hold integers."""
    label, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    # Every number of the expansion is at most d (|x| + |c|)^2.
    bound = x.shape[1] * (_greatest(x) + float(_greatest(c).max())) ** 2
    fast = bound < _EXACT
    if fast.any():
        a, b = x[fast].astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        label[fast] = d.argmin(1)
        distance[fast] = d[np.arange(len(d)), label[fast]].astype(np.int64)
    for rows, kind in ((~fast & (bound < _LONG), np.int64), (~fast & (bound >= _LONG), object)):
        if rows.any():
            a, b = x[rows].astype(kind), c.astype(kind)
            best = at = None
            for j in range(len(b)):
                d = ((a - b[j]) ** 2).sum(1)
                if best is None:
                    best, at = d, np.zeros(len(a), np.int64)
                else:
                    less = (d < best).astype(bool)
                    best, at = np.where(less, d, best), np.where(less, j, at)
            label[rows], distance[rows] = at, best
    return label, distance


def sums_of(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the components and number of rows of each of ``k`` clusters."""
    counts = np.bincount(label, minlength=k)
    order = np.argsort(label, kind="stable")
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    safe = x.dtype != object and float(_greatest(x).max()) * len(x) < _LONG
    out = np.zeros((k, x.shape[1]), object)
    out[some] = np.add.reduceat(x[order] if safe else x[order].astype(object), starts, axis=0)
    return out, counts.astype(object)


def _round(blocks, centroids: np.ndarray, dim: int):
    """Sums, counts and inertia of the clusters around ``centroids``: one table of fixed size reaches the driver."""
    k = len(centroids)
    held = blocks.context.broadcast(centroids)

    def add(have, block):
        x = unpacked(block["kind"], block["body"], dim)
        label, distance = nearest(x, held.value)
        s, n = sums_of(x, label, k)
        d = np.zeros(k, object)
        np.add.at(d, label, distance)
        return merge(have, (s, n, d))

    def merge(a, b):
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b))

    out = blocks.treeAggregate(None, add, merge, depth=2 if blocks.getNumPartitions() <= 512 else 3)
    held.unpersist()
    return out


def starts(vectors: DataFrame, k: int, seed: int, dim: int, scale: int, id_column: str, vector_column: str) -> np.ndarray | None:
    """The first centroids: vectors with the smallest sha256 of ``seed:id``. Floors keep the order of components, so ties may be broken before them."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")).cast("binary"), 256)
    rows = vectors.where(_sound(v, dim)).select(h.alias("h"), v.alias("v")).where("h is not null").orderBy("h", "v").limit(k).collect()
    return _tight(scaled(np.array([r["v"] for r in rows]), scale)) if rows else None


def _tight(c: np.ndarray) -> np.ndarray:
    """64-bit integers where they fit."""
    return c.astype(np.int64) if max(abs(int(v)) for v in c.ravel()) < _LONG else c


def moved(c: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; empty clusters stay."""
    out = c.astype(object)
    for j in range(len(c)):
        if counts[j]:
            out[j] = [int(s) // int(counts[j]) for s in sums[j]]
    return _tight(out)


def _long_or_none(v) -> int | None:
    return int(v) if v < 2**63 else None


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per vector that takes part: id, cluster, distance, cluster_inertia, inertia and centroid_sha256 after ``rounds`` rounds."""
    spark = vectors.sparkSession
    blocks = durable(packed(vectors, dim, scale, id_column, vector_column))
    schema = f"`{id_column}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    c = starts(vectors, k, seed, dim, scale, id_column, vector_column)
    if c is None:
        return spark.createDataFrame([], schema)
    bodies = blocks.select("kind", "body").rdd
    for _ in range(rounds):
        sums, counts, _ = _round(bodies, c, dim)
        c = moved(c, sums, counts)
    inertia = _round(bodies, c, dim)[2]
    each, total = [_long_or_none(v) for v in inertia], _long_or_none(sum(inertia))
    digests = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c]
    held = spark.sparkContext.broadcast(c)

    def label(batches):
        for batch in batches:
            for ids, kind, body in zip(batch["ids"].to_pylist(), batch["kind"].to_pylist(), batch["body"].to_pylist()):
                at, distance = nearest(unpacked(kind, body, dim), held.value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array([_long_or_none(d) for d in distance], pa.int64()), pa.array([each[j] for j in at], pa.int64()),
                    pa.array([total] * len(at), pa.int64()), pa.array([digests[j] for j in at], pa.string())], [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        trim()

    return blocks.mapInArrow(label, schema)
