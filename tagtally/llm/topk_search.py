"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of partial scores over blocks of dimensions. A block is a node of the method; its list of partial
scores lies in pieces, one for each group of candidates, as rows that hold the candidates' components of that block.

1. Every node lists, for each query, its k best partial scores and its least one. The totals of the listed entries are
   gathered, and the k-th best of a query is a safe cutoff. Partial scores may be negative, so each node counts from
   its least one.
2. The cutoff is broadcast to the nodes with the queries: a total can reach it only if some node's part lies above that
   node's least by ``(cutoff - sum of least parts) / nodes``. Nodes collect these entries alone, without those that a
   piece's greatest other parts cannot lift to the cutoff; only their totals are added up, and only what reaches the
   cutoff is sent.
3. The scores of the entries sent are resolved exactly from the vectors, ranked, and cut to k.

Candidates are written once, in pieces, and never shuffled again. Queries are broadcast in runs of ``QUERY_ROWS``, which
bounds what a task holds. Equal vectors are one candidate with its smallest ids, which bounds ties, and equal queries
are one query.

Defined results: vectors that are null, empty, of another length than most, or hold null or non-finite
components take no part; neither do rows without an id. Scores are exact integers (a score beyond 64 bits is
returned as the nearest 64-bit integer, ranked exactly). Ties go to the smaller id. Rows of equal id and
vector count once; a query never finds rows of its own id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtally.llm._common import durable

#: Queries of a run that is broadcast, of a tile that a task scores at a time, and candidates of a group.
QUERY_ROWS, TILE_ROWS, GROUP_ROWS = 1 << 15, 512, 4096


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``; only vectors that are whole and finite."""
    v = F.col(f"`{vector_column}`")
    finite = F.expr(f"not exists(`{vector_column}`, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))")
    rows = vectors.where(v.isNotNull() & F.col(f"`{id_column}`").isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.expr(f"transform(`{vector_column}`, x -> floor({scale} * cast(x as double)))").alias("v"))
    return rows


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width), np.int64)


def _partials(q: np.ndarray, c: np.ndarray, block: slice) -> np.ndarray:
    """Exact integer partial scores of all queries with all candidates."""
    a, b = q[:, block], c[:, block]
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**61:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def _best(p: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest entries of each row, in any order."""
    return np.argpartition(-p.astype(float), n - 1, axis=1)[:, :n] if n < p.shape[1] else np.tile(np.arange(p.shape[1]), (len(p), 1))


def _nodes(candidates: DataFrame, width: int, edges: list[int], groups: int) -> DataFrame:
    """``g, b, ids, part``: for each group of candidates and each block of dimensions the ids and their components."""

    def pack(group: pa.Table) -> pa.Table:
        ids, v = group["cid"].to_numpy().astype(np.int64), _matrix(group["v"], width)
        rows = [(group["g"][0].as_py(), b, ids.tobytes(), np.ascontiguousarray(v[:, lo:hi]).tobytes()) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["g", "b", "ids", "part"])

    group_of = F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int")
    dealt = candidates.select(group_of.alias("g"), "cid", "v").repartitionById(groups, F.col("g"))
    return durable(dealt.groupBy("g").applyInArrow(pack, "g int, b int, ids binary, part binary"))


def _pieces(batches, edges: list[int]):
    """Yield ``(ids, [components of each block])`` of the groups of a partition, whose nodes lie side by side."""
    held: list[np.ndarray] = []
    for batch in batches:
        for b, ids, part in zip(batch["b"].to_pylist(), batch["ids"].to_pylist(), batch["part"].to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            held.append(np.frombuffer(part, np.int64).reshape(len(ids), edges[b + 1] - edges[b]))
            if b == len(edges) - 2:
                yield ids, held
                held = []


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, blocks: int = 2, stats: dict | None = None) -> DataFrame:
    """For each row whose id ``every`` divides, its ``k`` best other rows: query_id, rank, vec_id, score.

    ``stats`` receives how many entries' totals the second phase added up (``scored``), and of how many pairs.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = durable(quantized(vectors, id_column, vector_column, scale).distinct())
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score long"
    if not common:
        return spark.createDataFrame([], out)
    width = int(common[0]["d"])
    rows = rows.where(F.size("v") == width)
    blocks = min(blocks, width)
    edges = [width * b // blocks for b in range(blocks + 1)]
    keep = k + 1  # the query's own row may be among them

    same = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("at", F.row_number().over(same)).where(F.col("at") <= keep)
    candidates = durable(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    asked = rows.where(F.col("id") % every == 0)
    queries = durable(asked.groupBy("v").agg(F.min("id").alias("qid")))
    count = candidates.count()
    nodes = _nodes(candidates, width, edges, max(1, -(-count // GROUP_ROWS)))
    runs = max(1, -(-queries.count() // QUERY_ROWS))
    small = _small(rows, width)
    whole = "long" if small else "decimal(38,0)"
    arrow = pa.int64() if small else pa.decimal128(38)
    exact = "aggregate(zip_with(qv, v, (x, y) -> x * y), 0L, (s, x) -> s + x)" if small else "aggregate(zip_with(qv, v, (x, y) -> cast(x as decimal(38,0)) * y), cast(0 as decimal(38,0)), (s, x) -> cast(s + x as decimal(38,0)))"
    asking = queries.withColumnRenamed("v", "qv")
    scores = lambda pairs: pairs.join(asking, "qid").join(candidates, "cid").select("qid", "cid", "ids", F.expr(exact).alias("s"))

    def entries(run: int) -> DataFrame:
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(runs)) == run).toArrow().sort_by("qid")
        ids, q = own["qid"].to_numpy(), _matrix(own["v"], width)
        held = sc.broadcast((ids, q))

        def listed(batches):
            ids, q = held.value
            best = [(np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)) for _ in range(blocks)]
            least: list = [None] * blocks
            for cids, parts in _pieces(batches, edges):
                for b, c in enumerate(parts):
                    low, tops, names = [], [], []
                    for t in range(0, len(ids), TILE_ROWS):
                        p = _partials(q[t : t + TILE_ROWS, edges[b] : edges[b + 1]], c, slice(None))
                        at = _best(p, min(keep, p.shape[1]))
                        low.append(p.min(1))
                        tops.append(np.take_along_axis(p, at, 1).astype(float))
                        names.append(cids[at])
                    low = np.concatenate(low)
                    least[b] = low if least[b] is None else np.minimum(least[b], low)
                    top, name = np.concatenate([best[b][0], np.concatenate(tops)], 1), np.concatenate([best[b][1], np.concatenate(names)], 1)
                    at = _best(top, min(keep, top.shape[1]))
                    best[b] = np.take_along_axis(top, at, 1), np.take_along_axis(name, at, 1)
            for b, (top, name) in enumerate(best):
                if least[b] is None:
                    continue
                n, m = top.shape
                lows = pa.array([int(x) for x in least[b]], pa.int64()) if small else pa.array([_decimal(x) for x in least[b]], arrow)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, b, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), lows], ["qid", "b", "cid", "part", "least"])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(np.full(n * m, b, np.int32)), pa.array(name.ravel()), pa.array(top.ravel()), pa.nulls(n * m, arrow)], ["qid", "b", "cid", "part", "least"])

        first = durable(nodes.select("b", "ids", "part").mapInArrow(listed, f"qid long, b int, cid long, part double, least {whole}"))
        in_list = Window.partitionBy("qid", "b").orderBy(F.desc("part"), "cid")
        lists = first.where("cid is not null").withColumn("at", F.row_number().over(in_list)).where(F.col("at") <= keep).select("qid", "cid").distinct()
        by_total = Window.partitionBy("qid").orderBy(F.desc("s"), "cid")
        totals = scores(lists).withColumn("at", F.row_number().over(by_total)).where(F.col("at") == keep).select("qid", F.col("s").alias("cut"))
        low = first.where("least is not null").groupBy("qid").pivot("b", list(range(blocks))).agg(F.min("least"))
        known = low.join(totals, "qid", "left").toArrow().sort_by("qid")  # a row for each query of the run
        floors = [[int(x) for x in known[str(b)].to_pylist()] for b in range(blocks)]
        cuts = [None if x is None else int(x) for x in known["cut"].to_pylist()]
        bars = [[None if cut is None else -(-(cut - sum(f)) // blocks) + f[b] for cut, f in zip(cuts, zip(*floors))] for b in range(blocks)]
        # A bar that no 64-bit part reaches or misses is the nearest 64-bit number; without a cutoff everything passes.
        bounds = sc.broadcast(([np.array([_LOW if x is None else min(max(x, _LOW), _HIGH) for x in bar], object if not small else np.int64) for bar in bars], cuts))

        def above(batches):
            ids, q = held.value
            bars, cuts = bounds.value
            cut = np.array([_LOW if x is None else x for x in cuts], np.int64 if small else object)
            added = 0
            for cids, parts in _pieces(batches, edges):
                for t in range(0, len(ids), TILE_ROWS):
                    tile = slice(t, t + TILE_ROWS)
                    found = [_partials(q[tile, edges[b] : edges[b + 1]], c, slice(None)) for b, c in enumerate(parts)]
                    over = np.zeros(found[0].shape, bool)
                    for p, bar in zip(found, bars):
                        over |= (p >= bar[tile][:, None]).astype(bool)
                    # Beside the uniform threshold: with the piece's greatest other parts an entry must reach the cutoff.
                    tops = [p.max(1) for p in found]
                    for p, top in zip(found, tops):
                        need = np.where(cut[tile] == _LOW, _LOW, cut[tile] - (sum(tops) - top))
                        over &= (p >= need[:, None]).astype(bool)
                    i, j = np.nonzero(over)
                    added += len(i)
                    total = sum(p[i, j] for p in found)
                    able = np.asarray(total >= cut[tile][i], bool)
                    i, j, total = i[able], j[able], total[able]
                    # Without a cutoff, or with many totals near it, a group still contributes no more than its best.
                    order = np.lexsort((cids[j], -total if small else _places(total), i))
                    i, j = i[order], j[order]
                    own = np.arange(len(i)) - np.searchsorted(i, i) < keep
                    yield pa.RecordBatch.from_arrays([pa.array(ids[tile][i[own]]), pa.array(cids[j[own]])], ["qid", "cid"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([added], pa.int64())], ["qid", "cid"])

        sent = durable(nodes.select("b", "ids", "part").mapInArrow(above, "qid long, cid long"))
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + (sent.where("qid is null").agg(F.sum("cid")).first()[0] or 0)
            stats["pairs"] = stats.get("pairs", 0) + len(ids) * count
        return sent.where("qid is not null")

    left = entries(0)
    for run in range(1, runs):
        left = left.unionByName(entries(run))
    ids = scores(left).select("qid", "s", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("qid").orderBy(F.desc("s"), "vec_id")
    short = ids.withColumn("at", F.row_number().over(near)).where(F.col("at") <= keep)
    named = asked.select(F.col("id").alias("query_id"), "v").distinct().join(queries, "v").select("query_id", "qid")
    every_query = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    found = named.join(short, "qid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(every_query)).where(F.col("rank") <= k)
    score = F.expr("cast(least(greatest(s, cast(-9223372036854775808 as decimal(38,0))), cast(9223372036854775807 as decimal(38,0))) as long)")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


_LOW, _HIGH = -(2**63), 2**63 - 1


def _decimal(x):
    from decimal import Decimal

    return Decimal(int(x))


def _places(total: np.ndarray) -> np.ndarray:
    """Ranks of exact integers of any size, greatest first; equal ones alike."""
    at = {x: i for i, x in enumerate(sorted({int(x) for x in total}, reverse=True))}
    return np.array([at[int(x)] for x in total], np.int64)


def _small(rows: DataFrame, width: int) -> bool:
    """Whether all inner products fit 64-bit integers."""
    top = rows.agg(F.max(F.expr("greatest(abs(cast(array_max(v) as double)), abs(cast(array_min(v) as double)))"))).first()[0]
    return top is None or top * top * width < 2**62
