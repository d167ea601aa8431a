"""Mixing sources to target weights, in DataFrame and SQL expressions only.

Every source has a target in words: shares of the mix by weight, stopped at ``most`` times the source's size, the
excess shared again by weight among the others. A source's documents fall into blocks by a hash of the row; the
mix takes whole passes over all blocks, and of the last pass as many blocks of the source's permutation as the
target asks for, the last block and its last document in part, so that the words taken meet the rounded target.

Which output shard gets which draw is decided by a splitting tree: the root holds each source's quota of block
draws; a node with an even number of shards below gives its left child half of its draws, and how many of each
source is a draw from the multivariate hypergeometric distribution, source by source, by inversion of the exact
probabilities around the mode. The leaves' quotas of a source sum to its quota exactly, and a shard's draws are a
run of the source's permutation that no other shard has. Within a shard rows stand in hash order.

A node of the tree is a row with one number for each source, so the tree is for up to some 100,000 sources; the work
is linear in them (draws are dealt to groups of sources, then within a group), and documents, blocks and draws have
no such bound. Whatever is drawn is read off the leaves' quotas.

Random numbers are hashes of (seed, source, block), so reruns agree and lost tasks repeat the same draw.

Defined results: a null text has no words; documents without words are drawn for nothing (taken 0); a null source
is a source of its own, last in order; repeated rows are documents of their own. A table without words takes none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtally.llm._common import durable, hinted, shuffle_width
from tagtally.llm._sql import let

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating: fixed values of the contract.
WEIGHTS = (3, 1, 2)
#: Documents of a block, about, and the most blocks of a source; blocks of larger sources hold more documents.
BLOCK_DOCS, BLOCKS_MOST = 64, 1 << 16
SHARDS = 16
#: Sources that one fold deals draws to.
SOURCES_FOLD = 128


def sized(docs: DataFrame, text_column: str = "text") -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, n_docs, target``: shares by weight, stopped at ``most`` times the size.

    Sorted by ``most * size / weight`` the stopped sources come first, so running sums give the level at which
    the rest shares what they leave; the number of rows is that of the sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    table = table.withColumn("stop", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("stop") / F.col("w"))
    total, turn = Window.partitionBy(), Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    after = turn.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumn("mix", share * F.sum("source_size").over(total).cast("double"))
    table = table.withColumn("level", F.greatest(F.col("mix") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)), F.lit(0.0)) / F.sum("w").over(after))
    # The level is that of the first source that stays under its stop.
    table = table.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(total)["level"])
    return table.select("source", "source_size", "n_docs", F.coalesce(F.least("stop", F.col("final") * F.col("w")), F.col("stop")).alias("target"))


def _log_factorial(x: str) -> str:
    """SQL of ln(x!): Stirling's series above a shift, exact to about 1e-12."""
    z = f"({x} + 8D)"
    shift = " + ".join(f"ln({x} + {k}D)" for k in range(1, 8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - ({shift}))"


def _hypergeometric(good: str, bad: str, drawn: str, u: str) -> str:
    """SQL of a draw: how many of ``drawn`` items out of ``good + bad`` are good, for a uniform ``u``.

    Steps away from the mode in both directions, by the ratios of neighbouring probabilities, add these up until
    they exceed ``u``; beyond twelve standard deviations nothing is left to add in double precision.
    """
    g, b, n = (f"cast({x} as double)" for x in (good, bad, drawn))
    lo, hi = f"greatest(0L, {drawn} - {bad})", f"least({good}, {drawn})"
    mode = f"least({hi}, greatest({lo}, cast(floor(({n} + 1D) * ({g} + 1D) / ({g} + {b} + 2D)) as bigint)))"
    terms = [(f"{g}", 1), ("k0", -1), (f"({g} - k0)", -1), (f"{b}", 1), (f"({n} - k0)", -1), (f"({b} - {n} + k0)", -1), (f"({g} + {b})", -1), (f"{n}", 1), (f"({g} + {b} - {n})", 1)]
    top = "exp(" + " ".join(f"{'+' if sign > 0 else '-'} {_log_factorial(x)}" for x, sign in terms).lstrip("+ ") + ")"
    reach = f"cast(least({hi} - {lo}, 20L + cast(12D * sqrt({n} * {g} / greatest(1D, {g} + {b}) * {b} / greatest(1D, {g} + {b})) as bigint)) as int)"
    up = f"z.up * ({g} - k1 + 1D) * ({n} - k1 + 1D) / (k1 * ({b} - {n} + k1))"
    down = f"z.down * (k1 + 1D) * ({b} - {n} + k1 + 1D) / (({g} - k1) * ({n} - k1))"
    state = "named_struct('m', z.m, 'up', {up}, 'down', {down}, 'left', z.left - p1, 'k', if(z.left < p1, cast({k} as bigint), z.k))"
    return f"""
        aggregate(sequence(0, 2 * {reach} + 1),
            {let(f"cast({mode} as double)", "k0", let(top, "p0", f"named_struct('m', k0, 'up', p0, 'down', p0, 'left', {u}, 'k', -1L)"))},
            (z, j) -> if(z.k >= 0, z,
                if(j = 0, {let("z.up", "p1", state.format(up="z.up", down="z.down", k="z.m"))},
                if(j % 2 = 1, {let("z.m + (j + 1) / 2", "k1", let(up, "p1", state.format(up="p1", down="z.down", k="k1")))},
                    {let("z.m - j / 2", "k1", let(down, "p1", state.format(up="z.up", down="p1", k="k1")))}))),
            z -> if(z.k >= 0, z.k, cast(z.m as bigint)))"""


def _shared(items: str, want: str, draw: str) -> str:
    """SQL: how many of ``want`` draws without replacement fall on each of ``items`` (with their numbers ``n``)."""
    total = f"aggregate({items}, 0L, (t, x) -> t + x.n)"
    return f"""
        aggregate({items}, named_struct('rest', {total}, 'want', {want}, 'out', cast(array() as array<bigint>)),
            (a, x) -> {let(draw, "d", "named_struct('rest', a.rest - x.n, 'want', a.want - d, 'out', array_append(a.out, d))")},
            a -> a.out)"""


def _split(quotas: DataFrame, seed: int, shards: int) -> DataFrame:
    """``source, shard, n``: block quotas of the sources dealt to shards by the splitting tree."""
    key = F.struct(F.col("source").isNull().alias("o"), F.col("source").alias("s"), F.col("quota").alias("n"))
    nodes = quotas.agg(F.sort_array(F.collect_list(key)).alias("q")).withColumn("node", F.lit(1)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        total = "aggregate(q, 0L, (t, x) -> t + x.n)"
        u = lambda mark: f"(cast(pmod(xxhash64({seed}, node, {mark}), 9007199254740992L) as double) / 9007199254740992D)"
        want = f"cast(floor(cast({total} as double) * ((hi - lo) div 2) / (hi - lo)) as bigint)"
        # Groups of sources share the draws first, then the sources of a group: no result grows with all sources.
        groups = f"transform(sequence(0, cast(greatest(0, size(q) - 1) div {SOURCES_FOLD} as int)), g -> slice(q, g * {SOURCES_FOLD} + 1, {SOURCES_FOLD}))"
        by_group = _shared("transform(p, (x, g) -> named_struct('n', aggregate(x, 0L, (t, y) -> t + y.n), 's', g))", "n0", _hypergeometric("x.n", "(a.rest - x.n)", "a.want", u("'group', x.s")))
        by_source = _shared("y", "n1", _hypergeometric("x.n", "(a.rest - x.n)", "a.want", u("'source', x.o, x.s")))
        left = let(groups, "p", let(let(want, "n0", by_group), "w", f"flatten(zip_with(p, w, (y, n1) -> {by_source}))"))
        nodes = nodes.withColumn("left", F.expr(left))
        half = F.expr("cast(lo + (hi - lo) div 2 as int)")
        one = F.col("hi") - F.col("lo") <= 1
        down = F.expr("transform(q, (x, i) -> named_struct('o', x.o, 's', x.s, 'n', left[i]))")
        rest = F.expr("transform(q, (x, i) -> named_struct('o', x.o, 's', x.s, 'n', x.n - left[i]))")
        whole = F.struct(F.col("q").alias("q"), (F.col("node") * 2).alias("node"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))
        a = F.struct(down.alias("q"), (F.col("node") * 2).alias("node"), F.col("lo").alias("lo"), half.alias("hi"))
        b = F.struct(rest.alias("q"), (F.col("node") * 2 + 1).alias("node"), half.alias("lo"), F.col("hi").alias("hi"))
        nodes = durable(nodes.select(F.explode(F.when(one, F.array(whole)).otherwise(F.array(a, b))).alias("x")).select("x.*"))
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select(F.col("x.s").alias("source"), "shard", F.col("x.n").alias("n"))


def draws(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, shards: int = SHARDS, with_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(documents, drawn)``.

    ``documents``: row_id, doc_id, source, size, source_size, target. ``drawn``: one row for each time that a
    document is drawn: row_id, doc_id, pass (0 is the first), shard, position (its order in the shard), words.
    """
    id_, source = F.col(f"`{id_column}`"), F.col(f"`{source_column}`").cast("string")
    rows = docs.select(id_.alias("doc_id"), source.alias("source"), sized(docs, text_column).alias("size"), F.xxhash64(F.lit(seed), id_, source, F.col(f"`{text_column}`")).alias("h"), F.monotonically_increasing_id().alias("row_id"))
    rows = durable(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = durable(targets(sizes, share, most, weights))
    sources = plan.count()
    plan = plan.withColumn("blocks", F.least(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(BLOCKS_MOST)).cast("long"))
    plan = plan.withColumn("goal", F.least(F.round("target").cast("long"), most * F.col("source_size")))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("cast(goal div source_size as long)")).otherwise(F.lit(0)))
    plan = plan.withColumn("part", F.col("goal") - F.col("passes") * F.col("source_size"))

    documents = rows.join(hinted(plan, sources), rows["source"].eqNullSafe(plan["source"])).select(rows["*"], "source_size", "target", "blocks", "passes", "part")
    documents = documents.withColumn("block", F.pmod("h", "blocks"))

    # Blocks in the source's permuted order; what of the part is left when a block begins.
    blocks = documents.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("passes").alias("passes"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    blocks = blocks.withColumn("at", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumn("left", F.col("part") - F.coalesce("before", F.lit(0)))
    blocks = blocks.withColumn("draws", F.col("passes") + F.when(F.col("left") > 0, 1).otherwise(0))
    blocks = durable(blocks)
    quotas = blocks.groupBy("source").agg(F.sum("draws").cast("long").alias("quota"), F.count("*").alias("all"))

    # Place p of a source is block p modulo blocks of its permutation, in pass p div blocks; a leaf of the tree owns a
    # run of places, and what is drawn is what the leaves' quotas name.
    leaves = _split(quotas.select("source", "quota"), seed + 2, shards)
    ends = Window.partitionBy("source").orderBy("shard")
    leaves = leaves.withColumn("end", F.sum("n").over(ends)).where("n > 0").withColumn("begin", F.col("end") - F.col("n"))
    totals = quotas.select(F.col("source").alias("a_source"), F.col("all"))
    places = leaves.join(hinted(totals, sources), F.expr("source <=> a_source")).withColumn("place", F.explode(F.expr("sequence(begin, end - 1)")))
    places = places.select(F.col("source").alias("p_source"), "shard", F.expr("place % all").alias("p_at"), F.expr("cast(place div all as int)").alias("pass"))
    drawn = places.join(blocks, F.expr("p_source <=> source and p_at = at"))
    drawn = drawn.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "pass", "shard", F.when(F.col("pass") >= F.col("passes"), F.col("left")).alias("left"))

    taken = documents.where("size > 0").join(drawn, F.expr("source <=> b_source and block = b_block"))
    # Within the block where the part ends, documents in hash order until it is used up.
    inside = Window.partitionBy("b_source", "b_block", "pass").orderBy("h", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = taken.where("left is not null").withColumn("room", F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("words", F.greatest(F.least("size", "room"), F.lit(0))).where("words > 0").drop("room")
    full = taken.where("left is null").withColumn("words", F.col("size"))
    taken = full.unionByName(cut).select("row_id", "doc_id", "pass", "shard", F.col("b_block").alias("block"), F.xxhash64(F.lit(seed + 3), "shard", "pass", "h", "row_id").alias("position"), F.col("words").cast("long").alias("words"))
    return documents.select("row_id", "doc_id", "h", "source", "size", "source_size", "target"), taken.join(rows.select("row_id", "h"), "row_id") if with_hash else taken


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken and ``draws``.

    ``draws`` lists the document's draws as ``shard:pass:block:words``, comma-joined by shard and pass; ``taken`` is
    the sum of their words. Both come from the leaves of the splitting tree.
    """
    documents, drawn = draws(docs, **options)
    taken = drawn.groupBy("row_id").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "pass", "block", "words"))).alias("draws"))  # one for each pass
    rows = documents.join(taken, "row_id", "left")
    listed = F.expr("coalesce(array_join(transform(draws, x -> concat_ws(':', x.shard, x.pass, x.block, x.words)), ','), '')")
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), listed.alias("draws"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 17, **options) -> DataFrame:
    """The mix: a row of ``docs`` for each draw, with ``shard`` and ``position``, its order in the shard.

    A draw of a part of a document holds that many words of it, joined by single spaces.
    """
    _, drawn = draws(docs, id_column, source_column, text_column, seed=seed, with_hash=True, **options)
    listed = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("shard", "position", "words")).alias("__draws"))
    columns = [c for c in docs.columns if c not in ("shard", "position")]
    id_, source = F.col(f"`{id_column}`"), F.col(f"`{source_column}`").cast("string")
    rows = docs.select(*[f"`{c}`" for c in columns], F.xxhash64(F.lit(seed), id_, source, F.col(f"`{text_column}`")).alias("__k"))
    # Equal rows are drawn as one list, which one of them carries.
    same = Window.partitionBy(id_column, "__k").orderBy(F.lit(0))
    rows = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    rows = rows.join(listed, id_.eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h"))).withColumn("__draw", F.explode("__draws"))
    cut = F.expr(f"array_join(slice(regexp_extract_all(`{text_column}`, r'{WORD}', 0), 1, cast(__draw.words as int)), ' ')")
    whole = F.col("__draw.words") == sized(docs, text_column)
    text = F.when(whole, F.col(f"`{text_column}`")).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in columns], F.col("__draw.shard").alias("shard"), F.col("__draw.position").alias("position"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` dealt to tasks by shard and stretch of positions, each task's rows in their order.

    Positions are hashes, so a stretch of them is an even part of a shard, whatever the number of tasks.
    """
    stretches = max(1, shuffle_width(mixed.sparkSession) // SHARDS)
    task = F.expr(f"shard * {stretches} + least({stretches - 1}, cast(floor((cast(position as double) / 18446744073709551616D + 0.5D) * {stretches}) as int))")
    return mixed.repartitionById(SHARDS * stretches, task).sortWithinPartitions("shard", "position")
