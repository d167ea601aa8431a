"""Exact set-similarity self-join of texts on word shingles, by multiple global token orders.

Two texts link when ``100 * |A & B| >= 75 * |A | B|`` over their shingle sets (five words unless told
otherwise). For a set of size n, any global order of the tokens gives a prefix of ``n - ceil(t n) + 1`` tokens,
and two linked sets share a token of their prefixes, whichever order it is. The join

1. counts in how many sets each token occurs (over all texts, tokens dealt out by range in packed arrays);
2. drops sets of which more tokens are unique than a link allows: they have no partner;
3. compares each set with the hubs of its prefix tokens in the rare-first order, and takes the nearest as candidates:
   large groups of near copies become one class by a linear number of pairs;
4. joins on the prefix tokens that still lie in two classes, by length, position and parity-map bounds;
5. of the candidates of 3 and of 4 keeps those that share a prefix token under two other (hash) orders as well, by
   their prefixes alone, fetches the sets of what is left, and intersects them;
6. contracts the verified links to components.

Equal sets are one node, so copies cost nothing after the first stage. Tokens that are very frequent in some batch of
texts form a bounded table that each task knows. The postings of a token that is in many sets never meet in one task,
nor do the members of a large class: joins go around them by broadcasts of counted size. In the exhaustive join a token in
many sets is dealt out in blocks of sets, and the sets of its largest class are not paired with each other.

A set's identity is 128 bits (two sets of a corpus of 10**10 agree by chance with 2**-62); sets that agree in the first 64
only are told apart where they meet. Tokens have 64 bits: two tokens of a pair of sets of 1,000 agree with 2**-44.

Defined results: a null or wordless text has no shingles and links with nothing; a text with fewer words than
a shingle has its whole word sequence as its one token; repeated rows stay, one result each; a row whose id is
null takes part in links but cannot name a component (a component of null ids only gets null). Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtally.llm._common import HOT_ROWS, bounded_batches, connected_components, durable, hinted, hot_keys, merged_components, planes, shuffle_width, spread_join, text_slices, trim, unplanes
from tagtally.llm._words import Words, mix

#: Entries of the table of frequent tokens (8 + 4 bytes each) and the share of a batch's texts that makes one.
FREQUENT_MOST, FREQUENT_SHARE, FREQUENT_LEAST = 100_000, 0.005, 24

#: Bytes of texts whose sets one task of the last exchange holds; the others have a quarter.
HOME_BYTES, FINER = 32 << 20, 4

_CHUNK = "part int, home int, kind int, bid long, a binary, b binary, c binary, d binary"
_DOC, _KEY, _ENTRY, _TOKEN, _ANON = 0, 1, 2, 3, 4
_SETS = "kind int, doc_id long, n int, key long, more long, pre int, light int, toks array<long>, pre2 array<int>, pre3 array<int>, parity array<long>"

#: Bits of a set's parity map. The number of places where two maps differ never exceeds the number of tokens
#: that only one of the sets has, so a pair whose maps differ too much cannot link.
PARITY_BITS = 1024

#: Hubs that a set is compared with by parity map, and of these the nearest ones that are verified, before all pairs
#: of sets that are not yet in one class are looked at.
HUBS_LOOKED_AT, HUBS_VERIFIED = 16, 3


def _sets(batches, id_column: str, text_column: str, width: int):
    """(ids, null mask, per-text token sets) of runs of rows."""
    words = Words()
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_column))
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for first, data, offsets in text_slices(batch, text_column, 3 << 20):
            h, bounds = words.words(data, offsets)
            last = first + len(offsets) - 1
            yield ids[first:last], missing[first:last], words.shingles(h, bounds, width)
        data = batch = None  # before the next one is read
        trim()


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set of distinct tokens in order."""
    first = int((s * (s >> np.uint64(7))).sum()) ^ int(np.bitwise_xor.reduce(s)) ^ len(s)
    second = int(((s ^ (s >> np.uint64(33))) * ((s << np.uint64(11)) | np.uint64(1))).sum()) + len(s)
    a, b = mix(np.array([first, second % 2**64], np.uint64)).tolist()
    return a, b


def _told_apart(keys: np.ndarray, others: np.ndarray, homes: int) -> np.ndarray:
    """A key of 64 bits for each distinct pair of fingerprints, sorted by both: the first one's, or the next free one of the same home."""
    out, clash = keys.copy(), np.r_[False, keys[1:] == keys[:-1]]
    taken = set(keys.tolist()) if clash.any() else set()
    for i in np.flatnonzero(clash).tolist():
        k = int(keys[i])
        while k in taken:  # all keys of a home are here, so a free one is free everywhere
            k = k + homes if k + homes < 2**64 else k % homes
        taken.add(k)
        out[i] = k
    return out


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.concatenate([np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), [len(ordered)]])


def _frequent(docs: DataFrame, id_column: str, text_column: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens that are frequent in some batch, by value, and their places in the order; at most FREQUENT_MOST.

    Third the number of tokens of all texts, counted in the same pass.
    """

    def count(batches):
        for _, _, sets in _sets(batches, id_column, text_column, width):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sum(map(len, sets))], pa.int64())], ["token", "n"])
            distinct = {s.tobytes(): s for s in sets}
            tokens = np.sort(np.concatenate(list(distinct.values())))
            runs = _runs(tokens)
            sizes = np.diff(runs)
            often = sizes >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[runs[:-1][often]].view(np.int64)), pa.array(sizes[often].astype(np.int64))], ["token", "n"])

    counted = durable(docs.select(id_column, text_column).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = counted.where("token is null").agg(F.sum("n")).first()[0] or 0
    counted = counted.where("token is not null")
    # The lowest power of two over which no more tokens lie than the table may have; only these reach the driver.
    sizes = {r["b"]: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}
    least, held = 63, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= FREQUENT_MOST:
        least -= 1
        held += sizes.get(least, 0)
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), total
    rows = counted.where(F.col("n") >= 2**least).toArrow()
    tokens, often = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(tokens), np.int32)
    rank[np.lexsort((tokens, often))] = np.arange(len(tokens))
    place = np.argsort(tokens)
    return tokens[place], 2**30 + rank[place], total


def _prepared(docs: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """Rows of each text (kind 0: doc_id, n, key) and of each distinct set (kind 1: with its shared tokens)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    often, places, total = _frequent(docs, id_column, text_column, width)
    # Exchanges are as wide as the data asks for; a token and a word are some six bytes of text.
    homes = max(shuffle_width(spark), -(-6 * total // HOME_BYTES))
    parts = FINER * homes
    span = 2**64 // parts + 1
    # Tokens in more sets than this are heavy; there are fewer than eight of them for each task.
    heavy = max(HOT_ROWS, total // (8 * homes))
    table = spark.sparkContext.broadcast((often, places))
    key_of = _set_key
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def scatter(batches):
        often, places = table.value
        for ids, missing, sets in _sets(batches, id_column, text_column, width):
            sizes = np.array([len(s) for s in sets], np.int32)
            keys, others = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            new: dict[tuple[int, int], np.ndarray] = {}
            for i, s in enumerate(sets):
                if len(s):
                    keys[i], others[i] = k = key_of(s)
                    new.setdefault(k, s)
            out = []

            def add(part, home, kind, bid, a, b=b"", c=b"", d=b""):
                out.append((int(part), int(home), kind, int(bid), a, b, c, d))

            held = sorted(new)
            names, more = (np.array([k[i] for k in held], np.uint64) for i in (0, 1))
            home = (names % np.uint64(homes)).astype(np.int64)
            turn = np.argsort(home, kind="stable")
            names, more, home, held = names[turn], more[turn], home[turn], [new[held[i]] for i in turn.tolist()]
            edge = np.searchsorted(home, np.arange(homes + 1))
            index = (np.arange(len(names)) - edge[home]).astype(np.uint32)  # of a set among those of its home
            bid = int(mix(np.array([int((mix(keys) * np.arange(1, len(keys) + 1, dtype=np.uint64)).sum()) ^ (int(ids[0]) & (2**64 - 1))], np.uint64)).view(np.int64)[0])
            salt = bid % parts
            for kind, mask in ((_DOC, ~missing), (_ANON, missing)):
                for k in range(0, int(mask.sum()), 2048):
                    pick = np.flatnonzero(mask)[k : k + 2048]
                    add(salt, (salt + k) % homes, kind, bid, planes(ids[pick]), planes(sizes[pick]), planes(keys[pick]), planes(others[pick]))
            if len(names):
                lengths = np.array([len(s) for s in held], np.int32)
                for h in np.flatnonzero(np.diff(edge)):
                    own = slice(edge[h], edge[h + 1])
                    add(FINER * h + salt % FINER, h, _KEY, bid, planes(names[own]), planes(lengths[own]), planes(more[own]))
                tokens, owner = np.concatenate(held), np.repeat(np.arange(len(names), dtype=np.int32), lengths)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    known = often[at] == tokens
                    k_tokens, k_owner, k_place = tokens[known], owner[known], places[at[known]]
                    cut = np.searchsorted(k_owner, edge)  # owners stand by home
                    for h in np.flatnonzero(np.diff(cut)):
                        own = slice(cut[h], cut[h + 1])
                        add(FINER * h + salt % FINER, h, _ENTRY, bid, planes(k_tokens[own]), planes(k_place[own]), planes(index[k_owner[own]]), planes(np.full(cut[h + 1] - cut[h], bid)))
                    tokens, owner = tokens[~known], owner[~known]
                turn = np.argsort(tokens)
                tokens, owner = tokens[turn], owner[turn]
                cut = np.searchsorted(tokens, np.array([p * span for p in range(parts)], np.uint64)).tolist() + [len(tokens)]
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[p], cut[p + 1])
                    # Sorted tokens of a range travel as differences, whose high bytes are zeros.
                    add(p, 0, _TOKEN, bid, planes(np.diff(tokens[own], prepend=np.uint64(p * span))), planes(home[owner[own]].astype(np.uint32)), planes(index[owner[own]]))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[k : k + 64]], t) for i, t in enumerate(kinds)], ["part", "home", "kind", "bid", "a", "b", "c", "d"])

    def count(group: pa.Table) -> pa.Table:
        trim()  # what the group before left
        which = group["kind"].to_numpy()
        passed = group.filter(pa.array(which != _TOKEN)).select(["home", "kind", "bid", "a", "b", "c", "d"])
        own = group.filter(pa.array(which == _TOKEN))
        rows: list[tuple] = []
        if own.num_rows:
            base = np.uint64(int(own["part"][0].as_py()) * span)
            lists = [[unplanes(x.as_py(), t) for x in own[c]] for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.uint32))]
            lists[0] = [np.cumsum(x) + base for x in lists[0]]
            tokens, home, index = map(np.concatenate, lists)
            bids = np.repeat(own["bid"].to_numpy(), [len(x) for x in lists[0]])
            turn = np.argsort(tokens)
            sizes = np.diff(_runs(tokens[turn]))
            often = np.repeat(sizes, sizes).astype(np.int32)
            shared = often > 1
            turn, often = turn[shared], often[shared]
            tokens, home, index, bids = tokens[turn], home[turn], index[turn], bids[turn]
            turn = np.lexsort((index, bids, home))
            edge = _runs(home[turn])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                pick = turn[lo:hi]
                if hi > lo:
                    rows.append((int(home[pick[0]]), _ENTRY, 0, planes(tokens[pick]), planes(often[pick]), planes(index[pick]), planes(bids[pick])))
        made = pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds[1:])], ["home", "kind", "bid", "a", "b", "c", "d"])
        return pa.concat_tables([passed.cast(made.schema), made])

    def gather(group: pa.Table) -> pa.Table:
        trim()  # what the group before left
        which = group["kind"].to_numpy()
        a, b, c, d = (group[x].to_pylist() for x in "abcd")
        part = lambda column, kind, dtype: np.concatenate([unplanes(column[i], dtype) for i in np.flatnonzero(which == kind)] or [np.zeros(0, dtype)])
        ids, anon = part(a, _DOC, np.int64), part(a, _ANON, np.int64)
        sizes, keys, others = (np.r_[part(x, _DOC, t), part(x, _ANON, t)] for x, t in ((b, np.int32), (c, np.uint64), (d, np.uint64)))
        # Where an entry says (batch, index), the batch's list of sets has the key.
        heads = np.flatnonzero(which == _KEY)
        lists = [unplanes(a[i], np.uint64) for i in heads]
        listed, begin = np.concatenate(lists or [np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, lists)])
        seconds = part(c, _KEY, np.uint64)
        order = np.lexsort((seconds, listed))
        fresh = np.r_[True, (listed[order][1:] != listed[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])][: len(order)]
        final = _told_apart(listed[order][fresh], seconds[order][fresh], homes)
        moved = np.flatnonzero(final != listed[order][fresh])
        old, old2, new = listed[order][fresh][moved], seconds[order][fresh][moved], final[moved]
        listed[order] = final[np.cumsum(fresh) - 1]
        head_bids = group["bid"].to_numpy()[heads]
        turn = np.argsort(head_bids)
        bids = part(d, _ENTRY, np.int64)
        place = turn[np.searchsorted(head_bids[turn], bids)] if len(bids) else np.zeros(0, np.int64)
        owner = listed[begin[place] + part(c, _ENTRY, np.uint32)]
        names, first = np.unique(listed, return_index=True)
        lengths = part(b, _KEY, np.int32)[first]
        tokens, often = part(a, _ENTRY, np.uint64), part(b, _ENTRY, np.int32)
        turn = np.lexsort((tokens, often, owner))
        owner, tokens, often = owner[turn], tokens[turn], often[turn]
        if len(owner):
            once = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
            owner, tokens, often = owner[once], tokens[once], often[once]
        lo, hi = np.searchsorted(owner, names), np.searchsorted(owner, names, "right")
        need = -(-lengths.astype(np.int64) * percent // 100)
        alive = np.flatnonzero(hi - lo >= need)
        tokens2, tokens3 = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), mix(tokens ^ np.uint64(0x14057B7EF767814F))
        made: list[list] = [[], [], [], []]
        pres, lights = [], []
        for i in alive.tolist():
            own = slice(lo[i], hi[i])
            pre = int(hi[i] - lo[i] - need[i] + 1)
            pres.append(pre)
            lights.append(int(np.searchsorted(often[lo[i] : lo[i] + pre], heavy, "right")))
            made[0].append(tokens[own].view(np.int64))
            # The other orders only rule pairs out, so half a token is enough there.
            made[1].append((np.sort(tokens2[own])[:pre] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            made[2].append((np.sort(tokens3[own])[:pre] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            odd = np.bincount((tokens2[own] >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
            made[3].append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        n, m = len(ids) + len(anon), len(alive)
        null = lambda k, kind: pa.nulls(k, kind)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        docs_out = [pa.array(np.zeros(n, np.int32)), pa.concat_arrays([pa.array(ids), null(len(anon), pa.int64())]), pa.array(sizes), pa.array(keys.view(np.int64), mask=sizes == 0), pa.array(others.view(np.int64)), null(n, pa.int32()), null(n, pa.int32()), *[null(n, t) for t in (longs, ints, ints, longs)]]
        keys_out = [pa.array(np.ones(m, np.int32)), null(m, pa.int64()), pa.array(lengths[alive]), pa.array(names[alive].view(np.int64)), null(m, pa.int64()), pa.array(pres, pa.int32()), pa.array(lights, pa.int32()), *[pa.array(x, t) for x, t in zip(made, (longs, ints, ints, longs))]]
        # Different sets with one first fingerprint: which of them has another key from here on.
        k = len(moved)
        moved_out = [pa.array(np.full(k, 2, np.int32)), pa.array(new.view(np.int64)), null(k, pa.int32()), pa.array(old.view(np.int64)), pa.array(old2.view(np.int64)), null(k, pa.int32()), null(k, pa.int32()), *[null(k, t) for t in (longs, ints, ints, longs)]]
        columns = ["kind", "doc_id", "n", "key", "more", "pre", "light", "toks", "pre2", "pre3", "parity"]
        return pa.concat_tables([pa.Table.from_arrays(x, columns) for x in (docs_out, keys_out, moved_out)])

    return durable(
        docs.select(id_column, text_column).mapInArrow(scatter, _CHUNK)
        .repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(count, "home int, kind int, bid long, a binary, b binary, c binary, d binary")
        .repartitionById(homes, F.col("home")).groupBy("home").applyInArrow(gather, _SETS)
    )


#: How much two sets differ at least, by their parity maps; what nobody else has counts as it is.
_APART = "(n_a - s_a) + (n_b - s_b) + aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
_NEAR = _APART + " <= n_a + n_b - 2 * cast(ceil({percent} * cast(n_a + n_b as long) / {whole}) as int)"


def _sided(rows: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in columns])


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str], hot: DataFrame | None, size: str | None = None) -> DataFrame:
    """Pairs (u, v) of keys with ``columns`` of both sets; a set is the left end of few pairs, but hubs may be ``hot`` right ends."""
    left = pairs.join(_sided(rows, "a", columns).withColumnRenamed("key_a", "u"), "u")
    return spread_join(left, _sided(rows, "b", columns).withColumnRenamed("key_b", "v"), "v", hot, size=size)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) of keys those that sizes and parity maps allow, with ``apart``, the least difference."""
    near = _both(pairs, sets.withColumn("s", F.size("toks")), ["key", "n", "s", "parity"], hot_keys(pairs, "v"))
    near = near.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").where(_NEAR.format(percent=percent, whole=100 + percent))
    return near.select("u", "v", F.expr(f"cast({_APART} as double) / (n_a + n_b)").alias("apart"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) of keys that share a prefix token in the first order those whose sets link.

    Pairs must share one under each of the other orders as well; only then are the sets fetched and intersected.
    """
    pairs = durable(pairs.select("u", "v"))
    hot = hot_keys(pairs, "v")
    shared = _both(pairs, sets, ["key", "pre2", "pre3"], hot, "8L * size(pre2_b) + 64")
    shared = shared.where(F.arrays_overlap("pre2_a", "pre2_b") & F.arrays_overlap("pre3_a", "pre3_b")).select("u", "v")
    both = _both(shared, sets, ["key", "n", "toks"], hot, "8L * size(toks_b) + 64")
    common = F.size(F.array_intersect("toks_a", "toks_b")).cast("long")
    return durable(both.withColumn("common", common).where(f"100 * common >= {percent} * (n_a + n_b - common)").select("u", "v"))


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _by_token(posted: DataFrame, *aggregates) -> list[DataFrame]:
    """An aggregate of the postings of each token, for tokens that are not heavy and, if there are any, for those that are.

    Heavy tokens are few, so theirs may be broadcast: their postings, which one task could not hold, stay in place.
    """
    if not posted.where("heavy").take(1):
        return [posted.groupBy("token").agg(*aggregates)]
    light, heavy = (posted.where(c).groupBy("token").agg(*aggregates) for c in ("not heavy", "heavy"))
    return [light, durable(heavy.coalesce(max(1, shuffle_width(posted.sparkSession) // 64)))]


def _joined(posted: DataFrame, light: DataFrame, heavy: DataFrame | None = None, how: str = "inner") -> DataFrame:
    if heavy is None:
        return posted.join(light, "token", how)
    few = hinted(heavy, heavy.count())
    return posted.where("not heavy").join(light, "token", how).unionByName(posted.where("heavy").join(few, "token", how))


def _mixed(posted: DataFrame) -> DataFrame:
    """The postings of tokens that still lie in two classes."""
    tokens = [x.where("lo <> hi").select("token") for x in _by_token(posted, F.min("label").alias("lo"), F.max("label").alias("hi"))]
    return _joined(posted, *tokens, how="left_semi")


#: Sets of a token that one task pairs with its other sets at once.
CROWD = 1024


def _meetings(rich: DataFrame, percent: int) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    """Sides and keys of the joins whose pairs are looked at; ``rich`` holds the postings of prefix tokens in the first order.

    The left side of a token in more than ``CROWD`` sets is dealt out in blocks of some so many, each of which meets all of the right side.
    Of such a token's sets those of its largest class are not paired with each other: they are linked already.
    """
    short = F.expr(f"pos <= s - ceil(2 * {percent} * cast(n as long) / {100 + percent})")
    classes = rich.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token")
    crowded = durable(classes.agg(F.sum("c").alias("m"), F.max(F.struct("c", "label"))["label"].alias("most")).where(F.col("m") > CROWD))
    found = crowded.count()
    if not found:
        return [(rich.where(short), rich, ["token"])]
    rich = rich.join(hinted(crowded, found), "token", "left")
    few, many = rich.where("m is null").drop("m", "most"), rich.where("m is not null").withColumn("blocks", F.ceil(F.col("m") / CROWD).cast("int")).withColumn("main", F.col("label") == F.col("most")).drop("m", "most")
    dealt = many.where(short).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["token", "block"]
    return [(few.where(short), few, ["token"]), (dealt.where("not main"), spread, by), (dealt.where("main"), spread.where("not main"), by)]


def _met(left: DataFrame, right: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Pairs (u, v) of keys of different classes on the two sides that sizes, positions and parity maps allow."""
    columns = ["key", "n", "s", "pos", "label", "parity"]
    a = left.select(*by, *[F.col(c).alias(f"{c}_a") for c in columns])
    b = right.select(*by, *[F.col(c).alias(f"{c}_b") for c in columns])
    bound = f"{100 + percent} * cast(least(s_a - pos_a, s_b - pos_b) as long) >= {percent} * cast(n_a + n_b as long)"
    bound += f" and label_a <> label_b and (n_a < n_b or (n_a = n_b and key_a < key_b)) and 100 * n_a >= {percent} * n_b"
    bound += " and " + _NEAR.format(percent=percent, whole=100 + percent)
    return a.join(b, by).where(bound).select(F.col("key_a").alias("u"), F.col("key_b").alias("v"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id it is linked with."""
    rows = _prepared(docs, id_column, text_column, width, percent)
    texts = rows.where("kind = 0").select("doc_id", "n", "key", "more")
    moved = rows.where("kind = 2").select("key", "more", F.col("doc_id").alias("own"))
    if moved.take(1):
        texts = texts.join(moved, ["key", "more"], "left").withColumn("key", F.coalesce("own", "key")).drop("own")
    texts = texts.drop("more")
    sets = rows.where("kind = 1").select("key", "n", "pre", "light", "toks", "pre2", "pre3", "parity")

    prefix = F.posexplode(F.slice("toks", F.lit(1), F.col("pre"))).alias("pos", "token")
    posted = sets.select("key", "light", prefix).withColumn("heavy", F.expr("pos >= light"))
    # Hubs vary from token to token, so a set has many to choose from.
    turn = F.struct(F.xxhash64("key", "token").alias("h"), F.col("key").alias("v"))
    hubs = [x.where("m > 1").select("token", F.col("hub.v").alias("v")) for x in _by_token(posted, F.min(turn).alias("hub"), F.count("*").alias("m"))]
    edges = _joined(posted, *hubs).where("key <> v").groupBy(F.col("key").alias("u"), "v").agg(F.count("*").alias("m"))
    often = Window.partitionBy("u").orderBy(F.desc("m"), F.xxhash64("u", "v"))
    edges = durable(edges.withColumn("at", F.row_number().over(often)).where(f"at <= {HUBS_LOOKED_AT}").select("u", "v"))
    nearest = Window.partitionBy("u").orderBy("apart", "v")
    edges = _near(edges, sets, percent).withColumn("at", F.row_number().over(nearest)).where(f"at <= {HUBS_VERIFIED}").select("u", "v")
    classes = connected_components(_verified(edges, sets, percent))

    # Every pair of sets of different classes that shares a prefix token, the smaller set by its shorter index prefix.
    rich = sets.select("key", "n", F.size("toks").alias("s"), "parity", "light", prefix).withColumn("heavy", F.expr("pos >= light"))
    rich = durable(_mixed(_labelled(rich, classes)).drop("heavy", "light"))
    pairs = None
    for left, right, by in _meetings(rich, percent):
        met = _met(left, right, by, percent)
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.distinct()
    classes = merged_components(classes, _verified(pairs, sets, percent))

    named = texts.groupBy("key").agg(F.min("doc_id").alias("low")).where("key is not null")
    named = _labelled(named, classes)
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = spread_join(named, lowest, "label", hot_keys(classes, "label")).select("key", "component_id")
    out = texts.join(named, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows are told apart by id and text, so a row stays if its own text is new, whatever other rows have its id; rows
    equal in both share their fate. A null id comes after all others. Rows without words stay.
    """
    id_, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    row = F.xxhash64(id_, text)
    found = durable(jaccard_components(docs.select(row.alias("__row"), text.alias("__text")), "__row", "__text", **options)).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__class")).distinct()
    ids = durable(docs.select(id_.alias("__id"), row.alias("__row")).distinct().join(found, "__row"))
    place = F.struct(F.col("__id").isNull().alias("o"), F.col("__id").alias("i"), F.col("__row").alias("r"))
    first = ids.groupBy("__class").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    later = spread_join(ids, first, "__class", hot_keys(ids, "__class")).where(place != F.col("__first")).select("__id", "__row")
    return docs.join(later, id_.eqNullSafe(F.col("__id")) & (row == F.col("__row")), "left_anti")
