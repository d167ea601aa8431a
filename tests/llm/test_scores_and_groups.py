"""Line quality, clustering and source divergence against brute force, edge cases included."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_corpus_operators import CLASH, docs_of


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def good_text(rng):
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randrange(2, 8)))
    return "\n".join(" ".join(word() for _ in range(rng.randrange(4, 15))).capitalize() + "." for _ in range(rng.randrange(1, 9)))


def bad_text(rng):
    kind = rng.randrange(3)
    if kind == 0:
        lines = [" ".join([w] * 15) for w in (f"w{rng.randrange(50)}" for _ in range(4))]
    elif kind == 1:
        lines = [" | ".join(f"item{rng.randrange(90)}" for _ in range(12)) for _ in range(3)]
    else:
        lines = [" ".join("".join(rng.choices("ABCDE", k=5)) + "!!" for _ in range(10)) for _ in range(3)]
    return "\n".join([*lines, good_text(rng).split("\n")[0]])


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    rows = [(i, (good_text if i % 3 else bad_text)(rng), "s") for i in range(400)]
    rows += [(None, good_text(rng), "s"), (1000, None, "s"), (1001, "", None), (1002, " \n\t\r\n ", "s"), (1003, "x" * 400_000, "s"), (0, rows[0][1], "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, None, 1), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs_of(spark, rows), labels


def test_quality_of_held_out_documents(spark, judged):
    from tagtally.llm.quality import classify

    rows, docs, labels = judged
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    tested = [(r.predicted, int(r.doc_id % 3 > 0)) for r in got if r.held_out and r.doc_id < 400]
    assert len(tested) > 100 and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.score, r.predicted))
    assert len(by[0]) == 1 and by[1000] == by[1001] == by[1002] and next(iter(by[1000]))[1] == 0
    # Scores do not depend on how rows lie together.
    again = {r.doc_id: r.score for r in classify(docs.repartition(1), labels).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_quality_without_labels_and_rows(spark, judged):
    from tagtally.llm.quality import classify, score

    _, docs, labels = judged
    assert {(r.score, r.predicted) for r in classify(docs, labels.where("false")).collect()} == {(0.5, 1)}
    assert {(r.score, r.predicted) for r in classify(docs, labels.where("quality = 1")).collect()} == {(0.5, 1)}
    assert classify(docs.where("false"), labels).count() == 0
    out = score(docs, None, lines=True)
    assert set(out.columns) == set(docs.columns) | {"lines"} and out.where("doc_id = 1001").first()["lines"] == []


def test_line_marginals_are_those_of_all_labellings():
    from tagtally.llm import quality as q

    rng = np.random.default_rng(1)
    both, bounds = np.array([0.7, 1.3]), np.array([0, 4, 4, 5, 11])
    z = rng.normal(size=11)
    ahead, back = q.messages(z, bounds, both)
    got = 1 / (1 + np.exp(-(ahead + back)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            s = sum(z[a + k] for k in range(b - a) if y[k]) + sum(both[y[k]] for k in range(1, b - a) if y[k] == y[k - 1])
            total += math.exp(s)
            good += np.array(y) * math.exp(s)
        assert np.allclose(got[a:b], good / total)


def test_training_climbs_the_likelihood():
    """The gradient that training follows agrees with differences of the log-likelihood over all labellings."""
    from tagtally.llm import quality as q

    rng = np.random.default_rng(2)
    bounds = np.array([0, 3, 7])
    x, y = rng.normal(size=(7, q._WIDTH)), np.array([1, 1, 0, 0, 0, 1, 1])

    def likelihood(model):
        w, both = np.array(model["weights"]).reshape(3, -1), model["both"]
        z = x @ w[0] + q._beside(x, bounds, -1) @ w[1] + q._beside(x, bounds, 1) @ w[2]
        out = 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            value = lambda v: sum(z[a + k] for k in range(b - a) if v[k]) + sum(both[v[k]] for k in range(1, b - a) if v[k] == v[k - 1])
            every = [value([(c >> k) & 1 for k in range(b - a)]) for c in range(2 ** (b - a))]
            out += value(y[a:b].tolist()) - math.log(sum(map(math.exp, every)))
        return out

    found = [likelihood(q.train(x, y, bounds, rounds=r, shrink=0.0)) for r in (1, 10, 60, 200)]
    assert found == sorted(found) and found[-1] > -0.1


def test_slices_of_long_texts_change_no_sums(monkeypatch):
    from tagtally.llm import quality as q

    rng = random.Random(3)
    text = "\n".join(rng.choice([good_text, bad_text])(rng) for _ in range(60)) + "\r\n\n tail of it"
    data = np.frombuffer(text.encode(), np.uint8)
    whole, bounds = q.Lines().of_texts(data, np.array([0, len(data)]))
    for size in (64, 301, 5000):
        monkeypatch.setattr(q, "SLICE", size)
        cut, cut_bounds = q.Lines().of_texts(data, np.array([0, len(data)]))
        assert (cut == whole).all() and (cut_bounds == bounds).all()
    lines = [x for x in re.split(r"[\r\n]", text) if x.strip()]
    assert len(whole) == len(lines) and whole[:, : q._KINDS].sum(1).tolist() == [len(x.encode()) for x in lines]
    same = [sum(a == b for a, b in zip(w, w[1:])) for w in (x.split() for x in lines)]
    # The word before a line counts for its first word, too.
    before = [0, *[int(a.split()[-1] == b.split()[0]) for a, b in zip(lines, lines[1:])]]
    assert whole[:, q._KINDS + 1].tolist() == [a + b for a, b in zip(same, before)]


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k, rounds, dim, scale, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v)))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in first[:k]]
    if not c:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, x) in zip(kept, at) if x == j]
            if own:
                c[j] = tuple(sum(x) // len(own) for x in zip(*own))
    at = assign()
    inertia = collections.Counter()
    for d, j in at:
        inertia[j] += d
    short = lambda d: d if d < 2**63 else None
    return [(i, j, short(d), short(inertia[j]), short(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)]


@pytest.mark.parametrize("size", [1.0, 1e5, 1e8, 1e15, 1e300])
def test_clusters(spark, monkeypatch, size):
    from tagtally.llm import centroids

    monkeypatch.setattr(centroids, "BLOCK", 37)
    rng = random.Random(int(math.log10(size)))
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * size * rng.choice([1, 1e-3]) for _ in range(4)]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(7, rows[7][1]), (7, [0.0, -0.0, 1.5, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, rows[3][1])]
    rows += [(500, None), (501, [1.0]), (502, [1.0, None, 2.0, 3.0]), (503, [math.nan, 0.0, 0.0, 0.0]), (504, [math.inf, 0.0, 0.0, 0.0]), (505, [])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, kind string, id long").repartition(3)
    got = sorted(map(tuple, centroids.cluster(frame, 6, 4, 4).collect()), key=repr)
    assert got == sorted(brute_clusters(rows, 6, 4, 4, 256, 2), key=repr)


def test_few_and_no_vectors(spark):
    from tagtally.llm.centroids import cluster

    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.cluster, r.distance) for r in cluster(frame, 5, 2, 2).collect()] == [(0, 0), (0, 0)]
    assert cluster(frame.where("false"), 5, 2, 2).count() == 0 and cluster(frame, 5, 2, 3).count() == 0


def test_doubles_are_used_only_where_they_are_exact():
    from tagtally.llm.centroids import nearest

    c = np.array([[2**26, 0], [2**26 + 1, 0]], np.int64)
    # The expansion would round these: |x|^2 is about 2^54.
    label, distance = nearest(np.array([[2**27 + 1, 3], [5, 5], [2**40, 1]], np.int64), c)
    want = [min((int((int(a) - int(m)) ** 2 + (int(b) - int(n)) ** 2), j) for j, (m, n) in enumerate(c.tolist())) for a, b in ((2**27 + 1, 3), (5, 5), (2**40, 1))]
    assert list(zip(distance.tolist(), label.tolist())) == want


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        v = len(kept)
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        everything = sum(count.values(), collections.Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v)

        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted((-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode(), o) for o in count if o != s)
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(pairs)]
            terms = sorted((-f(p(count[s], t), p(everything, t)), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(everything, t))
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,tile,slice_", [(1 << 22, 256, 1 << 20), (300, 3, 40), (20, 2, 7)])
def test_divergence(spark, monkeypatch, shard, tile, slice_):
    from tagtally.llm import divergence as d

    for name, value in (("SHARD_BYTES", shard), ("TILE", tile), ("SLICE", slice_), ("WAITING", 4 * slice_), ("HELD", 50), ("BLOCK_ROWS", 60)):
        monkeypatch.setattr(d, name, value)
    rng = random.Random(shard)
    rows = []
    for i in range(220):
        text = " ".join(rng.choice(["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "x", "a1b", "日本", "it's", "q\x00r", "z\n", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(5))}"]) for _ in range(rng.randrange(0, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "é", None])))
    rows += [(None, "en", "empty"), ("only once", "one", "a"), (None, "one", "b"), ("", None, "s1"), ("word " * 50, "en", "s1"), ("y" * 300, "en", "s1"), ("y" * 300, "en", "s2"), ("y" * 300, "fr", "s2"), ("y" * 300, "en", "s2"), ("solo solo solo", "solo", "x")]
    frame = spark.createDataFrame([(t, lg, s, "item", 3, 4, "t") for t, lg, s in rows], "text string, lang string, source string, item string, n long, rank int, term string").repartition(4)
    got = sorted(map(tuple, d.audit(frame).collect()))
    assert got == brute_divergence(rows)
    assert d.audit(frame.where("false")).count() == 0
    short = [r for r in d.audit(frame, top=2).collect() if r.part == "term"]
    assert sorted(map(tuple, short)) == [r for r in brute_divergence(rows, top=2) if r[2] == "term"]


def test_operators_keep_their_hands_off_clashing_columns(spark):
    from tagtally.llm.divergence import audit
    from tagtally.llm.quality import score

    docs = docs_of(spark, [(1, "One two three.", "s"), (2, None, None)])
    assert score(docs, None).columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert "score" in CLASH and audit(docs).where("part = 'pair'").count() == 2
