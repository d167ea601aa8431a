"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagtally.llm._common import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tagtally.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.secret_scan import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.sharding import shard_report

    return shard_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.language_id import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.mixing import report

    return report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.media import digests

    return digests(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagtally.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM i UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _centroids_sql(rounds: int = 5) -> str:
    """The rounds written out: assignments ``a0``, ``a1``, ... around the centroids ``c0``, ``c1``, ..."""
    steps = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """i AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS x FROM v)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, c, list_sum(list_transform(list_zip(v.e, c{r}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v, c{r})""")
        steps.append(f"""a{r} AS (SELECT vec_id, first(c ORDER BY d, c) AS c, min(d) AS d FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN i USING (vec_id) GROUP BY c, i)""")
            steps.append(f"""m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c)""")
            steps.append(f"""c{r + 1} AS (SELECT c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))""")
    steps = [x if x[:1] == "v" or x[:2] == "i " else x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


DIVERGENCE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, t FROM o GROUP BY lang, t HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, t, sum(n)::HUGEINT AS n FROM o JOIN k USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT k.lang, gn.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (gn.total + v.v) AS p FROM k JOIN v USING (lang) JOIN gn USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = gn.source AND c.t = k.t),
l AS (SELECT lang, t, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
q AS (SELECT l.lang, l.t, 1 + 1000000000::HUGEINT * (l.n + 1) // (z.total + v.v) AS q FROM l JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang) z USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.t, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, t) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL where it says the whole result; the other operators are tested against brute force."""
    return {"op1_topk_search": TOPK_SQL, "op4_jaccard_join": JACCARD_SQL, "op12_centroids": _centroids_sql(), "op13_divergence": DIVERGENCE_SQL}
