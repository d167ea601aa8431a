"""Pieces of SQL for numbers that statements need and engines lack: tails, quantiles, hypergeometric sums, eigenvectors."""

from __future__ import annotations

STEPS = 4000


def simpson(f: str, to: str) -> str:
    """The integral of ``f`` (of ``u``) from 0 to ``to``."""
    at = f"({to}) * i / {STEPS}.0"
    weight = f"CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: ({weight}) * ({f.replace('$u', at)}))) * ({to}) / {3 * STEPS}.0)"


def normal_sf(z: str) -> str:
    return f"(0.5 - {simpson('exp(-0.5 * power($u, 2))', z)} / sqrt(2 * pi()))"


def t_sf(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    return f"(0.5 - {simpson(f'power(1 + power($u, 2) / {df}, -({df} + 1) / 2.0)', t)} * {scale})"


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def hypergeometric(k: str, good: str, whole: str, drawn: str) -> str:
    """Probability of ``k`` good ones among ``drawn`` of ``whole``."""
    return f"exp({log_choose(good, k)} + {log_choose(f'({whole} - {good})', f'({drawn} - {k})')} - {log_choose(whole, drawn)})"


def eigen(matrix: str, count: int, squarings: int = 36) -> str:
    """Common table expressions ``e1`` to ``e{count}`` of rows ``i, ev, v2`` (squared components) of a symmetric matrix ``i, j, v``.

    Squaring a matrix and scaling it to trace 1 leaves the projector on its greatest eigenvector; it is taken off and the
    rest is treated alike. ``eigens`` has all of them, numbered by ``k``.
    """
    out, last = [], matrix
    for k in range(1, count + 1):
        out.append(f"""s{k}(s, i, j, v) AS (SELECT 0, i, j, v / (SELECT sqrt(sum(v * v)) + 1e-300 FROM {last}) FROM {last} UNION ALL
            SELECT s, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (SELECT a.s + 1 AS s, a.i, b.j, sum(a.v * b.v) AS v FROM s{k} a JOIN s{k} b ON a.j = b.i WHERE a.s < {squarings} GROUP BY 1, 2, 3))""")
        out.append(f"p{k} AS MATERIALIZED (SELECT i, j, v FROM s{k} WHERE s = {squarings})")
        out.append(f"l{k} AS MATERIALIZED (SELECT sum(m.v * p.v) AS ev FROM {last} m JOIN p{k} p ON m.i = p.i AND m.j = p.j)")
        out.append(f"r{k} AS MATERIALIZED (SELECT m.i, m.j, m.v - (SELECT ev FROM l{k}) * p.v AS v FROM {last} m JOIN p{k} p ON m.i = p.i AND m.j = p.j)")
        last = f"r{k}"
    rows = " UNION ALL ".join(f"SELECT {k} AS k, i, (SELECT ev FROM l{k}) AS ev, v AS v2 FROM p{k} WHERE i = j" for k in range(1, count + 1))
    return ", ".join(out) + f", eigens AS MATERIALIZED ({rows})"


DISTANCES = """dist AS MATERIALIZED (SELECT a.grp AS i, b.grp AS j, 1 - sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS d FROM {vecs} a JOIN vecs b ON a.feature = b.feature GROUP BY 1, 2)"""
SCALED = DISTANCES + """, centred AS MATERIALIZED (SELECT i, j, -0.5 * (d * d - avg(d * d) OVER (PARTITION BY i) - avg(d * d) OVER (PARTITION BY j) + avg(d * d) OVER ()) AS v FROM dist)"""
GRAM = """z AS MATERIALIZED (SELECT grp, feature, (value - avg(value) OVER f) / stddev_samp(value) OVER f AS z FROM {vecs} WINDOW f AS (PARTITION BY feature)),
    gram AS MATERIALIZED (SELECT a.grp AS i, b.grp AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.feature = b.feature GROUP BY 1, 2)"""

MDS = "WITH RECURSIVE " + SCALED + ", " + eigen("centred", 9) + """, ranked AS (SELECT i, sqrt(greatest(v2, 0) * ev) AS a, dense_rank() OVER (ORDER BY ev DESC, k) AS turn FROM eigens WHERE ev > 1e-12)
    SELECT CAST(i AS VARCHAR) AS grp, round(max(a) FILTER (turn = 1), 5) AS a1, round(max(a) FILTER (turn = 2), 5) AS a2, round(max(a) FILTER (turn = 3), 5) AS a3 FROM ranked GROUP BY 1"""
MDS_AXES = "WITH RECURSIVE " + SCALED + ", " + eigen("centred", 9) + ", l AS (SELECT DISTINCT k, ev FROM eigens WHERE ev > 1e-12) SELECT CAST(count(*) FILTER (ev >= 0.05 * (SELECT sum(ev) FROM l)) AS INTEGER) AS k FROM l"
PCA = "WITH RECURSIVE " + GRAM + ", " + eigen("gram", 2) + """ SELECT CAST(i AS VARCHAR) AS grp, round(sqrt(max(greatest(v2, 0) * ev) FILTER (k = 1)), 5) AS pc1, round(sqrt(max(greatest(v2, 0) * ev) FILTER (k = 2)), 5) AS pc2,
    round(max(ev) FILTER (k = 1) / (SELECT sum(v) FROM gram WHERE i = j), 6) AS share1 FROM eigens GROUP BY 1"""
PERMANOVA = "WITH " + DISTANCES + """, q AS (SELECT i, j, d * d AS q, i % 2 AS a, j % 2 AS b FROM dist WHERE i < j), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT i FROM dist)), g AS (SELECT i % 2 AS a, count(DISTINCT i) AS k FROM dist GROUP BY 1),
    w AS (SELECT sum(q / k) AS within FROM q JOIN g ON q.a = g.a WHERE q.a = q.b), t AS (SELECT sum(q) / (SELECT n FROM n) AS total FROM q)
    SELECT round((total - within) / (within / (n - 2)), 6) AS f, round(1 - within / total, 6) AS r2 FROM w, t, n"""

HYPERGEOM = f"""WITH n AS (SELECT count(DISTINCT c_custkey) AS u FROM customer), a AS (SELECT DISTINCT item FROM {{sets}} WHERE set_name = '1-URGENT' AND item IN (SELECT c_custkey FROM customer)), b AS (SELECT DISTINCT item FROM sets WHERE set_name = '2-HIGH' AND item IN (SELECT c_custkey FROM customer)),
    s AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b USING (item)) AS o, (SELECT u FROM n) AS u)
    SELECT na AS n_a, nb AS n_b, o AS overlap, u AS universe, round((SELECT sum({hypergeometric("k", "nb", "u", "na")}) FROM (SELECT unnest(range(o, least(na, nb) + 1)) AS k)), 8) AS p FROM s"""


def _fold(i: int) -> str:
    term = hypergeometric("k", "j", "(SELECT u FROM n)", f"(SELECT m FROM s WHERE turn = {i})")
    return f"""f{i} AS MATERIALIZED (SELECT k, sum(p * {term}) AS p FROM (SELECT k AS j, p, unnest(range(greatest(0, k + (SELECT m FROM s WHERE turn = {i}) - (SELECT u FROM n)), least(k, (SELECT m FROM s WHERE turn = {i})) + 1)) AS k FROM f{i - 1}) GROUP BY 1)"""


def nway(names: str) -> str:
    return f"""WITH n AS (SELECT count(DISTINCT c_custkey) AS u FROM customer), x AS (SELECT DISTINCT set_name, item FROM {{sets}} WHERE set_name IN ({names}) AND item IN (SELECT c_custkey FROM customer)),
        s AS MATERIALIZED (SELECT m, row_number() OVER (ORDER BY m, set_name) AS turn FROM (SELECT set_name, count(*) AS m FROM x GROUP BY 1)), o AS (SELECT count(*) AS o FROM (SELECT item FROM x GROUP BY 1 HAVING count(*) = 3)),
        f1 AS (SELECT m AS k, 1.0::DOUBLE AS p FROM s WHERE turn = 1), {_fold(2)}, {_fold(3)}, e AS (SELECT product(m / (SELECT u FROM n)::DOUBLE) * (SELECT u FROM n) AS e FROM s)
        SELECT o AS observed, round(e, 6) AS expected, round(o / e, 6) AS enrichment, round((SELECT sum(p) FROM f3 WHERE k >= o), 8) AS p FROM o, e"""


def t_quantile(table: str, level: float) -> str:
    """Common table expressions whose last, ``tq``, has the quantile ``q`` for the ``df`` of a table of one row, by bisection."""
    low = f"{t_sf('mid', 'df')} > {1 - level!r}"
    return f"""bis(s, lo, hi, df) AS (SELECT 0, 0.0::DOUBLE, 40.0::DOUBLE, df FROM {table} UNION ALL SELECT s + 1, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, df FROM (SELECT *, {low} AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE s < 50))),
        tq AS (SELECT (lo + hi) / 2 AS q FROM bis WHERE s = 50)"""
