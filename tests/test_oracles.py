"""Every query with a statement agrees with DuckDB on the smallest tables; the others run."""

import decimal
import os

import duckdb
import pytest

from tagtally.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: float(v) if isinstance(v, decimal.Decimal) else (round(v, 9) + 0.0 if isinstance(v, float) and v == v else v)
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(got, df.columns) == normal(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_resampling_queries_run_all_rounds(spark, monkeypatch):
    import inspect

    from tagtally.operators import ordination, sequences
    from tagtally.plans.registry import QUERIES

    rounds = {}
    for module, name, of in ((sequences, "bootstrap_gc", "rounds"), (sequences, "permutation_gc", "rounds"), (ordination, "permanova", "permutations")):
        real = getattr(module, name)

        def run(*a, real=real, name=name, of=of, **b):
            bound = inspect.signature(real).bind(*a, **b)
            bound.apply_defaults()
            rounds[name] = bound.arguments[of]
            return real(*a, **b)

        monkeypatch.setattr(module, name, run)
    assert QUERIES["bootstrap_ci"](spark, SF).count() == 7
    p = [r.p for r in QUERIES["permutation_null"](spark, SF).collect()]
    assert all(abs(x * 501 - round(x * 501)) < 1e-3 for x in p)
    p = QUERIES["permanova"](spark, SF).first().p
    assert abs(p * 5000 - round(p * 5000)) < 1e-6 and rounds == {"bootstrap_gc": 500, "permutation_gc": 500, "permanova": 4999}


def test_the_moderated_test_decides_what_is_permuted(spark, monkeypatch):
    """Sites over the effect that fail the error rate are background, and what the query says of each position follows from that."""
    import numpy as np

    from tagtally.plans import chains

    seen, real = [], chains.K.motif_sites
    monkeypatch.setattr(chains.K, "motif_sites", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    got = {r.k_pos: r for r in QUERIES["motif_permutation"](spark, SF).collect()}
    sites = seen[0]["sites"].toPandas()
    over, passed = sites.beta > chains.EFFECT, sites.padj < 0.05
    assert (over & passed).any() and (over & ~passed).any() and (sites.hit == (over & passed)).all()
    words = sites[sites.sequence_context.str.fullmatch("[ACGT]{7}", na=False)]
    sizes = words.groupby("stratum").hit.agg(["sum", "count"])
    words = words[words.stratum.isin(sizes.index[(sizes["sum"] > 0) & (sizes["sum"] < sizes["count"])])]
    gc = np.array([[b in "GC" for b in w] for w in words.sequence_context])
    hit = words.hit.to_numpy(bool)
    assert len(got) == 7 and np.allclose([got[k + 1].observed for k in range(7)], gc[hit].mean(0) - gc[~hit].mean(0), atol=1e-6)
    # Where no site passes, nothing is a hit and there is nothing to permute.
    fitted = chains.K.V.moderated
    monkeypatch.setattr(chains.K.V, "moderated", lambda fit: fitted(fit).withColumn("padj", chains.F.lit(0.99)))
    assert QUERIES["motif_permutation"](spark, SF).count() == 0
