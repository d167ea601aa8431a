"""Special functions against known values, and string expressions at their edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtally.functions import strings as s
from tagtally.functions import tails as t


def test_tails():
    assert float(t.normal_sf(np.array(1.96))) == pytest.approx(0.0249978951, abs=1e-9)
    assert t.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-8)
    assert t.t_sf(-2.228138852, 10) == pytest.approx(0.975, abs=1e-8)
    assert t.t_sf(1.5, math.inf) == pytest.approx(float(t.normal_sf(np.array(1.5))))
    assert t.f_sf(2.228138852**2, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert t.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert float(t.digamma(np.array(1.0))) == pytest.approx(-0.5772156649, abs=1e-9)
    assert float(t.trigamma(np.array(1.0))) == pytest.approx(math.pi**2 / 6, abs=1e-9)


@given(st.floats(1e-4, 1e4))
@settings(max_examples=40, deadline=None)
def test_trigamma_inverse(x):
    assert float(t.trigamma(t.trigamma_inverse(x))) == pytest.approx(x, rel=1e-6)


@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=40, deadline=None)
def test_hypergeometric_sums_to_one(good, bad, drawn):
    drawn = min(drawn, good + bad)
    assert sum(t.hypergeometric_pmf(k, good, bad, drawn) for k in range(drawn + 1)) == pytest.approx(1)
    assert t.hypergeometric_sf(0, good, bad, drawn) == pytest.approx(1)


def test_intersection_of_sets():
    pmf = t.intersection_pmf(50, [20, 12, 30])
    assert pmf.sum() == pytest.approx(1) and (pmf * np.arange(len(pmf))).sum() == pytest.approx(20 * 12 * 30 / 50**2)
    two = t.intersection_pmf(40, [10, 15])
    assert two[4] == pytest.approx(t.hypergeometric_pmf(4, 10, 30, 15))


def test_intersection_of_large_sets():
    import time

    begun = time.monotonic()
    pmf = t.intersection_pmf(200_000, [110_000, 112_000, 115_000])
    assert time.monotonic() - begun < 60  # every pair of sizes would take hours
    at = np.arange(len(pmf))
    mean = 110_000 * 112_000 * 115_000 / 200_000**2
    assert pmf.sum() == pytest.approx(1) and (pmf * at).sum() == pytest.approx(mean)
    small = t.intersection_pmf(300, [140, 150])  # tails keep their relative precision
    assert all(small[k] == pytest.approx(t.hypergeometric_pmf(k, 140, 160, 150), rel=1e-9, abs=0) for k in range(141))


def test_hypergeometric_row_at_its_ends():
    assert t.hypergeometric_row(0, 0, 0) == (0, np.array([1.0])) and t.hypergeometric_row(4, 0, 3) == (3, np.array([1.0]))
    at, row = t.hypergeometric_row(3, 2, 4)
    assert at == 2 and row == pytest.approx([0.6, 0.4])


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, s.umi_of(F.col("q")), q="read_1_ACGT") == "ACGT"
    assert one(spark, s.umi_of(F.col("q")), q="read") is None
    assert one(spark, s.umi_or_tag(F.col("q"), F.col("r"), "RX"), q="a_CC", r="GG") == "GG"
    assert one(spark, s.umi_or_tag(F.col("q"), F.col("r"), "RX"), q="a_CC", r=None) == "CC"
    assert one(spark, s.umi_or_tag(F.col("q"), None, length=3), q="a_CC") is None
    assert one(spark, s.condition_of(F.col("q")), q="VH1P") is None and one(spark, s.condition_of(F.col("q"), True), q="VH1P") == "IP"
    assert one(spark, s.base_id(F.col("q")), q="VH1p") == "VH1"
    assert one(spark, s.site_transcript(F.col("q")), q="tx_1_22") == "tx_1" and one(spark, s.site_position(F.col("q")), q="tx_1_22") == 22
    assert one(spark, s.family_key(F.col("q")), q="SNORD13") == "small nucleolar rna c/d box"
    assert one(spark, s.family_key(F.col("q")), q="U6_sn-RNA,  x") == "u6 sn rna x"
    assert one(spark, s.context(F.col("q"), F.col("p"), 2), q="ACGT", p=1) == "NNACG" and one(spark, s.context(F.col("q"), F.col("p"), 2), q="ACGT", p=5) is None
    assert one(spark, s.center_kmer(F.col("q"), 3), q="ACGTA") == "CGT" and one(spark, s.center_kmer(F.col("q"), 3), q="AC") is None
    assert one(spark, s.valid_kmer(F.col("q"), 3), q="ACN") is False
    assert 0 <= one(spark, s.uniform_md5(F.col("q")), q="x") < 1 and 0 <= one(spark, s.uniform_udf(42)(F.col("q")), q="x") < 1
    assert len(one(spark, s.digest_udf(16)(F.col("q")), q="x")) == 32
