"""Samples of an exact size, aggregates with partial states, bucketed layouts and table functions, on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinspark.operators import aggregation
from skeinspark.operators.sampling import sample_exact
from skeinspark.plans import catalogue
from skeinspark.sources.buckets import bucketed

from .conftest import SF


def test_sample_exact(spark):
    """The lowest priorities of each stratum, a hot one, a null one and a small one; larger samples begin with smaller ones."""
    rows = [(k, "hot" if k % 3 else [None, "a", "b", "tiny"][k % 4 if k != 9 else 3]) for k in range(600)] + [(None, "tiny")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(5).withColumns({c: F.lit("clash") for c in ("priority", "slot", "row", "s0", "a.b")})
    digest = lambda i: hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    told = {}
    for k in (5, 40):
        out = sample_exact(df, "s", "id", k)
        assert out.columns == [*df.columns, "place"]
        got = out.collect()
        for s in {r[1] for r in rows}:
            want = sorted((i for i, t in rows if t == s), key=digest)[:k]
            assert [r.id for r in sorted((r for r in got if r.s == s), key=lambda r: r.place)] == want
        told[k] = {(r.s, r.id) for r in got}
    assert told[5] < told[40]
    assert sample_exact(df.limit(0), "s", "id", 3).count() == 0
    with pytest.raises(ValueError):
        sample_exact(df.withColumn("place", F.lit(1)), "s", "id", 3)


@pytest.mark.parametrize("states", [50_000, 2])
def test_aggregate_by(spark, monkeypatch, states):
    monkeypatch.setattr(aggregation, "STATES", states)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.gamma(2, 3, 900) + 1e6, "a": rng.normal(size=50), None: rng.normal(size=7), "one": np.array([4.0]), "same": np.full(9, 2.5), "none": np.zeros(0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6).withColumns({c: F.lit("clash") for c in ("key", "state", "part", "c0")})
    got = {r.g: r for r in aggregation.aggregate_by(df, "g", ["v"], aggregation.Moments(), "n long, mean double, variance double, skewness double").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        r = got[g]
        if not len(v):
            assert (r.n, r.mean, r.variance, r.skewness) == (0, None, None, None)
            continue
        off = v - v.mean()
        assert r.n == len(v) and r.mean == pytest.approx(v.mean()) and r.variance == pytest.approx((off**2).mean(), rel=1e-6, abs=1e-12)
        assert r.skewness is None if (off == 0).all() else r.skewness == pytest.approx((off**3).mean() / (off**2).mean() ** 1.5, rel=1e-4)
    assert aggregation.aggregate_by(df.limit(0), "g", ["v"], aggregation.Moments(), "n long, mean double, variance double, skewness double").count() == 0


def test_bucketed_sides_join_without_an_exchange(spark):
    a = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.col("id") % 7).alias("k"), "id")
    b = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    left, right = bucketed(a, "k", 4), bucketed(b, "k", 4)
    joined = left.hint("merge").join(right, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    assert left.count() == 500 and bucketed(a.limit(0), "k", 4).count() == 0


def test_partitioned_table_function(spark):
    rows = catalogue.queries()["x3_partitioned"](spark, SF).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
