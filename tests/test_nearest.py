"""Nearest vectors against comparing everything: clusters, cells of many blocks, queries in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinspark.operators import nearest as N


def brute(rows, asked, k):
    out = []
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.linalg.norm(np.array(v, float)) > 0}
    for q in asked:
        if q in ok:
            near = sorted((-round(float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])), 6) + 0.0, i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, i, -s + 0.0, p) for p, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(spark, rows, asked, k):
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(4).withColumns({c: F.lit("clash") for c in ("key", "v", "cell", "block", "dim", "place", "a.b")})
    return sorted((r.query_id, r.id, r.similarity + 0.0, r.place) for r in N.nearest(df.filter(F.col("id").isin(asked)), df, "id", "e", k).collect())


@pytest.mark.parametrize("block_bytes", [8 << 20, 4096])
def test_nearest_of_clusters(spark, monkeypatch, block_bytes):
    """A third of all rows in one cluster, copies, and rows of other kinds; cells are cut in blocks and queries in parts."""
    monkeypatch.setattr(N, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(N, "QUERIES_AT_ONCE", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16))
    rows = [(k, (centre[0 if k % 3 == 0 else k % 30] + 0.2 * rng.normal(size=16)).round(3).tolist()) for k in range(900)]
    rows += [(900 + k, rows[3][1]) for k in range(20)] + [(930, None), (931, [0.0] * 16), (932, [1.0, None] * 8), (933, [float("nan")] * 16), (934, [float("inf")] + [1.0] * 15), (935, []), (None, [1.0] * 16)]
    rows += [(940 + k, rng.normal(size=3).tolist()) for k in range(12)] + [(960, [1.0, 2.0])]
    asked = [*range(0, 900, 50), 905, 930, 931, 932, 935, 941, 960]
    got, want = found(spark, rows, asked, 7), brute(rows, asked, 7)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_cells_are_left_out(spark):
    """Of well parted clusters, the rows of few are compared."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 32))
    v = np.repeat(centre, 100, 0) + 0.01 * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centroids = N.fit_cells(v[rng.permutation(4000)[:2000]], 30)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<double>").withColumn("dim", F.size("v"))
    dealt = N._dealt(df, {32: centroids})
    reach = {(r.dim, r.cell): (r.n, r.low) for r in dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("low")).collect()}
    asked = df.filter("key % 50 = 0").withColumn("floor", F.lit(0.999))
    met = N._visits(asked, {32: centroids}, reach, 1, True).count() + N._visits(asked, {32: centroids}, reach, 1, False).count()
    assert met < 0.25 * 80 * len(reach)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, e array<double>")
    assert N.nearest(df.limit(0), df, "id", "e", 2).count() == 0
    assert N.nearest(df, df.limit(0), "id", "e", 2).count() == 0
    assert N.nearest(df.limit(0), df.limit(0), "id", "e", 2).count() == 0
