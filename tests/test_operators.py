"""Joins and streams on small fixtures with nulls, ties, empty tables and late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinspark.operators.joins import asof_join, interval_join, range_join, salted_join
from skeinspark.operators.nearest import nearest
from skeinspark.operators.quantiles import exact_quantiles
from skeinspark.operators.sorting import placed
from skeinspark.plans import catalogue
from skeinspark.sources import formats
from skeinspark.streaming import streams

from .conftest import SF

T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def test_asof_join(spark):
    left = [("a", 1), ("a", 30), ("a", 80), ("b", 5), (None, 3), ("a", None), ("c", 1)]
    right = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 29, 3.0), ("a", 31, 4.0), ("b", 6, 5.0), (None, 1, 6.0), ("a", None, 7.0), ("c", 0, None)]
    a = spark.createDataFrame([(k, at(t)) for k, t in left], "k string, t timestamp_ntz")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, u timestamp_ntz, v double")
    got = {(r.k, r.t): r.v for r in asof_join(a, b, "k", "t", "u", "v").collect()}
    assert got == {("a", at(1)): 2.0, ("a", at(30)): 3.0, ("a", at(80)): 4.0, ("b", at(5)): None, (None, at(3)): None, ("a", None): None, ("c", at(1)): None}
    assert asof_join(a, b.limit(0), "k", "t", "u", "v").filter("v is not null").count() == 0
    assert asof_join(a.limit(0), b, "k", "t", "u", "v").count() == 0


def test_range_join(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, -5.0), (5, None)], "id int, x double")
    ranges = spark.createDataFrame([(1, -5.0, 10.0), (2, 10.0, 10.0), (3, 5.0, 1.0), (4, None, 2.0)], "r int, low double, high double")
    got = {(r.id, r.r) for r in range_join(points, ranges, "x", "low", "high", 3).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (3, 2)}


def test_interval_join(spark):
    a = spark.createDataFrame([("u", at(0), 1), ("u", at(2), 2), (None, at(0), 3)], "k string, s timestamp_ntz, i int")
    b = spark.createDataFrame([("u", at(0), 1), ("u", at(1), 2), ("u", at(2.5), 3), (None, at(0.5), 4)], "k string, e timestamp_ntz, j int")
    assert {(r.i, r.j) for r in interval_join(a, b, ["k"], "s", "e", 3600).collect()} == {(1, 2), (2, 3)}


def test_salted_join(spark):
    a = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    b = spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert sorted(map(tuple, salted_join(a, b, "k", 8).collect())) == sorted(map(tuple, a.join(b, "k").collect()))


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_keep_nulls(spark, kind):
    df = spark.createDataFrame([(1, "a,b\"c", 1.5), (None, None, None), (3, "", -0.25)], "i int, s string, x double")
    assert sorted(map(str, formats.round_trip(df, kind).collect())) == sorted(map(str, df.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark of the batch before the last does not reopen its window."""

    def part(name, rows):
        df = spark.createDataFrame([(i, at(h), 1, "view", 1.0, None) for i, h in rows], streams.EVENTS)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")

    part("a", [(1, 0.5), (2, 10.0)])
    part("b", [(3, 20.0)])
    part("c", [(4, 0.6), (5, 30.0)])
    stream = streams.events(spark, f"{tmp_path}/*", files_per_trigger=1)
    got = {(r.start, r.n) for r in streams.run_to_end(streams.windowed_counts(stream), "late").collect()}
    assert (T0, 1) in got and len(got) >= 2


@pytest.mark.parametrize("pieces", [1, 4, 64])
def test_placed(spark, pieces):
    rows = [(k * 7919 % 1009, [None, 0, 1, 2][k % 4]) for k in range(300)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "k bigint, v int")
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    assert [(r.k, r.v) for r in sorted(placed(df, "v", "k", pieces).collect(), key=lambda r: r.place)] == want
    assert placed(df.limit(0), "v", "k", pieces).count() == 0


def test_sort_nulls_has_every_row(spark):
    got = catalogue.queries()["o1_sort_nulls"](spark, SF).collect()
    assert len(got) == 200 and [r.place for r in got] == list(range(1, 201))
    assert [r.quality is None for r in got] == [True] * 113 + [False] * 87


def test_pivot_counts_every_event(spark):
    rows = catalogue.queries()["a10_pivot"](spark, SF).collect()
    assert sum(sum(r[1:]) for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_table_udf_meets_whole_texts(spark):
    """Words put together again are the texts, the longest and the empty ones too."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in catalogue.queries()["x3_table_udf_documents"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.part] = r.word
    assert {k: " ".join(w[i] for i in sorted(w)) for k, w in got.items()} == docs


def test_exact_quantiles(spark):
    """Against numpy: ties, nulls, NaN, a null group, a group without values, and values far apart."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=301).tolist(), "b": [5.0] * 40 + [7.0], "c": [1e300, -1e300, 0.0, 1e-300], None: rng.integers(0, 9, 50).astype(float).tolist(), "d": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    wanted = {"m": ("v", 0.5, "cont"), "q": ("v", 0.9, "disc"), "low": ("v", 0.0, "cont"), "top": ("v", 1.0, "disc")}
    got = {r.g: r for r in exact_quantiles(df, "g", wanted).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = [None] * 4 if not vs else [float(np.percentile(vs, 50)), float(np.percentile(vs, 90, method="inverted_cdf")), min(vs), max(vs)]
        assert [got[g].m, got[g].q, got[g].low, got[g].top] == (want if not vs else pytest.approx(want, rel=1e-12))
    assert exact_quantiles(df.limit(0), "g", wanted).count() == 0


def test_range_join_of_wide_ranges(spark):
    points = [(k, float(k * 37 % 1000)) for k in range(300)]
    ranges = [(k, float(k * 91 % 900), float(k * 91 % 900) + w) for k, w in enumerate([0.0, 0.5, 3.0, 10.0, 11.0, 400.0, 1e6])]
    a, b = spark.createDataFrame(points, "id int, x double"), spark.createDataFrame(ranges, "r int, low double, high double")
    got = sorted((r.id, r.r) for r in range_join(a, b, "x", "low", "high", 10).collect())
    assert got == sorted((i, r) for i, x in points for r, lo, hi in ranges if lo <= x <= hi)
    assert range_join(a, b.limit(0), "x", "low", "high", 10).count() == 0


def test_salted_join_of_a_hot_key(spark):
    a = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(900)] + [(None, -1)], "k long, id long")
    b = spark.createDataFrame([(7, "x"), (7, "y"), (3, "z"), (None, "n")], "k long, v string")
    assert sorted(map(tuple, salted_join(a, b, "k", 8).collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    assert salted_join(a.limit(0), b, "k", 8).count() == 0


def test_asof_join_by_several_keys_and_values(spark):
    a = spark.createDataFrame([("a", 1, at(5)), ("a", 2, at(5)), ("b", 1, at(5))], "k string, j int, t timestamp_ntz")
    b = spark.createDataFrame([("a", 1, at(1), 1.0, "x"), ("a", 2, at(6), 2.0, "y"), ("b", 1, at(-30), 3.0, None)], "k string, j int, u timestamp_ntz, v double, w string")
    got = {(r.k, r.j): (r.p, r.q) for r in asof_join(a, b, ["k", "j"], "t", "u", ["v", "w"], alias=["p", "q"]).collect()}
    assert got == {("a", 1): (1.0, "x"), ("a", 2): (None, None), ("b", 1): (3.0, None)}
    with pytest.raises(ValueError):
        asof_join(a, b, "k", "t", "u", "v", alias="t")


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0, None]), (8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    got = [(r.query_id, r.id, r.similarity, r.place) for r in nearest(df.filter("id in (1, 3, 6)"), df, "id", "e", 2).collect()]
    assert sorted(got) == [(1, 2, 1.0, 1), (1, 4, 0.707107, 2), (3, 1, 0.0, 2), (3, 4, 0.707107, 1)]
    assert nearest(df.limit(0), df, "id", "e", 2).count() == 0


def test_views_of_the_session_stay(spark):
    spark.range(1).createOrReplaceTempView("lineitem")
    for name in ("a9_filtered_having", "j11_exists", "a5_within_group"):
        assert catalogue.queries()[name](spark, SF).count() > 0
    assert spark.table("lineitem").columns == ["id"]


def asof_brute(left, right, direction, tolerance):
    out = []
    for k, t in left:
        near = None
        able = [(u, v) for j, u, v in right if None not in (k, t, u) and j == k]
        back = max(((u, v) for u, v in able if u <= t), default=None)
        ahead = min(((u, -v) for u, v in able if u >= t), default=None)
        ahead = ahead and (ahead[0], -ahead[1])
        if tolerance is not None:
            back, ahead = (x if x and abs(x[0] - t) <= tolerance else None for x in (back, ahead))
        if direction == "nearest":
            near = ahead if ahead and (not back or ahead[0] - t < t - back[0]) else back
        else:
            near = back if direction == "backward" else ahead
        out.append((k, t, near and near[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_directions(spark, direction, tolerance):
    """Against comparing everything: a hot key, ties, rows at a bucket's border, empty buckets, nulls, and clashing names."""
    import random

    r = random.Random(4)
    left = [(r.choice("aaab") if k % 9 else None, r.choice([None, *range(0, 400, 6)])) for k in range(150)] + [("c", 24), ("c", 48), ("c", 24)]
    right = [(r.choice("aab") if k % 9 else None, r.choice([None, *range(0, 400, 4)]), float(k)) for k in range(60)] + [("c", 24, 1.0), ("c", 24, 2.0), ("c", 72, 3.0)]
    clash = ("row", "t", "k0", "v", "b", "asks", "backward", "a.b")
    a = spark.createDataFrame([(k, at(t)) for k, t in left], "k string, time timestamp_ntz").withColumns({c: F.lit("clash") for c in clash})
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, u timestamp_ntz, x double").withColumns({c: F.lit("clash") for c in clash})
    told = asof_join(a, b, "k", "time", "u", "x", direction=direction, tolerance=None if tolerance is None else f"{tolerance} hours")
    assert told.columns == [*a.columns, "x"] and {x["a.b"] for x in told.select("`a.b`").collect()} == {"clash"}
    want = [(k, at(t), v) for k, t, v in asof_brute(left, right, direction, tolerance)]
    assert sorted(map(str, ((x.k, x.time, x.x) for x in told.collect()))) == sorted(map(str, want))


def test_asof_within_reads_and_deals_the_rows_once(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    plans = []
    from skeinspark.operators import joins

    real = joins.staged
    joins.staged = lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1]
    try:
        got = joins.asof_within(e, F.col("event_type") == "purchase", F.col("event_type") == "view", "user_id", "ts", "value", "last").count()
    finally:
        joins.staged = real
    assert got == e.filter("event_type = 'purchase'").count()
    assert plans[0].count("FileScan") == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_exact_quantiles_of_types(spark):
    """Bigints beyond doubles, decimals, infinities, times, strings, and far more groups than fit a driver's list."""
    from decimal import Decimal

    big = 2**53
    inf = float("inf")
    rows = [(1, big, Decimal("0.10"), -inf, T0, "a"), (1, big + 1, Decimal("0.20"), inf, T0 + timedelta(hours=1), "b"), (1, big + 1, Decimal("0.30"), 5.0, T0 + timedelta(hours=4), "c"), (2, big + 1, None, inf, None, None), (2, big + 2, None, inf, None, None)]
    df = spark.createDataFrame(rows, "g int, l bigint, d decimal(20,2), x double, t timestamp_ntz, s string")
    wanted = {"l_cont": ("l", 0.5, "cont"), "l_disc": ("l", 0.5, "disc"), "d_cont": ("d", 0.25, "cont"), "d_disc": ("d", 0.9, "disc"), "x_low": ("x", 0.25, "cont"), "x_mid": ("x", 0.5, "cont"), "x_top": ("x", 1.0, "disc"), "t_cont": ("t", 0.75, "cont"), "s_disc": ("s", 0.5, "disc")}
    out = exact_quantiles(df, "g", wanted)
    got = {r.g: r for r in out.collect()}
    assert got[1].l_cont == big + 1 and got[1].l_disc == big + 1 and got[2].l_cont == Decimal(big) + Decimal("1.5") and got[2].l_disc == big + 1
    assert got[1].d_cont == Decimal("0.15") and got[1].d_disc == Decimal("0.30") and got[2].d_cont is None and got[2].s_disc is None
    assert (got[1].x_low, got[1].x_mid, got[1].x_top, got[2].x_mid) == (-inf, 5.0, inf, inf)
    assert got[1].t_cont == T0 + timedelta(hours=2, minutes=30) and got[1].s_disc == "b"
    assert dict(out.dtypes)["l_disc"] == "bigint" and dict(out.dtypes)["t_cont"] == "timestamp_ntz"
    with pytest.raises(ValueError):
        exact_quantiles(df, "g", {"m": ("s", 0.5, "cont")})
    many = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").alias("v"))
    told = exact_quantiles(many, "g", {"m": ("v", 0.5, "cont"), "q": ("v", 1.0, "disc")})
    assert told.count() == 20_000 and told.filter("m <> g + 20000 or q <> g + 40000").count() == 0
