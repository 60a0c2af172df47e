"""State with timers over several micro-batches: rows out of order, rows that join sessions, late rows, state that is dropped."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skeinspark.streaming import stateful, streams

T0 = datetime(2024, 1, 1)


def fed(spark, folder, batches):
    """A stream of one micro-batch for each list of (id, minutes, user, type, value)."""
    for k, rows in enumerate(batches):
        data = [(i, None if m is None else T0 + timedelta(minutes=m), u, t, v, None) for i, m, u, t, v in rows]
        spark.createDataFrame(data, streams.EVENTS).coalesce(1).write.parquet(f"{folder}/{k}")
    return streams.events(spark, f"{folder}/*", files_per_trigger=1)


def test_sessions_by_timer(spark, tmp_path):
    batches = [
        [(1, 0, 1, "view", 1.0), (2, 10, 1, "click", 2.0), (3, 50, 1, "view", None), (4, 5, 2, None, 1.0), (5, None, 1, "view", 9.0), (6, 20, None, "view", 4.0)],
        [(7, 31, 1, "view", 5.0), (8, 70, 2, "click", 1.0)],  # joins the two sessions of user 1, out of order
        [(9, 300, 2, "view", 1.0)],
        [(10, 2, 1, "error", 100.0), (11, 320, 2, "view", 1.0), (11, 320, 2, "view", 1.0)],  # the first is behind the watermark
        [(12, 10_000, 3, "view", 1.0)],
    ]
    told = []
    out = streams.run_to_end(stateful.timed_sessions(fed(spark, tmp_path, batches)), "timers", streams.ROCKS, told)
    got = sorted((r.user_id or 0, (r.start - T0).total_seconds() / 60, (r.finish - T0).total_seconds() / 60, r.n, r.kinds, r.most, r.total) for r in out.collect())
    assert got == [
        (0, 20.0, 50.0, 1, 1, "view", 4.0),
        (1, 0.0, 80.0, 4, 2, "view", 8.0),
        (2, 5.0, 35.0, 1, 1, "", 1.0),
        (2, 70.0, 100.0, 1, 1, "click", 1.0),
        (2, 300.0, 350.0, 3, 1, "view", 3.0),
    ]
    # Only the last user's session is left: its timer, span, count and time, in the store's own rows.
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in told if p["stateOperators"]]
    assert max(rows) > rows[-1] and rows[-1] <= 6


def test_sessions_equal_sql_in_any_order_within_the_watermark(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(9)
    minutes = np.sort(rng.integers(0, 3000, 240)) + 0.5
    order = np.argsort(minutes + rng.integers(0, 50, 240))  # at most 50 minutes late
    rows = [(int(k), float(minutes[k]), int(k % 4), "abc"[k % 3], 1.0) for k in order]
    batches = [rows[i : i + 60] for i in range(0, 240, 60)] + [[(999, 9000.0, 9, "a", 1.0)]]
    got = sorted((r.user_id, (r.start - T0).total_seconds() / 60, r.n, r.kinds) for r in streams.run_to_end(stateful.timed_sessions(fed(spark, tmp_path, batches), lateness="60 minutes"), "any", streams.ROCKS).collect())
    want = []
    for u in range(4):
        spans = []
        for m, t in sorted((r[1], r[3]) for r in rows if r[2] == u):
            if spans and m < spans[-1][0][-1] + 30:
                spans[-1][0].append(m)
                spans[-1][1].add(t)
            else:
                spans.append(([m], {t}))
        want += [(u, s[0][0], len(s[0]), len(s[1])) for s in spans]
    assert got == sorted(want) and len(want) > 40


def test_sessions_of_nothing(spark, tmp_path):
    stream = fed(spark, tmp_path, [[]])
    before = spark.conf.get(streams.STORE)
    assert streams.run_to_end(stateful.timed_sessions(stream), "none", streams.ROCKS).count() == 0
    assert spark.conf.get(streams.STORE) == before
