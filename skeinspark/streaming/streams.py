"""Structured Streaming: file sources, watermarked operators and a run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinspark.sources.scratch import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events of a Parquet file or folder as a stream. Watermarks need ``timestamp``, so ``ts`` is cast."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    glob = path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path only a folder
    return reader.parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


#: The setting that names the store of state, and the store that keeps it outside the heap, as state with timers needs.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, name: str, store: str | None = None, told: list | None = None, path: str | None = None) -> DataFrame:
    """Process all that is there in append mode into Parquet files, exactly once, and read them.

    ``store`` names a state store for this run; the session's setting stays. ``told`` gets the progress of the batches.
    ``path`` is the folder of an earlier run of the same stream, which then goes on from there.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, f"stream-{name}")
    before = spark.conf.get(STORE)
    try:
        if store:
            spark.conf.set(STORE, store)
        started = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        if store:
            spark.conf.set(STORE, before)
    started.awaitTermination()
    if told is not None:
        told += started.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_in_order(spark: SparkSession, path: str, parts: list[str], plan: Callable[[DataFrame], DataFrame], name: str, **terms: str) -> DataFrame:
    """What ``plan`` makes of the events of a table that arrive part by part (each a condition), in the order given. ``terms`` are columns that conditions may name.

    Each part is written to the shared folder by as many tasks as read it, and the stream then goes on from its last checkpoint over the new files.
    """
    feed, done = scratch(spark, "feed"), scratch(spark, f"stream-{name}")
    rows = spark.read.schema(EVENTS).parquet(path)
    named = rows
    for term in reversed(terms):
        named = named.withColumn(term, F.expr(terms[term]))
    for k, part in enumerate(parts):
        named.filter(part).select(*rows.columns).write.parquet(f"{feed}/{k}")
        out = run_to_end(plan(events(spark, f"{feed}/*")), name, path=done)
    return out


def windowed_counts(stream: DataFrame, lateness: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; a window is emitted when the watermark has passed its end."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", lateness).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("finish"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def followed_by(stream: DataFrame, first: str, then: str, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Stream-stream join: pairs of events of one user, the second at most ``within`` after the first."""
    a = stream.filter(F.col("event_type") == first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", lateness)
    b = stream.filter(F.col("event_type") == then).select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", lateness)
    on = (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("user_id", "first_id", "then_id")


def running_totals(stream: DataFrame) -> DataFrame:
    """Custom state: each user's number of events and sum so far, emitted whenever it changes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)
