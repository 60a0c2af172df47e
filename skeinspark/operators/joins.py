"""Joins that Spark has no operator for: as-of, range and interval joins, as DataFrame compositions.

All work by time or value buckets, so that no task holds all rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from skeinspark.sources.scratch import staged

#: Rows of a side that is broadcast, at most; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Ways in which an as-of join looks: to the last row at or before, the first at or after, or the nearer of the two.
DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    left: DataFrame, right: DataFrame, on: str | list[str], left_time: str, right_time: str, value: str | list[str], bucket: Callable[[Column], Column] | None = None, alias: str | list[str] | None = None,
    direction: str = "backward", tolerance: str | None = None,
) -> DataFrame:
    """``left`` with values of a ``right`` row of the same keys (null if none): the last at or before its time, or as ``direction`` says.

    ``forward`` takes the first row at or after it, ``nearest`` the nearer of the two, of equally near ones the
    earlier. With a ``tolerance`` (an interval such as ``1 hour``) rows further away do not count. Of
    right rows with equal times the greatest values count. Null keys and times match nothing.
    Repeated left rows each stay; an empty side gives nulls or no rows. ``bucket`` is a function of the time
    column that never decreases, a day by default. ``alias`` names the new columns; a name that ``left`` has already is an error.

    Both sides shuffle once, by keys and bucket, and are sorted and walked within these. What holds
    beyond a bucket's border comes from one row for each key and bucket, which only the left rows
    meet that found nothing in their own.
    """
    keys, values, alias = _asof_names(on, value, alias, left.columns)
    a = left.select(F.struct(*(left[f"`{c}`"] for c in left.columns)).alias("row"), *_asof_keys(left, keys), F.col(left_time).alias("t"), F.lit(True).alias("asks"), F.lit(None).cast(_asof_kind(right, values)).alias("v"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (right_time, *keys)])
    r = right.filter(known)
    b = r.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *_asof_keys(r, keys), F.col(right_time).alias("t"), F.lit(False).alias("asks"), _asof_value(r, values).alias("v"))
    return _asof(a.unionByName(b), len(keys), alias, bucket, direction, tolerance)


def asof_within(rows: DataFrame, asks: Column, answers: Column, on: str | list[str], time: str, value: str | list[str], alias: str | list[str], bucket: Callable[[Column], Column] | None = None, direction: str = "backward", tolerance: str | None = None) -> DataFrame:
    """``asof_join`` of rows of one table, read once: those for which ``asks`` holds, with values of those for which ``answers`` holds. A row may be both."""
    keys, values, alias = _asof_names(on, value, alias, rows.columns)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (time, *keys)])
    sides = F.array_compact(F.array(F.when(asks, True), F.when(answers & known, False)))
    both = rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), *_asof_keys(rows, keys), F.col(time).alias("t"), F.explode(sides).alias("asks"), _asof_value(rows, values).alias("v"))
    only = lambda c, when: F.when(when, F.col(c)).alias(c)
    both = both.select(only("row", F.col("asks")), *(f"k{k}" for k in range(len(keys))), "t", "asks", only("v", ~F.col("asks")))
    return _asof(both, len(keys), alias, bucket, direction, tolerance)


def _asof_names(on: str | list[str], value: str | list[str], alias: str | list[str] | None, taken: list[str]) -> tuple[list[str], list[str], list[str]]:
    keys, values = [on] if isinstance(on, str) else list(on), [value] if isinstance(value, str) else list(value)
    alias = values if alias is None else [alias] if isinstance(alias, str) else list(alias)
    if clash := set(alias) & set(taken):
        raise ValueError(f"left has columns {sorted(clash)} already")
    return keys, values, alias


def _asof_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    return [df[f"`{c}`"].alias(f"k{k}") for k, c in enumerate(keys)]


def _asof_kind(df: DataFrame, values: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"v{k}", df.schema[v].dataType) for k, v in enumerate(values)])


def _asof_value(df: DataFrame, values: list[str]) -> Column:
    return F.struct(*(df[f"`{v}`"].alias(f"v{k}") for k, v in enumerate(values)))


def _asof(both: DataFrame, n_keys: int, alias: list[str], bucket: Callable[[Column], Column] | None, direction: str, tolerance: str | None) -> DataFrame:
    """``both`` has row (null for the right side), keys k0, k1, ..., t, asks and v."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    keys = [f"k{k}" for k in range(n_keys)]
    ways = ("backward", "forward") if direction == "nearest" else (direction,)
    cut = bucket or (lambda t: F.date_trunc("day", t))
    dealt = both.withColumn("b", cut(F.col("t"))).repartition(*keys, "b")
    held = dealt
    for way in ways:  # rows that answer come before those that ask at the same time, the greatest values last
        time = F.asc("t") if way == "backward" else F.desc("t")
        order = W.Window.partitionBy(*keys, "b").orderBy(time, "asks", "v")
        inside = order.rowsBetween(W.Window.unboundedPreceding, 0)
        held = held.withColumns({way: F.last(F.when(~F.col("asks"), F.struct("t", "v")), ignorenulls=True).over(inside), f"{way}_end": F.lead(F.lit(1)).over(order).isNull()})
    ends = reduce(lambda x, y: x | y, [F.col(f"{way}_end") for way in ways])
    walked = staged(held.filter(F.col("asks") | ends).drop("v"), "asof")
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, "t")])
    out = walked.filter("asks").drop(*(f"{way}_end" for way in ways))
    for way in ways:
        by = W.Window.partitionBy(*keys).orderBy(F.asc("b") if way == "backward" else F.desc("b")).rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each bucket
        carried = walked.filter(f"{way}_end").filter(known).select(*keys, "b", F.last(way, ignorenulls=True).over(by).alias("carry")).filter("carry is not null")
        here = F.col(way).isNotNull()
        beyond = out.filter(~here & known).join(carried, [*keys, "b"], "left").withColumn(way, F.col("carry")).drop("carry")
        out = out.filter(here & known).unionByName(out.filter(~known).withColumn(way, F.lit(None).cast(out.schema[way].dataType))).unionByName(beyond.select(*out.columns))
    if tolerance:
        near = lambda way: F.when(F.expr(f"{way}.t >= t - INTERVAL {tolerance} AND {way}.t <= t + INTERVAL {tolerance}"), F.col(way))
        out = out.withColumns({way: near(way) for way in ways})
    if direction == "nearest":
        ahead = F.col("backward").isNull() | (F.col("forward.t") - F.col("t") < F.col("t") - F.col("backward.t"))
        found = F.when(F.col("forward").isNotNull() & ahead, F.col("forward")).otherwise(F.col("backward"))
    else:
        found = F.col(direction)
    return out.select("row.*", *(found["v"][f"v{k}"].alias(n) for k, n in enumerate(alias)))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join where ``low <= point <= high``, as an equi-join on slots and a recheck.

    Slots have levels of ``width``, 2 ``width``, 4 ``width`` and so on. A range goes to the
    level whose slots are as wide as itself, so it touches two of them however wide it is; a
    point goes to its slot of each level that occurs, of which there are about 60 at most.
    Adaptive execution splits slots that many points share. Nulls match nothing.
    """
    size = F.pow(F.lit(2.0), F.col("__level")) * F.lit(float(width))
    slot = lambda c: F.floor(F.col(c) / size).cast("long")
    span = (F.col(high) - F.col(low)).cast("double") / F.lit(float(width))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.when(span > 1, span).otherwise(F.lit(1.0))))).cast("int")
    leveled = ranges.filter(F.col(low) <= F.col(high)).withColumn("__level", level)
    levels = [r["__level"] for r in leveled.select("__level").distinct().collect()]  # powers of two
    spread = leveled.withColumn("__slot", F.explode(F.sequence(slot(low), slot(high))))
    placed = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__slot", slot(point))
    return placed.join(spread, ["__level", "__slot"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__level", "__slot")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Inner join on keys where ``right_time`` is after ``left_time`` by at most ``seconds``; key columns come once.

    Both sides are dealt by key and time slot, a left row to its own and the next slot.
    """
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / F.lit(seconds)).cast("long")
    a = left.withColumn("__slot", F.explode(F.array(slot(left_time), slot(left_time) + 1)))
    b = right.withColumn("__slot", slot(right_time))
    gap = F.col(right_time) - F.col(left_time)
    return a.join(b, [*on, "__slot"]).filter((F.col(right_time) > F.col(left_time)) & (gap <= F.expr(f"INTERVAL {seconds} SECONDS"))).drop("__slot")


#: Keys with more than one in so many left rows are salted; there are at most that many of them.
HOT_SHARE = 4096


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int) -> DataFrame:
    """Inner equi-join that deals the left rows of a hot key over ``salts`` tasks; only right rows of hot keys are repeated that often.

    Hot are keys of more than 1 / ``HOT_SHARE`` of the left rows (and two a task at least), so their list is bounded.
    """
    n = left.count()
    hot = left.groupBy(on).count().filter(F.col("count") > max(2 * salts, n // HOT_SHARE)).select(on, F.lit(True).alias("__hot"))
    a = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    repeated = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(repeated)).drop("__hot")
    return a.drop("__hot").join(b, [on, "__salt"]).drop("__salt")
