"""Exact quantiles of groups of any size and number, by order statistics on the values' own types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skeinspark.operators.joins import small
from skeinspark.sources.scratch import staged

#: Distinct values of a range that is sorted in one task, about.
RANGE_ROWS = 1 << 20
_FLOATS = (T.FloatType, T.DoubleType)
_EXACT = (T.LongType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _between(a: Column, b: Column, part: Column, kind: T.DataType) -> Column:
    """The value at ``part`` (0 to 1) between two neighbours: of longs and decimals a decimal, of times a time, else a double."""
    if isinstance(kind, _EXACT):
        a, b = (c.cast("decimal(38,9)" if isinstance(kind, T.DecimalType) else "decimal(29,9)") for c in (a, b))
        return (a + ((b - a) * part.cast("decimal(9,8)"))).cast("decimal(38,9)")
    if isinstance(kind, _TIMES):
        return F.when(part == 0, a).otherwise(a + (b - a) * part)
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"values between two of {kind.simpleString()} are not defined; use disc")
    a, b = a.cast("double"), b.cast("double")
    endless = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return F.when((part == 0) | (a == b), a).when(endless, a * (1 - part) + b * part).otherwise(a + (b - a) * part)


def _ranks(wanted: list[tuple[str, float, str]], n: Column) -> list[Column]:
    """The ranks (from 0) that the wanted shares of ``n`` values need."""
    out = []
    for _, share, kind in wanted:
        at = F.lit(share) * (n - 1)
        out += [F.floor(at), F.ceil(at)] if kind == "cont" else [F.greatest(F.lit(0), F.ceil(F.lit(share) * n) - 1)]
    return [c.cast("long") for c in out]


def _of_kind(rows: DataFrame, group: str, kind: T.DataType, columns: dict[str, list[tuple[str, float, str]]]) -> DataFrame:
    """Quantiles of the columns of one type: g and the names that are wanted."""
    value = lambda c: F.when(~F.isnan(F.col(c)), F.col(c)) if isinstance(kind, _FLOATS) else F.col(c)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), value(c).alias("v")) for k, c in enumerate(columns))))
    # One row for each distinct value, so that one that a third of all rows have is no hot range.
    counted = rows.select(F.col(group).alias("g"), each.alias("e")).groupBy("g", "e.c", "e.v").agg(F.count("e.v").alias("n"))
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * len(columns) // RANGE_ROWS)
    ranged = staged(counted.repartitionByRange(pieces, "g", "c", "v").withColumn("piece", F.spark_partition_id()), "ranges")
    same = W.partitionBy("g", "c")  # a row for each range that a group has values in
    held = ranged.groupBy("g", "c", "piece").agg(F.sum("n").alias("n"))
    upto_piece = F.coalesce(F.sum("n").over(same.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = staged(held.select("g", "c", "piece", "n", F.sum("n").over(same).alias("total"), upto_piece.alias("before")), "held")
    wanted = [(k, *w) for k, ws in enumerate(columns.values()) for w in ws]
    ranks = [(k, r) for k, ws in enumerate(columns.values()) for r in _ranks(ws, F.col("total"))]
    needs = reduce(lambda x, y: x | y, [(F.col("c") == k) & (r >= F.col("before")) & (r < F.col("before") + F.col("n")) for k, r in ranks])
    need = held.filter((F.col("total") > 0) & needs).select(F.col("g").alias("of"), F.col("c").alias("col"), F.col("piece").alias("in"), "total", "before")
    near = ranged.filter("v is not null").join(small(need), F.col("g").eqNullSafe(F.col("of")) & (F.col("c") == F.col("col")) & (F.col("piece") == F.col("in")))
    upto = F.col("before") + F.sum("n").over(W.partitionBy("g", "c", "piece").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    told = near.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    at = lambda k, r: F.max(F.when((F.col("c") == k) & (r >= F.col("from")) & (r < F.col("upto")), F.col("v")))
    totals = [F.max(F.when(F.col("c") == k, F.col("total"))).alias(f"n{k}") for k in range(len(columns))]
    found = told.groupBy("g").agg(*totals, *(at(k, r).alias(f"r{i}") for i, (k, r) in enumerate(ranks)))
    out, i = [], 0
    for k, name, share, how in wanted:
        if how == "cont":
            part = F.lit(share) * (F.col(f"n{k}") - 1)
            out.append(_between(F.col(f"r{i}"), F.col(f"r{i + 1}"), part - F.floor(part), kind).alias(name))
        else:
            out.append(F.col(f"r{i}").alias(name))
        i += 2 if how == "cont" else 1
    groups = held.select(F.col("g").alias("of")).distinct()
    return groups.join(found.select("g", *out), F.col("of").eqNullSafe(F.col("g")), "left").select(F.col("of").alias("g"), *(f"`{w[1]}`" for w in wanted))


def exact_quantiles(rows: DataFrame, group: str, wanted: dict[str, tuple[str, float, str]]) -> DataFrame:
    """One row per group with quantiles: ``wanted`` has column, share (0 to 1) and kind (``cont`` or ``disc``) by name of the result.

    ``disc`` is a value of the column, in its type, whatever that is. ``cont`` lies between two neighbours: of
    bigints and decimals a decimal of nine digits, of timestamps a timestamp, of other numbers a double;
    other types have none, which is an error. Infinite values count as such; between an infinite value and
    a finite one lies the infinite one, between two infinite ones NaN. Nulls and NaN count as no
    value; a group without values has null quantiles. Null is a group of its own, and an empty table has none.

    Distinct values are counted, dealt to ranges of group and value, and a range's counts tell at which
    rank it begins; only ranges with a wanted rank are sorted. So neither a group nor a value
    meets in one task, groups may be as many as rows, and nothing goes through the driver.
    """
    kinds: dict[T.DataType, dict[str, list]] = {}
    for name, (column, share, kind) in wanted.items():
        if kind not in ("cont", "disc") or not 0 <= share <= 1:
            raise ValueError(f"{name}: a share is 0 to 1, a kind cont or disc")
        kinds.setdefault(rows.schema[column].dataType, {}).setdefault(column, []).append((name, share, kind))
    first, *others = [_of_kind(rows, group, kind, columns) for kind, columns in kinds.items()]
    for part in others:
        first = first.withColumnRenamed("g", "same group").join(part, F.col("same group").eqNullSafe(F.col("g"))).drop("same group")
    return first.select(F.col("g").alias(group), *(f"`{n}`" for n in wanted))
