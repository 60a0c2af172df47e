"""Places of all rows of a sort, where no task holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def placed(rows: DataFrame, value: str, key: str, pieces: int = 64, name: str = "place") -> DataFrame:
    """Every row with its place (column ``name``, from 1) by ``value`` descending with nulls first, then ``key`` ascending with nulls first.

    ``value`` has few distinct values and ``key`` is a number. Rows are numbered within their value and one of
    ``pieces`` ranges of keys; a piece begins after the rows of all pieces before it, of which there is one
    counted row each. A row's piece depends on its key only, so reading the rows twice tells the same.
    """
    cuts = rows.agg(F.percentile_approx(key, [k / pieces for k in range(1, pieces)]).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    told = rows.withColumn("__piece", F.size(F.filter(bounds, lambda b: b < F.col(key))))
    before = W.orderBy(F.desc_nulls_first(value), "__piece").rowsBetween(W.unboundedPreceding, -1)
    starts = told.groupBy(value, "__piece").agg(F.count(F.lit(1)).alias("__n")).select(F.col(value).alias("__v"), F.col("__piece").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy(value, "__piece").orderBy(F.asc_nulls_first(key)))
    numbered = told.withColumn("__inside", inside).join(F.broadcast(starts), F.col(value).eqNullSafe(F.col("__v")) & (F.col("__piece") == F.col("__p")))
    return numbered.select(*rows.columns, (F.col("__start") + F.col("__inside")).alias(name))
