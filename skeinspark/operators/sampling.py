"""Samples of an exact size, by priorities that depend on a row's key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Slots of a stratum whose best rows are found on their own, so that no task meets those of all others.
SLOTS = 64


def priority(key: Column | str, seed: int) -> Column:
    """Hex digits of a hash of the seed and the key, as if drawn at random; null is a key of its own."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def sample_exact(rows: DataFrame, strata: str | list[str], key: str, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows of each stratum (all, where it has fewer), with column ``place`` from 1: those of the lowest priorities.

    Without replacement, and the same for the same keys wherever the rows lie; a sample of fewer rows is
    the beginning of one of more, and samples of parts, sampled again together, are that of the whole.
    Keys should be unique: of rows that share one, any comes first. Null strata are strata. An
    empty table gives no rows. Tasks keep ``k`` rows of a stratum and slot before anything shuffles.
    """
    by = [strata] if isinstance(strata, str) else list(strata)
    if "place" in rows.columns:
        raise ValueError("rows have a column place already")
    whole = rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), *(rows[f"`{c}`"].alias(f"s{i}") for i, c in enumerate(by)), priority(rows[f"`{key}`"], seed).alias("priority"))
    groups = [f"s{i}" for i in range(len(by))]
    told = whole.withColumn("slot", F.pmod(F.xxhash64("priority"), F.lit(SLOTS)))
    for part in ([*groups, "slot"], groups):
        told = told.withColumn("place", F.row_number().over(W.partitionBy(*part).orderBy("priority"))).filter(F.col("place") <= k)
    return told.select("row.*", "place")
