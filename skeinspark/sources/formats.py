"""File formats: writing a frame and reading it back with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skeinspark.sources.scratch import scratch

FORMATS = ("parquet", "orc", "json", "csv", "text")


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write in one of ``FORMATS``. CSV has a header; text needs one string column."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    w = df.write.mode(mode)
    if kind == "csv":
        w = w.option("header", True).option("nullValue", "\\N")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read in one of ``FORMATS``. A schema is needed for CSV and JSON, so that no pass infers it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    r = spark.read.format(kind)
    if kind == "csv":
        r = r.option("header", True).option("nullValue", "\\N")
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark, "formats")
    write(df, path, kind)
    return read(spark, path, kind, df.schema if kind != "text" else None)
