"""Reading the Parquet tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tables(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """An SQL query over named tables of the folder. The session's own views stay as they are."""
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})
