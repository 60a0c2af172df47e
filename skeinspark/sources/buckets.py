"""Tables laid out in buckets, written once and joined without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from skeinspark.sources.scratch import scratch


def bucketed(df: DataFrame, key: str | list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` written in ``buckets`` buckets by ``key``, each sorted by it, and read from there: a table of the session's catalogue.

    Frames with the same keys and number of buckets join on them without an exchange, however often. ``path`` is a
    folder of the shared store; a scratch folder by default. Rows go to their bucket before they are written, so
    a bucket is one file. Null keys are a bucket's rows like others.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark, name = df.sparkSession, f"skein_bucketed_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)
