"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm import _shared, ship, shipped
from skeinspark.llm.exact_dedup import drop_copies
from skeinspark.llm.jaccard_join import drop_near_copies
from skeinspark.llm.packing import pack_documents
from skeinspark.llm.quality import drop_rejected
from skeinspark.llm.suffix_dedup import remove_repeats


def _stage(function):
    """A stage. Its last job, which the caller starts, needs small batches as well, so the session's bound on Arrow batches stays lowered; ``run`` sets it back."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set(_shared.BATCHES, _shared.BATCH)
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("suffix_dedup", repeated_passages), ("packing", packing)]

#: The factorisation machine and the tokenizer have no SQL form.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a written stage has read is removed; what the returned frame reads stays until ``llm.discard`` or exit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, function in STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        path = _shared.scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        _shared.discard(out)
        docs = spark.read.schema(out.schema).parquet(path)
    out = STAGES[-1][1](spark, docs, sf_dir)
    if path not in _shared.read_by(out):
        _shared.forget(path)
    return out
