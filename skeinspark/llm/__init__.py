"""Operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import wraps
from importlib import import_module
from pathlib import Path

from . import _shared

_MODULES = ("jaccard_join", "packing", "suffix_dedup", "language_model", "embedding_dedup", "exact_dedup", "quality", "sharding", "bpe", "language", "source_audit", "mixing", "importance")


def ship(spark) -> None:
    """Give executors this package: once for each session, as a zip in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", False):
        return
    top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    folder = f"{_shared.shared_root(spark)}/skein-package-{uuid.uuid4().hex[:12]}"
    _shared._lasting[folder] = spark
    context.addPyFile(_shared.write_bytes(spark, f"{folder}/skeinspark_package.zip", packed.getvalue()))
    context._skein_shipped = True


def discard(df) -> None:
    """Remove the scratch folders that a query's frame reads, when it is no longer wanted."""
    _shared.discard(df)


def shipped(query):
    """A query whose package is on the executors, and whose jobs, but for the last, get small batches."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        with _shared.bounded_batches(spark):
            return query(spark, *args)

    return run


def queries() -> dict:
    return {k: shipped(v) for m in _MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE.items()}
