"""The nearest vectors of a stated set of queries, exactly: coarse cells, bounds, and products of blocks.

Rows are dealt to the nearest of some centroids, fitted on a bounded sample, and each cell
keeps how far its rows reach from the centroid. A query first meets the cells nearest to
it, which gives the similarity that its last place needs; then all other cells whose
reach could hold something as near. What a cell can't hold is never compared, and
nothing that could count is left out, so results are those of comparing everything.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skeinspark.operators.joins import small
from skeinspark.sources.scratch import staged

# Workers get this module with the functions, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of vectors that centroids are fitted on, cells at most, and rounds of fitting.
SAMPLE_BYTES, MOST_CELLS, ROUNDS = 16 << 20, 2048, 8
#: Bytes of vectors of a block of rows, and queries that meet it at once.
BLOCK_BYTES, QUERIES_AT_ONCE = 8 << 20, 4096
#: More than what rounding to six digits and sums in another order can shift a similarity.
SLACK = 2e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; empty cells take rows that are far from their own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = sample @ centroids.T
        cell, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _ready(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and unit vector of the rows that are near anything: those whose vectors have no nulls, are finite and not zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    known = df.select(F.col(key).alias("key"), v.alias("v")).withColumn("square", square(F.col("v"))).filter("square > 0 and square < double('infinity')")
    return known.select("key", F.transform("v", lambda x: x / F.sqrt("square")).alias("v"), F.size("v").alias("dim"))


def _dealt(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Rows with the nearest cell of their number of dimensions, and the cosine to its centroid (-1 where there is none)."""

    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cell, cosine = np.zeros(len(dim), np.int32), np.full(len(dim), -1.0)
            for d in np.unique(dim).tolist():
                if d in centroids:
                    at = np.flatnonzero(dim == d)
                    near = _matrix(batch.column("v").take(pa.array(at))) @ centroids[d].T
                    cell[at], cosine[at] = near.argmax(1), near.max(1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(cosine)], [*batch.schema.names, "cell", "cosine"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, v array<double>, dim int, cell int, cosine double")


def _visits(asked: DataFrame, centroids: dict[int, np.ndarray], reach: dict[tuple[int, int], tuple[int, float]], least: int, again: bool) -> DataFrame:
    """key, v, dim and cell for each cell that a query meets: the nearest ones with ``least`` rows, or (``again``) all others that may hold something of similarity ``floor``."""

    def run(batches):
        for batch in batches:
            dim, out = batch.column("dim").to_numpy(), ([], [])
            floor = batch.column("floor").to_numpy(zero_copy_only=False) if again else None
            for d in np.unique(dim).tolist():
                held = sorted(c for dd, c in reach if dd == d)
                if not held:
                    continue
                at = np.flatnonzero(dim == d)
                count, cosine = (np.array([reach[d, c][j] for c in held]) for j in (0, 1))
                if d in centroids:
                    near = np.clip(_matrix(batch.column("v").take(pa.array(at))) @ centroids[d][held].T, -1, 1)
                    far = np.maximum(np.arccos(near) - np.arccos(np.clip(cosine, -1, 1)), 0)
                    most = np.cos(far)  # nothing in the cell is nearer to the query
                else:
                    near = most = np.ones((len(at), len(held)))
                order = np.argsort(-near, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, order, before < least, axis=1)
                meets = (most >= floor[at][:, None] - SLACK) & ~first if again else first
                q, c = np.nonzero(meets)
                out[0].append(at[q])
                out[1].append(np.array(held, np.int32)[c])
            if out[0]:
                at, cell = np.concatenate(out[0]), np.concatenate(out[1])
                for lo in range(0, len(at), QUERIES_AT_ONCE):
                    told = batch.select(["key", "v", "dim"]).take(pa.array(at[lo : lo + QUERIES_AT_ONCE]))
                    yield pa.record_batch([*told.columns, pa.array(cell[lo : lo + QUERIES_AT_ONCE])], ["key", "v", "dim", "cell"])

    kind = asked.schema["key"].dataType.simpleString()
    return asked.mapInArrow(run, f"key {kind}, v array<double>, dim int, cell int")


def _met(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, key and similarity of the ``k`` best rows of each block that a query meets.

    Blocks hold rows of a cell; a cell of many rows has many, each met by its queries in parts of a bounded size.
    """
    kind = blocks.schema["key"].dataType.simpleString()

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, found, told = [], [], []
        if asked.num_rows and rows.num_rows:
            other = _matrix(rows.column("v").combine_chunks())
            # Rows by key, so that a stable sort by similarity leaves ties to the smaller one.
            order = np.asarray(pa.compute.sort_indices(rows.column("key")))
            other, names = other[order], rows.column("key").take(pa.array(order)).combine_chunks()
            for lo in range(0, asked.num_rows, 256):
                part = asked.slice(lo, 256)
                near = np.round(_matrix(part.column("v").combine_chunks()) @ other.T, 6) + 0.0
                take = min(k + 1, near.shape[1])  # one may be the query itself
                if take < near.shape[1]:
                    last = -np.partition(-near, take - 1, axis=1)[:, take - 1]
                    q, c = np.nonzero(near >= last[:, None])
                else:
                    q, c = np.nonzero(np.ones(near.shape, bool))
                best = np.lexsort((c, -near[q, c], q))
                q, c = q[best], c[best]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, c = q[place < take], c[place < take]
                ids.append(part.column("key").combine_chunks().take(pa.array(q)))
                found.append(names.take(pa.array(c)))
                told.append(near[q, c])
        key_type = asked.schema.field("key").type
        return pa.table({"query_id": pa.chunked_array(ids, key_type), "key": pa.chunked_array(found, key_type), "similarity": pa.array(np.concatenate(told) if told else np.zeros(0))})

    sizes = visits.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("met"))
    parts = sizes.select("dim", "cell", F.ceil(F.col("met") / QUERIES_AT_ONCE).cast("int").alias("parts"))
    counts = small(blocks.select("dim", "cell", "blocks").distinct().join(parts, ["dim", "cell"]))
    q = visits.join(counts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = blocks.drop("blocks").join(counts.drop("blocks"), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = ["dim", "cell", "block", "part"]
    pairs = q.select(*unit, "key", "v").groupBy(*unit).cogroup(r.select(*unit, "key", "v").groupBy(*unit))
    return pairs.applyInArrow(run, f"query_id {kind}, key {kind}, similarity double").filter("query_id <> key")


def _best(told: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    return told.withColumn("place", place).filter(F.col("place") <= k)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_id, ``key``, similarity (cosine, 6 digits) and place of the ``k`` nearest other rows of each query.

    Exact: cells that are left out hold nothing as near. Ties go to the smaller key. Vectors that
    are null, zero, not finite or hold nulls are near nothing, nor are those of other lengths; a
    query without others has no rows. Keys should be unique; null keys are near nothing. An empty
    table on either side gives no rows; other columns are not read.

    Cells grow with the root of the rows, up to ``MOST_CELLS``, and are cut in blocks of ``BLOCK_BYTES``, so
    blocks grow with the rows. Rows shuffle once for each part of the queries that meet their
    block. The sample, the centroids and a row for each cell are on the driver.
    """
    spark = rows.sparkSession
    ready = staged(_ready(rows, key, vector), "vectors")
    asked = staged(_ready(queries, key, vector).filter("key is not null"), "queries")
    dims = {r["dim"]: r["n"] for r in ready.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    centroids = {}
    for d, n in dims.items():  # of rarer numbers of dimensions, a number is one cell
        most = max(64, SAMPLE_BYTES // (8 * d * len(dims)))
        sample = ready.filter(F.col("dim") == d).sample(min(1.0, 1.2 * most / n), seed=3).limit(most).select("v").collect()
        cells = min(MOST_CELLS, int(math.sqrt(n)) // 2, len(sample) // 8)
        if cells > 1:
            centroids[d] = fit_cells(np.array([r["v"] for r in sample]), cells)
    dealt = staged(_dealt(ready, centroids), "cells")
    reach = {(r["dim"], r["cell"]): (r["n"], r["low"]) for r in dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("low")).collect()}
    told = spark.createDataFrame([(d, c, -(-n * d * 8 // BLOCK_BYTES)) for (d, c), (n, _) in reach.items()], "dim int, cell int, blocks int")
    blocks = dealt.filter("key is not null").select("key", "v", "dim", "cell").join(small(told), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    first = staged(_best(_met(_visits(asked, centroids, reach, 4 * (k + 1), False), blocks, k), k), "first")
    floors = first.filter(F.col("place") == k).select(F.col("query_id").alias("key"), F.col("similarity").alias("floor"))
    again = asked.join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    rest = _met(_visits(again, centroids, reach, 4 * (k + 1), True), blocks, k)
    return _best(first.drop("place").unionByName(rest), k).select("query_id", F.col("key").alias(key), "similarity", "place")
