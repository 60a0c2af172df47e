"""Near-duplicate embeddings by a pivot-permutation index.

1. A vector is described by its ``NEAREST`` pivots (reference points) in order. The number
   of pivots grows with the root of the number of vectors.
2. Inverted lists hold, for each pivot, the vectors near it: ids and pivots only. Where two
   of a list share at least ``SHARED`` pivots they are candidates, found once, in the list of
   their smallest shared pivot. A list of more than ``SPLIT`` vectors is dealt to lists by
   the second smallest shared pivot as well.
3. Vectors are fetched for those that have a candidate in their list, and candidates are
   verified by cosine in double precision.

A list that is long even so holds vectors of almost the same pivots, a dense cluster whose
links all count; it is compared in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import join_by_key, settled, stage

#: Least cosine; nearest pivots kept, and of these to be shared.
COSINE, NEAREST, SHARED = 0.9, 16, 3
#: Pivots for each root of the number of vectors, and at most (their broadcast: 8 bytes a dimension each); those chosen far apart, at most; vectors of a list that is not dealt further; vectors of a block.
DENSITY, MOST_PIVOTS, FAR_APART, SPLIT, BLOCK = 2.0, 1 << 16, 4096, 4096, 2048
#: Bytes of pivots, which go to each worker, and of the rows that they are chosen from, which the driver holds; fewer are taken where vectors are long.
PIVOT_BYTES, SAMPLE_BYTES = 48 << 20, 96 << 20
_NO_ID = 1 << 62


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    with np.errstate(over="ignore"):
        v = v / np.abs(v).max(1, keepdims=True)  # very large and very small vectors keep their direction
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` rows of a sample, the first ``FAR_APART`` of them each as far as can be from those before it."""
    if len(sample) <= m:
        return sample
    nearest, chosen = np.full(len(sample), -2.0), [0]
    for _ in range(min(m, FAR_APART) - 1):
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
        chosen.append(int(nearest.argmin()))
    rest = np.setdiff1d(np.arange(len(sample)), chosen)[: m - len(chosen)]
    return sample[np.union1d(chosen, rest)]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    out, step = np.empty((len(x), nearest), np.int32), max(16, (1 << 22) // max(1, len(pivots)))
    for lo in range(0, len(x), step):
        sims = x[lo : lo + step] @ pivots.T
        top = np.argpartition(-sims, nearest - 1, axis=1)[:, :nearest]
        order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
        out[lo : lo + step] = np.take_along_axis(top, order, 1)
    return out


def candidates(near: np.ndarray, side: np.ndarray, first: int, second: int, shared: int):
    """Pairs of rows of a list that share at least ``shared`` pivots, of which ``first`` is the smallest, and ``second`` (unless -1) the next: in chunks."""
    ids, place, count = np.unique(near, return_inverse=True, return_counts=True)
    some = count > 1
    column = np.cumsum(some) - 1
    row, place = np.repeat(np.arange(len(near)), near.shape[1]), place.ravel()
    row, place = row[some[place]], place[some[place]]
    has = np.zeros((len(near), int(some.sum())), np.float32)
    has[row, column[place]] = 1
    # Shared pivots below the list's own: none, or where it is dealt by two, the first alone.
    low = has[:, ids[some] < (second if second >= 0 else first)]
    two = side.min() != side.max()
    for lo in range(0, len(near), 256):
        ok = has[lo : lo + 256] @ has.T >= shared
        ok &= low[lo : lo + 256] @ low.T == (1 if second >= 0 else 0)
        i, j = np.nonzero(ok)
        i += lo
        keep = i < j
        if two:
            keep &= side[i] != side[j]
        yield i[keep], j[keep]


def _links_of_unit(key, copies, vectors, near, side, first: int, second: int, cosine: float, shared: int):
    """Sums of link counts of each vector in one unit, and for each linked one the root of its part."""
    x = unit_rows(vectors)
    n = len(x)
    count, root = np.zeros(n, np.int64), np.arange(n)
    pairs_i, pairs_j = [], []
    for i, j in candidates(near, side, first, second, shared):
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            linked = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            pairs_i.append(a[linked])
            pairs_j.append(b[linked])
    i, j = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pairs_i, pairs_j))
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = count > 0
    return key[some], key[root[some]], count[some]


def _dimension_links(classes: DataFrame, n: int, size: int, cosine: float, shared: int, nearest: int) -> DataFrame:
    """(u, v, links) of classes of one dimension (vectors of ``size`` bytes): partial link counts of u, and an edge to v."""
    spark = classes.sparkSession
    m = int(min(MOST_PIVOTS, max(16, PIVOT_BYTES // size), max(16, DENSITY * np.sqrt(n))))
    wanted = max(m, min(4 * m if m <= FAR_APART else m + 3 * FAR_APART, SAMPLE_BYTES // size))
    sample = [r["vector"] for r in classes.orderBy(F.xxhash64("key"), "key").select("vector").limit(wanted).collect()]
    pivots = choose_pivots(unit_rows(sample), m)  # at most MOST_PIVOTS rows
    near_n = min(nearest, len(pivots))
    need = min(shared, near_n)
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def describe(batches):
        p = shared_pivots.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                near = np.sort(nearest_pivots(unit_rows(part.column("vector").to_pylist()), p, near_n), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near_n), pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.record_batch([part.column("key"), part.column("copies"), lists], ["key", "copies", "near"])

    told = stage(classes.select("key", "copies", "vector").mapInArrow(describe, "key long, copies long, near array<int>"), "pivots")
    # With ``need`` shared pivots, the smallest shared one is among the first of both in order of number.
    posted = told.select("key", "copies", "near", F.posexplode(F.slice("near", 1, near_n - need + 1)).alias("pos", "first"))
    sizes = posted.groupBy("first").count().select("first", (F.col("count") > SPLIT).alias("long"))  # a row for each pivot
    last = near_n - need + (2 if need > 1 else 1)  # the second smallest is there at most
    seconds = F.when(F.col("long") & F.lit(need > 1), F.expr(f"slice(near, pos + 2, {last} - pos - 1)")).otherwise(F.array(F.lit(-1)))
    lists = posted.join(F.broadcast(sizes), "first").withColumn("second", F.explode(seconds)).select("first", "second", "key", "copies", "near")
    # Lists that are still long go in pairs of blocks.
    counted = lists.groupBy("first", "second").count().filter(F.col("count") > 2 * BLOCK).select("first", "second", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    units = (
        lists.join(counted, ["first", "second"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("first", "second", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "key", "copies", "near")
    )
    unit = ["first", "second", "i", "j"]
    units = units.repartition(*unit)  # else all blocks of a list stay where its rows were counted

    def near_of(t: pa.Table) -> np.ndarray:
        return t.column("near").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

    def pick(t: pa.Table) -> pa.Table:
        """The rows of a unit that have a candidate in it."""
        some = np.zeros(t.num_rows, bool)
        if t.num_rows > 1:
            for i, j in candidates(near_of(t), t.column("side").to_numpy(), t.column("first")[0].as_py(), t.column("second")[0].as_py(), need):
                some[i] = some[j] = True
        return t.filter(pa.array(some))

    picked = stage(units.groupBy(*unit).applyInArrow(pick, units.schema), "candidates")

    def compare(t: pa.Table) -> pa.Table:
        key, copies, side = (t.column(k).to_numpy() for k in ("key", "copies", "side"))
        u, v, c = _links_of_unit(key, copies, t.column("vector").to_pylist(), near_of(t), side, t.column("first")[0].as_py(), t.column("second")[0].as_py(), cosine, need)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(c, pa.int64())})

    return picked.join(classes.select("key", "vector"), "key").groupBy(*unit).applyInArrow(compare, "u long, v long, links long")


@settled
def near_embeddings(vectors: DataFrame, cosine: float = COSINE, shared: int = SHARED, nearest: int = NEAREST) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Null and zero vectors, and those with null or non-finite components, link with nothing.
    Vectors of different lengths are never compared. Equal vectors link with each other, and
    repeated rows each count. Vectors may have any length. Rows with a null id link like others; a component without any
    id is null. An empty table gives no rows. Other columns are not read.
    """

    def prepare(batches):
        for batch in batches:
            lists = batch.column("embedding")
            blobs = []
            for k in range(batch.num_rows):
                value = lists[k]
                v = None if not value.is_valid or value.values is None or value.values.null_count else value.values.to_numpy(zero_copy_only=False).astype("<f8")
                good = v is not None and len(v) and np.isfinite(v).all() and v.any()
                blobs.append((v + 0.0).tobytes() if good else None)  # + 0.0: one zero
            yield pa.record_batch([batch.column("vec_id"), pa.array(blobs, pa.binary())], ["vec_id", "vector"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(prepare, "vec_id long, vector binary")
    rows = stage(rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    classes = stage(
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .withColumn("node", F.coalesce("node", F.expr(f"(key & {_NO_ID - 1}L) | {_NO_ID}L"))),
        "classes",
    )
    size = F.octet_length("vector")
    links = None
    for r in classes.groupBy(size.alias("size")).count().collect():  # the lengths that occur
        some = _dimension_links(classes.filter(size == r["size"]), r["count"], r["size"], cosine, shared, nearest)
        links = some if links is None else links.unionByName(some)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stage(links, "links")
    nodes = classes.select("key", "node")
    edges = links.filter("u != v").select("u", "v").distinct().join(nodes.select(F.col("key").alias("u"), F.col("node").alias("a")), "u").join(nodes.select(F.col("key").alias("v"), F.col("node").alias("b")), "v")
    label = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    facts = (
        classes.select("key", "node", "copies")
        .join(links.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("others")), "key", "left")
        .join(label, "node", "left")
        .select("key", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    )
    told = join_by_key(rows.filter("key is not null").select("vec_id", "key"), stage(facts, "facts"), "key", "copies").select("vec_id", "n_links", F.when(F.col("component_id") < _NO_ID, F.col("component_id")).alias("component_id"))
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op4_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
label AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM label
""",
}
QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
