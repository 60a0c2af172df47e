"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Word and bigram counts of all training texts are summed bucket by bucket. Words are kept
as a sorted array of hashes, whose places are the word ids; bigrams as a sorted array of
mixed pairs of ids, with counts beside them. These lie in the shared folder, and workers
map them into memory, so that a worker touches only the pages it looks up.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bucket_count, dealt, local_path, pack, scratch, stage, text_bytes, unpack
from ._words import U64, mix, slices, words
from .quality import in_fold

#: Share of the smallest count in the base model.
BASE = 0.1
#: Hash that stands for the end of a text in the list of words.
_END = U64(0x5E1D0F7E47E2D15A)
_FLUSH = 1 << 22
#: Words whose ids fit half of a 64-bit key.
MOST_WORDS = (1 << 32) - 1


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of a well-mixed value, so that sorted buckets make up a sorted whole."""
    return ((x >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _sum_by(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return [keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) if len(first) else c.astype(np.int64) for c in columns)]


def _narrow(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint8 if not len(c) or c.max() < 256 else np.uint32 if c.max() < 1 << 32 else np.int64)


def _create(path: str, kind, n: int) -> None:
    with open(path, "wb") as f:
        f.truncate(max(1, n) * np.dtype(kind).itemsize)


def _put(path: str, at: int, values: np.ndarray) -> None:
    """Write values at a place of an array's file; the same again after a lost task."""
    fd = os.open(path, os.O_WRONLY)
    try:
        data, place = memoryview(np.ascontiguousarray(values)).cast("B"), at * values.itemsize
        while len(data):
            done = os.pwrite(fd, data, place)
            data, place = data[done:], place + done
        os.fsync(fd)
    finally:
        os.close(fd)


@lru_cache(64)
def _mapped(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, kind, "r")


def _find(table: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys in a sorted table, -1 where absent."""
    if not n:
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table[:n], keys), n - 1)
    return np.where(table[at] == keys, at, -1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    if min(n) <= 0:
        return 0.75, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) for k in (1, 2, 3))


@dataclass
class KneserNey:
    """Where the arrays are, and the numbers that hold for all words."""

    folder: str
    kind: str
    words: int
    bigrams: int
    large: int
    tokens: int
    texts: int
    types: int
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    word_spare: float

    def array(self, name: str, kind: str) -> np.ndarray:
        return _mapped(f"{self.folder}/{name}", kind)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of sorted hashes, -1 for unknown words."""
        return _find(self.array("word", "<u8"), self.words, hashes)

    def word_count(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.array("count", "<i8")[np.maximum(ids, 0)], 0)

    def continuation(self, ids: np.ndarray) -> np.ndarray:
        """Lower-order probabilities: in how many contexts a word occurs, interpolated with a uniform share for all and one unknown word."""
        uniform = 1 / (self.words + 1)
        if not self.types:
            return np.full(len(ids), uniform)
        c = np.where(ids >= 0, self.array("contexts", self.kind)[np.maximum(ids, 0)], 0).astype(np.int64)
        d = np.array([0.0, *self.word_discount])[np.minimum(c, 3)]
        return (c - d) / self.types + self.word_spare * uniform

    def spare(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of known contexts: how often they occur, and the share that discounts leave. Id ``words`` is the start of a text."""
        total = np.where(ids == self.words, self.texts, self.array("count", "<i8")[np.minimum(ids, max(self.words - 1, 0))])
        left = np.zeros(len(ids))
        for k, name in enumerate(("once", "twice", "more")):
            left += self.pair_discount[k] * self.array(name, self.kind)[ids]
        return total, left / np.maximum(total, 1)

    def pair_count(self, mixed: np.ndarray) -> np.ndarray:
        """Counts of sorted mixed pairs."""
        at = _find(self.array("pair", "<u8"), self.bigrams, mixed)
        c = np.where(at >= 0, self.array("pair-count", "u1")[np.maximum(at, 0)], 0).astype(np.int64)
        big = np.flatnonzero(c == 255)
        if len(big):
            k = _find(self.array("large", "<u8"), self.large, mixed[big])
            c[big] = self.array("large-count", "<i8")[k]
        return c

    def log10(self, hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of texts one after the other, with ``_END`` after each (where ``last``): counts, base and model log10 probabilities."""
        distinct, back = np.unique(hashes, return_inverse=True)
        known = self.ids(distinct)
        ids = known[back]
        c = self.word_count(known)
        base = np.log10((c + BASE) / (self.tokens + BASE * (self.words + 1)))[back]
        lower = self.continuation(known)[back]
        context = np.empty(len(ids), np.int64)
        context[1:] = ids[:-1]
        start = np.ones(len(ids), bool)
        start[1:] = last[:-1]
        context[start] = self.words
        p = lower.copy()
        have = np.flatnonzero((context >= 0) & (self.texts > 0))
        if len(have):
            ctx, inv = np.unique(context[have], return_inverse=True)
            total, spare = self.spare(ctx)
            total, spare = total[inv], spare[inv]
            ok = total > 0  # a context of training texts
            p[have] = np.where(ok, spare * lower[have], lower[have])
            both = have[ok & (ids[have] >= 0)]
            pair = mix(context[both].astype(U64) << U64(32) | ids[both].astype(U64))
            mixed, inv2 = np.unique(pair, return_inverse=True)
            n = self.pair_count(mixed)
            d = np.array([0.0, *self.pair_discount])[np.minimum(n, 3)]
            p[both] += ((n - d)[inv2]) / total[ok & (ids[have] >= 0)]
        return c[back], base, np.log10(p)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words with an end after each text, where these ends are, and each text's number of tokens."""
    w = words(data, offs)
    n = w.counts() + 1
    end = np.cumsum(n) - 1
    hashes = np.empty(int(n.sum()), U64)
    last = np.zeros(len(hashes), bool)
    last[end] = True
    hashes[last] = _END
    hashes[~last] = w.hash
    return hashes, last, n


def train(docs: DataFrame, folds: int = 10) -> KneserNey:
    """Count the texts of all rows outside the held-out fold and lay the model out in the shared folder."""
    spark = docs.sparkSession
    texts = docs.filter(~in_fold("doc_id", folds)).select("text")
    _, size = text_bytes(docs)
    buckets = bucket_count(spark, size, 12 << 20)
    uri = scratch(spark, "language-model")
    folder = local_path(uri)
    os.makedirs(folder)

    def held_sums(batches, keys_of):
        held, n = [], 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                held.append(keys_of(*_tokens(data, offs)))
                n += len(held[-1])
                if n > _FLUSH:
                    yield np.unique(np.concatenate(held), return_counts=True)
                    held, n = [], 0
        if n:
            yield np.unique(np.concatenate(held), return_counts=True)

    def blocks_of(t: pa.Table) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*(unpack(b.as_py()) for b in t.column("block")))]

    # Words.
    def count_words(batches):
        for h, c in held_sums(batches, lambda h, last, n: h):
            yield dealt(_bucket(h, buckets), [h, c.astype(np.uint32)])

    def sum_words(t: pa.Table) -> pa.Table:
        h, c = _sum_by(*blocks_of(t))
        return pa.table({"bucket": t.column("bucket")[:1], "n": pa.array([len(h)]), "total": pa.array([int(c.sum())]), "block": pa.array([pack(h, _narrow(c))], pa.binary())})

    def laid_out(found: DataFrame, arrays: dict) -> int:
        """Writes blocks of sorted buckets into whole arrays, each at its place; the driver and each worker hold 8 bytes for a bucket of 12 MB."""
        sizes = found.select("bucket", "n").toArrow()
        first = np.zeros(buckets + 1, np.int64)
        first[sizes.column("bucket").to_numpy() + 1] = sizes.column("n").to_numpy()
        first = spark.sparkContext.broadcast(np.cumsum(first))
        n = int(first.value[-1])
        for name, kind in arrays.items():
            _create(f"{folder}/{name}", kind, n)

        def put(batches):
            for batch in batches:
                for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                    for (name, kind), values in zip(arrays.items(), unpack(block)):
                        if kind == "u1":
                            values = np.minimum(values, 255)
                        _put(f"{folder}/{name}", int(first.value[b]), values.astype(kind))
                yield pa.record_batch([batch.column("bucket")], ["bucket"])

        found.select("bucket", "block").mapInArrow(put, "bucket int").count()
        return n

    def summed(found: DataFrame, name: str, size: int) -> list[int]:
        """Sums of the elements of an array column."""
        row = found.agg(*(F.sum(F.col(name)[k]).alias(f"c{k}") for k in range(size))).first()
        return [v or 0 for v in row]

    found = stage(texts.mapInArrow(count_words, "bucket int, block binary").groupBy("bucket").applyInArrow(sum_words, "bucket int, n long, total long, block binary"), "words", "none")
    vocabulary = laid_out(found, {"word": "<u8", "count": "<i8"})
    if vocabulary >= MOST_WORDS:
        raise ValueError(f"{vocabulary} different words; pairs of ids hold fewer than {MOST_WORDS}")
    tokens = found.agg(F.sum("total")).first()[0] or 0
    kind = "<u4" if tokens < 1 << 32 else "<i8"  # of counts, none of which is above that of all tokens
    ends = texts.count()
    model = KneserNey(folder, kind, vocabulary, 0, 0, tokens, ends, 0, (0.75,) * 3, (0.75,) * 3, 1.0)

    # Bigrams of ids; the start of a text is the id after the last word.
    def pairs(h, last, n):
        distinct, back = np.unique(h, return_inverse=True)
        ids = model.ids(distinct)[back].astype(U64)
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        start = np.ones(len(ids), bool)
        start[1:] = last[:-1]
        context[start] = U64(vocabulary)
        return context << U64(32) | ids

    def count_pairs(batches):
        for k, c in held_sums(batches, pairs):
            yield dealt(_bucket(mix(k), buckets), [k, _narrow(c)])

    def sum_pairs(t: pa.Table) -> pa.Table:
        k, c = _sum_by(*blocks_of(t))
        m = mix(k)
        order = np.argsort(m)
        large = order[c[order] >= 255]
        context, *stats = _sum_by(k >> U64(32), c == 1, c == 2, c > 2)
        word, contexts = _sum_by(k & U64(0xFFFFFFFF), np.ones(len(k), np.uint8))
        return pa.table(
            {
                "bucket": t.column("bucket")[:1],
                "n": pa.array([len(k)]),
                "counts": pa.array([[int((c == x).sum()) for x in (1, 2, 3, 4)]], pa.list_(pa.int64())),
                "block": pa.array([pack(m[order], _narrow(c[order]))], pa.binary()),
                "n_large": pa.array([len(large)], pa.int64()),
                "large": pa.array([pack(m[large], c[large])], pa.binary()),
                "contexts": pa.array([pack(context, *map(_narrow, stats))], pa.binary()),
                "words": pa.array([pack(word, _narrow(contexts))], pa.binary()),
            }
        )

    found = stage(
        texts.mapInArrow(count_pairs, "bucket int, block binary").groupBy("bucket").applyInArrow(sum_pairs, "bucket int, n long, counts array<long>, block binary, n_large long, large binary, contexts binary, words binary"),
        "pairs",
        "none",
    )
    bigrams = laid_out(found.select("bucket", "n", "block"), {"pair": "<u8", "pair-count": "u1"})
    counts = summed(found, "counts", 4)
    # Pairs of 255 or more, in order of buckets: at most a 255th of all tokens.
    n_large = laid_out(found.select("bucket", F.col("n_large").alias("n"), F.col("large").alias("block")), {"large": "<u8", "large-count": "<i8"})

    # Statistics of words: buckets of equal ranges of ids.
    spans = max(1, min(buckets, vocabulary))
    width = -(-(vocabulary + 1) // spans)
    for name in ("once", "twice", "more", "contexts"):
        _create(f"{folder}/{name}", kind, vocabulary + 1)

    def deal_stats(batches):
        for batch in batches:
            for name in ("contexts", "words"):
                for block in batch.column(name).to_pylist():
                    ids, *stats = unpack(block)
                    if len(ids):
                        part = dealt((ids // U64(width)).astype(np.int64), [ids, *stats])
                        yield part.append_column("kind", pa.array([name] * part.num_rows))

    def sum_stats(t: pa.Table) -> pa.Table:
        span = t.column("bucket")[0].as_py()
        lo, hi = span * width, min((span + 1) * width, vocabulary + 1)
        sums = np.zeros((4, hi - lo), np.int64)
        for name, block in zip(t.column("kind").to_pylist(), t.column("block").to_pylist()):
            ids, *stats = unpack(block)
            at = ids.astype(np.int64) - lo
            if name == "contexts":
                for k in range(3):
                    sums[k, at] += stats[k]
            else:
                sums[3, at] += stats[0]
        for k, name in enumerate(("once", "twice", "more", "contexts")):
            _put(f"{folder}/{name}", lo, sums[k].astype(kind))
        c = sums[3]
        return pa.table({"total": pa.array([int(c.sum())]), "counts": pa.array([[int((c == x).sum()) for x in (1, 2, 3, 4)] + [int((c > 2).sum())]], pa.list_(pa.int64()))})

    spread = found.select("contexts", "words").mapInArrow(deal_stats, "bucket int, block binary, kind string")
    got = stage(spread.groupBy("bucket").applyInArrow(sum_stats, "total long, counts array<long>"), "statistics")
    types = got.agg(F.sum("total")).first()[0] or 0
    by_count = summed(got, "counts", 5)
    word_discount = discounts(by_count[:4])
    left = word_discount[0] * by_count[0] + word_discount[1] * by_count[1] + word_discount[2] * by_count[4]
    return KneserNey(folder, kind, vocabulary, bigrams, n_large, tokens, ends, types, discounts(counts), word_discount, left / types if types else 1.0)


def score(docs: DataFrame, model: KneserNey, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are a single end. Rows without an id are held out. Repeated rows
    score alike. Without training texts all words have one probability. An empty table
    gives no rows. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                hashes, last, n = _tokens(data, offs)
                c, base, full = model.log10(hashes, last)
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, full)]
                yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", in_fold("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_language_model": op5_language_model}
