"""Importance resampling towards a target distribution of hashed n-grams.

A task maps the distinct words of a stretch of text to whole numbers and n-grams to tuples
of them. Each distinct tuple's bytes are put together and hashed once, and its bucket is
joined back to where the tuple stands. Buckets of all documents and of the target texts
are counted, a bucket's gain is the logarithm of the ratio of its two shares, and the
documents of the highest perturbed weights are drawn.

The dictionary of words is one of each stretch and task: one of the whole corpus would
send every word of every text through a shuffle to learn its number, and distinct n-grams
grow nearly as fast as the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import numbered, ragged, settled, stage, tidy
from ._words import NO_LETTER_OR_DIGIT, Words, slices, words

BUCKETS, LENGTHS, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Words whose n-grams are made at once; their numbers need ``_BITS`` bits, three of which fit a 64-bit tuple.
_STRETCH, _BITS = 1 << 18, 20
#: Bytes of a tuple that are hashed for all tuples side by side; longer ones go to zlib.
_STEPPED = 96


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def span_checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 (unsigned) of byte spans: a byte of all of them at a time, long ones by zlib."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    begin, length = start[order], size[order]
    first = int(np.searchsorted(-length, -_STEPPED, "left"))
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(length[first]) if first < len(length) else 0):
        live = slice(first, int(np.searchsorted(-length, -k, "left")))  # those longer than k
        s = state[live]
        state[live] = (s >> np.uint32(8)) ^ _CRC[(s ^ data[begin[live] + k]) & np.uint32(255)]
    out[order] = ~state
    for j in order[:first].tolist():
        out[j] = zlib.crc32(data[start[j] : start[j] + size[j]])
    return out


def _stretch_buckets(w: Words, lo: int, hi: int, lengths: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of all n-grams that begin at words ``lo:hi``."""
    end = min(len(w.start), hi + lengths - 1)
    _, first, ids = np.unique(w.hash[lo:end], return_index=True, return_inverse=True)
    row, n = w.row[lo:end], hi - lo
    # The dictionary's words, each with a space behind it.
    size = (w.end - w.start)[lo:end][first]
    at = np.cumsum(size + 1) - size - 1
    spelt = np.full(int((size + 1).sum()), 32, np.uint8)
    spelt[ragged(at, size)] = w.data[ragged(w.start[lo:end][first], size)]
    rows, out = [], []
    for k in range(1, lengths + 1):
        m = min(n, len(ids) - k + 1)
        if m <= 0:
            break
        here = np.flatnonzero(row[:m] == row[k - 1 : k - 1 + m])
        tuples = np.zeros(len(here), np.int64)
        for j in range(k):
            tuples = tuples << _BITS | ids[here + j]
        distinct, back = np.unique(tuples, return_inverse=True)
        bucket = np.empty(len(distinct), np.uint32)
        for a in range(0, len(distinct), 1 << 16):
            part = distinct[a : a + (1 << 16)]
            word = np.stack([part >> _BITS * (k - 1 - j) & (1 << _BITS) - 1 for j in range(k)], 1).ravel()
            total = (size[word] + 1).reshape(-1, k).sum(1)
            spelling = spelt[ragged(at[word], size[word] + 1)]  # the reconstructed bytes; the last space of each is left out
            bucket[a : a + len(part)] = span_checksums(spelling, np.cumsum(total) - total, total - 1) % np.uint32(buckets)
        rows.append(row[here])
        out.append(bucket[back])
    return np.concatenate(rows), np.concatenate(out)


def text_features(column: pa.Array, lengths: int = LENGTHS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For slices of rows: the number of words of each row, and the sorted buckets of its n-grams as steps of 16 bits."""
    for _, _, data, offs in slices(column):
        w = words(data, offs, breaks=NO_LETTER_OR_DIGIT)
        parts = [_stretch_buckets(w, lo, min(lo + _STRETCH, len(w.start)), lengths, buckets) for lo in range(0, len(w.start), _STRETCH)]
        key = np.sort(np.concatenate([r << 32 | b for r, b in parts])) if parts else np.zeros(0, np.int64)
        row = key >> 32
        bucket = (key & 0xFFFFFFFF).astype(np.int64)
        cut = np.searchsorted(row, np.arange(len(offs)))
        steps = np.diff(bucket, prepend=0)
        steps[cut[:-1][cut[:-1] < len(steps)]] = bucket[cut[:-1][cut[:-1] < len(steps)]]
        steps = steps.astype("<u2")
        yield w.counts(), [steps[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _bucket_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows of stored steps, and where each row begins."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    steps = np.frombuffer(data, "<u2")[offs[0] // 2 : offs[-1] // 2].astype(np.int64) if data is not None else np.zeros(0, np.int64)
    begin = (offs[:-1] - offs[0]) // 2
    total = np.cumsum(steps)
    before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0) if len(total) else np.zeros(len(begin), np.int64)
    return total - np.repeat(before, np.diff(np.append(begin, len(steps)))), begin


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: int = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and buckets (sorted, as steps of 16 bits) of every row's whole text; a null text has none."""
    if not 0 < buckets <= 1 << 16 or not 0 < lengths <= 3:
        raise ValueError("buckets have 16 bits and tuples three words at most")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lo = 0
            for n, steps in text_features(batch.column("text"), lengths, buckets):
                counts = np.array([len(s) // 2 for s in steps], np.int64)
                yield pa.record_batch([batch.column("doc_id").slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(counts), pa.array(steps, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])
                lo += len(n)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(told: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: tasks count, and ``buckets`` sums reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_bucket_values(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in told.select("buckets").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of each bucket's smoothed shares in the target and in the source."""
    t_all, s_all, size = float(target.sum()), float(source.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def weighted(told: DataFrame, gain: np.ndarray) -> DataFrame:
    """``told`` without buckets, with weight, the sum of the gains of a row's n-grams."""
    kind = told.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bucket, begin = _bucket_values(batch.column("buckets"))
            total = np.concatenate(([0], np.cumsum(gain[bucket])))
            weight = total[np.append(begin[1:], len(bucket))] - total[begin] if len(begin) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return told.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 g), where g is a Gumbel number seeded by the id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


@settled
def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank (of rows drawn; others null).

    ``target`` has the texts whose distribution is aimed at. Of the rows with ``least_words`` words,
    ``percent`` hundredths with the highest scores are drawn; ties go to smaller ids, null ids last,
    and between repeated rows any goes first. Null and empty texts have no n-grams and weight 0. Very
    long texts are worked on in stretches, as a whole. An empty table gives no rows; an empty target
    gives every n-gram the gain of an unseen one. Other columns are not read.
    """
    told = stage(features(docs, buckets=buckets), "features")
    aimed = bucket_counts(features(target, key="text", buckets=buckets), buckets)
    gain = gains(aimed, bucket_counts(told, buckets))
    score = (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")
    scored = stage(weighted(told, gain).withColumn("score", score), "scores")
    drawn = scored.filter(F.col("n_words") >= least_words).count() * percent // 100
    placed = numbered(scored.filter(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 has no function in DuckDB's SQL; the tests compare with a version written out.
ORACLE: dict[str, str] = {}
QUERIES = {"op13_importance": op13_importance}
