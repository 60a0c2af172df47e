"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Scores take linear time by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.
It is fitted on a bounded sample of labelled rows; every row is scored from its whole text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import tidy
from ._words import U64, slices, words

#: Labelled rows to fit on at most, word buckets, factors, bins of each statistic, and the score from which a text is good.
SAMPLE, BUCKETS, FACTORS, BINS, THRESHOLD = 8000, 1 << 13, 8, 10, 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "shout": b"!?",
    "stop": b".,;:",
    "symbol": b"#$%&*+<=>@^_`|~/\\{}[]()",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_TABLES = np.zeros((len(_CLASSES), 256), bool)
for _k, _members in enumerate(_CLASSES.values()):
    _TABLES[_k, list(_members)] = True


def structure(data: np.ndarray, offs: np.ndarray, w) -> np.ndarray:
    """Statistics of each text: shares of byte classes, sizes, and how much words repeat."""
    n, size = len(offs) - 1, np.diff(offs)
    per = 1 / np.maximum(size, 1)
    total = np.zeros(len(data) + 1, np.int64)
    cols = []
    for t in _TABLES:
        np.cumsum(t[data], out=total[1:])
        cols.append(np.diff(total[offs]) * per)
    count = w.counts()
    each = 1 / np.maximum(count, 1)
    length = w.end - w.start
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    code, _ = pd.factorize(w.hash ^ (w.row.astype(U64) * U64(0x9E3779B97F4A7C15)))
    times = np.bincount(code)
    first = np.zeros(len(times), np.int64)
    first[code[::-1]] = w.row[::-1]
    most = np.zeros(n)
    np.maximum.at(most, first, times)
    letter = cols[0] + cols[1]
    cols += [
        np.bincount(w.row, length, n) * each / 20,
        np.sqrt(np.maximum(np.bincount(w.row, length.astype(float) ** 2, n) * each - (np.bincount(w.row, length, n) * each) ** 2, 0)) / 10,
        np.bincount(w.row, again, n) * each,
        np.bincount(first, minlength=n) * each,
        most * each,
        np.log1p(count) / 10,
        np.log1p(size) / 12,
        cols[0] / np.maximum(letter, 1e-9),
        cols[4] * size * each,
        cols[6] * size * each,
    ]
    return np.stack(cols, 1)


#: Metadata columns: whether the text is null, n_chars on a log scale, and whether it is null.
METADATA = 3


def with_metadata(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` and text of ``docs``, and __n_chars, null where ``docs`` has no such column."""
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(*names, "text", size.cast("long").alias("__n_chars"))


def metadata(text: pa.Array, n_chars: pa.Array) -> np.ndarray:
    size = n_chars.fill_null(0).to_numpy(zero_copy_only=False)
    return np.stack([text.is_null().to_numpy(zero_copy_only=False), np.log1p(np.maximum(size, 0)) / 12, n_chars.is_null().to_numpy(zero_copy_only=False)], 1).astype(float)


def word_features(w, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of hashed words: damped counts, each row of unit length."""
    key = w.row.astype(np.int64) * BUCKETS + (w.hash >> U64(20)).astype(np.int64) % BUCKETS
    code, distinct = pd.factorize(key)
    value = 1 + np.log(np.bincount(code, minlength=len(distinct)))
    row = distinct // BUCKETS
    norm = np.sqrt(np.bincount(row, value**2, rows))
    return row, distinct % BUCKETS, value / norm[row]


@dataclass
class FactorisationMachine:
    """Weights ``w`` and factors ``v`` over word buckets, then bins of statistics, then the statistics themselves."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        """The part of the input that statistics give: one bin of each, and scaled values."""
        n, m = stats.shape
        out = np.zeros((n, m * BINS + m))
        for k in range(m):
            out[np.arange(n), k * BINS + np.searchsorted(self.edges[k], stats[:, k])] = 1 / np.sqrt(m)
        out[:, m * BINS :] = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(m)
        return out

    def score(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, x = len(stats), self.dense(stats)
        w, v = self.w[BUCKETS:], self.v[BUCKETS:]
        linear = self.bias + x @ w + np.bincount(row, self.w[bucket] * value, n)
        square = (x**2) @ (v**2).sum(1) + np.bincount(row, (self.v[bucket] ** 2).sum(1) * value**2, n)
        pairs = np.zeros(n)
        for f in range(FACTORS):
            pairs += (x @ v[:, f] + np.bincount(row, self.v[bucket, f] * value, n)) ** 2
        return 1 / (1 + np.exp(-np.clip(linear + (pairs - square) / 2, -40, 40)))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 2e-4, seed: int = 5) -> FactorisationMachine:
        """Adam on the logistic loss. ``rows``: buckets, values and statistics of each text."""
        rng = np.random.default_rng(seed)
        stats = np.stack([r[2] for r in rows]) if rows else np.zeros((0, len(_CLASSES) + 10 + METADATA))
        m = stats.shape[1]
        if not len(y) or y.min() == y.max():  # nothing to tell apart: a constant
            p = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
            size = BUCKETS + m * BINS + m
            return FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(size), np.zeros((size, FACTORS)), np.zeros((m, BINS - 1)), np.zeros(m), np.ones(m))
        fm = FactorisationMachine(
            0.0, np.zeros(BUCKETS + m * BINS + m, np.float32), rng.normal(0, 0.02, (BUCKETS + m * BINS + m, FACTORS)).astype(np.float32),
            np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T, stats.mean(0), stats.std(0) + 1e-6,
        )
        dense = fm.dense(stats).astype(np.float32)
        bias = np.zeros(1, np.float32)
        params = [bias, fm.w, fm.v]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                chosen = order[lo : lo + batch]
                x = np.zeros((len(chosen), BUCKETS + dense.shape[1]), np.float32)
                for k, i in enumerate(chosen):
                    x[k, rows[i][0]] = rows[i][1]
                x[:, BUCKETS:] = dense[chosen]
                s = x @ fm.v
                raw = bias[0] + x @ fm.w + ((s**2).sum(1) - (x**2) @ (fm.v**2).sum(1)) / 2
                g = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[chosen]).astype(np.float32) / len(chosen)
                grads = [g.sum(keepdims=True), x.T @ g + decay * fm.w, x.T @ (g[:, None] * s) - fm.v * ((x**2).T @ g)[:, None] + decay * fm.v]
                step += 1
                for p, d, a, b in zip(params, grads, first, second):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        fm.bias = float(bias[0])
        fm.w, fm.v = fm.w.astype(float), fm.v.astype(float)
        return fm


def in_fold(doc_id: str, folds: int) -> F.Column:
    """Whether crc32 of the id as text is divisible by ``folds``; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, those of the lowest id hashes; of documents that share an id one."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~in_fold("doc_id", folds))
        .select("doc_id", "quality")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )

    @tidy
    def features(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                w = words(data, offs)
                row, bucket, value = word_features(w, hi - lo)
                stats = np.concatenate([structure(data, offs, w), metadata(batch.column("text")[lo:hi], batch.column("__n_chars")[lo:hi])], 1)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
                out = [pickle.dumps((bucket[order[a:b]].astype(np.int16), value[order[a:b]].astype(np.float32), stats[k])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
                yield pa.record_batch([batch.column("doc_id")[lo:hi], batch.column("quality")[lo:hi], pa.array(out, pa.binary())], ["doc_id", "quality", "x"])

    texts = with_metadata(docs, "doc_id").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    got = texts.select("doc_id", "quality", "text", "__n_chars").mapInArrow(features, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()
    return FactorisationMachine.fit([pickle.loads(r["x"]) for r in got], np.array([r["quality"] for r in got], float))


def _scores(fm: FactorisationMachine, text: pa.Array, n_chars: pa.Array) -> np.ndarray:
    out = np.zeros(len(text))
    for lo, hi, data, offs in slices(text):
        w = words(data, offs)
        stats = np.concatenate([structure(data, offs, w), metadata(text[lo:hi], n_chars[lo:hi])], 1)
        out[lo:hi] = fm.score(*word_features(w, hi - lo), stats)
    return out


def score_quality(docs: DataFrame, model: FactorisationMachine, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns (struct ``row`` of all of them, where that is kept) and the score (column ``name``) of every row of ``docs`` (which has ``text``, and ``n_chars`` where known); null counts as empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    chosen = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), "text", size.cast("long").alias("size"))

    @tidy
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("row"), pa.array(_scores(shared.value, batch.column("text"), batch.column("size")))], ["row", "score"])

    told = chosen.mapInArrow(run, T.StructType([chosen.schema["row"], T.StructField("score", T.DoubleType())]))
    return told.select("row.*", F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every row.

    A null text scores as an empty one that is told as null; a very long one is read whole; n_chars is read where there is one. Repeated rows score alike. Labels
    with a null id or value are not used; without both labels the score is a constant. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``, which are told as in ``classify``; all columns stay, whatever their names."""
    shared, names = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels)), docs.columns
    size = F.col("n_chars") if "n_chars" in names else F.lit(None)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), size.cast("long").alias("size"))
    at = names.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array(_scores(shared.value, batch.column("row").field(at), batch.column("size")) >= threshold))

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}
