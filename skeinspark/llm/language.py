"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One linear classifier over hashed byte n-grams
predicts each bit; the language with the least weighted loss against the predicted bits
wins, and a close second marks the row as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import discard, settled, stage, tidy
from ._words import slices
from .quality import in_fold

#: Rows of each language to fit on at most, rows of all languages at most (more languages have fewer rows each), n-gram buckets, longest n-gram.
PER_LANGUAGE, SAMPLE, BUCKETS, GRAM = 2000, 256_000, 2048, 4
#: Rows whose features stand dense side by side, 16 KB each, however short their texts are.
AT_ONCE = 256
#: A winner of less than this share over the second is ambiguous.
AMBIGUOUS = 0.2

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13, *range(33, 65), *range(91, 97), *range(123, 127)]] = 32  # digits and marks say little
_LETTER = regex.compile(r"\p{L}")


def _least_gap(c: np.ndarray, lo: int, rows: int = 256) -> float:
    """Least number of places in which a codeword of ``rows`` from ``lo`` on differs from another."""
    differ = (c.shape[1] - c[lo : lo + rows] @ c.T) / 2
    differ[np.arange(len(differ)), lo + np.arange(len(differ))] = np.inf
    return differ.min()


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codes of ``n`` languages: all splits in two where these are few, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if k == 0 or not s >> (k - 1) & 1 else -1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng, best = np.random.default_rng(seed), None
    width = 4 * int(np.ceil(np.log2(n))) + 15
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (n, width))
        c = c[:, np.abs(c.sum(0)) < n]
        gap = min(_least_gap(c, lo) for lo in range(0, n, 256))
        if best is None or gap > best[0]:
            best = (gap, c)
    return best[1]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Damped counts of hashed byte n-grams of each text, each row of unit length."""
    n, b = len(offs) - 1, _FOLD[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offs))
    counts = np.zeros(n * BUCKETS, np.int64)
    h = np.zeros(len(b), np.uint32)
    for k in range(1, GRAM + 1):
        m = len(b) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + b[k - 1 : k - 1 + m] + np.uint32(k)
        inside = row[:m] == row[k - 1 : k - 1 + m]
        mixed = h ^ (h >> np.uint32(15))
        counts += np.bincount((row[:m] + (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(12)).astype(np.int64) % BUCKETS)[inside], minlength=n * BUCKETS)
    x = np.log1p(counts).reshape(n, BUCKETS)
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)


@dataclass
class OutputCodes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    sharpness: float = 4.0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its score, the second, and the score's lead over it."""
        out = x @ self.weights[:-1] + self.weights[-1]
        loss = np.zeros((len(x), len(self.languages)))
        for k in range(out.shape[1]):
            loss += self.bit_weight[k] * np.logaddexp(0, -self.sharpness * out[:, k : k + 1] * self.code[:, k][None])
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        rows = np.arange(len(x))
        second = order[:, min(1, p.shape[1] - 1)]
        return order[:, 0], p[rows, order[:, 0]], second, p[rows, order[:, 0]] - np.where(p.shape[1] > 1, p[rows, second], 0)


def solved(a: np.ndarray, b: np.ndarray, block: int = 64) -> np.ndarray:
    """The solution of ``a x = b`` for a symmetric positive definite ``a``, eliminated block by block: factorising it whole was seen to hang where the library does so in threads."""
    a, b, n = a.copy(), b.copy(), len(a)
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        part = np.linalg.inv(a[lo:hi, lo:hi])
        a[lo:hi, hi:], b[lo:hi] = part @ a[lo:hi, hi:], part @ b[lo:hi]
        b[hi:] -= a[hi:, lo:hi] @ b[lo:hi]
        a[hi:, hi:] -= a[hi:, lo:hi] @ a[lo:hi, hi:]
    for lo in range((n - 1) // block * block, -1, -block):
        hi = min(lo + block, n)
        b[lo:hi] -= a[lo:hi, hi:] @ b[hi:]
    return b


#: Rows of the normal equations that are summed in one place, and rows of the sample for each task that sums: its sums are 34 MB, however few its rows.
_STRIP, _SUMMED = 64, 4096


@settled
def _sampled(docs: DataFrame, folds: int, each: int, n: int) -> DataFrame:
    """lang and features x of at most ``each`` rows of each of ``n`` languages outside the held-out fold; of rows that share id and language one."""
    known = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds))
    # First within pieces of each language, so that no task ranks all ids of a common one.
    chosen = known.distinct().withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for by in (("lang", "piece"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= each).drop("rank")

    @tidy
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text"), rows=AT_ONCE):
                x = features(data, offs).astype(np.float16)
                yield pa.record_batch([batch.column("doc_id")[lo:hi], batch.column("lang")[lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])  # about SAMPLE rows at most
    rows = texts.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, x binary")
    return stage(rows.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("lang", "x"), "language-sample")


def fit_language(docs: DataFrame, folds: int = 5, each: int = PER_LANGUAGE, sample: int = SAMPLE, ridge: float = 1e-2) -> OutputCodes:
    """One ridge classifier for each bit of the codewords; a bit weighs as it is right on the sample.

    Fitted on every language, on at most ``each`` rows of one and about ``sample`` in all (one
    of each language at least), outside the held-out fold. Rows with a null id or language are
    not learned from; null and empty texts are. The sample stays distributed: tasks sum their
    part of the normal equations, and these sums, of a fixed size, reach the driver.
    """
    learned = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds)).select("lang").distinct()
    names = sorted(r["lang"] for r in learned.collect())
    if not names:
        return OutputCodes([], np.zeros((0, 1)), np.zeros((BUCKETS + 1, 1)), np.ones(1))
    rows = _sampled(docs, folds, max(1, min(each, sample // len(names))), len(names))
    code, number = codewords(len(names)), {k: i for i, k in enumerate(names)}
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    total = sum(held.values())
    share = np.array([total / (len(names) * held[k]) if k in held else 0.0 for k in names])  # languages weigh alike

    def matrices(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
                yield np.concatenate([x, np.ones((len(x), 1), np.float32)], 1), np.array([number[k] for k in part.column("lang").to_pylist()])

    @tidy
    def equations(batches):
        left, right = np.zeros((BUCKETS + 1, BUCKETS + 1)), np.zeros((BUCKETS + 1, code.shape[1]))
        for x, who in matrices(batches):
            weighted = x * share[who].astype(np.float32)[:, None]
            left += weighted.T @ x
            right += weighted.T @ code[who].astype(np.float32)
        if left[-1, -1]:
            both = np.concatenate([left, right], 1)
            at = range(0, BUCKETS + 1, _STRIP)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array([both[k : k + _STRIP].tobytes() for k in at], pa.binary())], ["strip", "sums"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in t.column("sums"))
        return pa.table({"strip": t.column("strip")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    got = rows.coalesce(1 + total // _SUMMED).mapInArrow(equations, "strip int, sums binary").groupBy("strip").applyInArrow(added, "strip int, sums binary").collect()
    both = np.frombuffer(b"".join(r["sums"] for r in sorted(got, key=lambda r: r["strip"]))).reshape(BUCKETS + 1, -1)
    weights = solved(both[:, : BUCKETS + 1] + ridge * np.eye(BUCKETS + 1), both[:, BUCKETS + 1 :])

    @tidy
    def rightly(batches):
        right = np.zeros(code.shape[1], np.int64)
        for x, who in matrices(batches):
            right += (x @ weights * code[who] > 0).sum(0)
        yield pa.record_batch([pa.array([right.tolist()], pa.list_(pa.int64()))], ["right"])

    right = rows.mapInArrow(rightly, "right array<long>").agg(*(F.sum(F.col("right")[k]) for k in range(code.shape[1]))).first()
    discard(rows)
    return OutputCodes(names, code, weights, np.maximum(np.array(right, float) / total - 0.5, 0.01) / 0.5)


def identify(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """doc_id, lang_pred, score, second and ambiguous of every row.

    ``und`` with score 0 stands for null texts, texts without a letter, and a model that
    has learned no language. Repeated rows are told alike, very long texts are read whole. An
    empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            pred, two, score, lead = np.full(batch.num_rows, "und", object), np.full(batch.num_rows, None, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi, data, offs in slices(batch.column("text"), rows=AT_ONCE):
                letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_FOLD[data] >= 97) & (_FOLD[data] <= 122), out=letter[1:])
                some = np.diff(letter[offs]) > 0
                for k in np.flatnonzero(~some):
                    some[k] = bool(_LETTER.search(data[offs[k] : offs[k + 1]].tobytes().decode()))
                if not m.languages or not some.any():
                    continue
                a, p, b, d = m.decode(features(data, offs))
                pred[lo:hi] = np.where(some, names[a], "und")
                two[lo:hi] = np.where(some, names[b], None)
                score[lo:hi], lead[lo:hi] = np.where(some, p, 0), np.where(some, d, 0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(two, pa.string()), pa.array(lead < AMBIGUOUS)], ["doc_id", "lang_pred", "score", "second", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, second string, ambiguous boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit_language(docs)).select("doc_id", in_fold("doc_id", 5).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_language": op10_language}
