"""Repeated passages by sparse suffix arrays.

A window of ``MIN_WORDS`` words selects one anchor, the least hash among its ``GRAM``-word
grams (a minimiser), so equal windows select equal anchors at equal places. Only suffixes
at anchors are retained.

1. Anchor hashes of all texts are counted; hashes that stand alone cannot lie in a
   repeated passage, and their suffixes are dropped.
2. The other suffixes, with the words that their windows span, are gathered by their
   leading words (the anchor), sorted by the words that follow it and by those that lead to
   it, and compared with their neighbours in both orders. That tells for each depth to the
   right and to the left which suffixes agree; windows that agree in both are repeats, and
   adjoining ones merge to maximal matches.
3. All but the first occurrence, in order of doc_id and place, are marked.

Suffixes that meet in one task are compared there, and only windows that may still be a
first occurrence go on, so that a passage in a third of all rows is a few rows for each task.
Where an anchor still comes from very many tasks, its suffixes meet by anchor and salt first,
and what each of these groups leaves meets by anchor then: with n stretches of text that hold
it, no group has more than about the square root of n of them.
A very long text is a slice of its own; nothing of it is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bit_table, bucket_count, dealt, has_bits, pack, ragged, settled, split_by_marks, stage, text_bytes, tidy, unpack
from ._words import U64, gram_hashes, mix, slices, words

#: Words of a repeated passage at least, and of the grams that anchors are chosen from.
MIN_WORDS, GRAM = 50, 25
_LAST = np.iinfo(np.int64).max
#: Stretches of text (``slices``) that may hold an anchor before its suffixes meet by anchor and salt first.
CROWDED = 64


def anchors(w, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows within a row, the anchor's word of each, and the anchor's hash."""
    grams = gram_hashes(w.hash, gram)
    span = min_words - gram + 1
    n = len(w.hash) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[:n] == w.row[min_words - 1 :])
    view = sliding_window_view(grams, span)
    place = np.empty(len(at), np.int64)
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        place[lo : lo + (1 << 16)] = part + view[part].argmin(1)
    return at, place, grams[place]


def repeated_anchors(texts: DataFrame, buckets: int, min_words: int, gram: int, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray, int]:
    """Tables of bounded size of the anchors that occur more than once and of those that more than ``crowded`` stretches hold, and the most stretches that hold one."""

    @tidy
    def emit(batches):
        held, n = [], 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] + U64(1)) != 0)
            stretches = np.diff(np.append(first, len(h)))
            c = np.add.reduceat(c, first)
            return dealt((mix(h[first]) % U64(buckets)).astype(np.int64), [h[first], np.minimum(c, 255).astype(np.uint8), np.minimum(stretches, 65535).astype(np.uint16)])

        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                w = words(data, offs)
                _, place, h = anchors(w, min_words, gram)
                held.append(np.unique(h[np.diff(place, prepend=-1) != 0], return_counts=True))
                n += len(held[-1][0])
                if n > 1 << 21:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        h, c, stretches = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in t.column("block"))))
        order = np.argsort(h)
        h, c, stretches = h[order], c[order], stretches[order]
        first = np.flatnonzero(np.diff(h, prepend=h[0] + U64(1)) != 0)
        many = np.add.reduceat(c.astype(np.int64), first) > 1
        return pa.table({"mark": pa.array(mix(h[first[many]]).view(np.int64)), "n": pa.array(np.add.reduceat(stretches.astype(np.int64), first)[many])})

    marks = stage(texts.mapInArrow(emit, "bucket int, block binary").groupBy("bucket").applyInArrow(count, "mark long, n long"), "anchors")
    most = marks.agg(F.max("n")).first()[0] or 0
    return bit_table(marks.select("mark"), staged=True), bit_table(marks.filter(F.col("n") > crowded).select("mark"), staged=True), most


def _intervals(key, start, other, min_words):
    """Windows of rows (sorted by key and start) merged where they follow each other: key, start, stop, least other."""
    if not len(key):
        return key, start, start, other
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], start[last] + min_words, np.minimum.reduceat(other, first)


@dataclass
class Suffixes:
    """Suffixes at anchors: the anchor's hash, an order of rows, the anchor's word in the row, the first and the last window that chose it, and the words of these windows, one suffix after the other."""

    anchor: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    words: np.ndarray

    def spans(self, min_words: int) -> np.ndarray:
        return self.hi - self.lo + min_words

    def first(self, min_words: int) -> np.ndarray:
        n = self.spans(min_words)
        return np.cumsum(n) - n

    def take(self, k: np.ndarray, min_words: int) -> Suffixes:
        at = ragged(self.first(min_words)[k], self.spans(min_words)[k])
        return Suffixes(self.anchor[k], self.row[k], self.pos[k], self.lo[k], self.hi[k], self.words[at])

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "row", "pos", "lo", "hi", "words")))


def _sorted_depths(anchor: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes sorted by anchor and words and compared with their neighbours: for each depth, the number of the class that agrees so far."""
    keys = np.concatenate([anchor[:, None], words], 1).astype(">u8")
    order = np.argsort(keys.view(f"S{8 * keys.shape[1]}")[:, 0], kind="stable")
    keys = keys[order]
    common = np.zeros(len(keys), np.int64)  # with the neighbour before
    differ = keys[1:] != keys[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    classes = np.empty((keys.shape[1], len(keys)), np.int32)
    for depth in range(keys.shape[1]):
        classes[depth, order] = np.cumsum(common <= depth)
    return classes


def repeats_among(s: Suffixes, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of suffixes that occur before, as number of the suffix, offset of its anchor in the window, and row of the first occurrence."""
    room = min_words - gram
    _, code, count = np.unique(s.anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[code] > 1)
    if not len(some):
        return some, some, some
    first, depth = s.first(min_words)[some], np.arange(room)
    anchor, row, pos, lo, hi = s.anchor[some], s.row[some], s.pos[some], s.lo[some], s.hi[some]
    right, left = (pos + gram - lo)[:, None] + depth, (pos - 1 - lo)[:, None] - depth
    after = np.where(right < (hi - lo + min_words)[:, None], s.words[np.minimum(first[:, None] + right, len(s.words) - 1)], U64(0))
    before = np.where(left >= 0, s.words[np.maximum(first[:, None] + left, 0)], U64(0))
    after, before = _sorted_depths(anchor, after), _sorted_depths(anchor, before)
    out: list[list[np.ndarray]] = [[], [], []]
    for d in range(room + 1):
        has = np.flatnonzero((d >= pos - hi) & (d <= pos - lo))
        # Equal words on both sides: equal windows. The first in order of rows and places stays.
        same = before[d, has].astype(np.int64) << 32 | after[room - d, has]
        order = np.lexsort((pos[has], row[has], same))
        has, same = has[order], same[order]
        new = np.ones(len(has), bool)
        new[1:] = same[1:] != same[:-1]
        origin = has[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(has) else has
        told = (row[has] != row[origin]) | (pos[has] >= pos[origin] + min_words)
        for c, v in zip(out, (some[has[told]], np.full(int(told.sum()), d), row[origin[told]])):
            c.append(v)
    return tuple(np.concatenate(c) for c in out)


def left_over(s: Suffixes, told: np.ndarray, start: np.ndarray, min_words: int) -> Suffixes:
    """Of each suffix the windows from the first to the last that was not told (numbers of suffixes, first words of windows)."""
    size = s.hi - s.lo + 1
    begin = np.cumsum(size) - size
    left = np.ones(int(size.sum()), bool)
    left[begin[told] + start - s.lo[told]] = False
    owner, at = np.repeat(np.arange(len(size)), size)[left], ragged(s.lo, size)[left]
    rest, first = np.unique(owner, return_index=True)
    lo, hi = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1]
    words_at = ragged(s.first(min_words)[rest] + lo - s.lo[rest], hi - lo + min_words)
    return Suffixes(s.anchor[rest], s.row[rest], s.pos[rest], lo, hi, s.words[words_at])


def blocks(s: Suffixes, doc: np.ndarray, key: np.ndarray, bucket: np.ndarray, min_words: int) -> pa.RecordBatch:
    """Suffixes as one packed block for each bucket. ``doc`` and ``key`` are of rows."""
    s, bucket = s.take(np.argsort(bucket, kind="stable"), min_words), np.sort(bucket)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends, word_ends = np.append(cut[1:], len(bucket)), np.append(s.first(min_words)[cut[1:]], len(s.words))
    out, w0 = [], 0
    for x, y, w1 in zip(cut.tolist(), ends.tolist(), word_ends.tolist()):
        who, ref = np.unique(s.row[x:y], return_inverse=True)
        table, code = np.unique(s.words[w0:w1], return_inverse=True)
        small = np.uint8 if len(table) <= 1 << 8 else np.uint16 if len(table) <= 1 << 16 else np.uint32
        out.append(pack(np.full(1, 0, np.uint8), s.anchor[x:y], ref.astype(np.uint32), *(c[x:y].astype(np.uint32) for c in (s.pos, s.lo)), (s.hi - s.lo)[x:y].astype(np.uint16), doc[who], key[who], table, code.astype(small)))
        w0 = w1
    return pa.record_batch([pa.array(bucket[cut], pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """Intervals of words to remove: key (of the row), start, stop and an earlier document with the same words.

    ``docs`` has key, doc_id and text. Intervals of a row may overlap. Suffixes at anchors that more than
    ``crowded`` stretches of text hold meet in two steps; what is found is the same.
    """
    sent, merge, settle = _steps(docs, min_words, gram, crowded)
    return sent.groupBy("bucket").applyInArrow(merge, sent.schema).groupBy("bucket").applyInArrow(settle, "key long, start int, stop int, other long")


def _steps(docs: DataFrame, min_words: int, gram: int, crowded: int):
    """Packed suffixes and repeats by bucket, and what is done with a bucket in the first and in the second step."""
    spark = docs.sparkSession
    _, size = text_bytes(docs)
    buckets = bucket_count(spark, size)
    again, many, most = repeated_anchors(docs.select("text"), buckets, min_words, gram, crowded)
    table, salted, salts = spark.sparkContext.broadcast(again), spark.sparkContext.broadcast(many), max(1, math.isqrt(most))

    def found(s: Suffixes, doc: np.ndarray, key: np.ndarray):
        """Merged repeats: key, start, stop, other; and the told windows themselves. ``doc`` and ``key`` are of rows."""
        k, d, origin = repeats_among(s, min_words, gram)
        start = s.pos[k] - d
        order = np.lexsort((start, s.row[k]))
        return _intervals(key[s.row[k[order]]], start[order], doc[origin[order]], min_words), k, start

    def numbered(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of rows in order of doc and key, repeated rows alike; doc and key by number."""
        order = np.lexsort((key, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank, doc[order[new]], key[order[new]]

    def distinct(s: Suffixes) -> Suffixes:
        """Repeated rows have the same suffixes; those whose windows another of the same place has, too, go."""
        order = np.lexsort((-s.hi, s.lo, s.pos, s.row))
        new = np.ones(len(order), bool)
        new[1:] = (s.row[order][1:] != s.row[order][:-1]) | (s.pos[order][1:] != s.pos[order][:-1])
        reach = np.cumsum(new) << 32 | s.hi[order]
        new[1:] |= reach[1:] > np.maximum.accumulate(reach)[:-1]
        return s if new.all() else s.take(order[new], min_words)

    def by_key(key: np.ndarray) -> np.ndarray:
        return (mix(key.view(U64)) % U64(buckets)).astype(np.int64)

    def packed(bucket: np.ndarray, told: tuple) -> pa.RecordBatch:
        k, a, b, o = told
        return dealt(bucket, [np.full(len(k), 1, np.uint8), k, a.astype(np.uint32), b.astype(np.uint32), o])

    @tidy
    def emit(batches):
        held, names, n, docs_held = [], [], 0, 0

        def flush():
            doc, key = (np.concatenate(c) for c in zip(*names))
            rank, doc, key = numbered(doc, key)
            s = Suffixes.joined(held)
            s.row = rank[s.row]
            s = distinct(s)
            done, told, start = found(s, doc, key)
            if len(done[0]):
                yield packed(by_key(done[0]), done)
            s = left_over(s, told, start, min_words)
            if len(s.anchor):
                # Groups of anchor and salt have buckets of their own, beyond those of anchors. A stretch has one salt, told by its first row.
                salt = mix(mix(key[:1].view(U64)) % U64(salts))
                mixed = mix(s.anchor)
                bucket = np.where(has_bits(salted.value, mixed), U64(buckets) + mix(mixed ^ salt) % U64(buckets), mixed % U64(buckets))
                yield blocks(s, doc, key, bucket.astype(np.int64), min_words)

        for batch in batches:
            doc = batch.column("doc_id").fill_null(_LAST).to_numpy()
            key = batch.column("key").to_numpy()
            for lo, hi, data, offs in slices(batch.column("text")):
                w = words(data, offs)
                at, place, h = anchors(w, min_words, gram)
                again = has_bits(table.value, mix(h))
                at, place, h = at[again], place[again], h[again]
                if len(at):
                    # The windows that chose a suffix follow each other.
                    first = np.flatnonzero(np.diff(place, prepend=-1))
                    last = np.append(first[1:], len(at)) - 1
                    row = w.row[at[first]]
                    begin = w.first[row]
                    span = w.hash[ragged(at[first], at[last] - at[first] + min_words)]
                    held.append(Suffixes(h[first], row + docs_held, place[first] - begin, at[first] - begin, at[last] - begin, span))
                    names.append((doc[lo:hi], key[lo:hi]))
                    docs_held += hi - lo
                    n += len(at)
                if n > 1 << 19:
                    yield from flush()
                    held, names, n, docs_held = [], [], 0, 0
        if n:
            yield from flush()

    def opened(t: pa.Table):
        """Repeats told so far, and the suffixes of a bucket with doc and key of their rows (None where there are none)."""
        done, open_, names, held = [], [], [], 0
        for b in t.column("block"):
            kind, *cols = unpack(b.as_py())
            if kind[0]:
                done.append([cols[0], cols[1].astype(np.int64), cols[2].astype(np.int64), cols[3]])
            else:
                anchor, ref, pos, lo, more, doc, key, table, code = cols
                lo = lo.astype(np.int64)
                open_.append(Suffixes(anchor, ref.astype(np.int64) + held, pos.astype(np.int64), lo, lo + more, table[code]))
                names.append((doc, key))
                held += len(doc)
        if not open_:
            return done, None, None, None
        doc, key = (np.concatenate(c) for c in zip(*names))
        rank, doc, key = numbered(doc, key)
        s = Suffixes.joined(open_)
        s.row = rank[s.row]
        return done, distinct(s), doc, key

    def merge(of: tuple, t: pa.Table) -> pa.Table:
        """The repeats of a bucket; of salted anchors also what may still be a first occurrence, by anchor."""
        bucket, out = of[0].as_py(), []
        told, s, doc, key = opened(t)
        if s is not None:
            done, k, start = found(s, doc, key)
            told.append(done)
            if bucket >= buckets:
                s = left_over(s, k, start, min_words)
                out.append(blocks(s, doc, key, (mix(s.anchor) % U64(buckets)).astype(np.int64), min_words))
        told = tuple(np.concatenate(c) for c in zip(*told))
        if len(told[0]):
            out.append(packed(np.full(len(told[0]), bucket % buckets), told))
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))

    def settle(t: pa.Table) -> pa.Table:
        done, s, doc, key = opened(t)
        if s is not None:
            done.append(found(s, doc, key)[0])
        k, a, b, o = (np.concatenate(c) for c in zip(*done))
        return pa.table({"key": pa.array(k, pa.int64()), "start": pa.array(a, pa.int32()), "stop": pa.array(b, pa.int32()), "other": pa.array(o, pa.int64())})

    sent = docs.select("doc_id", "key", "text").mapInArrow(emit, "bucket int, block binary")
    return sent, merge, settle


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


@settled
def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """One row per span of words that repeats an earlier one: doc_id, start, stop (words), other_doc_id.

    Words are lower-cased (A-Z). A window of ``min_words`` words is a repeat if it occurs
    before: in a document of smaller doc_id (null ids last), or ``min_words`` or more words
    before in its own. Spans are unions of repeats. ``other_doc_id`` is an earlier document
    with words of the span. Shorter, null and empty texts have no spans. Rows that repeat id
    and text are one document. An empty table gives no rows. Other columns are not read.
    """
    rows = _keyed(docs.select("doc_id", "text"))
    names = rows.select("key", "doc_id").distinct()
    return names.join(_union(repeated_windows(rows, min_words, gram)), "key").select("doc_id", "start", "stop", F.when(F.col("other") < _LAST, F.col("other")).alias("other_doc_id"))


def _union(found: DataFrame) -> DataFrame:
    """The union of each row's intervals: key, start, stop, other. A row has no more of them than words."""

    @tidy
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, each in zip(batch.column("key").to_pylist(), batch.column("all").to_pylist()):
                for k, (a, b, o) in enumerate(sorted((x["start"], x["stop"], x["other"]) for x in each)):
                    if k and a <= out[2][-1]:
                        out[2][-1], out[3][-1] = max(out[2][-1], b), min(out[3][-1], o)
                    else:
                        for c, v in zip(out, (key, a, b, o)):
                            c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["key", "start", "stop", "other"])

    merged = found.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop", "other")).alias("all"))
    return merged.mapInArrow(run, "key long, start int, stop int, other long")


@settled
def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut out of ``text``; all other columns and rows stay, whatever their names.

    A cut takes the words of the span and the white space after them. Null texts stay null, and
    null, empty and short ones have no spans; rows that repeat id and text are cut alike; null
    ids come last in order. An empty table gives no rows. Only rows that may have spans are
    shuffled, told by a table of fixed size; the rest pass straight through.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    spans = stage(_union(repeated_windows(keyed, min_words, gram)), "spans")
    clear, maybe = split_by_marks(rows, "key", spans.select("key").distinct())
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    at = names.index("text")

    @tidy
    def cut(batches):
        for batch in batches:
            row, texts = batch.column("row"), []
            for text, each in zip(row.field(at).to_pylist(), batch.column("spans").to_pylist()):
                if each:
                    raw = text.encode()
                    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    done, parts = 0, []
                    for a, b in sorted((x["start"], x["stop"]) for x in each):
                        parts.append(raw[done : w.start[a]])
                        done = int(w.start[b]) if b < len(w.start) else len(raw)
                    text = (b"".join(parts) + raw[done:]).decode()
                texts.append(text)
            fields = [row.type.field(j) for j in range(row.type.num_fields)]
            columns = [pa.array(texts, f.type) if j == at else row.field(j) for j, f in enumerate(fields)]
            yield pa.record_batch([pa.StructArray.from_arrays(columns, fields=fields)], ["row"])

    mended = maybe.join(lists, "key", "left").select("row", "spans").mapInArrow(cut, T.StructType([T.StructField("row", docs.schema)]))
    return clear.select("row.*").unionByName(mended.select("row.*"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
