"""Packing along a space-filling curve.

Hashed word vectors are projected to a few dimensions, the cell of each document gets a
Hilbert key, documents are range-sorted by it, and neighbours on the curve are packed one
after the other into sequences of fixed length. Only the last sequence has padding.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, settled, stage, tidy
from ._words import U64, mix, slices, words
from .bpe import AT_ONCE, default_vocabulary, encoder

#: Tokens of a sequence, and the id that ends each document.
LENGTH, END = 2048, 1
DIMENSIONS, BITS, PROJECTIONS = 4, 10, 16
#: Bits of a place, tokens of a range of the curve (about 100 MB), and sums of tokens at most that the driver holds at once.
PLACE_BITS, PER_RANGE, CELLS = 60, 64_000_000, 1 << 16
#: Tokens that a row counts for besides its own where ranges are made.
ROW = 256


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows by dimensions) of ``bits`` bits each.

    Skilling's transform: undo excess rotations from the highest bit down, Gray encode, interleave.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x = [c ^ turn for c in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c >> b & 1)
    return key


def curve_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text: signs of word hashes summed, scaled to unit spread, cut into cells at normal quantiles."""
    w = words(data, offs)
    n = len(offs) - 1
    sums = np.empty((n, PROJECTIONS))
    signs = mix(w.hash + U64(7))
    for k in range(PROJECTIONS):
        sums[:, k] = np.bincount(w.row, (signs >> U64(k) & U64(1)).astype(np.float64) * 2 - 1, n)
    spread = np.sqrt((sums**2).mean(1, keepdims=True))
    z = sums[:, :DIMENSIONS] / np.where(spread > 0, spread, 1)
    share = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution function
    cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, place (Hilbert key, then hash of the row to part equal keys), n_tokens and ids, compressed."""

    def run(batches):
        tool = encoder(path)
        squeeze = zstandard.ZstdCompressor(level=1)
        small = len(tool.token_bytes) <= 1 << 16
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text"), AT_ONCE):
                ids, bound = tool.encode(data, offs)
                ids = ids.astype("<u2" if small else "<u4")
                key = curve_keys(data, offs)
                blocks = [squeeze.compress(np.append(ids[a:b], ids.dtype.type(END)).tobytes()) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                yield pa.record_batch(
                    [batch.column("doc_id")[lo:hi], pa.array(key << 20, pa.int64()), pa.array(np.diff(bound) + 1, pa.int64()), pa.array(blocks, pa.binary())],
                    ["doc_id", "place", "n_tokens", "ids"],
                )

    part = F.shiftrightunsigned(F.xxhash64("doc_id", "n_tokens"), 44)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, n_tokens long, ids binary").withColumn("place", F.col("place") + part)


def _ranged(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``rows`` with range and base, and the number of ranges: stretches of the curve of about equal tokens and rows, and the tokens before each.

    Tokens and rows are counted by the first 16 bits of places, and cells with more than a
    range's share again by further bits, down to whole places, of which the last bits part rows
    of one key: at most ``CELLS`` counts at once, however large the table.
    """
    spark = rows.sparkSession

    def counts(df):
        return {r["cell"]: (r["t"], r["t"] + ROW * r["n"]) for r in df.groupBy("cell").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}

    def begin(bits):
        return F.shiftleft(F.shiftright("place", PLACE_BITS - bits), PLACE_BITS - bits)

    depth = 16
    split = rows.withColumn("cell", begin(depth))  # the first place of a row's cell
    fine = counts(split)
    total = sum(w for _, w in fine.values())
    share = max(1, -(-total // max(least, total // PER_RANGE + 1)))
    heavy = [c for c, (_, w) in fine.items() if w > share]
    while heavy and depth < PLACE_BITS:
        depth = min(PLACE_BITS, depth + max(1, (CELLS // len(heavy)).bit_length() - 1))
        parted = F.broadcast(spark.createDataFrame([(c, True) for c in heavy], "cell long, heavy boolean"))
        split = split.join(parted, "cell", "left").withColumn("cell", F.when(F.col("heavy"), begin(depth)).otherwise(F.col("cell")))
        deeper = counts(split.filter("heavy"))
        split = split.drop("heavy")
        parents = set(heavy)
        fine = {c: v for c, v in fine.items() if c not in parents} | deeper
        heavy = [c for c, (_, w) in deeper.items() if w > share]
    told, tokens, weight, base = [], 0, 0, {}
    for c in sorted(fine):
        k = weight // share
        told.append((c, k, base.setdefault(k, tokens)))
        tokens, weight = tokens + fine[c][0], weight + fine[c][1]
    table = spark.createDataFrame(told, "cell long, range long, base long")
    placed = split.join(F.broadcast(table), "cell")
    return placed.select(*rows.columns, F.col("range").cast("int").alias("range"), "base"), weight // share + 1


@settled
def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pieces of sequences of ``length`` tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and then ``END``; it is cut wherever a sequence ends, and every id
    lies in one piece. Null and empty texts are the single id ``END``. Null ids and repeated
    rows are packed like others, very long texts whole. An empty table gives no rows. Other columns are not read.
    ``ids`` are unsigned little-endian 32-bit integers.
    """
    path = path or default_vocabulary()
    spark = docs.sparkSession
    rows = stage(tokenised(docs, path), "tokens")
    placed, ranges = _ranged(rows, partitions(spark))
    small = len(encoder(path).token_bytes) <= 1 << 16

    @tidy
    def pieces(batches):
        expand = zstandard.ZstdDecompressor()
        at, current = 0, None
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, r, base, n, block in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "range", "base", "n_tokens", "ids"))):
                if r != current:
                    at, current = base, r
                ids = np.frombuffer(expand.decompress(block), "<u2" if small else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    m = min(n - start, length - off)
                    for c, v in zip(cols, (doc, start, m, ids[start : start + m].tobytes(), n, seq, off)):
                        c.append(v)
                    start += m
                at += n
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    sorted_rows = placed.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "place", "doc_id", "n_tokens")
    return sorted_rows.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


ORACLE: dict[str, str] = {}
QUERIES = {"op2_packing": op2_packing}
