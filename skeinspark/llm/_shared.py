"""What the operators share: scratch tables in the shared folder, sizes, and columnar shuffles of packed arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import sys
import uuid
from contextvars import ContextVar
from functools import wraps
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

_made: dict[str, SparkSession] = {}
#: Folders that stay to the end of the process.
_lasting: dict[str, SparkSession] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scratch folders of the running function", default=None)

#: Of the C library's mallopt: its names for the threshold of own mappings, for trimming and for arenas.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _M_ARENA_MAX = -1, -3, -8


def return_memory() -> None:
    """Freed arrays go back to the system at once: workers live on, and several share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no mallopt
        libc = ctypes.CDLL(None)
        for name, value in ((_M_MMAP_THRESHOLD, 4 << 20), (_M_TRIM_THRESHOLD, 4 << 20), (_M_ARENA_MAX, 2)):
            libc.mallopt(name, value)


return_memory()


def tidy(run):
    """For a function that workers run over batches: afterwards they keep no tools or tables, for workers live on."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    if bpe := sys.modules.get(f"{__package__}.bpe"):
        bpe.encoder.cache_clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a default only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; removed by ``settled`` or ``discard`` when it is no longer read, at the latest at exit."""
    path = f"{shared_root(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def read_by(df: DataFrame) -> set[str]:
    """The scratch folders that a frame reads."""
    files = df.inputFiles()
    names = {part for f in files for part in urlparse(f).path.split("/") if part.startswith("skein-")}
    return {p for p in list(_made) if p.rpartition("/")[2] in names}


def settled(function):
    """For a function that returns a frame: when it is done, only those of its scratch folders stay that the frame reads."""

    @wraps(function)
    def run(*args, **named):
        token = _scope.set([])
        try:
            out = function(*args, **named)
        finally:
            made = _scope.get()
            _scope.reset(token)
        needed = read_by(out)
        for path in made:
            if path not in needed:
                forget(path)
            elif (outer := _scope.get()) is not None:
                outer.append(path)
        return out

    return run


def discard(df: DataFrame) -> None:
    """Remove the scratch folders that a frame reads, when its rows have been written or are no longer wanted."""
    for path in read_by(df):
        forget(path)


#: The session's bound on batches for Python workers, and what operators set it to.
BATCHES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextlib.contextmanager
def bounded_batches(spark: SparkSession):
    """While jobs run within, Python workers get at most ``BATCH`` of rows at once; afterwards the session is as it was."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def local_path(path: str) -> str:
    """The mounted path of a shared-folder URI; memory mapping needs one."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs spark.checkpoint.dir on a mounted file system, not {url.scheme}://")
    return url.path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    return path


def sweep() -> None:
    """Remove all scratch folders made so far. Only safe when no frame that reads them is still wanted."""
    for path in list(_made):
        with contextlib.suppress(Exception):
            forget(path)


def forget(path: str) -> None:
    """Remove one scratch folder, which no frame may still want."""
    if spark := _made.pop(path, None):
        delete(spark, path)


def _leave() -> None:
    sweep()
    for path, spark in _lasting.items():
        with contextlib.suppress(Exception):
            delete(spark, path)


atexit.register(_leave)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it from there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a range that ``numbered`` sorts in one task, about.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Every row with its place (long, from 1) in ``order``, where no task holds all rows.

    Rows are dealt to ranges and numbered within each; a range begins after the rows of those
    before it, of which there is one counted row each. Rows that ``order`` doesn't tell apart
    are dealt by a column of their own, so many equal ones are no hot range either.
    """
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "unordered")
    pieces = max(partitions(rows.sparkSession), rows.count() // RANGE_ROWS)
    dealt = stage(rows.repartitionByRange(pieces, *order, F.col("tie")).withColumn("piece", F.spark_partition_id()), "ranges")
    counts, starts, before = {r["piece"]: r["n"] for r in dealt.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}, [], 0
    for piece in sorted(counts):
        starts.append((piece, before))
        before += counts[piece]
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "piece int, begin long"))  # a row for each range
    place = F.row_number().over(W.Window.partitionBy("piece").orderBy(*order, "tie"))
    return dealt.withColumn(name, place.cast("long")).join(begins, "piece").withColumn(name, F.col(name) + F.col("begin")).drop("piece", "begin", "tie")


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts: one narrow JVM aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def bucket_count(spark: SparkSession, total_bytes: float, each: int = 6 << 20) -> int:
    """Buckets of a packed shuffle: about ``each`` bytes in one, so that a bucket fits a worker at any input size."""
    return max(partitions(spark), int(total_bytes / each) + 1)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed block. Sorted 64-bit keys go as differences with like bytes together."""
    parts = []
    for c in columns:
        if c.dtype == np.uint64:
            c = np.diff(c, prepend=np.uint64(0))
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T
        parts.append(np.uint32(len(c)).tobytes() + c.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.uint32, 1, at)[0]), np.dtype(raw[at + 4 : at + 8].decode().strip())
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at + 8).reshape(kind.itemsize, n)
        c = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if kind == np.uint64 else c)
        at += 8 + size
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + length[i]`` of all i, one after the other."""
    total = np.cumsum(length)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(start - (total - length), length)


#: Keys with more than 1 / HOT_SHARE of the rows are joined by broadcast; there are at most HOT_SHARE of them.
HOT_SHARE = 4096


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows to one fact row for each key, whose column ``count`` is the key's number of rows.

    Facts of hot keys are broadcast, at most ``HOT_SHARE`` of them, so that a hot key's rows
    stay where they are; only the others shuffle.
    """
    n = rows.count()
    share = max(1000, n // HOT_SHARE)
    hot = facts.filter(F.col(count) > share)
    cold = facts.filter(F.col(count) <= share)
    told = F.broadcast(hot.select(key, F.lit(True).alias("is_hot")))
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(told, key, "left_anti").join(cold, key)
    return near.unionByName(rest)


#: Bits of a table of marks: 8 MB, and where there are more marks up to 64 MB. Where even so more marks meet, more rows are looked at; results stay the same.
TABLE_BITS, MOST_BITS = 1 << 26, 1 << 29


def bit_table(marks: DataFrame, staged: bool = False) -> np.ndarray:
    """A table with the bits of column ``mark`` (longs, well mixed in the low bits) set, about eight bits for each mark: at most 16,384 rows of 4 KB reach the driver.

    ``marks`` is read twice, and so written first where it isn't ``staged``.
    """
    marks = marks if staged else stage(marks, "marks")
    bits = min(MOST_BITS, max(TABLE_BITS, 1 << (8 * marks.count() - 1).bit_length()))
    place = F.col("mark").bitwiseAND(F.lit(bits - 1)) + 1  # bitmap functions count from 1
    table = np.zeros(bits // 8, np.uint8)
    for r in marks.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect():
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return table


def has_bits(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks.astype(np.uint64).view(np.int64) & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows as one packed block for each bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = [pack(*(c[a:b] for c in columns)) for a, b in zip(cut, np.append(cut[1:], len(bucket)))]
    return pa.record_batch([pa.array(bucket[cut], pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])


def split_by_marks(rows: DataFrame, key: str, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``key`` is surely not in ``marked`` (a frame with that one column), and the others.

    The marks are broadcast as bitmaps of about eight bits a mark, ``TABLE_BITS`` at least and ``MOST_BITS`` at most,
    so that only the others need a shuffle. Columns of ``rows`` are not named as the bitmaps' are.
    """
    marked = stage(marked, "marked")
    place = F.pmod(F.xxhash64(key), F.lit(min(MOST_BITS, max(TABLE_BITS, 1 << (8 * marked.count() - 1).bit_length()))))
    maps = stage(marked.select(place.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__map")), "marks")
    told = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place)).join(F.broadcast(maps), "__bucket", "left")
    hit = test_bit("__map", F.col("__bit"))
    return told.filter(~hit).select(*rows.columns), told.filter(hit).select(*rows.columns)


def test_bit(bitmap: str, position) -> F.Column:
    """Whether a binary column has a bit set; a null bitmap has none."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
