"""Overlap of documents with the items of a benchmark, by n-grams of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinspark.operators.joins import BROADCAST_ROWS, small

#: Words of an n-gram. Bits of a filter of n-grams at most (8 MB) and for each n-gram, where these are too many to broadcast.
WORDS, FILTER_BITS, BITS_EACH = 8, 1 << 26, 16
_MAP_BITS = 8 * 4096


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def _grams(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (with ``words``) without it and by n-gram, as text. Words are taken by place, so that long texts take time in proportion. Rows of fewer words give none."""
    spelt = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))), lambda i: F.concat_ws(" ", *(F.get("words", i + k) for k in range(n))))
    # An outer explode: of an inner one a filter would be inferred that splits the text anew for each word.
    return rows.withColumn("grams", F.when(F.size("words") >= n, spelt)).withColumn("gram", F.explode_outer("grams")).drop("words", "grams").filter("gram is not null")


def gram_index(items: DataFrame, item_id: str, text: str, n: int = WORDS) -> DataFrame:
    """Inverted index of the items' n-grams: gram, and the ids of the items that have it, each once."""
    told = _grams(items.select(F.col(item_id).alias("item_id"), _word_list(F.col(text)).alias("words")), n)
    return told.groupBy("gram").agg(F.array_union(F.collect_set("item_id"), F.when(F.count("item_id") < F.count(F.lit(1)), F.array(F.lit(None).cast(told.schema["item_id"].dataType))).otherwise(F.array().cast(f"array<{told.schema['item_id'].dataType.simpleString()}>"))).alias("items"))


def _may_be_in(told: DataFrame, index: DataFrame) -> DataFrame:
    """The rows whose n-gram a filter of the index can't rule out: a bitmap of bounded size, broadcast."""
    bits = min(FILTER_BITS, max(_MAP_BITS, 1 << (BITS_EACH * index.count() - 1).bit_length()))
    at = F.pmod(F.xxhash64("gram"), F.lit(bits)) + 1  # bitmap functions count from 1
    maps = index.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    told = told.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return told.join(F.broadcast(maps), "bucket").filter(F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1).drop("bucket", "bit", "bitmap")


def benchmark_overlap(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = WORDS, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, overlap, n_grams and share, for each document and item that share an n-gram.

    ``overlap`` counts the item's distinct n-grams of ``n`` words (lower-cased, between blanks) that the
    whole text has, ``n_grams`` all that the item has, and ``share`` is their ratio. Texts and
    items that are null, empty or have fewer than ``n`` words overlap nothing. Rows of one document id
    count as one document, those of one item id as one item; null ids are an id of their own. Other
    columns are not read.

    An index of up to ``most`` n-grams (counted) is broadcast, and document n-grams never shuffle. Beyond
    that a filter of bounded size is broadcast, and only n-grams that it can't rule out shuffle.
    A document's n-gram goes once, so one that all documents have is as many rows as documents, which
    are dealt by document before they meet.
    """
    index = gram_index(items, item_id, text, n)
    told = _grams(docs.select(F.col(doc_id).alias("doc_id"), _word_list(F.col(text)).alias("words")), n)
    if index.limit(most + 1).count() <= most:
        hits = told.join(F.broadcast(index), "gram").select("doc_id", "gram", "items").distinct()
    else:
        hits = _may_be_in(told, index.select("gram")).distinct().join(index, "gram").select("doc_id", "gram", "items")
    found = hits.select("doc_id", F.explode("items").alias("item_id")).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = index.select(F.explode("items").alias("size_of")).groupBy("size_of").agg(F.count(F.lit(1)).alias("n_grams"))
    joined = found.join(small(sizes, most), F.col("item_id").eqNullSafe(F.col("size_of"))).drop("size_of")
    return joined.withColumn("share", F.col("overlap") / F.col("n_grams")).select("doc_id", "item_id", "overlap", "n_grams", "share")
