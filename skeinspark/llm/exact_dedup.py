"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one folds every text hash into a distributed filter of 64-bit words: a word whose
rows outnumber its distinct bits holds a possible repeat. Pass two tests every row
against the suspect words, as a bitmap of bounded size that is broadcast. Rows that
cannot repeat pass straight through; only the others shuffle, as digest and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import join_by_key, settled, split_by_marks, stage, test_bit

#: Bits of the broadcast filter at most: 8 MB. Beyond what these can tell apart more rows shuffle; results stay the same.
FILTER_BITS = 1 << 26
_PER_BITMAP = 8 * 4096


def _suspects(docs: DataFrame, doc_id: str, text: str, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows with whether they may repeat, and the groups of those that may."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(value, 256)).alias("digest"), F.xxhash64(value).alias("hash")), "digests")
    cells = 1 << max(10, (4 * rows.count() - 1).bit_length())
    bits = min(filter_bits, max(_PER_BITMAP, cells))
    cell = F.col("hash").bitwiseAND(F.lit(cells - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 58) as int))")
    suspect = (
        rows.groupBy(cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits"))
        .filter(F.col("n") > F.bit_count("bits"))
        .select(F.col("cell").bitwiseAND(F.lit(bits - 1)).alias("at"))
    )
    seen = suspect.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    told = stage(
        rows.withColumn("at", cell.bitwiseAND(F.lit(bits - 1)))
        .withColumn("bucket", F.bitmap_bucket_number("at"))
        .join(F.broadcast(seen), "bucket", "left")  # at most filter_bits bits
        .select("doc_id", "digest", test_bit("bitmap", F.bitmap_bit_position("at")).alias("maybe")),
        "suspects",
    )
    groups = stage(told.filter("maybe").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return told, groups


@settled
def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest id of a group stays.
    Null ids lose to any other id and stay only where a group has no other. Repeated rows
    of one id and text count each in ``group_size`` and share their fate. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    told, groups = _suspects(docs, doc_id, text, filter_bits)
    alone = told.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    grouped = join_by_key(told.filter("maybe").select("doc_id", "digest"), groups, "digest", "group_size").select("doc_id", "keep_id", "group_size", "digest")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


@settled
def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest doc_id; repeated rows become one.

    Null texts count as empty, null ids lose to any other, very long texts are hashed whole, and
    an empty table gives no rows. All columns stay, whatever their names.
    Rows of other texts pass straight through, and further copies are dropped where they are;
    of the texts only those that stay in a group shuffle, and those that marks can't tell apart.
    """
    told, groups = _suspects(docs, "doc_id", "text", FILTER_BITS)
    again = groups.filter("group_size > 1").withColumn("key", F.xxhash64("digest"))
    marked = again.select("key")
    # Marks may meet by chance: digests that do so without a group of their own.
    _, near = split_by_marks(told.select("digest", F.xxhash64("digest").alias("key")), "key", marked)
    chance = stage(near.join(again.select("digest"), "digest", "left_anti").select("key").distinct(), "chance")

    identity = lambda c: F.struct(F.coalesce(c, F.lit(0).cast("long")).alias("i"), c.isNull().alias("n"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(whole, digest.alias("digest"), identity(F.col("doc_id")).alias("id")).withColumn("key", F.xxhash64("digest")).withColumn("place", F.xxhash64("digest", "id"))
    alone, members = split_by_marks(rows, "key", marked)
    keep = again.select("digest", identity(F.col("keep_id")).alias("id"))
    _, kept = split_by_marks(members, "place", keep.select(F.xxhash64("digest", "id").alias("place")))
    # An equi-join on digest and id together, so that the rows of a large group go to different tasks.
    stay = kept.join(keep, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    _, unsure = split_by_marks(members, "key", chance)
    other = unsure.join(again.select("digest"), "digest", "left_anti")
    return alone.select("row.*").unionByName(stay.select("row.*")).unionByName(other.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
