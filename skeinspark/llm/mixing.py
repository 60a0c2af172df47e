"""Mixing sources to target weights.

Words are summed for each source, targets are filled up by weight below their caps, and
each source gets a rate, its target over its words. Every document is taken floor(rate)
times, and once more where a coin seeded by its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.operators.joins import small

from ._shared import join_by_key, numbered, settled, stage

WEIGHTS = (3, 1, 2)
#: The mix in hundredths of all words, and the most that a source's words are repeated.
SHARE, CAP = 150, 2
SEED = 42
_WORD, _BLANK = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a whole text as a long; null has none. Words become one letter each and blanks nothing, so no list of words is made."""
    letters = F.regexp_replace(F.regexp_replace(text, _WORD, "w"), _BLANK, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 of a document's id; of its text where it has none."""
    name = F.coalesce(doc_id.cast("string"), F.sha2(text, 256), F.lit(""))
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8)
    return (F.conv(first, 16, 10).cast("long") + 0.5) / 4294967296.0


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, cap: int = CAP) -> DataFrame:
    """``sources`` (key, words) with weight, target and rate.

    Weights go round over the keys in their order. What is above a source's cap is shared anew by
    weight among the others until none is above: in each round the sources above the level are
    held at their caps, and what they leave raises it. A round is one aggregate of one row.
    A source without words has no target; its rate is 0.
    """
    table = numbered(sources, [F.col("key")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(table.withColumn("weight", weight.cast("long")), "sources")
    total = table.agg(F.sum("words")).first()[0] or 0
    most = F.col("words") * cap
    level = None  # words for each unit of weight, as a fraction; weights and words are whole, so nothing is rounded
    held_words = held_weight = -1
    while True:
        above = F.lit(False) if level is None else F.col("weight").cast("decimal(10,0)") * F.lit(level[0]).cast("decimal(22,0)") > most.cast("decimal(22,0)") * F.lit(level[1]).cast("decimal(12,0)")
        held = table.agg(F.sum(F.when(above, most)).alias("words"), F.sum(F.when(above, F.col("weight"))).alias("weight"), F.sum("weight").alias("all")).first()
        words, at = held["words"] or 0, held["weight"] or 0
        if (words, at) == (held_words, held_weight) or at == (held["all"] or 0):
            break
        held_words, held_weight = words, at
        level = (share * total - 100 * words, 100 * ((held["all"] or 0) - at))
    free = F.lit(0.0) if level is None else F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
    target = F.when(above, most.cast("double")).otherwise(free)
    return table.withColumn("target", target).withColumn("rate", F.coalesce(F.try_divide("target", F.col("words").cast("double")), F.lit(0.0)))


@settled
def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target (its source's), copies, taken (words, copies counted).

    Sources in order of code points, null as the last one, weigh ``weights`` by turns and share
    ``share`` hundredths of all words; none is repeated more than ``cap`` times. Reruns agree:
    copies depend on the id alone (of rows without one, on the text). A null or empty text has
    no words and is taken as often as others of its source. Repeated rows share one coin. Very
    long texts are counted whole, an empty table gives no rows, and columns besides doc_id,
    text and source are not read.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = stage(docs.select("doc_id", key.alias("key"), word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("coin")), "sizes")
    sources = rows.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    rates = stage(targets(stage(sources, "source-words"), weights, share, cap), "rates")
    copies = F.floor("rate") + F.when(F.col("coin") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    told = join_by_key(rows, rates, "key", "n").withColumn("copies", copies.cast("long"))
    return told.select("doc_id", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


@settled
def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay, whatever their names. Options are those of ``mix_sources``.

    Rows with a null id or repeated ids are taken as ``mix_sources`` says. Texts stay where they are:
    rates, a row for each source, come to them where these are few, else by a join.
    """
    weights, share, cap, seed = (options.get(k, v) for k, v in (("weights", WEIGHTS), ("share", SHARE), ("cap", CAP), ("seed", SEED)))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sources = docs.select(key.alias("key"), word_count(F.col("text")).alias("size")).groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    rates = stage(targets(stage(sources, "source-words"), weights, share, cap), "rates").select("key", "rate")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key.alias("key"), coin(F.col("doc_id"), F.col("text"), seed).alias("coin"))
    copies = F.floor("rate") + F.when(F.col("coin") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    told = rows.join(small(rates), "key").withColumn("copies", copies.cast("int"))
    return told.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).select("row.*")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op12_mixing": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         (('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), sha256(text), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS coin FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (place - 1) % 3] AS BIGINT) AS weight FROM s),
o AS (SELECT *, coalesce(sum(2 * words) OVER b, 0) AS held, coalesce(sum(weight) OVER b, 0) AS gone, sum(words) OVER () AS all_words, sum(weight) OVER () AS all_weight
  FROM w WINDOW b AS (ORDER BY words::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT 150 * all_words - 100 * held AS up, 100 * (all_weight - gone) AS down FROM o
  WHERE weight * (150 * all_words - 100 * held) <= 2 * words * 100 * (all_weight - gone) ORDER BY words::DOUBLE / weight, place LIMIT 1),
t AS (SELECT source, words, least(2 * words::DOUBLE, weight * up::DOUBLE / down::DOUBLE) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.words, t.target, d.coin, coalesce(t.target / nullif(t.words::DOUBLE, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, words AS source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
}
QUERIES = {"op12_mixing": op12_mixing}
