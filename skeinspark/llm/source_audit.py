"""Audit of how sources diverge from each other and from their language.

Tasks count terms of slices of text, so what shuffles is a row for each term and group of
a slice. A group's terms are ranked by a radix selection: histograms over 16 bits of the
values at a time find the value of each group's last rank, and where very many rows have
that value, histograms over bytes of the terms go on. Only what lies above is sorted.
Divergences of all pairs of sources start from the value that terms absent from both
would give, and are corrected for the terms that either has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skeinspark.operators.joins import small

from ._shared import ragged, settled, stage, tidy
from ._words import NO_LETTER, slices, words

LEAST_DOCUMENTS, RANKS = 3, 200
UNIT = 1_000_000_000
#: Bytes of text that are counted at once in a task, and bits of a value that a histogram tells apart.
SLICE, DIGIT = 4 << 20, 16
#: Rows of a group between which a histogram need not choose: they are sorted.
FEW = 4096


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offs = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[ragged(start, size)]))).cast(pa.string())


def _count_terms(batches):
    """Of batches with lang, source and text: lang, source, term, occurrences and documents, of a slice each."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        wide = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        for lo, _, data, offs in slices(batch.column("text"), SLICE):
            w = words(data, offs, breaks=NO_LETTER)
            if not len(w.hash):
                continue
            distinct, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
            pair, n = np.unique(w.row * len(distinct) + ids, return_counts=True)  # a document's term
            key, back = np.unique(group[lo + pair // len(distinct)] * len(distinct) + pair % len(distinct), return_inverse=True)
            at, g = first[key % len(distinct)], key // len(distinct)
            yield pa.record_batch(
                [
                    lang.dictionary.take(pa.array(g // wide)), source.dictionary.take(pa.array(g % wide)), _strings(w.data, w.start[at], w.end[at]),
                    pa.array(np.bincount(back, n, len(key)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(key)).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it). Nulls are read as empty."""
    told = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = told.mapInArrow(tidy(_count_terms), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT (n + 1) / total), exactly."""
    units = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", units, total.cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); a square of shares fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _kept(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms with occurrences (lang, source, term, n, total), and every group (lang, source, base: its share of an absent term, terms, size, lang_size)."""
    counts = stage(term_counts(docs), "terms")
    of_term = W.Window.partitionBy("lang", "term")  # a row for each source
    kept = (
        counts.withColumns({"found": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
        .filter(F.col("found") >= least)
        .select("lang", "source", "term", "n", "total", "first")
    )
    kept = stage(kept, "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct().join(sizes, ["lang", "source"], "left")
    groups = stage(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "terms"))), "sizes")
    langs = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("terms").alias("lang_terms"))
    told = groups.drop("terms").join(small(langs), "lang").withColumnRenamed("lang_terms", "terms")
    base = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("size") + F.col("terms")))
    return kept.drop("first"), stage(told.withColumn("base", base), "groups")


def _pairs(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (every other source of the language) and value.

    For a pair the value is that of absent terms, times all terms; corrected for each side's own terms,
    by the number of terms that have a share; and again for terms that both have.
    """
    g = groups.select("lang", "source", "base", "terms")
    a, b = (g.select("lang", F.col("source").alias(s), F.col("base").alias(f"{s}_base"), "terms") for s in ("source", "item"))
    every = a.join(b.drop("terms"), "lang").filter("source <> item")
    absent = F.when(F.col("terms") > 0, F.col("terms") * _gap(F.col("source_base"), F.col("item_base"))).otherwise(0)
    whole = every.select("lang", "source", "item", absent.alias("value"))

    shares = stage(rates.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("n")), "shares")
    met = shares.join(small(g.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))), "lang").filter("source <> other")
    p, own, other = F.col("p"), F.col("base"), F.col("other_base")
    forth = F.struct(F.col("source").alias("source"), F.col("other").alias("item"), (F.col("n") * (_gap(p, other) - _gap(own, other))).alias("value"))
    back = F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("n") * (_gap(other, p) - _gap(other, own))).alias("value"))
    one = met.select("lang", F.explode(F.array(forth, back)).alias("e")).select("lang", "e.*")

    left = rates.select("lang", "term", "source", F.col("p").alias("pa"), F.col("base").alias("a"))
    right = rates.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("base").alias("b"))
    pa_, pb, a_, b_ = (F.col(c) for c in ("pa", "pb", "a", "b"))
    both = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(
        F.sum(_gap(pa_, pb) - _gap(pa_, b_) - _gap(a_, pb) + _gap(a_, b_)).alias("forth"), F.sum(_gap(pb, pa_) - _gap(pb, a_) - _gap(b_, pa_) + _gap(b_, a_)).alias("back")
    )
    ways = F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item"), F.col("forth").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    two = both.select("lang", F.explode(ways).alias("e")).select("lang", "e.*")
    return whole.unionByName(one).unionByName(two).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the greatest ``value`` (a long from 0), ties to the smaller ``item`` (UTF-8 bytes), with their rank from 1.

    In each round the rows of a group that may hold its last rank are counted by the next ``DIGIT``
    bits of their value, and those of the greatest digits that hold ``k`` rows stay in question. A group
    is done when ``few`` rows at most are. Of a value that more rows have, the item's bytes are told
    apart likewise, two at a time. What is above and what is in question is then sorted: ``k + few``
    rows of a group at most. A task or a window holds counts of at most 2 ** ``DIGIT`` digits of a group.
    Null values and items are not expected; items of a group that are the same are in question together.
    """
    spark = rows.sparkSession
    top = rows.agg(F.max(value)).first()[0] or 0
    shift = max(0, -(-int(top).bit_length() // DIGIT) * DIGIT - DIGIT)
    v, spelt = F.col(value), F.hex(F.encode(F.col(item), "UTF-8"))  # the order of hex digits is that of bytes, and a prefix is less
    # Of an open group: ``at``, its digits so far; ``need``, ranks that are still to be filled by rows with these digits.
    first = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumns({"at": F.lit(0).cast("long"), "bits": F.lit(63), "prefix": F.lit(""), "chars": F.lit(0), "need": F.least(F.lit(k).cast("long"), F.col("n"))})
    state, bits, chars = stage(first, "radix"), shift, 0
    while not state.filter(F.col("n") > few).isEmpty():
        going = state.filter(F.col("n") > few)
        open_ = going.drop("n", "bits", "chars")
        inside = rows.join(small(open_), group)
        if bits >= 0:
            inside = inside.filter(F.shiftright(v, bits + DIGIT) == F.col("at")) if bits < shift else inside
            digit, order = F.shiftright(v, bits), F.desc("digit")
        else:
            chars += 4
            inside = inside.filter((v == F.col("at")) & (F.substring(spelt, 1, chars - 4) == F.col("prefix")))
            digit, order = F.substring(spelt, 1, chars), F.asc("digit")
        counts = inside.groupBy(*group, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = W.Window.partitionBy(*group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
        chosen = counts.withColumn("upto", F.sum("n").over(upto)).join(small(open_), group).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        left = F.col("need") - F.col("upto") + F.col("n")
        if bits >= 0:
            step = chosen.select(*group, "n", F.col("digit").alias("at"), F.lit(bits).alias("bits"), "prefix", F.lit(0).alias("chars"), left.alias("need"))
        else:
            ended = F.length("digit") < chars  # all rows of this digit are the same item
            step = chosen.select(*group, F.when(ended, 0).otherwise(F.col("n")).alias("n"), "at", F.lit(0).alias("bits"), F.col("digit").alias("prefix"), F.lit(chars).alias("chars"), left.alias("need"))
        state = stage(state.filter(F.col("n") <= few).unionByName(step), "radix")
        bits -= DIGIT
    # bits is 63 where all rows of a group are in question.
    own = F.expr(f"shiftright(`{value}`, bits)")
    above = (own > F.col("at")) | ((own == F.col("at")) & (F.substring(spelt, F.lit(1), F.col("chars")) <= F.col("prefix")))
    near = rows.join(small(state.drop("n", "need")), group).filter(above)
    rank = F.row_number().over(W.Window.partitionBy(*group).orderBy(F.desc(value), item))
    return near.drop("at", "bits", "prefix", "chars").withColumn("rank", rank).filter(F.col("rank") <= k)


@settled
def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, few: int = FEW) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language (part ``pair``), and the terms it has more of than its language (part ``term``, up to ``ranks``).

    Null texts, langs and sources are read as empty, and groups without terms count as well: a
    language without kept terms has pairs of value 0. A term is kept where ``least`` documents of the
    language have it; repeated rows count each. All sums are of whole numbers. Very long texts are
    read whole, an empty table gives no rows, and other columns are not read. Exact, up to meeting
    64-bit hashes of terms of more than eight bytes within a slice.
    """
    kept, groups = _kept(docs, least)
    met = kept.join(small(groups), ["lang", "source"])
    rates = stage(
        met.select(
            "lang", "source", "term", "base", _share(F.col("n"), F.col("size") + F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_size") + F.col("terms")).alias("q")
        ),
        "rates",
    )
    pairs = _pairs(rates, groups)
    among = W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row for each other source
    first = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(among).alias("rank"))
    more = stage(rates.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")), "more")
    top = radix_top(more, ["lang", "source"], "value", "item", ranks, few)
    return first.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op11_source_audit": """
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
own AS (SELECT w.lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
lang_size AS (SELECT lang, sum(total) AS size, count(*) AS terms FROM kept GROUP BY lang),
grp_size AS (SELECT lang, source, sum(n) AS size FROM own GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(s.size, 0) + l.terms) AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (l.size + l.terms) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN lang_size l ON l.lang = g.lang
  LEFT JOIN grp_size s ON s.lang = g.lang AND s.source = g.source LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gap g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
}
QUERIES = {"op11_source_audit": op11_source_audit}
