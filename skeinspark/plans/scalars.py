"""Scalar functions, user functions and time windows in batch."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from skeinspark.functions.columns import cosine, distance, dot
from skeinspark.operators.aggregation import Moments, aggregate_by
from skeinspark.operators.joins import small
from skeinspark.operators.nearest import nearest
from skeinspark.plans.registry import Registry
from skeinspark.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, substring(p_name, 1, 5) AS head, length(p_name) AS n, concat_ws('-', p_brand, p_type) AS joined,
       replace(p_name, ' ', '_') AS under, regexp_extract(p_name, '([0-9]+)', 1) AS digits, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS starred,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, reverse(p_brand) AS back, trim('  ' || p_brand || ' ') AS trimmed, split_part(p_name, ' ', 1) AS word, instr(p_name, 'a') AS at
FROM part
""")
def f1_string(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.upper("p_brand").alias("up"), F.substring("p_name", 1, 5).alias("head"), F.length("p_name").alias("n"), F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.replace(c("p_name"), F.lit(" "), F.lit("_")).alias("under"), F.regexp_extract("p_name", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_type", "[AEIOU]", "*").alias("starred"),
        F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.reverse("p_brand").alias("back"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"), F.split_part(c("p_name"), F.lit(" "), F.lit(1)).alias("word"), F.instr("p_name", "a").alias("at"),
    )


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
       CAST(o_orderdate AS DATE) + 30 AS due, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS age, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end, dayofweek(o_orderdate) + 1 AS weekday
FROM orders
""")
def f2_date(spark, sf_dir):
    c, d = F.col("o_orderdate"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("d"), F.quarter(c).alias("q"), F.date_format(c, "yyyy-MM-dd").alias("day_text"),
        F.date_add(d, 30).alias("due"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("age"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.dayofweek(d).alias("weekday"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 8) AS log, CAST(floor(l_extendedprice / 7) AS BIGINT) AS low, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS high,
       round(power(l_quantity, 1.5), 4) AS pow, abs(l_discount - 0.05) < 0.01 AS close, l_orderkey % 7 AS rest, greatest(l_quantity, l_tax * 100) AS most, CAST(sign(l_quantity - 25) AS DOUBLE) AS side
FROM lineitem
""")
def f3_math(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.ln("l_extendedprice"), 8).alias("log"), F.floor(c("l_extendedprice") / 7).alias("low"), F.ceil(c("l_extendedprice") / 7).alias("high"),
        F.round(F.pow("l_quantity", F.lit(1.5)), 4).alias("pow"), (F.abs(c("l_discount") - 0.05) < 0.01).alias("close"), F.pmod("l_orderkey", F.lit(7)).alias("rest"), F.greatest("l_quantity", c("l_tax") * 100).alias("most"), F.signum(c("l_quantity") - 25).alias("side"),
    )


@query("""
SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square,
       len(list_filter(embedding, lambda x: x > 0)) AS positive, round(CAST(list_max(embedding) AS DOUBLE), 5) AS top, round(CAST(embedding[1] AS DOUBLE), 5) AS first
FROM embeddings
""")
def f4_array(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(dot(e, e), 5).alias("square"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.round(F.array_max(e).cast("double"), 5).alias("top"), F.round(F.element_at(e, 1).cast("double"), 5).alias("first"),
    )


@query("SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def f4_explode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT event_type, CAST(cardinality(m) AS INTEGER) AS kinds, m['a'] AS a, coalesce(m['z'], 0) AS z FROM (SELECT event_type, map {'a': count(*), 'b': count(DISTINCT user_id)} AS m FROM events GROUP BY event_type)")
def f5_map(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("n", "u"))
    return g.withColumn("m", m).select("event_type", F.size(F.map_keys("m")).alias("kinds"), F.element_at("m", "a").alias("a"), F.coalesce(F.try_element_at("m", F.lit("z")), F.lit(0)).alias("z"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def f6_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("""
SELECT o_orderkey, TRY_CAST('x' || o_orderstatus AS INTEGER) AS none, o_totalprice / nullif(o_orderkey % 2, 0) AS odd_only, isnan(o_totalprice) AS nan, ifnull(nullif(o_orderpriority, '5-LOW'), '-') AS shown
FROM orders
""")
def f8_null_and_errors(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("try_cast('x' || o_orderstatus AS int)").alias("none"), F.try_divide(c("o_totalprice"), c("o_orderkey") % 2).alias("odd_only"), F.isnan("o_totalprice").alias("nan"), F.ifnull(F.nullif(c("o_orderpriority"), F.lit("5-LOW")), F.lit("-")).alias("shown")
    )


@query("""
SELECT a.vec_id, b.vec_id AS first_of_label, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS dot,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS distance
FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY label) b ON a.label = b.label
""")
def f7_vector_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    firsts = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"), F.min("vec_id").alias("first_of_label"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(small(firsts), "label").select(
        "vec_id", "first_of_label", F.round(dot(a, b), 5).alias("dot"), F.round(cosine(a, b), 5).alias("cosine"), F.round(distance(a, b), 5).alias("distance")
    )


@query("""
SELECT query_id, vec_id, similarity, place FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS place
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE place <= 5
""")
def f7_k_nearest(spark, sf_dir):
    """The five nearest of all vectors by cosine, for the query vectors: those whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1_tumbling(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT start, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * CAST(k AS INTEGER)) AS start FROM events, range(4) AS r(k)) GROUP BY start
""")
def t2_sliding(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


@query("""
WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM b GROUP BY user_id, s
""")
def t3_session(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


@query("SELECT event_id, round(value * 2 + 1, 6) AS y FROM events")
def x1_scalar_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def affine(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return table(spark, sf_dir, "events").select("event_id", F.round(affine("value"), 6).alias("y"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def x2_aggregate_udf(spark, sf_dir):
    # The range of each day first, so that the user function never gets all rows of a group.
    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return float(high.max() - low.min())

    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return days.groupBy("event_type").agg(F.round(spread("low", "high"), 6).alias("spread"))


@query("SELECT n_nationkey, i AS part, split_part(n_name, 'A', CAST(i AS INTEGER)) AS word FROM nation, LATERAL (SELECT unnest(range(1, len(string_split(n_name, 'A')) + 1)) AS i)")
def x3_table_udf(spark, sf_dir):
    @F.udtf(returnType="part bigint, word string")
    class Parts:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split("A"), 1):
                yield i, w

    return table(spark, sf_dir, "nation").lateralJoin(Parts(F.col("n_name").outer())).select("n_nationkey", "part", "word")


@query("""
WITH s AS (SELECT event_type, avg(value) AS mean, var_pop(value) AS variance FROM events GROUP BY event_type)
SELECT event_type, count(e.value) AS n, round(any_value(s.mean), 5) AS mean, round(any_value(s.variance), 5) AS variance,
       round(avg((e.value - s.mean) * (e.value - s.mean) * (e.value - s.mean)) / pow(any_value(s.variance), 1.5), 4) AS skewness
FROM events e JOIN s USING (event_type) GROUP BY event_type
""")
def x2_partial_states(spark, sf_dir):
    """A user's aggregate with states that are merged: moments of values."""
    told = aggregate_by(table(spark, sf_dir, "events"), "event_type", ["value"], Moments(), "n long, mean double, variance double, skewness double")
    return told.select("event_type", "n", F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance"), F.round("skewness", 4).alias("skewness"))


@query("SELECT doc_id, i AS part, string_split(text, ' ')[i] AS word FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, ' ')) + 1)) AS i)")
def x3_table_udf_documents(spark, sf_dir):
    """A table function over batches of a table: about ``at_once`` words of whole texts at a time."""
    at_once = 1 << 15

    @F.arrow_udtf(returnType="doc_id bigint, part bigint, word string")
    class Words:
        def eval(self, rows: pa.RecordBatch):
            for k in range(rows.num_rows):
                words = pa.compute.split_pattern(rows.column("text").slice(k, 1), " ").flatten()
                for lo in range(0, len(words), at_once):
                    some = words.slice(lo, at_once)
                    ids = pa.repeat(rows.column("doc_id")[k], len(some))
                    yield pa.table({"doc_id": ids, "part": pa.array(range(lo + 1, lo + 1 + len(some)), pa.int64()), "word": some})

    return Words(table(spark, sf_dir, "documents").select("doc_id", "text").asTable())


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, CAST(sum(len(text)) AS BIGINT) AS letters FROM documents GROUP BY source")
def x3_partitioned(spark, sf_dir):
    """A table function with a table argument by partition: documents by source, a large source in slots."""

    @F.arrow_udtf(returnType="source string, n bigint, langs array<string>, letters bigint")
    class Totals:
        def __init__(self):
            self.source, self.n, self.letters, self.langs = None, 0, 0, set()

        def eval(self, rows: pa.RecordBatch):
            self.source = rows.column("source")[0].as_py()
            self.n += rows.num_rows
            self.letters += pa.compute.sum(rows.column("letters")).as_py() or 0
            self.langs |= set(rows.column("lang").unique().to_pylist())

        def terminate(self):
            if self.n:  # a task without rows ends as well
                yield pa.table({"source": pa.array([self.source], pa.string()), "n": [self.n], "langs": pa.array([sorted(x for x in self.langs if x is not None)], pa.list_(pa.string())), "letters": [self.letters]})

    docs = table(spark, sf_dir, "documents").select("source", "lang", F.length("text").cast("long").alias("letters"), F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("slot"))
    told = Totals(docs.asTable().partitionBy("source", "slot"))
    return told.groupBy("source").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("langs")))).cast("long").alias("langs"), F.sum("letters").alias("letters"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def x4_grouped_map(spark, sf_dir):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pdf["user_id"][:1], "n": [int(pdf["n"].sum())], "total": [pdf["total"].sum()]})

    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return days.groupBy("user_id").applyInPandas(fold, "user_id long, n long, total double").withColumn("total", F.round("total", 4))
