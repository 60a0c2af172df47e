"""Scans, projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinspark.functions.columns import money
from skeinspark.operators.joins import asof_join, asof_within, interval_join, range_join, salted_join, small
from skeinspark.operators.sampling import sample_exact
from skeinspark.operators.sorting import placed
from skeinspark.plans.registry import Registry
from skeinspark.sources import formats
from skeinspark.sources.buckets import bucketed
from skeinspark.sources.tables import over_tables, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


@query("""
SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY c_mktsegment
""")
def q_revenue_by_segment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= ntz("1996-01-01"))
    return (
        table(spark, sf_dir, "customer")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n_lines"), money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    )


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_csv_round_trip(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "customer"), "csv")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_json_round_trip(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "customer"), "json")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2_orc_round_trip(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "customer"), "orc")


@query("SELECT p_name AS value FROM part")
def s2_text_round_trip(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), "text")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def p1_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"))


@query("""
SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem
WHERE l_quantity BETWEEN 20 AND 25 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_discount IS NOT NULL
""")
def p2_filter(spark, sf_dir):
    c = F.col
    return (
        table(spark, sf_dir, "lineitem")
        .filter(c("l_quantity").between(20, 25) & c("l_returnflag").isin("A", "R") & (c("l_shipdate") >= ntz("1997-01-01")) & c("l_discount").isNotNull())
        .select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    )


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (p_name LIKE '% ring' OR p_name LIKE '_e_ %') AND p_type NOT LIKE 'S%'")
def p2_like(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").filter((c("p_name").like("% ring") | c("p_name").like("_e_ %")) & ~c("p_type").like("S%")).select("p_partkey", "p_name", "p_type")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band,
       coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status
FROM orders
""")
def p3_conditional(spark, sf_dir):
    c = F.col
    band = F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 50000, "middle").otherwise("low")
    return table(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), F.coalesce(F.nullif(c("o_orderstatus"), F.lit("P")), F.lit("pending")).alias("status"))


@query("SELECT DISTINCT lang, source FROM documents")
def p4_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT o_orderkey, l_linenumber, l_quantity, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000")
def j1_inner(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_orderpriority")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2_left(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT d.doc_id, l.quality, d.lang FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id AND l.quality = 1")
def j2_right(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", "quality")
    return good.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "right")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.lang, b.quality
FROM (SELECT doc_id, lang FROM documents WHERE lang <> 'en') a FULL JOIN (SELECT doc_id, quality FROM labels) b ON a.doc_id = b.doc_id
""")
def j2_full(spark, sf_dir):
    a = table(spark, sf_dir, "documents").filter("lang <> 'en'").select("doc_id", "lang")
    return a.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "full")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j3_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j4_cross(spark, sf_dir):
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j5_broadcast(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), money(F.sum("c_acctbal")).alias("balance"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def j6_sort_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").hint("merge")
    joined = o.join(table(spark, sf_dir, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), money(F.sum("l_quantity")).alias("quantity"))


@query("SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def j6_bucketed(spark, sf_dir):
    """Both sides laid out once in the same buckets, which then join without an exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", buckets)
    li = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "l_orderkey", buckets)
    joined = o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), money(F.sum("l_quantity")).alias("quantity"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def j7_range(spark, sf_dir):
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return range_join(table(spark, sf_dir, "customer"), bands, "c_acctbal", "low", "high", 10).select("s_suppkey", "c_custkey")


@query("""
SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p
  ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 3600 SECOND
WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def j8_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return interval_join(views, buys, ["user_id"], "viewed", "bought", 3600).select("view_id", "purchase_id", "user_id")


@query("""
SELECT l.event_id, l.user_id, r.value AS last_view FROM events l
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts
WHERE l.event_type = 'purchase'
""")
def j9_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return asof_within(e, F.col("event_type") == "purchase", F.col("event_type") == "view", "user_id", "ts", "value", "last_view").select("event_id", "user_id", "last_view")


@query("""
WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT * FROM events WHERE event_type = 'purchase'),
a AS (SELECT p.event_id, p.user_id, p.ts, r.ts AS before, r.value AS back FROM p ASOF LEFT JOIN v r ON p.user_id = r.user_id AND p.ts >= r.ts),
b AS (SELECT p.event_id, r.ts AS after, r.value AS forth FROM p ASOF LEFT JOIN v r ON p.user_id = r.user_id AND p.ts <= r.ts),
c AS (SELECT event_id, user_id, ts, CASE WHEN before >= ts - INTERVAL 2 HOUR THEN before END AS before, back, CASE WHEN after <= ts + INTERVAL 2 HOUR THEN after END AS after, forth FROM a JOIN b USING (event_id))
SELECT event_id, user_id, CASE WHEN after IS NOT NULL AND (before IS NULL OR after - ts < ts - before) THEN forth WHEN before IS NOT NULL THEN back END AS nearest_view FROM c
""")
def j9_asof_nearest(spark, sf_dir):
    """The view that is nearest in time to each purchase, before or after it, within two hours."""
    e = table(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(buys, e.filter("event_type = 'view'"), "user_id", "ts", "ts", "value", alias="nearest_view", direction="nearest", tolerance="2 hours").select("event_id", "user_id", "nearest_view")


@query("""
SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer, LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o
""")
def j10_lateral(spark, sf_dir):
    top = table(spark, sf_dir, "orders").filter(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return table(spark, sf_dir, "customer").lateralJoin(top).select("c_custkey", "o_orderkey", "o_totalprice")


_EXISTS = "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"


@query(_EXISTS)
def j11_exists(spark, sf_dir):
    return over_tables(spark, sf_dir, _EXISTS, "orders", "lineitem")


_SCALAR = "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)"


@query(_SCALAR)
def j11_scalar_subquery(spark, sf_dir):
    return over_tables(spark, sf_dir, _SCALAR, "lineitem")


@query("SELECT l_suppkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey")
def j12_salted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    joined = salted_join(lines, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey", 4)
    return joined.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), money(F.sum("s_acctbal")).alias("balance"))


@query("""
SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id) AS place
FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY quality DESC NULLS FIRST, doc_id
""")
def o1_sort_nulls(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return placed(joined, "quality", "doc_id").orderBy(F.desc_nulls_first("quality"), "doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o2_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def o2_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@query("""
SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5
""")
def o3_top_k_per_group(spark, sf_dir):
    from pyspark.sql.window import Window

    # A rank filter over row_number is pushed below the shuffle as a per-task group limit.
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("place", place).filter("place <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query()
def o4_sample(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7)


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR))) AS place FROM orders) WHERE place <= 50
""")
def o4_sample_exact(spark, sf_dir):
    """Fifty orders of each priority, drawn by priorities that depend on the key alone."""
    return sample_exact(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_orderkey", 50)


@query("SELECT count(*) AS n, TRUE AS within FROM lineitem")
def o4_sample_within(spark, sf_dir):
    """The sample's size is within five standard deviations of a tenth."""
    t = table(spark, sf_dir, "lineitem")
    sizes = t.agg(F.count(F.lit(1)).alias("n")).crossJoin(t.sample(0.1, seed=7).agg(F.count(F.lit(1)).alias("m")))  # a row each
    return sizes.select("n", (F.abs(F.col("m") - F.col("n") * 0.1) <= 5 * F.sqrt(F.col("n") * 0.09)).alias("within"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u1_union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def u1_union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


def _two(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u2_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def u2_intersect_all(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersectAll(b)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
def u2_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.subtract(b.filter("k < 12"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u2_except_all(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b)
