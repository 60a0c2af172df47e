"""Aggregates and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skeinspark.functions.columns import money
from skeinspark.operators.quantiles import exact_quantiles
from skeinspark.plans.registry import Registry
from skeinspark.sources.tables import over_tables, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus
""")
def a1_group_by(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '2000-09-02'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_price"), money(F.avg("l_discount"), 6).alias("avg_disc"),
            F.min("l_quantity").alias("min_qty"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n"),
        )
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def a2_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query()
def a3_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS within FROM events GROUP BY event_type")
def a3_approx_within(spark, sf_dir):
    """The approximate count is within three of its stated standard errors of the exact one."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return g.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users")).alias("within"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a4_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), money(F.sum("l_quantity")).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a4_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@query(_SETS)
def a4_grouping_sets(spark, sf_dir):
    return over_tables(spark, sf_dir, _SETS, "orders")


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price, quantile_disc(l_quantity, 0.9) AS p90_quantity FROM lineitem GROUP BY l_returnflag")
def a5_percentile(spark, sf_dir):
    return exact_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", {"median_price": ("l_extendedprice", 0.5, "cont"), "p90_quantity": ("l_quantity", 0.9, "disc")})


_WITHIN_GROUP = """
SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS low_quantity, percentile_disc(0.75) WITHIN GROUP (ORDER BY l_quantity) AS high_quantity FROM lineitem GROUP BY l_returnflag
"""


@query(_WITHIN_GROUP)
def a5_within_group(spark, sf_dir):
    """The engine's own operator, which keeps a count of each distinct value of a group; quantities have few."""
    return over_tables(spark, sf_dir, _WITHIN_GROUP, "lineitem")


@query()
def a6_approx_percentile(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10_000).alias("quartiles"))


@query("SELECT l_returnflag, share, TRUE AS within FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS t(share)")
def a6_approx_within(spark, sf_dir):
    """The rank of each approximate quartile is within a ten thousandth of the rows, its stated error, of the exact one."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    shares = [0.25, 0.5, 0.75]
    about = t.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", shares, 10_000).alias("q"))  # a row for each flag
    ranks = t.join(F.broadcast(about), "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col("l_extendedprice") < F.col("q")[k], 1).otherwise(0)).alias(f"below{k}") for k in range(3)), *(F.sum(F.when(F.col("l_extendedprice") <= F.col("q")[k], 1).otherwise(0)).alias(f"upto{k}") for k in range(3))
    )
    near = lambda k, s: (F.col(f"below{k}") <= (s + 1e-4) * F.col("n") + 1) & (F.col(f"upto{k}") >= (s - 1e-4) * F.col("n") - 1)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), near(k, s).alias("within")) for k, s in enumerate(shares)))).alias("e")
    return ranks.select("l_returnflag", each).select("l_returnflag", "e.share", "e.within")


@query("SELECT l_returnflag, round(var_samp(l_quantity), 4) AS variance, round(stddev_samp(l_extendedprice), 2) AS deviation, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag")
def a7_statistics(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
        .agg(F.round(F.var_samp("l_quantity"), 4).alias("variance"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("deviation"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"))
    )


@query("SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a8_collect(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


_FILTERED = """
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10
"""


@query(_FILTERED)
def a9_filtered_having(spark, sf_dir):
    return over_tables(spark, sf_dir, _FILTERED, "lineitem")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view
FROM events GROUP BY user_id
""")
def a10_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def a10_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "name", "value")


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_totalprice > 0) AS all_paid FROM orders GROUP BY o_orderpriority")
def a11_max_by(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.bool_or(c("o_orderstatus") == "P").alias("any_pending"), F.bool_and(c("o_totalprice") > 0).alias("all_paid")
    )


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr, ntile(4) OVER w AS quarter,
       round(percent_rank() OVER r, 8) AS pr, round(cume_dist() OVER r, 8) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def w1_ranking(spark, sf_dir):
    w, r = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(r).alias("rk"), F.dense_rank().over(r).alias("dr"), F.ntile(4).over(w).alias("quarter"),
        F.round(F.percent_rank().over(r), 8).alias("pr"), F.round(F.cume_dist().over(r), 8).alias("cd"),
    )


@query("""
SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2, first_value(value) OVER w AS first,
       last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(value, 3) OVER w AS third
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w2_offset(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after2"), F.first("value").over(w).alias("first"),
        F.last("value").over(whole).alias("last"), F.nth_value("value", 3).over(w).alias("third"),
    )


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS running, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w3_rows_frame(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-2, 1)), 6).alias("near")
    )


_RANGE = """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events
"""


@query(_RANGE)
def w4_range_frame(spark, sf_dir):
    return over_tables(spark, sf_dir, _RANGE, "events")


@query("SELECT l_partkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS alike FROM lineitem")
def w4_numeric_range(spark, sf_dir):
    w = W.partitionBy("l_suppkey").orderBy("l_quantity").rangeBetween(-2, 2)
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("alike"))
