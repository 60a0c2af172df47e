"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinspark.functions.html import html_text
from skeinspark.operators.overlap import benchmark_overlap
from skeinspark.plans.registry import Registry
from skeinspark.sources.tables import table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) AS gram FROM w),
g AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) AS gram FROM b),
s AS (SELECT item_id, count(*) AS n_grams FROM g GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS overlap, any_value(n_grams) AS n_grams, count(*) / any_value(n_grams) AS share
FROM d JOIN g USING (gram) JOIN s USING (item_id) GROUP BY doc_id, item_id
""")
def d3_benchmark_overlap(spark, sf_dir):
    return benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH a AS (SELECT page_id, regexp_replace(html, '[ \\t\\n\\f\\r]+', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?i)<!--.*?(-->|\\z)|<script\\b.*?(</script *>|\\z)|<style\\b.*?(</style *>|\\z)', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|li|ul|nav|div|article|h1|title|head|body|html|footer|br)( [^>]*)?(>|\\z)', chr(10), 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(t, '<[A-Za-z/!][^>]*(>|\\z)', '', 'g') AS t FROM c),
e AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), chr(10) || ' ') AS t FROM d)
SELECT page_id, regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM e
""")
def d4_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))
