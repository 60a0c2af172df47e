"""Overlap with a benchmark and the text of pages, against versions written out and the standard library's parser."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from skeinspark.functions import html as H
from skeinspark.operators import overlap

from .conftest import SF


def grams(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("most", [100_000, 2])
def test_benchmark_overlap(spark, most):
    passage = "A b c d E f g h"
    docs = [(1, passage), (2, f"x {passage}  y\tz " * 3), (3, None), (4, ""), (5, "a b"), (6, "a b c\n" * 2000), (7, "q r s t"), (None, passage), (1, "a b c d e f g h"), (8, "Ä b c É")]
    items = [(1, "a b c d e f"), (2, "c a b c a"), (3, None), (4, "a b"), (5, "s t u"), (None, "f g h"), (6, "q R s"), (6, "r s t"), (7, "ä b c é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "words", "gram", "grams", "items", "overlap", "bucket", "a.b")}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "gram", "size_of", "share")})
    want = {}
    ids = {i for i, _ in items}
    of_item = {i: set().union(*(grams(t, 3) for j, t in items if j == i)) for i in ids}
    for k in {i for i, _ in docs}:
        mine = set().union(*(grams(t, 3) for j, t in docs if j == k))
        for i, theirs in of_item.items():
            if n := len(mine & theirs):
                want[k, i] = (n, len(theirs), n / len(theirs))
    got = {(r.doc_id, r.item_id): (r.overlap, r.n_grams, r.share) for r in overlap.benchmark_overlap(d, b, n=3, most=most).collect()}
    assert got == want and len(want) > 10
    assert overlap.benchmark_overlap(d.limit(0), b, n=3, most=most).count() == 0
    assert overlap.benchmark_overlap(d, b.limit(0), n=3, most=most).count() == 0


def test_document_grams_do_not_shuffle(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = overlap.benchmark_overlap(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "SortMergeJoin [gram" not in plan


class Parser(HTMLParser):
    """The standard library's reading: text, a line break for each block, nothing for raw elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw = [], None

    def handle_starttag(self, tag, attrs):
        self.out.append("\n" if tag in H.BLOCKS else "")
        self.raw = tag if tag in H.DROPPED else self.raw

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in H.BLOCKS else "")
        self.raw = None if tag == self.raw else self.raw

    def handle_data(self, data):
        if not self.raw:
            self.out.append(re.sub(r"[ \t\n\f\r]+", " ", data))


def parsed(page):
    p = Parser()
    p.feed(page)
    p.close()
    return re.sub(r" *\n[ \n]*", "\n", re.sub(" +", " ", "".join(p.out))).strip(" \n")


def test_pages_against_the_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html", H.html_text("html").alias("text")).collect()
    assert len(rows) == 250
    for r in rows:
        assert r.text == parsed(r.html)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no markup &lt;b&gt; &amp;amp; &#65;&#x42;", "no markup <b> &amp; AB"),
        ("a<b>b</b> <i>c</i>d", "ab cd"),
        ("<p>one<p>two<br>three</p><hr/>four", "one\ntwo\nthree\nfour"),
        ("a <!-- <p> -- > --> b<!-->c<!--->d<!-- open", "a bcd"),
        ("x<script type='a>b'>if (a<b) { '<p>' }</script>y<STYLE>p{}</style >z", "xyz"),
        ("x<script>open </scripty> <p>", "x"),
        ('<a title="1 > 0" href=\'<p>\'>t</a>', "t"),
        ("<a b=\"open > quote <p> text", ""),
        ("2 < 3 <3 a<1 <", "2 < 3 <3 a<1 <"),
        ("<title>a < b & c <b></title>d", "a < b & c <b>\nd"),
        ("<textarea><p>x</textarea>y", "<p>xy"),
        ("&am<b>p;</b> &copy;&nbsp;x &unknown; &amp", "&amp; ©\xa0x &unknown; &"),
        ("<!DOCTYPE html><?xml a?></ x>t</>u", "tu"),
        ("  a \n\t b  <div>  </div>  c  ", "a b\nc"),
        ("a<custom-tag x=y/>b<svg:g>c", "abc"),
        ("nul\0l", "null"),
        ("<td>1</td><td>2</td>", "1\n2"),
        ("cut <a href=", "cut"),
    ],
)
def test_page_text(page, text):
    assert H.page_text(page) == text


def test_broken_pages_take_time_in_proportion():
    import time

    for piece in ("<a \"", "<a '", "<!--", "<script>", "<p <p", "</", "<a = \" ", "<title>", "&", "< "):
        began = time.perf_counter()
        H.page_text(piece * 100_000)
        assert time.perf_counter() - began < 3, piece


def test_html_text_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (4, "x " * 500_000)], "page_id long, html string")
    got = sorted((r.page_id, r.t) for r in df.select("page_id", H.html_text("html").alias("t")).collect() if r.t is not None and r.page_id < 4)
    assert got == [(2, ""), (3, "a"), (3, "a")]
    assert df.filter("page_id = 1").select(H.html_text("html").alias("t")).first().t is None
    assert df.limit(0).select(H.html_text("html")).count() == 0
