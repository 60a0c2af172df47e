"""The operators that compare, mix and resample sources, against versions written out in plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinspark import llm
from skeinspark.llm import importance, mixing, source_audit

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASH = ("key", "coin", "words", "n", "place", "tie", "piece", "term", "size", "base", "p", "q", "bits", "prefix", "weight", "score", "rank", "buckets", "row", "a.b", "copies", "rate")


def texts():
    rng = np.random.default_rng(7)
    vocabulary = ["the", "The", "of", "Äpfel", "äpfel", "x9", "9", "don't", "word-pair", "日本", "z" * 150, "É", "a_b"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    say = lambda n: [vocabulary[int(k)] for k in np.minimum(rng.zipf(1.3, n), len(vocabulary)) - 1]
    langs, sources = ["en", "fr", None, ""], ["s1", "s2", "Z", "é", None, "", "s1 "]
    rows = [(k, " ".join(say(int(rng.integers(0, 120)))), langs[int(rng.integers(4)) if k % 3 else 0], sources[int(rng.integers(7)) if k % 2 else 0]) for k in range(150)]
    rows += [(200, None, "en", "s1"), (201, "", "en", "s2"), (202, " \n\t!", "de", "s1"), (203, "one", "de", "s9"), (None, "the of", None, None), (None, None, "en", None)]
    rows += [(204, " ".join(say(30_000)), "en", "s2"), rows[3], rows[3], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    llm.ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


def share(n, total):
    return 1 + 10**9 * (n + 1) // total


def divergence(rows, least, ranks):
    terms = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in terms}:
        found = collections.Counter(w for a, _, ws in terms if a == lang for w in set(ws))
        kept = {w for w, n in found.items() if n >= least}
        own = {s: collections.Counter() for a, s, _ in terms if a == lang}
        for a, s, ws in terms:
            if a == lang:
                own[s].update(w for w in ws if w in kept)
        every = sum(own.values(), collections.Counter())
        p = {s: {w: share(c[w], sum(c.values()) + len(kept)) for w in kept} for s, c in own.items()}
        q = {w: share(every[w], sum(every.values()) + len(kept)) for w in kept}
        gap = lambda x, y: (x - y) ** 2 // y
        for s in own:
            pairs = [(o, sum(gap(p[s][w], p[o][w]) for w in kept)) for o in own if o != s]
            more = [(w, gap(p[s][w], q[w])) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", more, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks", "few"), [(3, 200, 4096), (1, 7, 2), (10_000, 5, 1)])
def test_source_divergence(docs, rows, least, ranks, few):
    got = source_audit.source_divergence(docs, least, ranks, few)
    assert sorted(map(tuple, got.collect())) == divergence(rows, least, ranks)


def test_source_divergence_of_nothing(docs):
    assert source_audit.source_divergence(docs.limit(0)).count() == 0


def test_radix_top_tells_ties_apart(spark):
    """Long ties with common beginnings, one item the beginning of many, large and equal values."""
    rows = [("a", 5, "x" * k) for k in range(60)] + [("a", 5, f"x{k:03}") for k in range(60)] + [("a", 1 << 60, "big"), ("a", (1 << 60) - 1, "next"), ("a", 0, "none")]
    rows += [("b", k // 9 << 20, f"é{k % 9}") for k in range(200)] + [("c", 1, "only")] + [("d", 7, f"y{'z' * 8}{k:04}") for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, i string").repartition(4)
    for k, few in ((1, 1), (65, 3), (500, 4096)):
        want = []
        for g in "abcd":
            want += [(*r, n) for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k], 1)]
        got = source_audit.radix_top(df, ["g"], "v", "i", k, few).select("g", "v", "i", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def mixed(rows, weights=(3, 1, 2), share=150, cap=2):
    size = [len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]
    words = collections.Counter()
    for r, n in zip(rows, size):
        words[r[3]] += n
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    from fractions import Fraction

    held, total = set(), Fraction(share * sum(words.values()), 100)
    while True:
        free = [s for s in order if s not in held]
        if not free:
            break
        level = (total - sum(cap * words[s] for s in held)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > cap * words[s]}
        if not more:
            break
        held |= more
    target = {s: float(cap * words[s]) if s in held else float(weight[s] * level) for s in order}
    return size, words, target


def test_mixing(docs, rows):
    size, words, target = mixed(rows)
    got = collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in mixing.mix_sources(docs).collect())
    assert got == collections.Counter((r[0], n, words[r[3]], round(target[r[3]], 6)) for r, n in zip(rows, size))
    told = mixing.mix_sources(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in told)
    assert sorted(map(str, told)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in told)
    assert {r["a.b"] for r in out.select("`a.b`").distinct().collect()} == {"clash"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.emit_mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + k * 7919 % 40), "en", f"s{k % 11 if k % 3 else 0}") for k in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.first("source_size").alias("n")).collect()
    assert all(abs(r.t - r.want) <= 0.05 * r.want for r in told)
    assert any(r.want == 2 * r.n for r in told) and sum(r.want for r in told) == pytest.approx(1.5 * sum(r.n for r in told))


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(df).collect()] == [(0.0, 0)] * 3


def grams(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent, least):
    told = [grams(r[1]) for r in rows]
    s, t = collections.Counter(b for _, g in told for b in g), collections.Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for r, (n, g) in zip(rows, told):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out.append([r[0], n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    places = collections.defaultdict(list)
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        places[tuple(x)].append(k)
    return sorted(str((*x, places[tuple(x)].pop(0) if places[tuple(x)] and x[1] >= least else None)) for x in out)


@pytest.mark.parametrize("stretch", [1 << 18, 50])
def test_resample(spark, docs, rows, monkeypatch, stretch):
    monkeypatch.setattr(importance, "_STRETCH", stretch)
    target = [rows[0][1], rows[1][1], None, "", "unseen words here"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((5, 20), (60, 1)):
        got = importance.resample(docs, aim, percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(str(tuple(r)) for r in got) == resampled(rows, target, percent, least)
    assert importance.resample(docs.limit(0), aim).count() == 0
    assert importance.resample(docs, aim.limit(0)).count() == len(rows)


def test_span_checksums():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    start, size = rng.integers(0, 3000, 500), np.concatenate((rng.integers(0, 90, 460), rng.integers(90, 1000, 40)))
    got = importance.span_checksums(data, start, size)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size)]


def test_numbered_of_equal_rows(spark, monkeypatch):
    """Rows that the order doesn't tell apart are dealt to many ranges."""
    from skeinspark.llm import _shared

    monkeypatch.setattr(_shared, "RANGE_ROWS", 100)
    got = _shared.numbered(spark.range(2000).select(F.lit(1).alias("v")), [F.col("v")], "place")
    assert sorted(r.place for r in got.collect()) == list(range(1, 2001))
    assert max(r["count"] for r in got.groupBy(F.floor((F.col("place") - 1) / 100)).count().collect()) == 100


def test_queries_against_sql(spark, duck):
    from ..conftest import SF

    for module in (source_audit, mixing):
        for name, sql in module.ORACLE.items():
            df = module.QUERIES[name](spark, SF)
            result = duck.execute(sql)
            names = [d[0] for d in result.description]
            assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
