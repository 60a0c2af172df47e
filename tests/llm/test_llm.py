"""The operators for training data against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinspark import llm
from skeinspark.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, language, language_model, packing, quality, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EXTRA = ("key", "bits", "row", "score", "digest", "hash", "slot", "rank", "bucket", "place", "range", "unit", "label", "node", "n")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def base_texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    say = lambda n: [vocabulary[k] for k in rng.integers(0, 400, n)]
    texts = [None, "", " \n\t ", "one", "one two three", "ONE two THREE", "a" * 3000, "x " * 300]
    passage = say(60)
    for k in range(12):
        w = say(int(rng.integers(40, 200)))
        texts.append(" ".join(w))
        if k % 2:
            texts.append(" ".join(w[:-3] + say(3)))
        if k % 3 == 0:
            texts.append(" ".join(w))
        if k % 4 == 0:
            texts.append(" ".join(say(20) + passage + say(15)))
    texts.append(" ".join(say(20_000)))
    return texts


@pytest.fixture(scope="module")
def rows():
    t = [(i * 3 + 2, x) for i, x in enumerate(base_texts())]
    return [*t, t[10], t[0], (None, None), (None, t[9][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    llm.ship(spark)
    df = spark.createDataFrame([(i, x, "en", "s") for i, x in rows], "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, x in rows:
        groups[x or ""].append(i)
    want = sorted(
        str((i, k, len(g), i == k, hashlib.sha256((x or "").encode()).hexdigest())) for i, x in rows for g in [groups[x or ""]] for k in [max((j for j in g if j is not None), default=None)]
    )
    for bits in (exact_dedup.FILTER_BITS, 1 << 15):
        assert sorted(str(tuple(r)) for r in exact_dedup.exact_groups(docs, filter_bits=bits).collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in kept.collect()) == sorted((x, max(j for j in g if j is not None)) for x, g in groups.items())
    assert exact_dedup.drop_copies(empty).count() == 0


def test_exact_dedup_where_marks_meet(spark, monkeypatch):
    from skeinspark.llm import _shared

    monkeypatch.setattr(_shared, "TABLE_BITS", 16)  # rows without copies meet the marks of others
    texts = [f"text {k}" for k in range(60)] + [f"text {k}" for k in range(8)] + ["text 3", None, ""]
    data = [(k, t) for k, t in enumerate(texts)] + [(70, "")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()
    last = {t or "": k for k, t in data}
    assert sorted(r["doc_id"] for r in kept) == sorted(last.values())


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, shards=5, slots=64).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for _, x in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(empty).count() == 0


#: Names that operators use beside a row, and names that need quotes.
HELPERS = ("__key", "__row", "__spans", "__score", "__n_chars", "__digest", "__id", "__at", "__bucket", "__bit", "__map", "a.b", "row", "whole", "key", "digest", "id", "place", "spans", "size", "score", "with space", "back`tick")


def test_columns_of_users_stay(spark):
    """Whatever their names, columns come through each function that drops or mends rows as they were."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"v{k}" for k in rng.integers(0, 500, n))
    passage = say(70)
    texts = [say(90) for _ in range(12)] + [f"{say(20)} {passage} {say(9)}" for _ in range(4)]
    texts += [texts[0], texts[1] + " more", None, "", None]
    names = [n for n in HELPERS if "`" not in n]
    df = spark.createDataFrame([(k, t, *(f"{n}-{k}" for n in names)) for k, t in enumerate(texts)], ["doc_id", "text", *names]).withColumn("n_chars", F.length("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    for f in (exact_dedup.drop_copies, jaccard_join.drop_near_copies, suffix_dedup.remove_repeats, lambda d: quality.drop_rejected(d, labels, 0.0)):
        out = f(df)
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) >= 15 and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in names)
    assert any(r.text != texts[r.doc_id] for r in suffix_dedup.remove_repeats(df).collect())


def test_slot_map(spark, tmp_path):
    sizes = np.random.default_rng(2).integers(1, 1000, 2000).tolist()
    first = sharding.SlotMap.balanced(sizes, 24)
    load = np.bincount(first.shard, sizes)
    assert load.max() - load.min() <= 1000
    grown = first.rebalanced(sizes, 25)
    assert grown.version == 2 and all(to == 24 for _, _, to in grown.moved)
    load = np.bincount(grown.shard, sizes)
    assert load.max() < 1.05 * load.mean() and load[24] > 0.9 * load.mean()
    first.save(spark, f"{tmp_path}/map")
    grown.save(spark, f"{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map", 1).shard == first.shard
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map", 2).shard == grown.shard


ODD = ["'s", "it's we'll  're x're I'M'd", "a  b\n\n c \n", " \t'll 'll", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> 's", "<|endof", "héé 日本語 ١٢٣ ½  x  y　", "ab" * 400, "''s '' 's", "x́y 🙂🙂 e‍", "1234 5678a9", "\x1c\x1d\x85 a\x85b", "\r\n x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe(spark, docs, rows, empty, library):
    odd = spark.createDataFrame([(1000 + k, x) for k, x in enumerate(ODD)], "doc_id long, text string")
    all_rows = [*rows, *((1000 + k, x) for k, x in enumerate(ODD))]
    both = docs.select("doc_id", "text").unionByName(odd)
    ids = [library.encode(x or "", add_special_tokens=False).ids for _, x in all_rows]
    want = sorted(
        str((i, len(k), hashlib.sha256(",".join(map(str, k)).encode()).hexdigest(), hashlib.sha256(library.decode(k, skip_special_tokens=False).encode()).hexdigest())) for (i, _), k in zip(all_rows, ids)
    )
    assert sorted(str(tuple(r)) for r in bpe.round_trip(both).collect()) == want
    encoded = bpe.encode_documents(both)
    assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == sorted(str((i, k)) for (i, _), k in zip(all_rows, ids))
    assert sorted(str((r.doc_id, r.text)) for r in bpe.decode_documents(encoded).collect()) == sorted(str((i, x or "")) for i, x in all_rows)
    assert bpe.round_trip(empty).count() == 0


def test_bpe_checks_agree_with_merging():
    tool = bpe.encoder(bpe.default_vocabulary())
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("thersionagw"), rng.integers(1, 14))).encode() for _ in range(3000)]
    exact = [list(x) for x in tool.merged_all(pieces)]
    assert exact == [tool.merged(p) for p in pieces]
    ids, count = tool.propose(pieces)
    first = np.cumsum(np.abs(count)) - np.abs(count)
    for a, n, want in zip(first, count, exact):
        x = ids[a : a + n]
        assert n > 0 and tool.compatible(x[:-1], x[1:]).all() == (x.tolist() == want)


def test_packing(docs, rows, empty, library):
    length = 128
    got = packing.pack_documents(docs, length).collect()
    spans = sorted((r.sequence_id * length + r.offset, r.length) for r in got)
    assert [a for a, _ in spans] == list(itertools.accumulate([0, *(n for _, n in spans[:-1])]))
    assert all(r.offset + r.length <= length for r in got)
    want = collections.Counter()
    for i, x in rows:
        want[i, tuple(library.encode(x or "", add_special_tokens=False).ids + [1])] += 1
    pieces = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.sequence_id * length + r.offset):
        pieces[r.doc_id].append(r)
    have = collections.Counter()
    for i, parts in pieces.items():
        ids: list = []
        for r in parts:
            assert r.start == len(ids)
            ids += np.frombuffer(bytes(r.ids), "<u4").tolist()
            if len(ids) == r.doc_tokens:
                have[i, tuple(ids)] += 1
                ids = []
        assert not ids
    assert have == want
    assert packing.pack_documents(empty).count() == 0


def test_hilbert_curve():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def shingles(text, k=5):
    w = split(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(x) for _, x in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
        common = len(sets[a] & sets[b])
        if same_id or sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    return [(i, len(s), i if not s else min((j for j in least[find(a)] if j is not None), default=None)) for a, ((i, _), s) in enumerate(zip(rows, sets))]


def test_jaccard_join(spark, docs, rows, empty):
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_components(rows)))
    assert jaccard_join.near_duplicates(empty).count() == 0
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = [(i, x) for (i, x), (_, _, c) in zip(rows, brute_components(rows)) if c is None or i == c]
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, want))


def test_jaccard_join_of_clusters(spark, monkeypatch):
    """Chains, near-threshold copies and runs of several blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    llm.ship(spark)
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = f"e{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(brute_components(rows))


@pytest.mark.parametrize("home", [8, 4096])
def test_jaccard_join_sends_bitmaps_once_to_a_home(spark, monkeypatch, home):
    """Runs that begin with one class share homes, in which a class has one bitmap; each run lies whole in one home, of a bounded number of runs."""
    monkeypatch.setattr(jaccard_join, "HOME", home)
    llm.ship(spark)
    rng = np.random.default_rng(23)
    rows = []
    for k in range(80):
        w = [f"g{k // 8}w{i}" for i in range(120)]
        for at in rng.integers(0, 120, int(rng.integers(0, 3))).tolist():
            w[at] = f"e{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = jaccard_join.candidate_runs(df.select("text"), 4, 75).collect()
    sent, members = {(r.home, r.key) for r in runs}, collections.Counter(r.home for r in runs)
    assert len({(r.run, r.home) for r in runs}) == len({r.run for r in runs})
    if home == 4096:
        assert 2 * len(sent) < len(runs) and max(members.values()) <= home
    else:
        assert len(members) > 40
    got = jaccard_join.near_duplicates(df, links=True).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute_join_links(rows))


def brute_join_links(rows):
    """Other rows whose sets link, for each row."""
    sets = [shingles(x) for _, x in rows]
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    return [(i, sum(link(s, t) for k, t in enumerate(sets) if k != m)) for m, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_join_counts_every_link(spark, docs, rows, empty, monkeypatch, block):
    """Groups of several blocks, copies, null ids, and different texts of one id."""
    monkeypatch.setattr(jaccard_join, "LINKS", block)
    got = jaccard_join.near_duplicates(docs, links=True).select("doc_id", "n_links").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_join_links(rows)))
    assert jaccard_join.near_duplicates(empty, links=True).count() == 0
    rng = np.random.default_rng(19)
    made = []
    for k in range(60):
        w = [f"b{i}" for i in range(60)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = f"e{k}"
        made.append((k // 2 * 2 if k < 8 else k, " ".join(w)))
    made += [(70, "p q r s t u"), (70, "v w x y z a b"), made[3]]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(df, links=True).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute_join_links(made))


def test_signature_tree_keeps_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    tree = jaccard_join.SignatureTree(n, n, [jaccard_join.signature(s) for s in sets], np.full(150, -1))
    i, j, _ = tree.pairs(75)
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    for a, b in itertools.combinations(range(150), 2):
        c = len(np.intersect1d(sets[a], sets[b]))
        if 100 * c >= 75 * (n[a] + n[b] - c):
            assert frozenset((a, b)) in found


def brute_repeats(rows, size=50):
    order = sorted({(i if i is not None else 1 << 63, x or "") for i, x in rows})
    first, out = {}, collections.defaultdict(set)
    for d in order:
        w = split(d[1])
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key not in first:
                first[key] = (d, k)
            elif first[key][0] != d or k >= first[key][1] + size:
                out[d] |= set(range(k, k + size))
    return out


def test_suffix_dedup(docs, rows, empty):
    # Of rows with one id (or none) and different texts the order is by a hash: leave these out here.
    some = [r for r in dict.fromkeys(rows) if r[0] is not None]
    df = docs.filter("doc_id is not null")
    want = {(d[0], k) for d, s in brute_repeats(some).items() for k in s}
    spans = suffix_dedup.repeated_spans(df).collect()
    assert {(r.doc_id, k) for r in spans for k in range(r.start, r.stop)} == want
    assert all(r.other_doc_id <= r.doc_id for r in spans)
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == docs.columns
    for r in cut.collect():
        text = dict(some)[r.doc_id]
        keep = [w for k, w in enumerate(re.findall("[^\x20\x09-\x0d]+", text or "")) if (r.doc_id, k) not in want]
        assert re.findall("[^\x20\x09-\x0d]+", r.text or "") == keep and (r.text is None) == (text is None)
    assert suffix_dedup.repeated_spans(docs).count() >= len({d for d, _ in want})
    assert suffix_dedup.repeated_spans(empty).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_in_two_steps(spark, docs, rows, empty):
    """The same spans where every anchor is salted, and rows that repeat are in many stretches."""
    some = [r for r in dict.fromkeys(rows) if r[0] is not None]
    want = {(d[0], k) for d, s in brute_repeats(some).items() for k in s}
    df = docs.filter("doc_id is not null").select("doc_id", "text")
    df = suffix_dedup._keyed(df.union(df).union(df).repartition(24))
    for crowded in (0, suffix_dedup.CROWDED):
        keys = suffix_dedup._union(suffix_dedup.repeated_windows(df, crowded=crowded)).join(df.select("key", "doc_id").distinct(), "key").collect()
        assert {(r.doc_id, k) for r in keys for k in range(r.start, r.stop)} == want
        assert suffix_dedup.repeated_windows(suffix_dedup._keyed(empty.select("doc_id", "text")), crowded=crowded).count() == 0


def test_passage_in_every_row(spark, monkeypatch):
    """Of a passage that more than 100 stretches hold, no group gets more than some multiple of the root of that."""
    llm.ship(spark)
    monkeypatch.setattr(suffix_dedup, "bucket_count", lambda *_: 4096)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{' '.join(f'a{k}x{j}' for j in range(k % 30))} {passage} {' '.join(f'b{k}x{j}' for j in range(k % 40))}") for k in range(200)]
    df = suffix_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string")).repartition(200)

    def largest(crowded):
        sent, merge, _ = suffix_dedup._steps(df, suffix_dedup.MIN_WORDS, suffix_dedup.GRAM, crowded)
        sent = sent.cache()
        groups = [sent.groupBy("bucket").count(), sent.groupBy("bucket").applyInArrow(merge, sent.schema).groupBy("bucket").count()]
        out = [g.agg(F.max("count")).first()[0] for g in groups]
        sent.unpersist()
        return out

    assert largest(10**9)[0] > 100 and max(largest(8)) <= 40 and max(largest(suffix_dedup.CROWDED)) <= suffix_dedup.CROWDED
    spans = suffix_dedup.repeated_spans(df).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in spans) == [(k, k % 30, k % 30 + 60) for k in range(1, 200)]
    assert all(r.other_doc_id < r.doc_id for r in spans)


def brute_links(vectors, cosine=0.9):
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[i] for i in good], float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    return good, link


def test_embedding_dedup(spark):
    llm.ship(spark)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    v = [*base.tolist(), *(base + rng.normal(size=base.shape) * 0.3).tolist(), *base[:20].tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-200] * 16, [1e200] * 16]
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(v)], "vec_id long, embedding array<double>, near string")
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(df).collect()}
    assert len(got) == len(v)
    good, link = brute_links(v)
    assert all(got[i].n_links <= n for i, n in zip(good, link.sum(1)))
    assert sum(got[i].n_links for i in good) >= 0.9 * link.sum()
    for i in set(range(len(v))) - set(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].component_id <= got[i - 320 if i >= 320 else i].vec_id for i in got if i < 320)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def brute_model(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [split(x) + [None] for _, x in rows]
    c1, c2 = collections.Counter(), collections.Counter()
    for (i, _), w in zip(rows, tokens):
        if not held(i):
            c1.update(w)
            c2.update(zip([0, *w[:-1]], w))
    of = lambda c: language_model.discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    cont = collections.Counter(w for _, w in c2)
    d1, d2 = (0, *of(cont)), (0, *of(c2))
    total, spare = collections.Counter(), collections.Counter()
    for (v, _), n in c2.items():
        total[v] += n
        spare[v] += d2[min(n, 3)]
    n_all, v_all, types = sum(c1.values()), len(c1), len(c2)
    left = sum(d1[min(n, 3)] for n in cont.values()) / types

    def p(v, w):
        low = (cont[w] - d1[min(cont[w], 3)]) / types + left / (v_all + 1)
        return low if not total[v] else (c2[v, w] - d2[min(c2[v, w], 3)]) / total[v] + spare[v] / total[v] * low

    return [
        (i, held(i), len(w), sum(c1[t] > 0 for t in w), n_all, sum(math.log10((c1[t] + 0.1) / (n_all + 0.1 * (v_all + 1))) for t in w), sum(math.log10(p(a, t)) for a, t in zip([0, *w[:-1]], w)))
        for (i, _), w in zip(rows, tokens)
    ]


def test_language_model(docs, rows, empty):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted((tuple(r) for r in language_model.score(docs, language_model.train(docs)).collect()), key=key)
    for a, b in zip(got, sorted(brute_model(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert language_model.score(empty, language_model.train(empty)).count() == 0


def test_quality(spark, docs, rows, empty):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(table, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema))
    out = quality.classify(docs, odd).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r, in zip(out) if r.doc_id == 2}) == 1
    assert quality.classify(empty, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == len(rows)
    assert quality.drop_rejected(docs, labels).columns == docs.columns


def test_quality_reads_metadata(spark):
    """Labels that only n_chars, or only a null text, tell."""
    llm.ship(spark)
    for tell in ("n_chars", "null"):
        rows = [(k, None if tell == "null" and k % 2 else "" if tell == "null" else "same words here", 9000 if tell == "n_chars" and k % 2 else None if k % 8 == 0 else 10) for k in range(600)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
        labels = spark.createDataFrame([(k, k % 2, 0) for k in range(600)], "doc_id long, quality int, toxic int")
        got = quality.classify(docs, labels, 0.5).collect()
        assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
    assert quality.classify(docs.drop("n_chars"), labels).count() == 600


def test_factorisation_machine_learns_pairs():
    """An exclusive or of two words, which no linear model can tell."""
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (1200, 2))
    data = [(np.array([5 + 1 * a, 15 + 1 * b]), np.array([1.0, 1.0]), rng.normal(size=18)) for a, b in bits]
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    fm = quality.FactorisationMachine.fit(data, y, epochs=60)
    row, bucket = np.repeat(np.arange(1200), 2), np.concatenate([d[0] for d in data])
    score = fm.score(row, bucket, np.ones(2400), np.stack([d[2] for d in data]))
    assert ((score > 0.5) == (y > 0)).mean() > 0.9


def test_language(spark, docs, rows, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language(table)
    got = language.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert out[2].lang_pred == out[5].lang_pred == "und" and out[5].score == 0
    odd = spark.createDataFrame([(1, "123 !!"), (2, "日本"), (3, "été")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identify(odd, model).orderBy("doc_id").collect()] == [True, False, False]
    nothing = language.fit_language(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"} and language.identify(empty, model).count() == 0


def test_language_decoding_written_out(spark, docs, rows):
    """Winner, second and score of each row as counts, sums and losses give them, one number at a time."""
    model = language.fit_language(spark.read.parquet(f"{SF}/documents.parquet"))

    def scores(text):
        counts, b = collections.Counter(), [int(language._FOLD[x]) for x in text.encode()]
        for at in range(len(b)):
            h = 0
            for k in range(1, min(language.GRAM, len(b) - at) + 1):
                h = (h * 0x01000193 + b[at + k - 1] + k) % 2**32
                counts[(((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 12) % language.BUCKETS] += 1
        length = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        loss = [0.0] * len(model.languages)
        for bit in range(model.code.shape[1]):
            out = model.weights[-1, bit] + sum(math.log1p(n) / length * model.weights[j, bit] for j, n in counts.items())
            for i in range(len(loss)):
                loss[i] += model.bit_weight[bit] * math.log1p(math.exp(-model.sharpness * out * model.code[i, bit]))
        p = [math.exp(min(loss) - x) for x in loss]
        return sorted(((x / sum(p), name) for x, name in zip(p, model.languages)), reverse=True)

    told = sorted(((r.lang_pred, r.second, r.score, r.ambiguous) for r in language.identify(docs, model).collect()), key=str)
    want = []
    for _, text in rows:
        if re.search("[a-zA-Zé]", text or ""):
            (p, a), (q, b) = scores(text)[:2]
            want.append((a, b, p, p - q < language.AMBIGUOUS))
        else:
            want.append(("und", None, 0.0, True))
    assert len(told) == len(want)
    for got, made in zip(told, sorted(want, key=str), strict=True):
        assert got[:2] == made[:2] and got[3] == made[3] and abs(got[2] - made[2]) < 1e-9


def test_slices_of_many_short_rows():
    import pyarrow as pa

    from skeinspark.llm import _words

    column = pa.array([None, "", *["a"] * 700, "b" * 3000, ""], pa.string())
    got = [(lo, hi, data.tobytes()) for lo, hi, data, _ in _words.slices(column, 1000, 256)]
    assert [lo for lo, *_ in got] + [len(column)] == [0] + [hi for _, hi, _ in got] and max(hi - lo for lo, hi, _ in got) == 256
    assert b"".join(d for *_, d in got) == b"a" * 700 + b"b" * 3000


def test_language_learns_every_language(spark):
    """140 languages of a word each, the rarest with the fewest rows; a small bound lowers the rows of each."""
    llm.ship(spark)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)} " * 8 for k in range(140)]
    data = [(k * 10 + j, words[k], f"l{k:03}") for k in range(140) for j in range(10 if k < 139 else 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = language.fit_language(df)
    assert model.languages == [f"l{k:03}" for k in range(140)]
    got = language.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang == "l139"]) == 1
    assert language.fit_language(df, sample=50).languages == model.languages


def test_codeword_gaps():
    c = language.codewords(300)
    brute = min((c[a] != c[b]).sum() for a, b in itertools.combinations(range(300), 2))
    assert min(language._least_gap(c, lo) for lo in range(0, 300, 256)) == brute


def test_codewords():
    for n in (2, 4, 7, 12, 60):
        c = language.codewords(n)
        gap = min((c[a] != c[b]).sum() for a, b in itertools.combinations(range(n), 2))
        assert gap >= 1 and (n <= 2 or gap >= 2)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    spans = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in out)
    assert [a for a, _ in spans] == list(itertools.accumulate([0, *(n for _, n in spans[:-1])]))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in out}
    best = docs.groupBy("text").agg(F.max("doc_id").alias("i")).collect()
    assert kept <= {r.i for r in best} and len(kept) > 0.7 * len(best)


def test_pipeline_against_brute_force(spark, library):
    """Each document's words after all stages, by brute force but for the scores of the classifier."""
    import corpus_pipeline

    words = lambda text: re.findall("[^\x20\x09-\x0d]+", text or "")
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(table, labels).collect() if r.score >= quality.THRESHOLD}
    last = {}
    for r in table.collect():
        if r.doc_id in good:
            last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    rows = [(i, x) for x, i in last.items()]
    rows = [(i, x) for (i, x), (_, _, c) in zip(rows, brute_components(rows)) if i == c]
    cut = {d[0]: s for d, s in brute_repeats(rows).items()}
    want = {i: [w for k, w in enumerate(words(x)) if k not in cut.get(i, ())] for i, x in rows}
    out = corpus_pipeline.run(spark, SF)
    ids = collections.defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    llm.discard(out)
    assert all(x[-1] == 1 for x in ids.values())
    assert {i: words(library.decode(x[:-1], skip_special_tokens=False)) for i, x in ids.items()} == want


def test_registered_queries(spark):
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in llm.queries()) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(llm.queries())


def alike_sequence(n, flip=0):
    """Letters a and b of which each half is the other's complement: polynomial hashes modulo a power of two can't tell the two apart."""
    return "".join("ab"[(k.bit_count() + flip) & 1] for k in range(n))


ALIKE = [alike_sequence(n, flip) for n in (1024, 2048, 4096) for flip in (0, 1)]


def test_hashes_tell_alike_words_apart():
    from skeinspark.llm import _words

    texts = [*ALIKE, *(alike_sequence(n, f) for n in (16, 32, 64, 128) for f in (0, 1)), *("x" * n for n in range(1, 140))]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    w = _words.words(data, np.array([0, len(data)]))
    assert len(w.hash) == len(texts) == len(set(w.hash.tolist()))
    h = np.random.default_rng(0).integers(0, 1 << 63, 30_000).astype(np.uint64)
    for k in (1, 2, 5, 25):
        g = _words.gram_hashes(h, k)
        assert len(g) == len(h) - k + 1 and all(_words.gram_hashes(h[i : i + k], k)[0] == g[i] for i in (0, 8190, 8192, 20_000))
        assert len(_words.gram_hashes(h[: k - 1], k)) == 0


def test_alike_words_in_every_operator(spark, library):
    """Texts that differ in one such word are not the same to any operator."""
    llm.ship(spark)
    more = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{w} {more}" if k % 2 else w) for k, w in enumerate(x for x in ALIKE for _ in range(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {i: library.encode(x, add_special_tokens=False).ids for i, x in rows}
    assert {r.doc_id: r.ids for r in bpe.encode_documents(df).collect()} == ids
    pieces = collections.defaultdict(list)
    for r in sorted(packing.pack_documents(df).collect(), key=lambda r: (r.doc_id, r.start)):
        pieces[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert pieces == {i: [*x, 1] for i, x in ids.items()}
    assert sorted(map(tuple, jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_components(rows))
    got = {(r.doc_id, k) for r in suffix_dedup.repeated_spans(df).collect() for k in range(r.start, r.stop)}
    assert got == {(d[0], k) for d, s in brute_repeats(rows).items() for k in s}
    key = lambda r: r[0]
    for a, b in zip(sorted(map(tuple, language_model.score(df, language_model.train(df)).collect()), key=key), sorted(brute_model(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_bpe_where_keys_of_pieces_meet(library, monkeypatch):
    """All long pieces share one key, and the memory of pieces is emptied again and again; ids are the library's all the same."""
    monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    tool = bpe.Encoder(bpe.default_vocabulary())
    rng = np.random.default_rng(8)
    say = lambda: "".join(rng.choice(list("ab éthe'sion  \n1"), rng.integers(0, 300)))
    texts = [*ODD, *ALIKE, *(say() for _ in range(200))]
    from skeinspark.llm._words import slices
    import pyarrow as pa

    for _ in range(2):
        for lo, hi, data, offs in slices(pa.array(texts), 3000):
            ids, bound = tool.encode(data, offs)
            assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts[lo:hi]]
    assert tool.known.used <= 40 + 3000


def test_packing_parts_rows_of_one_place(spark):
    """Half of all rows are one short text under different ids: they go to different ranges."""
    short = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same few words")).otherwise(F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    llm.ship(spark)
    rows = packing.stage(packing.tokenised(short, bpe.default_vocabulary()), "tokens")
    placed, ranges = packing._ranged(rows, 64)
    held = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert sum(held) == 40_000 and ranges <= 65 and max(held) < 2.5 * 40_000 / 64
    begins = placed.groupBy("range").agg(F.min("base").alias("b"), F.max("base").alias("e"), F.sum("n_tokens").alias("t"), F.min("place").alias("lo"), F.max("place").alias("hi")).orderBy("range").collect()
    assert all(r.b == r.e for r in begins) and all(x.b + x.t == y.b and x.hi < y.lo for x, y in zip(begins, begins[1:]))


def test_packing_pads_the_last_sequence_alone(docs):
    """Sequences are full but for the last one, whose filled part is the rest of all tokens."""
    got = packing.pack_documents(docs, 128).collect()
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    total = sum(filled.values())
    assert sorted(filled) == list(range(-(-total // 128)))
    assert all(filled[k] == 128 for k in filled if k < total // 128) and filled[max(filled)] == (total % 128 or 128)


def test_pair_sums_are_those_of_all_pairs():
    """The sum-of-squares identity against each pair of inputs written out."""
    rng = np.random.default_rng(6)
    stats = rng.normal(size=(5, 7))
    m = stats.shape[1]
    size = quality.BUCKETS + m * quality.BINS + m
    fm = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)) * 0.2, np.sort(rng.normal(size=(m, quality.BINS - 1)), 1), stats.mean(0), stats.std(0))
    words = [(rng.choice(quality.BUCKETS, 6, replace=False), rng.random(6)) for _ in range(5)]
    got = fm.score(np.repeat(np.arange(5), 6), np.concatenate([w[0] for w in words]), np.concatenate([w[1] for w in words]), stats)
    for k, (bucket, value) in enumerate(words):
        x = np.zeros(size)
        x[bucket], x[quality.BUCKETS :] = value, fm.dense(stats[k : k + 1])[0]
        pairs = sum(x[i] * x[j] * (fm.v[i] @ fm.v[j]) for i, j in itertools.combinations(np.flatnonzero(x), 2))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(fm.bias + fm.w @ x + pairs))), rel=1e-9)


def test_quality_of_held_out_rows(spark):
    """Accuracy and order on rows that were not learned from; and only one label."""
    llm.ship(spark)
    sf = SF.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(table, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    one = quality.classify(table, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.9


def test_language_of_held_out_rows(spark):
    llm.ship(spark)
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language.fit_language(table)
    told = language.identify(table, model).withColumn("held", quality.in_fold("doc_id", 5)).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if r.held]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    # A text of two languages, or of a single word, is nearer to a second one than a long text is.
    by = {r.lang: r.doc_id for r in told if r.lang == r.lang_pred and not r.ambiguous}
    texts = {r.doc_id: r.text for r in table.filter(F.col("doc_id").isin(*by.values())).collect()}
    en, de = texts[by["en"]][:1500], texts[by["de"]][:1500]
    odd = spark.createDataFrame([(1, en), (2, de), *((10 + k, en[: 100 * k] + " " + de[: 1500 - 100 * k]) for k in range(1, 15))], "doc_id long, text string")
    out = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert not out[1].ambiguous and not out[2].ambiguous and any(out[10 + k].ambiguous for k in range(1, 15))
    mixed = min((out[10 + k] for k in range(1, 15)), key=lambda r: r.score)
    assert {mixed.lang_pred, mixed.second} <= {"en", "de", "fr", "es"} and mixed.score < out[1].score


def test_language_sample_takes_one_of_a_repeated_id(spark):
    llm.ship(spark)
    rows = [(7, f"word {k} again", "en") for k in range(50)] + [(k, "mot encore", "fr") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert {r.lang: r["count"] for r in language._sampled(df, 10**9, 100, 2).groupBy("lang").count().collect()} == {"en": 1, "fr": 30}


def test_shards_are_near_equal(spark):
    """The registered query: shards of near equal bytes, places without gaps, and null ids with places of their own."""
    got = llm.queries()["op8_sharding"](spark, SF.replace("0.001", "0.01")).collect()
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    biggest = max(r["size"] for r in got)
    assert max(load.values()) - min(load.values()) <= max(biggest, 0.02 * sum(load.values()) / 24)
    rows = [(None, "a")] * 3 + [(None, None)] * 2 + [(1, "b")] * 4
    odd = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 16).collect()
    places = collections.defaultdict(list)
    for r in odd:
        places[r.shard].append(r.slot)
    assert len(odd) == 9 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_edits_the_stored_map(spark, tmp_path):
    """A second run loads version 1, stores version 2, and moves only rows of the slots that the edit names."""
    llm.ship(spark)
    path = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 900)) for k in range(3000)], "doc_id long, text string")
    first = {r.doc_id: r for r in sharding.shard_documents(docs, 6, 256, path).collect()}
    same = {r.doc_id: r for r in sharding.shard_documents(docs, 6, 256, path).collect()}
    assert {k: (r.shard, r.map_version) for k, r in first.items()} == {k: (r.shard, r.map_version) for k, r in same.items()}
    grown = {r.doc_id: r for r in sharding.shard_documents(docs, 7, 256, path).collect()}
    assert sharding.SlotMap.versions(spark, path) == [1, 2] and {r.map_version for r in grown.values()} == {2}
    old, new = (sharding.SlotMap.load(spark, path, v).shard for v in (1, 2))
    moved = {s for s in range(256) if old[s] != new[s]}
    assert moved and all(new[s] == 6 for s in moved)
    assert all((r.shard == grown[k].shard) == (r.virtual_slot not in moved) for k, r in first.items())
    load = collections.Counter()
    for r in grown.values():
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.1 * sum(load.values()) / 7


def test_scratch_lives_as_long_as_it_is_read(spark):
    """Two results of the pipeline are both readable; a query leaves only what its frame reads, and settings and views as they were."""
    import corpus_pipeline
    from skeinspark.llm import _shared

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, made = spark.conf.get(name), set(_shared._made)
    spark.range(1).createOrReplaceTempView("orders")
    a, b = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert a.count() == b.count() > 0
    llm.discard(a)
    llm.discard(b)
    assert set(_shared._made) == made
    op1 = llm.queries()["op1_jaccard_join"](spark, SF)
    assert len(set(_shared._made) - made) == 1 and op1.count() == 200
    llm.discard(op1)
    assert set(_shared._made) == made and spark.conf.get(name) == before and spark.table("orders").columns == ["id"]


def test_repeats_of_null_and_shared_ids(spark, docs, rows):
    """Rows in order of id (null last), then of a hash; all words that are cut repeat, and all repeats are cut."""
    keyed = suffix_dedup._keyed(docs.select("doc_id", "text"))
    order = sorted({(r.doc_id if r.doc_id is not None else 1 << 63, r.key, r.text or "") for r in keyed.collect()})
    first, want = {}, collections.defaultdict(set)
    for d in order:
        w = split(d[2])
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if key not in first:
                first[key] = (d, k)
            elif first[key][0] != d or k >= first[key][1] + 50:
                want[d[1]] |= set(range(k, k + 50))
    found = suffix_dedup._union(suffix_dedup.repeated_windows(keyed)).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r.key] |= set(range(r.start, r.stop))
    assert got == want
    left = collections.Counter(" ".join(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in suffix_dedup.remove_repeats(docs).collect())
    texts = {d[1]: re.findall("[^\x20\x09-\x0d]+", d[2]) for d in order}
    assert left == collections.Counter(" ".join(w for k, w in enumerate(texts[r.key]) if k not in want[r.key]) for r in keyed.collect())


def test_embeddings_in_long_lists_and_blocks(spark, monkeypatch):
    """Lists dealt by two pivots and in blocks find what whole lists find; null, repeated and unlike ids and lengths."""
    llm.ship(spark)
    rng = np.random.default_rng(15)
    centre = rng.normal(size=(4, 12))
    v = [*(centre[k % 4] + rng.normal(size=12) * 0.25 for k in range(400)), *rng.normal(size=(100, 12)), *rng.normal(size=(20, 5))]
    ids = [*range(500), *(None if k % 2 else 3 for k in range(20))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(4)
    whole = sorted(map(str, embedding_dedup.near_embeddings(df).collect()))
    monkeypatch.setattr(embedding_dedup, "SPLIT", 20)
    assert sorted(map(str, embedding_dedup.near_embeddings(df).collect())) == whole
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert sorted(map(str, embedding_dedup.near_embeddings(df).collect())) == whole
    good, link = brute_links([x.tolist() for x in v[:500]])
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(df.filter("vec_id is not null")).collect() if r.vec_id != 3}
    assert sum(got.values()) >= 0.95 * (link.sum() - link[3].sum())


@pytest.mark.parametrize("kind", ["none", "mean", "clusters"])
@pytest.mark.parametrize("n", [5_000, 200_000, 1_000_000, 4_000_000])
def test_recall_of_pivots(n, kind):
    """Share of pairs at cosines of 0.90 to 0.93 that the index would compare, with as many pivots as ``n`` vectors have."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    m = int(embedding_dedup.DENSITY * np.sqrt(n))
    centre = unit(rng.normal(size=(50, 64)))

    def vectors(k):
        x = unit(rng.normal(size=(k, 64)))
        if kind == "mean":  # as text embeddings often have: cosines of 0.5 between any two
            x = (x + centre[0]) / np.sqrt(2)
        if kind == "clusters":
            x = np.sqrt(0.4) * x + np.sqrt(0.6) * centre[rng.integers(0, 50, k)]
        return unit(x)

    # Of many pivots any will do: choosing them far apart only helps.
    pivots = embedding_dedup.choose_pivots(vectors(4 * m), m) if n <= 200_000 else vectors(m)
    a, off = vectors(1000), rng.normal(size=(1000, 64))
    off = unit(off - (off * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.9, 0.93, (1000, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * off
    x, y = (embedding_dedup.nearest_pivots(v, pivots, embedding_dedup.NEAREST) for v in (a, b))
    assert ((x[:, :, None] == y[:, None, :]).any(2).sum(1) >= embedding_dedup.SHARED).mean() >= 0.95
