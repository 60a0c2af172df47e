"""Join of documents by Jaccard similarity of word shingles, with signature trees.

1. Equal shingle sets become one class. A class keeps its size and a bitmap of its tokens.
2. Every class lists the prefix of its tokens in one global order, frequent tokens last.
   Two classes that link share a token of their prefixes, so the classes under a token (a
   run) hold all candidates. Runs are split where sizes are too far apart. Runs of one
   first class meet in one place (a home), to which the bitmap of a class goes once.
3. In a run, a tree over the classes holds OR-combined bitmaps and size ranges; a dual
   traversal drops pairs of nodes whose largest possible overlap is too small.
4. Pairs that are left are verified on the sets themselves. A first round only tries a
   forest of each run; a second one tries what is left between different components, so
   large groups of copies never become all their pairs.

5. Where links are asked for, all pairs of each component are compared, in pairs of blocks.

Nothing is sampled or capped. Texts are read again for each pass and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import bit_table, bucket_count, dealt, has_bits, join_by_key, pack, partitions, ragged, settled, split_by_marks, stage, text_bytes, tidy, unpack
from ._words import U64, mix, shingle_sets, slices, words

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Classes under a token from which it counts as frequent, classes in a block of a run, and in a block of a component whose links are counted, pairs of one class that are verified in one place, and members of runs that are expected in one home at most.
FREQUENT, BLOCK, LINKS, HUB, HOME = 32, 1024, 256, 128, 4096
_NO_ID = 1 << 62
_FANOUT = 8


def required(a, b, percent: int = PERCENT):
    """The least overlap of sets of sizes ``a`` and ``b`` that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def class_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a set of tokens."""
    return int(mix(mix(tokens).sum(keepdims=True, dtype=U64) + U64(len(tokens)))[0].astype(np.int64))


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of about four bits for each token, of a power of two so that it can be folded."""
    width = min(1 << 16, max(256, 1 << (4 * len(tokens) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(a: np.ndarray, na: int, room_a: int, b: np.ndarray, nb: int, room_b: int, percent: int) -> int:
    """The largest possible overlap of two classes, or -1 if that is too small.

    A class has no more room than its tokens from the run's own on: a pair that shares an
    earlier token meets in that one's run.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return -1
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    # Tokens that share a bit with others may all be common, or none: the smaller surplus bounds them.
    both = int(np.bitwise_count(a & b).sum())
    most = both + min(na - int(np.bitwise_count(a).sum()), nb - int(np.bitwise_count(b).sum()))
    most = min(most, room_a, room_b)
    return most if most >= required(na, nb, percent) else -1


class SignatureTree:
    """Levels of nodes over classes in order of size; level 0 are the classes.

    A node has its OR-combined bitmap, range of sizes, largest room and surplus of tokens over
    bits, and the component of its classes where they have one.
    """

    def __init__(self, sizes: np.ndarray, rooms: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.order = order
        self.own = [bitmaps[k] for k in order]
        width = min(len(b) for b in bitmaps)
        bits = np.stack([folded(b, width) for b in self.own])
        n, room = sizes[order], rooms[order]
        surplus = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        label = labels[order]
        self.levels = [(bits, n, n, room, surplus, label)]
        while len(bits) > _FANOUT:
            at = np.arange(0, len(bits), _FANOUT)
            low, high = np.minimum.reduceat(n, at), np.maximum.reduceat(self.levels[-1][2], at)
            same = np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)
            label = np.where(same, label[at], -1)
            bits, n, room, surplus = np.bitwise_or.reduceat(bits, at, axis=0), low, np.maximum.reduceat(room, at), np.maximum.reduceat(surplus, at)
            self.levels.append((bits, low, high, room, surplus, label))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dual traversal: pairs of classes (positions given to the constructor) that may link, with their largest overlaps.

        Node pairs that lie in one known component are skipped.
        """
        top = len(self.levels[-1][0])
        i, j = np.triu_indices(top)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, low, high, room, surplus, label = self.levels[depth]
            kept_i, kept_j, kept_most = [], [], []
            for lo in range(0, len(i), 1 << 15):
                a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                if depth == 0:
                    a, b = a[a != b], b[a != b]
                near = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
                near &= (label[a] != label[b]) | (label[a] < 0)
                a, b = a[near], b[near]
                most = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64) + np.minimum(surplus[a], surplus[b])
                most = np.minimum(most, np.minimum(room[a], room[b]))
                ok = most >= required(low[a], low[b], percent)
                kept_i.append(a[ok])
                kept_j.append(b[ok])
                kept_most.append(most[ok])
            i, j, most = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_i, kept_j, kept_most))
            if depth:
                below = len(self.levels[depth - 1][0])
                ci = (i[:, None] * _FANOUT + np.repeat(np.arange(_FANOUT), _FANOUT)).ravel()
                cj = (j[:, None] * _FANOUT + np.tile(np.arange(_FANOUT), _FANOUT)).ravel()
                keep = (ci < below) & (cj < below) & (ci <= cj)
                i, j = ci[keep], cj[keep]
        if len(self.own[-1]) > len(self.levels[0][0][0]):  # where the common width lost detail
            n, room = self.levels[0][1].tolist(), self.levels[0][3].tolist()
            fine = np.array([may_link(self.own[a], n[a], room[a], self.own[b], n[b], room[b], percent) for a, b in zip(i.tolist(), j.tolist())], np.int64)
            i, j, most = i[fine >= 0], j[fine >= 0], fine[fine >= 0]
        return self.order[i], self.order[j], most


def _packed(batches, buckets: int, per_doc, merge=lambda *columns: columns, flush: int = 1 << 19):
    """Runs ``per_doc(tokens, key) -> columns`` on the set of each new class, ``merge`` on the columns of many, and yields blocks by bucket of the first column."""
    seen: set[int] = set()
    held: list[tuple] = []
    n = 0

    def blocks():
        cols = merge(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        return dealt((mix(cols[0]) % U64(buckets)).astype(np.int64), cols)

    for batch in batches:
        for _, _, data, offs in slices(batch.column("text")):
            for tokens in shingle_sets(words(data, offs), SHINGLE):
                if len(tokens) and (key := class_key(tokens)) not in seen:
                    seen.add(key)
                    held.append(per_doc(tokens, key))
                    n += len(held[-1][0])
            if n > flush:
                yield blocks()
                n = 0
    if held:
        yield blocks()


def _by_bucket(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(blocks) -> record batch`` over all blocks of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([fn([unpack(b.as_py()) for b in table.column("block")])])

    return df.groupBy("bucket").applyInArrow(run, schema)


def frequent_tokens(texts: DataFrame, buckets: int, percent: int) -> np.ndarray:
    """The table of tokens that stand in the prefixes of ``FREQUENT`` classes or more, of bounded size.

    Each task counts before it sends, so that a token in all documents is one row for every few thousand of them.
    """

    @tidy
    def emit(batches):
        def tokens_of(t, key):
            return (t[: prefix_length(len(t), percent)] >> U64(16),)

        def counted(t):
            t, c = np.unique(t, return_counts=True)
            return t, c.astype(np.uint32)

        yield from _packed(batches, buckets, tokens_of, counted)

    def count(blocks):
        t, c = (np.concatenate(x) for x in zip(*blocks))
        t, back = np.unique(t, return_inverse=True)
        many = np.bincount(back, c) >= FREQUENT
        return pa.record_batch([pa.array(t[many].view(np.int64))], ["mark"])

    return bit_table(_by_bucket(texts.mapInArrow(emit, "bucket int, block binary"), count, "mark long"))


def candidate_runs(texts: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Distinct runs, a row for each member: run, block, blocks, home, key, n (its size) and place (in the member's prefix).

    Runs with the same members are one, with the least places. Every block of a run has the run's first member.
    Runs that begin with one class share homes. It begins no more runs than its prefix is long, so a run of m members goes
    to one of prefix * m / ``HOME`` homes, and ``HOME`` rows are expected in each at most. Runs of several blocks have none.
    """
    table = texts.sparkSession.sparkContext.broadcast(frequent_tokens(texts, buckets, percent))

    @tidy
    def emit(batches):
        def postings(t, key):
            often = has_bits(table.value, t >> U64(16))
            p = np.concatenate([t[~often], t[often]])[: prefix_length(len(t), percent)]
            return p >> U64(16), np.full(len(p), key, np.int64), np.full(len(p), len(t), np.uint32), np.arange(len(p), dtype=np.uint32)

        yield from _packed(batches, buckets, postings)

    def runs(blocks):
        token, key, n, place = (np.concatenate(c) for c in zip(*blocks))
        order = np.lexsort((place, key, n, token))
        token, key, n, place = token[order], key[order], n[order].astype(np.int64), place[order].astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n, place = token[new], key[new], n[new], place[new]
        # A run ends with its token, or where the next larger class is too large for all before it.
        cut = np.ones(len(token), bool)
        cut[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(token)))
        names = np.add.reduceat(mix(key.view(U64)), first).view(np.int64) if len(first) else np.zeros(0, np.int64)
        many = size > 1
        first, size, names = first[many], size[many], names[many]
        order = np.argsort(names, kind="stable")
        first, size, names = first[order], size[order], names[order]
        # Runs of the same members are a group, of whose rows each has the least place.
        fresh = np.ones(len(names), bool)
        fresh[1:] = names[1:] != names[:-1]
        group = np.flatnonzero(fresh)
        head, rows, name = first[group], size[group], names[group]
        start = np.cumsum(rows) - rows
        member = ragged(head, rows)
        least = np.full(len(member), _NO_ID)
        np.minimum.at(least, ragged(start[np.cumsum(fresh) - 1], size), place[ragged(first, size)])
        pieces = -(-(rows - 1) // (BLOCK - 1))
        homes = -(-prefix_length(n[head], percent) * rows // HOME)
        home = np.where(pieces == 1, mix(mix(key[head].view(U64)) + name.view(U64) % homes.astype(U64)).view(np.int64), 0)
        row, block = [ragged(start[pieces == 1], rows[pieces == 1])], [np.zeros(int(rows[pieces == 1].sum()), np.int64)]
        for k in np.flatnonzero(pieces > 1).tolist():
            for p in range(int(pieces[k])):
                row.append(start[k] + np.append(0, np.arange(1 + p * (BLOCK - 1), min(1 + (p + 1) * (BLOCK - 1), int(rows[k])))))
                block.append(np.full(len(row[-1]), p))
        row, block = np.concatenate(row), np.concatenate(block)
        of = np.repeat(np.arange(len(group)), rows)[row]
        columns = (name[of], block, pieces[of], home[of], key[member[row]], n[member[row]], least[row])
        return pa.record_batch([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["run", "block", "blocks", "home", "key", "n", "place"])

    found = _by_bucket(texts.mapInArrow(emit, "bucket int, block binary"), runs, "run long, block int, blocks int, home long, key long, n int, place long")
    # All but places are the same wherever a run is found.
    return stage(found.groupBy("run", "block", "key").agg(F.first("blocks").alias("blocks"), F.first("home").alias("home"), F.first("n").alias("n"), F.min("place").alias("place")), "runs")


def _tree_pairs(rows: DataFrame, bitmaps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) that may link in each unit of rows with home, unit, side, key, place, n and label; a unit lies in one home.

    ``bitmaps`` has key and bits. A class's bits go to each home once, before the units there.
    ``forest``: only each class with its best earlier partner. Otherwise all pairs between
    different labels; where a unit has two sides, pairs between these.
    """

    def unit_pairs(key, n, room, bits, label, side):
        if len(key) == 2:
            if label[0] == label[1] and label[0] >= 0 or may_link(bits[0], int(n[0]), int(room[0]), bits[1], int(n[1]), int(room[1]), percent) < 0:
                return key[:0], key[:0]
            i, j = np.array([0]), np.array([1])
        else:
            i, j, most = SignatureTree(n, room, bits, label).pairs(percent)
            if forest and len(i):
                i, j = np.minimum(i, j), np.maximum(i, j)
                order = np.lexsort((i, -most, j))
                i, j = i[order], j[order]
                best = np.diff(j, prepend=-1) != 0
                i, j = i[best], j[best]
            if side.min() != side.max():
                across = side[i] != side[j]
                i, j = i[across], j[across]
        return np.minimum(key[i], key[j]), np.maximum(key[i], key[j])

    @tidy
    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            yield from complete(t, False)
            rest = tail(t)
        if rest is not None:
            yield from complete(rest, True)

    def bounds(t, *names):
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for c in names:
            c = t.column(c).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    def tail(t):
        cut = bounds(t, "home")
        return t.slice(cut[-2]) if len(cut) > 1 else None

    def complete(t, last):
        if not last:
            cut = bounds(t, "home")
            t = t.slice(0, cut[-2]) if len(cut) > 1 else t
        if not t.num_rows:
            return
        ends = bounds(t, "home", "member", "unit")
        member, key, n, place, label, side = (t.column(c).to_numpy() for c in ("member", "key", "n", "place", "label", "side"))
        out_a, out_b = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if not member[a]:
                known, raw = key[a:b], t.column("bits").slice(a, b - a).to_pylist()
                continue
            # The first member of a run comes with each of its blocks.
            _, own = np.unique(key[a:b], return_index=True)
            own = np.sort(own) + a
            if len(own) < 2:
                continue
            at = np.searchsorted(known, key[own])
            assert (known[at] == key[own]).all()
            x, y = unit_pairs(key[own], n[own], n[own] - place[own], [np.frombuffer(raw[k], U64) for k in at.tolist()], label[own], side[own])
            out_a.append(x)
            out_b.append(y)
        if out_a:
            yield pa.record_batch([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], ["a", "b"])

    parts = partitions(rows.sparkSession)
    members = rows.select("home", F.lit(1).alias("member"), "unit", "side", "key", F.col("n").cast("long").alias("n"), "place", "label", F.lit(None).cast("binary").alias("bits"))
    zero = [F.lit(0).cast(members.schema[c].dataType).alias(c) for c in ("unit", "side", "n", "place", "label")]
    sent = rows.select("home", "key").distinct().join(bitmaps, "key").select("home", F.lit(0).alias("member"), "key", "bits", *zero)
    placed = members.unionByName(sent).repartition(4 * parts, "home").sortWithinPartitions("home", "member", "unit", "n", "key")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Key and tokens of the classes in ``keys`` (column k): sets are made again from texts."""
    wanted = texts.sparkSession.sparkContext.broadcast(bit_table(keys.select(F.col("k").alias("mark")).distinct()))  # of bounded size

    @tidy
    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for _, _, data, offs in slices(batch.column("text")):
                for tokens in shingle_sets(words(data, offs), SHINGLE):
                    if len(tokens) and (key := class_key(tokens)) not in seen and has_bits(wanted.value, np.array([key]))[0]:
                        seen.add(key)
                        keys.append(key)
                        sets.append(pack(tokens))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "tokens"])

    return stage(texts.mapInArrow(emit, "key long, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens")), "sets", "none")


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link.

    Of a pair the class of more pairs is its hub. A hub's pairs are dealt in parts of about
    ``HUB``; its set goes to each part once, and the other classes' sets follow.
    """
    ends = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k")))
    sets = _sets(texts, ends)
    hubs = stage(ends.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB), "hubs")
    told = pairs.join(hubs.select(F.col("k").alias("a"), F.col("n").alias("na")), "a", "left").join(hubs.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b", "left").na.fill(0, ["na", "nb"])
    first = F.col("na") >= F.col("nb")
    parts = F.ceil(F.greatest("na", "nb") / HUB)
    dealt_pairs = stage(
        told.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), parts.alias("parts"))
        .select("hub", F.pmod(F.xxhash64("other"), F.greatest("parts", F.lit(1))).alias("part"), "other"),
        "dealt-pairs",
    )
    heads = dealt_pairs.select("hub", "part").distinct().join(sets.withColumnRenamed("key", "hub"), "hub").withColumn("other", F.lit(None).cast("long"))
    rows = heads.unionByName(dealt_pairs.join(sets.withColumnRenamed("key", "other"), "other"))

    @tidy
    def check(batches):
        hub, x = None, None
        for batch in batches:
            a, b, ok = batch.column("hub").to_pylist(), batch.column("other").to_pylist(), np.zeros(batch.num_rows, bool)
            for k, (h, o, raw) in enumerate(zip(a, b, batch.column("tokens"))):
                y = unpack(raw.as_py())[0]
                if o is None:  # the hub's own set comes before those of its part
                    hub, x = h, y
                    continue
                assert hub == h
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * common >= percent * (len(both) - common)
            yield pa.record_batch([batch.column("hub"), batch.column("other"), pa.array(ok)], ["hub", "other", "ok"])

    placed = rows.select("hub", "part", "other", "tokens").repartition(4 * partitions(texts.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("other"))
    found = placed.select("hub", "other", "tokens").mapInArrow(check, "hub long, other long, ok boolean").filter("ok")
    return stage(found.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")), "links")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each set of ``x`` with each of ``y``, as products of 0/1 matrices over slices of the tokens of both."""
    a, b = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), np.int64)
    sides = []
    for t, sets in ((a, x), (b, y)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, t)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == t[ok]
        row, at = row[ok], at[ok]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for lo in range(0, len(both), 4096):
        width = min(4096, len(both) - lo)
        dense = []
        for (row, at), sets in zip(sides, (x, y)):
            i, j = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((len(sets), width), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _others(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Key and ``others``, the rows of all other classes that link to the class; classes of no link may be missing.

    ``members`` has group, key, node and copies. Classes that link are in one group, so all pairs of each group are
    compared, in pairs of blocks of ``LINKS`` classes. Two classes of different nodes that make up a group do link.
    """
    groups = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("total"), F.min("node").alias("x"), F.max("node").alias("y"))
    told = stage(join_by_key(members, stage(groups.filter("size > 1"), "groups"), "group", "size"), "members")
    two = (F.col("size") == 2) & (F.col("x") != F.col("y"))
    pairs = told.filter(two).select("key", (F.col("total") - F.col("copies")).alias("others"))
    rest = told.filter(~two)
    sets = _sets(texts, rest.select(F.col("key").alias("k")))
    blocks = F.ceil(F.col("size") / LINKS).cast("int")
    units = (
        rest.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "copies", (F.col("block") > F.col("other")).alias("right"))
    )

    def count(t: pa.Table) -> pa.Table:
        key, copies, right = t.column("key").to_numpy(), t.column("copies").to_numpy(), t.column("right").to_numpy()
        tokens = [unpack(b)[0] for b in t.column("tokens").to_pylist()]
        n = np.array([len(x) for x in tokens])
        one = t.column("lo")[0] == t.column("hi")[0]
        i = np.arange(len(key)) if one else np.flatnonzero(~right)
        j = i if one else np.flatnonzero(right)
        found = np.zeros(len(key), np.int64)
        if len(i) and len(j):
            common = overlaps([tokens[k] for k in i], [tokens[k] for k in j])
            ok = 100 * common >= percent * (n[i][:, None] + n[j] - common)
            if one:
                np.fill_diagonal(ok, False)
            found[i] = ok @ copies[j]
            if not one:
                found[j] = copies[i] @ ok
        return pa.table({"key": pa.array(key, pa.int64()), "others": pa.array(found, pa.int64())})

    counted = units.join(sets, "key").groupBy("group", "lo", "hi").applyInArrow(count, "key long, others long")
    return pairs.unionByName(counted).groupBy("key").agg(F.sum("others").alias("others"))


@settled
def near_duplicates(docs: DataFrame, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and row (a hash of id and text).

    With ``links`` also n_links: the other rows (of whatever id) that link to the row itself, copies among them;
    none without shingles. All pairs of a component are compared for it.

    Fewer words than a shingle are one shingle; without words (null, empty, white space) a
    row has no shingles and is its own component. ``component_id`` is the smallest doc_id
    reachable by links. Rows with a null id link like others, and have a null component
    where no row in it has an id. Rows that repeat an id count as one document in links.
    Very long texts are a slice of their own and read whole. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    _, size = text_bytes(docs)
    buckets = bucket_count(spark, size)

    @tidy
    def describe(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                n, keys, bits = [], [], []
                for tokens in shingle_sets(words(data, offs), SHINGLE):
                    n.append(len(tokens))
                    keys.append(class_key(tokens) if len(tokens) else None)
                    bits.append(signature(tokens).tobytes() if len(tokens) else None)
                yield pa.record_batch([batch.column("row")[lo:hi], batch.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary())], ["row", "doc_id", "n_shingles", "key", "bits"])

    rows = stage(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(describe, "row long, doc_id long, n_shingles long, key long, bits binary"), "sets-of-documents")
    classes = stage(
        rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.coalesce("node", F.expr(f"(key & {_NO_ID - 1}L) | {_NO_ID}L"))),
        "classes",
    )
    runs = candidate_runs(texts, buckets, percent)
    bitmaps = classes.select("key", "bits")
    place_of = F.when(F.col("blocks") == 1, F.col("home")).otherwise(F.col("unit")).alias("home")
    first = runs.withColumn("unit", F.xxhash64("run", "block")).select(place_of, "unit", F.lit(0).alias("side"), "key", "place", "n", F.lit(-1).cast("long").alias("label"))
    tried = stage(_tree_pairs(first, bitmaps, percent, True), "pairs")
    linked_pairs = _verified(texts, tried, percent)
    labels = components(linked_pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Second round: runs that still hold more than one component.
    named = runs.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = stage(named, "named-runs")
    mixed = named.groupBy("run").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members")).filter("x != y").select("run", "members")
    left = stage(join_by_key(named, stage(mixed, "mixed"), "run", "members"), "mixed-runs")
    # A run of several blocks becomes pairs of blocks.
    units = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("unit", F.xxhash64("run", F.least("block", "other"), F.greatest("block", "other")))
    second = units.select(place_of, "unit", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "key", "place", "n", (F.pmod(F.xxhash64("label"), F.lit(1 << 62))).alias("label"))
    more = stage(_tree_pairs(second, bitmaps, percent, False).join(tried, ["a", "b"], "left_anti"), "pairs")
    linked_pairs = linked_pairs.unionByName(_verified(texts, more, percent))
    nodes = classes.select("key", "node")
    edges = linked_pairs.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("key").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    final = components(edges)
    of_class = classes.join(final, "node", "left").select("key", "node", "copies", F.coalesce("label", "node").alias("component_id"))
    facts = of_class.drop("node")
    if links:
        others = _others(texts, of_class.select(F.col("component_id").alias("group"), "key", "node", "copies"), percent)
        counted = of_class.join(others, "key", "left").select("key", "copies", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        facts = stage(counted, "facts")
    more_columns = ["n_links"] if links else []
    linked = join_by_key(rows.filter("key is not null").select("row", "doc_id", "n_shingles", "key"), facts, "key", "copies").select(
        "row", "doc_id", "n_shingles", F.when(F.col("component_id") < _NO_ID, F.col("component_id")).alias("component_id"), *more_columns
    )
    alone = rows.filter("key is null").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in more_columns])
    return stage(linked.unionByName(alone), "near-duplicates")


@settled
def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns stay, whatever their names.

    Null and empty texts and those without words are linked with nothing and stay. Rows with a
    null id go where their component has an id, and stay where it has none. Rows that repeat the
    staying id stay with it. An empty table gives no rows.
    """
    found = near_duplicates(docs, percent)
    dropped = stage(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("component_id").isNotNull()).select("row").distinct(), "dropped")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"), F.xxhash64("doc_id", "text").alias("row"))
    clear, others = split_by_marks(rows, "row", dropped)
    return clear.unionByName(others.join(dropped, "row", "left_anti").select(*rows.columns)).select("whole.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = {
    "op1_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM split),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
label AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s) AS n_shingles, component_id, (SELECT count(*) FROM links l WHERE l.u = doc_id) AS n_links FROM sets JOIN label USING (doc_id)
""",
}
QUERIES = {"op1_jaccard_join": op1_jaccard_join}
