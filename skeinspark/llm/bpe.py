"""Byte-level BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of every distinct piece of text. A sequence of
tokens is the BPE encoding exactly when each adjacent pair is what BPE makes of the pair's
own bytes, so vectorised checks of all pairs accept or refuse the proposals, and only the
refused pieces are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._shared import ragged
from ._words import MASKS, eights, mix, slices, span_hashes

#: Distinct pieces a worker remembers, about 75 bytes each, for as long as it lives; of the longest none is remembered.
REMEMBERED, STEPPED = 300_000, 32
#: Bytes of text encoded at once, about; encoding needs many times that.
AT_ONCE = 1 << 18
_NEVER = np.int32((1 << 31) - 1)
_OTHER, _LETTER, _NUMBER, _WHITE = 0, 1, 2, 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For every code point: letter, number, white space or other."""
    kind = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _WHITE)):
            for m in regex.finditer(pattern, every):
                kind[lo + m.start() : lo + m.end()] = value
    return kind


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(1)
def _byte_kinds() -> np.ndarray:
    return np.append(_kinds()[:128], np.full(128, _OTHER, np.uint8))


def _kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of the character of each byte."""
    kind = _byte_kinds()[data]
    wide = np.flatnonzero(data >= 128)
    if len(wide):
        chars = data[wide]
        lead = np.flatnonzero((chars & 0xC0) != 0x80)
        points = np.frombuffer(chars.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind[wide] = np.repeat(_kinds()[points], np.diff(np.append(lead, len(wide))))
    return kind


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start: contractions, or letters, numbers or others with a space before, or white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds_of(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    cut[n] = True
    change = cut[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    begin = change.copy()
    joined = np.zeros(n, bool)  # a run whose first piece takes in the space before it
    joined[1:] = change[1:] & ~white[1:] & (data[:-1] == 32) & ~cut[1:-1]
    begin[joined] = False
    # The last white space before something else: a character of its own, which may have several bytes.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~cut[1:-1])
    while len(inner := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[inner] -= 1
    begin[last] = True
    mark = np.flatnonzero((data[:-1] == 39) & change[:-1] & ~joined[:-1] & (kind[1:] == _LETTER) & ~cut[1:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(mark):
        c1 = data[mark + 1]
        two = (mark + 2 < n) & ~cut[np.minimum(mark + 2, n)]
        c2 = np.where(two, data[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(c1, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((c1 == ord(a)) & (c2 == ord(b)), 2, size)
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        after = mark + 1 + size
        after = after[after < n]
        begin[after] = True
    return np.flatnonzero(begin)


class Table:
    """Rows of 64-bit numbers by a positive key, with open addressing; lookups and insertions of whole arrays."""

    def __init__(self, entries: int, width: int = 1):
        self.bits = max(4, int(3 * entries // 2).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.int64), np.zeros((1 << self.bits, width), np.int64)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        slot = self._slot(keys)
        there = self.keys.take(slot)
        hit = there == keys
        live = np.flatnonzero(~hit & (there != 0))
        while len(live):
            at = (slot[live] + 1) & (len(self.keys) - 1)
            there, wanted = self.keys.take(at), keys[live]
            slot[live], hit[live] = at, there == wanted
            live = live[(there != wanted) & (there != 0)]
        return slot, hit

    def get(self, keys: np.ndarray) -> np.ndarray:
        """First numbers of the rows of keys, -1 where there is none."""
        slot, hit = self.find(keys)
        return np.where(hit, self.rows[:, 0].take(slot), -1)

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Rows of new, distinct keys."""
        if 3 * (self.used + len(keys)) > 2 * len(self.keys):
            some = self.keys != 0
            old, kept = self.keys[some], self.rows[some]
            self.__init__(self.used + len(keys), self.rows.shape[1])
            self.put(old, kept)
        rows = rows.reshape(len(keys), self.rows.shape[1])
        slot, live = self._slot(keys), np.arange(len(keys))
        while len(live):
            free = self.keys[slot[live]] == 0
            taken = live[free]
            self.keys[slot[taken]] = keys[taken]  # of several keys for a place the last one stays
            own = self.keys[slot[taken]] == keys[taken]
            self.rows[slot[taken[own]]] = rows[taken[own]]
            live = np.concatenate([live[~free], taken[~own]])
            slot[live] = (slot[live] + 1) & (len(self.keys) - 1)
        self.used += len(keys)


class Pool:
    """An array that grows."""

    def __init__(self, kind):
        self.held, self.used = np.zeros(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.used

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.used]

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.held):
            grown = np.zeros(end + end // 4, self.held.dtype)
            grown[: self.used] = self.values
            self.held = grown
        self.held[self.used : end] = values
        self.used = end


class Encoder:
    """One vocabulary file and the pieces seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = _printable_bytes()
        raw = lambda token: bytes(plain[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes = np.full(size, b"", object)
        for token, i in vocab.items():
            self.token_bytes[i] = raw(token)
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"].encode()] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        self.texts = np.array([b"%d" % i for i in range(size)], object)
        self.byte_id = np.zeros(256, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)  # bytes have the lowest ranks, then merges in their order
        for c, b in plain.items():
            self.byte_id[b] = vocab[c]
            self.rank[vocab[c]] = b
        self.merge: dict[int, tuple[int, int]] = {}
        made = []
        for r, pair in enumerate(spec["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.merge[a << 32 | b] = (256 + r, c)
            made.append(c)
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = 256 + r, a, b
        self.pair_rank = Table(len(made))
        self.pair_rank.put(np.fromiter(self.merge, np.int64, len(self.merge)) + 1, np.array([r for r, _ in self.merge.values()]))
        self.made = np.append(np.zeros(256, np.int64), np.array(made, np.int64))
        pair = np.arange(1 << 16)
        self.byte_ranks = self._pair_ranks(self.byte_id[pair >> 8], self.byte_id[pair & 255]).reshape(256, 256)
        self.automaton = ahocorasick.Automaton()
        states: dict[int, int] = {}
        accept = [-1]
        for i in np.flatnonzero(self.rank >= 0).tolist():
            token, at = self.token_bytes[i], 0
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
            for c in token:
                key = at << 8 | c
                if (at := states.get(key, 0)) == 0:
                    at = states[key] = len(accept)
                    accept.append(-1)
            accept[at] = i
        self.automaton.make_automaton()
        self.accept = np.array(accept, np.int64)
        self.first_state = np.array([states.get(c, -1) for c in range(256)], np.int64)
        self.states = Table(len(states))
        self.states.put(np.fromiter(states, np.int64, len(states)) + 1, np.fromiter(states.values(), np.int64, len(states)))
        self.forget()

    def forget(self) -> None:
        # Rows of a piece: up to four ids of 16 bits, or where they are in ``ids``; size, number of ids, whether they are in ``ids``, and place in ``text``; when it was last met.
        self.known = Table(1 << 14, 3)
        self.ids, self.text = Pool(np.int32), Pool(np.uint8)
        self.slice_number = 0
        self.fits = Table(1 << 14)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of tokens as it is: no merge across the border comes before those that made the two."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            rank = self.pair_rank.get((x << 32 | y) + 1)
            bad = (rank >= 0) & (rank < limit)
            ok[live[bad]] = False
            # Undo the later of the two merges; a border token that is a byte cannot be undone.
            rx, ry = np.where(x == self.left[x], -1, self.rank[x]), np.where(y == self.left[y], -1, self.rank[y])
            undo_x = rx > ry
            done = bad | ((rx < 0) & (ry < 0))
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            keep = ~done
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
        return ok

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.pair_rank.get((a << 32 | b) + 1)
        return np.where(rank >= 0, rank, _NEVER)

    def _merged_short(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short pieces side by side, one merge of each in every round: token ids, and how many each has."""
        width = int(size.max())
        cols = np.arange(width)
        inside = cols < size[:, None]
        byte = data[np.where(inside, start[:, None] + cols, start[:, None])]
        ids = np.where(inside, self.byte_id[byte], -1)
        rank = np.full((len(size), width), _NEVER, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_ranks[byte[:, :-1], byte[:, 1:]], _NEVER)
        after, before = np.tile((cols + 1).astype(np.int16), (len(size), 1)), np.tile((cols - 1).astype(np.int16), (len(size), 1))
        live = np.arange(len(size))
        while len(live):
            at = rank[live].argmin(1)
            r = rank[live, at]
            more = r != _NEVER
            live, at, r = live[more], at[more], r[more]
            if not len(live):
                break
            gone = after[live, at]
            then = after[live, gone].astype(np.int64)
            ids[live, at], ids[live, gone], rank[live, gone], after[live, at] = self.made[r], -1, _NEVER, then
            # The pairs on both sides of the new token.
            right = np.flatnonzero(then < size[live])
            before[live[right], then[right]] = at[right]
            first = before[live, at].astype(np.int64)
            left = np.flatnonzero(first >= 0)
            row, x, y = np.concatenate([live[right], live[left]]), np.concatenate([at[right], first[left]]), np.concatenate([then[right], at[left]])
            rank[live, at] = _NEVER
            rank[row, x] = self._pair_ranks(ids[row, x], ids[row, y])
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def _merged_spans(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, lowest rank first and leftmost among equals, of pieces of any length: token ids one piece after the other, and counts."""
        parts, owners, count = [], [], np.zeros(len(size), np.int64)
        for lo, hi in ((0, 6), (6, 10), (10, 16), (16, STEPPED)):
            chosen = np.flatnonzero((size > lo) & (size <= hi))
            if len(chosen):
                ids, count[chosen] = self._merged_short(data, start[chosen], size[chosen])
                parts.append(ids)
                owners.append(np.repeat(chosen, count[chosen]))
        for k in np.flatnonzero(size > STEPPED).tolist():
            ids = self.merged(data[start[k] : start[k] + size[k]].tobytes())
            count[k] = len(ids)
            parts.append(np.array(ids, np.int64))
            owners.append(np.full(len(ids), k))
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, owners))
        return ids[np.argsort(owner, kind="stable")], count

    def merged_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging of each piece."""
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        ids, count = self._merged_spans(data, np.cumsum(size) - size, size)
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging of one piece, for long ones: a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merge.get(ids[k] << 32 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if m := merge.get(made << 32 | ids[after[k]]):
                    heapq.heappush(heap, (m[0], k, made, ids[after[k]], m[1]))
            if (p := before[k]) >= 0 and (m := merge.get(ids[p] << 32 | made)):
                heapq.heappush(heap, (m[0], p, ids[p], made, m[1]))
        return [i for i in ids if i >= 0]

    def propose(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of pieces: token ids, and how many each piece has, as a negative number where they don't cover it."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size)
        return self._propose(data, end - size, end)

    def _propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, owners, broken = [], [], np.zeros(len(start), bool)
        for k in np.flatnonzero(end - start > STEPPED).tolist():
            text = data[start[k] : end[k]].tobytes().decode("latin-1")
            got = [v for _, v in self.automaton.iter_long(text)]
            broken[k] = sum(m for m, _ in got) != len(text)
            found.append(np.array([i for _, i in got], np.int64))
            owners.append(np.full(len(got), k))
        # All short pieces go down the tree of tokens side by side, a byte in a round.
        live = np.flatnonzero(end - start <= STEPPED)
        at, stop = start[live], end[live]
        state, best, best_at = np.zeros(len(live), np.int64), np.full(len(live), -1), at.copy()
        while len(live):
            inside = at < stop
            byte = data[np.minimum(at, len(data) - 1)]
            root = state == 0
            step = np.where(root, self.first_state[byte], -1)
            deep = np.flatnonzero(inside & ~root)
            step[deep] = self.states.get((state[deep] << 8 | byte[deep]) + 1)
            step[~inside] = -1
            on = step >= 0
            state, at = np.where(on, step, 0), at + on
            token = np.where(on, self.accept[np.maximum(step, 0)], -1)
            better = token >= 0
            best, best_at = np.where(better, token, best), np.where(better, at, best_at)
            done = np.flatnonzero(~on)
            if len(done):
                lost = best[done] < 0  # a byte that is no token
                broken[live[done[lost]]] = True
                found.append(best[done[~lost]])
                owners.append(live[done[~lost]])
                at[done] = best_at[done]
                best[done] = -1
                over = np.zeros(len(live), bool)
                over[done] = lost | (at[done] >= stop[done])
                if over.any():
                    live, at, stop, state, best, best_at = (x[~over] for x in (live, at, stop, state, best, best_at))
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, owners))
        order = np.argsort(owner, kind="stable")
        count = np.bincount(owner, minlength=len(start))
        return ids[order], np.where(broken, -count, count)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible``, with pairs told before remembered."""
        key = (a << 32 | b) + 1
        told = self.fits.get(key)
        new = np.flatnonzero(told < 0)
        if len(new):
            pair, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            ok = self.compatible(a[new[first]], b[new[first]])
            if self.fits.used > REMEMBERED:
                self.fits = Table(1 << 14)
            self.fits.put(pair, ok.astype(np.int64))
            told[new] = ok[back]
        return told > 0

    def encode_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, one after the other, and how many each has."""
        ids, count = self._propose(data, start, end)
        length = np.abs(count)
        owner = np.repeat(np.arange(len(start)), length)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        refused = (count < 0) | (length == 0)
        refused[owner[inner[~self._fit(ids[inner], ids[inner + 1])]]] = True
        again = np.flatnonzero(refused)
        if not len(again):
            return ids, length
        exact, n = self._merged_spans(data, start[again], end[again] - start[again])
        kept = ~refused[owner]
        ids, owner = np.concatenate([ids[kept], exact]), np.concatenate([owner[kept], np.repeat(again, n)])
        length[again] = n
        return ids[np.argsort(owner, kind="stable")], length

    def _alike(self, a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether spans of equal sizes from ``at`` in ``a`` and from ``bt`` in ``b`` have the same bytes."""
        a, b, ok = eights(a), eights(b), np.ones(len(at), bool)
        live = np.arange(len(at))
        for k in range(0, int(size.max(initial=0)), 8):
            live = live[size[live] > k]
            ok[live] &= ((a[at[live] + k] ^ b[bt[live] + k]) & MASKS[np.minimum(size[live] - k, 8)]) == 0
        return ok

    def _remember(self, key, data, start, size, ids, n) -> None:
        """Add pieces with new keys."""
        first = np.cumsum(n) - n
        apart = (n > 4) | (np.maximum.reduceat(ids, first) >= 1 << 16)
        inline = np.zeros((len(n), 4), np.uint16)
        near = ~apart
        inline[np.flatnonzero(near)[:, None], np.arange(4)] = np.where(np.arange(4) < n[near][:, None], ids[np.minimum(first[near][:, None] + np.arange(4), len(ids) - 1)], 0)
        rows = np.empty((len(n), 3), np.int64)
        rows[:, 0], rows[:, 2] = inline.view(np.int64)[:, 0], self.slice_number
        rows[:, 1] = size | n << 8 | apart.astype(np.int64) << 16
        long = np.where(size > 8, size, 0)
        rows[:, 1] |= (len(self.text) + np.cumsum(long) - long) << 17
        self.text.add(data[ragged(start, long)])
        rows[apart, 0] = len(self.ids) + np.cumsum(n[apart]) - n[apart]
        self.ids.add(ids[ragged(first[apart], n[apart])])
        self.known.put(key, rows)

    def _evict(self) -> None:
        """Beyond ``REMEMBERED`` pieces, the half that was met last stays."""
        if self.known.used <= REMEMBERED:
            return
        some = np.flatnonzero(self.known.keys)
        some = some[np.argsort(-self.known.rows[some, 2], kind="stable")[: REMEMBERED // 2]]
        keys, rows = self.known.keys[some], self.known.rows[some]
        size, n, apart, at = self._told(rows)
        long = np.where(size > 8, size, 0)
        text, ids = self.text.values[ragged(at, long)], self.ids.values[ragged(rows[apart, 0], n[apart])]
        rows[:, 1] = (rows[:, 1] & 0x1FFFF) | (np.cumsum(long) - long) << 17
        rows[apart, 0] = np.cumsum(n[apart]) - n[apart]
        number, fits = self.slice_number, self.fits
        self.forget()
        self.slice_number, self.fits, self.known = number, fits, Table(REMEMBERED, 3)
        self.known.put(keys, rows)
        self.text.add(text)
        self.ids.add(ids)

    @staticmethod
    def _told(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Size, number of ids, whether these are apart, and place of the text."""
        told = rows[:, 1]
        return told & 0xFF, told >> 8 & 0xFF, (told >> 16 & 1).astype(bool), told >> 17

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, and where each row's begin (one more than rows)."""
        self._evict()
        self.slice_number += 1
        cuts, marks = offs, []
        raw = data.tobytes() if self.special else b""
        for word in self.special:
            k = raw.find(word)
            while k >= 0:
                if np.searchsorted(offs, k, "right") == np.searchsorted(offs, k + len(word) - 1, "right"):
                    marks.append((k, k + len(word), self.special[word]))
                    k = raw.find(word, k + len(word))
                else:
                    k = raw.find(word, k + 1)
        if marks:
            a, b, special = np.array(sorted(marks)).T
            cuts = np.unique(np.concatenate([offs, a, b]))
        start = piece_starts(data, cuts)
        named = np.full(len(start), -1)
        if marks:
            k = np.searchsorted(a, start, "right") - 1
            keep = (k < 0) | (start == a[k]) | (start >= b[k])
            start, k = start[keep], k[keep]
            named = np.where((k >= 0) & (start == a[k]), special[k], -1)
        size = np.append(start[1:], len(data)) - start
        # What is known: the same key, size and bytes. Up to 8 bytes, the key (their bijection) and the size tell these.
        key = mix(eights(data)[start] & MASKS[np.minimum(size, 8)]).view(np.int64)
        long = np.flatnonzero(size > 8)
        key[long] = span_hashes(data, start[long], start[long] + size[long]).view(np.int64)
        key[key == 0] = 1  # 0 comes from zero bytes only; 1 from 8 bytes that are no text
        slot, met = self.known.find(key)
        row = self.known.rows.take(slot, 0)
        size_known, n, apart, at = self._told(row)
        hit = met & (size_known == size) & (named < 0)
        long = np.flatnonzero(hit & (size > 8))
        hit[long] = self._alike(data, start[long], self.text.values, at[long], size[long])
        if self.slice_number % 4 == 0:  # often enough to tell what is still met
            self.known.rows[slot[hit], 2] = self.slice_number
        # The others: each distinct one once, and where hashes meet, every one.
        new = np.flatnonzero(~hit & (named < 0))
        n[named >= 0] = 1
        if len(new):
            code, distinct = pd.factorize(key[new])
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            one = new[first[code]]
            same = size[one] == size[new]
            long = np.flatnonzero(same & (size[new] > 8))
            same[long] = self._alike(data, start[new[long]], data, start[one[long]], size[new[long]])
            odd = np.flatnonzero(~same)
            learned = np.concatenate([new[first], new[odd]])
            code[odd] = len(first) + np.arange(len(odd))
            ids_new, n_new = self.encode_spans(data, start[learned], start[learned] + size[learned])
            at_new = np.cumsum(n_new) - n_new
            n[new] = n_new[code]
        total = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(total[-1], np.int64)
        near = hit & ~apart
        inline = np.ascontiguousarray(row[near, 0]).view(np.uint16).reshape(-1, 4)
        out[np.repeat(near, n)] = inline[np.arange(4) < n[near][:, None]]
        far = np.flatnonzero(hit & apart)
        out[ragged(total[far], n[far])] = self.ids.values[ragged(row[far, 0], n[far])]
        out[total[:-1][named >= 0]] = named[named >= 0]
        if len(new):
            out[ragged(total[new], n[new])] = ids_new[ragged(at_new[code], n[new])]
            fresh = np.flatnonzero(~met[new[first]] & (size[new[first]] <= STEPPED) & (n_new[: len(first)] > 0))
            if len(fresh):
                own = ragged(at_new[fresh], n_new[fresh])
                self._remember(distinct[fresh], data, start[learned[fresh]], size[learned[fresh]], ids_new[own], n_new[fresh])
        return out, total[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids, specials as they are written; broken UTF-8 is replaced."""
        return b"".join(self.token_bytes[ids].tolist()).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Encoder]]:
    """For slices of batches with doc_id and text: ids of the documents, token ids, their bounds."""
    tool = encoder(path)
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text"), AT_ONCE):
            yield batch.column("doc_id")[lo:hi], *tool.encode(data, offs), tool


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row; null and empty texts have no ids. Other columns are not read."""
    path = path or default_vocabulary()

    def run(batches):
        for doc, ids, bound, _ in encoded(batches, path):
            yield pa.record_batch([doc, pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null."""
    path = path or default_vocabulary()

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            texts = [None if v is None else tool.decode(np.array(v, np.int64)) for v in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, and checksums of the ids and of the decoded text.

    Null counts as empty: no tokens, checksums of the empty string. Repeated rows and null ids each
    give a row. A very long text is a slice of its own, read whole. An empty table gives no rows.
    Other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches):
        for doc, ids, bound, tool in encoded(batches, path):
            texts, parts = tool.texts[ids], tool.token_bytes[ids]
            told, back = [], []
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
                told.append(hashlib.sha256(b",".join(texts[a:b].tolist())).hexdigest())
                back.append(hashlib.sha256(b"".join(parts[a:b].tolist()).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.record_batch([doc, pa.array(np.diff(bound), pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op9_bpe": op9_bpe}
