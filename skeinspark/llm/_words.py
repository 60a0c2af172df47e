"""Vectorised word splitting and hashing of whole texts held in Arrow buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D; A-Z are lower-cased.
Both act on ASCII bytes only, so working on UTF-8 bytes equals working on text.
Texts are taken in slices of about ``SLICE`` bytes, which bounds memory; one text
longer than that is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end words of letters (A-Z, a-z and all beyond ASCII), and those that end words of letters and digits.
NO_LETTER = np.zeros(256, dtype=bool)
NO_LETTER[:128] = True
NO_LETTER[65:91] = NO_LETTER[97:123] = False
NO_LETTER_OR_DIGIT = NO_LETTER.copy()
NO_LETTER_OR_DIGIT[48:58] = False

MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Bytes of a span that are hashed in 8-byte steps; longer ones go to a library's hash.
_STEPPED = 64
#: Numbers hashed at once, so that they stay in a core's cache.
_BLOCK = 1 << 13
#: Odd numbers of the hashes.
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA24BAED4963EE407)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows ``lo:hi`` of at most ``limit`` bytes (one row may exceed it) and at most ``rows``, with bytes and offsets."""
    data, offs = text_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + (rows or n))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of some texts, in order: spans in ``data`` (lower-cased), 64-bit hashes, row of each, first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``data`` on as an integer; zeros follow its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def _span_hashes(view: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    n = size.astype(U64)
    h = mix((view[start] & MASKS[np.minimum(size, 8)]) ^ (n * _C))
    long = np.flatnonzero(size > 8)
    a, b, live = h[long], h[long] * _B + n[long], np.flatnonzero(size[long] <= _STEPPED)
    chained = live
    for k in range(8, _STEPPED, 8):
        if not len(live):
            break
        at, left = start[long[live]] + k, size[long[live]] - k
        x = view[at] & MASKS[np.minimum(left, 8)]
        a[live], b[live] = mix(a[live] ^ x), mix((b[live] ^ (b[live] >> U64(29))) + x * _A)
        live = live[left > 8]
    h[long[chained]] = mix(a[chained] * _C ^ b[chained])
    for k in np.flatnonzero(size > _STEPPED).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans. Spans of up to 8 bytes of one length never meet; of longer ones two chains are folded."""
    view, out = eights(data), np.empty(len(start), U64)
    for lo in range(0, len(start), _BLOCK):
        out[lo : lo + _BLOCK] = _span_hashes(view, data, start[lo : lo + _BLOCK], end[lo : lo + _BLOCK])
    return out


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    """Split texts into words, runs of bytes that ``breaks`` does not name, and hash them."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    first = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(data, starts, ends, span_hashes(data, starts, ends), row, first)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in their order."""
    return mix(mix(a + _A) * _B ^ b)


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if k == 1:
        return mix(h)
    half = k // 2
    part = _gram_hashes(h, half)
    out = joined(part[: len(part) - half], part[half:])
    return out if k == 2 * half else joined(out[:-1], h[k - 1 :])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` neighbours in ``h``, made of those of half as many; empty where ``h`` is shorter."""
    n = max(0, len(h) - k + 1)
    out = np.empty(n, U64)
    step = max(_BLOCK, k)
    for lo in range(0, n, step):
        out[lo : lo + step] = _gram_hashes(h[lo : lo + step + k - 1], k)
    return out


def shingle_sets(w: Words, k: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its ``k``-word shingles.

    Fewer words than ``k`` give one shingle, the whole sequence; no words, none.
    """
    grams = gram_hashes(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield mix(gram_hashes(w.hash[a:b], b - a) + U64(b - a))
        else:
            yield np.zeros(0, U64)
