"""Vectorised views of Arrow string columns: words, word hashes and shingles
as NumPy arrays. Everything works on UTF-8 bytes; the word separators are all
ASCII, so cutting bytes and cutting code points give the same words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD = 1 << 16


def salt(k: int) -> np.uint64:
    """A 64-bit constant for each k."""
    return U(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POW = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        base = np.full(max(n, 64), 0xD6E8FEB86659FD93, U)
        base[0] = 1
        _POW = np.cumprod(base, dtype=U)
    return _POW


def string_array(col) -> pa.Array:
    """A plain string array without nulls (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def raw_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and the offset of each, from 0."""
    n = len(arr)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(bufs[2], np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(arr: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole strings of about ``max_bytes`` (one string at least)."""
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, arr.slice(lo, hi - lo)
        lo = hi


def find_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each string's range in that list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    first = np.empty_like(word)
    first[0] = True
    first[1:] = ~word[:-1]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    last = np.empty_like(word)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    starts = np.flatnonzero(word & first)
    return starts, np.flatnonzero(word & last) + 1, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word; a function of the word's bytes alone."""
    out = np.zeros(len(starts), U)
    for k in range(0, len(starts), block):
        s, lens = starts[k:k + block], ends[k:k + block] - starts[k:k + block]
        long = np.flatnonzero(lens > LONG_WORD)
        lens = np.where(lens > LONG_WORD, 1, lens)
        firsts = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum()))
        within = at - np.repeat(firsts, lens)
        v = BYTE[data[np.repeat(s, lens) + within]] * _powers(int(lens.max()))[within]
        h = np.add.reduceat(v, firsts)
        for i in long:
            whole = data[starts[k + i]:ends[k + i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
        out[k:k + block] = mix(h)
    return out


def word_hashes(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all strings, one after the other, and each string's range."""
    data, offs = raw_bytes(arr)
    if lower:
        data = LOWER[data]
    starts, ends, woff = find_words(data, offs)
    return hash_words(data, starts, ends), woff


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring hashes (order matters)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    acc = hashes[:m].copy()
    for k in range(1, n):
        acc = mix(acc + salt(k)) ^ hashes[k:k + m]
    return mix(acc)
