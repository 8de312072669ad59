"""Words, word hashes and shingle sets of Arrow string columns, computed with numpy inside a task.

Words are runs of bytes that are not separators. Only ASCII bytes separate, so the UTF-8 bytes of a
text can be cut without decoding it. Each word gets a 64-bit hash under a key: words of up to eight bytes for
all words at once by a bijection of their bytes, so that two of one length never collide; longer ones by keyed
BLAKE2, each distinct word of a step once. Under a key that is drawn anew for each run nobody can make words, or
sets of words, that collide; what is left is chance, 1 in 2^64 for two words of which one has over eight bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step takes (a longer text makes a step of its own).
STEP_BYTES = 1 << 20
#: Key of hashes that only meet those of texts of one's own choice; comparisons of documents draw a key.
PUBLIC_KEY = b"public"

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_JOIN = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: By number of bytes, the mask of the first so many of a little-endian eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Letters(NamedTuple):
    """What each byte becomes, and whether it belongs to a word."""

    lower: np.ndarray
    inside: np.ndarray


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def blank_separated() -> Letters:
    """A-Z lower-cased; ASCII white space (20, 09-0D) separates words, nothing else does."""
    inside = np.ones(256, bool)
    inside[[0x20, 9, 10, 11, 12, 13]] = False
    return Letters(_lowered(), inside)


def alphanumeric() -> Letters:
    """A-Z lower-cased; every ASCII byte but digits and letters separates words."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[65:91] = inside[128:] = True
    return Letters(_lowered(), inside)


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of x over all 64."""
    x = x ^ (x >> _U(30))
    x *= _MIX[0]
    x ^= x >> _U(27)
    x *= _MIX[1]
    x ^= x >> _U(31)
    return x


class Words(NamedTuple):
    """Words of some texts, in order: where each begins and ends in data, its text, its hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray | None


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most that many bytes each, or of one row."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def new_key() -> bytes:
    """A key that nobody knows; all tasks of a run must get the same one."""
    return os.urandom(32)


@lru_cache(maxsize=8)
def _constants(key: bytes) -> tuple[np.uint64, np.uint64, np.uint64]:
    raw = hashlib.blake2b(b"constants of short words", key=key, digest_size=24).digest()
    first, by_length, factor = np.frombuffer(raw, "<u8")
    return first, by_length | _U(1), factor | _U(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = PUBLIC_KEY) -> np.ndarray:
    """A 64-bit hash of each data[starts[i]:ends[i]], none of them empty."""
    length = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    first, by_length, factor = _constants(key)
    out = mix(((eights[starts] & _FIRST[np.minimum(length, 8)]) ^ first ^ (length.astype(np.uint64) * by_length)) * factor)
    long = np.flatnonzero(length > 8)
    if len(long):
        raw, seen = data.tobytes(), {}
        made = np.empty(len(long), np.uint64)
        for k, (a, b) in enumerate(zip(starts[long].tolist(), ends[long].tolist())):
            w = raw[a:b]
            h = seen.get(w)
            if h is None:
                h = seen[w] = int.from_bytes(hashlib.blake2b(w, key=key, digest_size=8).digest(), "little")
            made[k] = h
        out[long] = made
    return out


def words(data: np.ndarray, offsets: np.ndarray, letters: Letters, hashed: bool = True, key: bytes = PUBLIC_KEY) -> Words:
    """All words of the texts data[offsets[i]:offsets[i + 1]], with offsets[0] = 0."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.uint64))
    low, inside = letters.lower[data], letters.inside[data]
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(low, starts, ends, counts, word_hashes(low, starts, ends, key) if hashed else None)


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and, by text, how many there are.

    A text of fewer than k words, but at least one, has one run: all its words.
    """
    h, counts = found.hashes, found.counts
    at = np.concatenate(([0], np.cumsum(counts)))
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    out_n = np.where(short, 1, full)
    out = np.empty(int(out_n.sum()), np.uint64)
    to = np.concatenate(([0], np.cumsum(out_n)))
    if full.any():
        firsts = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(full)))[:-1], full) + np.arange(int(full.sum()))
        value = np.zeros(len(firsts), np.uint64)
        for j in range(k):
            value += h[firsts + j] * _JOIN[j]
        spots = np.repeat(to[:-1] - np.concatenate(([0], np.cumsum(full)))[:-1], full) + np.arange(int(full.sum()))
        out[spots] = mix(value)
    for i in np.flatnonzero(short):
        own = h[at[i] : at[i + 1]]
        out[to[i]] = mix((own * _JOIN[: len(own)]).sum(dtype=np.uint64) + np.full(1, len(own), np.uint64) * _JOIN[62])[0]
    return out, out_n


def shingle_sets(column: pa.Array, k: int, letters: Letters | None = None, key: bytes = PUBLIC_KEY) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By step of rows: the first row, all distinct shingle hashes (sorted within a text), counts by text."""
    letters = blank_separated() if letters is None else letters
    data, offsets = utf8(column)
    for first, last in steps(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        every, counts = shingles(words(data[lo:hi], offsets[first : last + 1] - lo, letters, key=key), k)
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(last - first):
            every[at[i] : at[i + 1]].sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        new[at[:-1][counts > 0]] = True
        sums = np.concatenate(([0], np.cumsum(new)))
        yield first, every[new], np.diff(sums[at])
