"""Words, shingles and their 64-bit hashes from UTF-8 buffers, in numpy over whole Arrow batches.

A word's hash is a polynomial over its bytes (each byte first mapped to a random 64-bit number),
taken from running sums, so hashing costs a few operations a byte and none a word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = _RNG.integers(0, 2**64, 16, dtype=U) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, b, U)])) for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values (nulls are empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return data[base : offsets[-1] if len(offsets) else 0], offsets - base


def bounded(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each holds about ``most`` bytes, or one row.

    Arrays made from a batch are many times its text, so this bounds a task's memory.
    """
    for batch in batches:
        _, offsets = text_buffers(batch.column(text))
        lo = 0
        while lo < len(batch):
            hi = max(int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1, lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _block_ends(space: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end at white space."""
    lo = 0
    while lo < total:
        hi = min(lo + BLOCK, total)
        while hi < total and not space[hi]:
            ahead = np.flatnonzero(space[hi : hi + 4096])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + 4096, total)
        yield lo, hi
        lo = hi


#: Bytes that end a word of letters and digits: all of ASCII but these.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all texts in order, and the n + 1 bounds of each text's words.

    Words are runs of bytes that ``apart`` does not mark (white space by default); A-Z count as
    a-z.  For each number in ``prefixes`` one more array follows: the hashes of the words' first
    bytes, or of whole shorter words.
    """
    data = _LOWER[data]
    space = apart[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    starts = []
    for lo, hi in _block_ends(space, len(data)):
        quiet, first = space[lo:hi], fresh[lo : hi + 1]
        word = ~quiet
        begins = word.copy()
        begins[1:] &= quiet[:-1] | first[1 : hi - lo]
        ends = word.copy()
        ends[:-1] &= quiet[1:] | first[1 : hi - lo]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        for k, most in enumerate((hi - lo, *prefixes)):
            stop = np.minimum(e, s + most)
            hashes[k].append(mix((sums[stop] - sums[s]) * down[s] + (stop - s).astype(U)))
        starts.append(s + lo)
    if not starts:
        return (np.zeros(0, U), np.zeros(len(offsets), np.int64), *[np.zeros(0, U) for _ in prefixes])
    at = np.concatenate(starts)
    whole, *parts = [np.concatenate(h) for h in hashes]
    return (whole, np.searchsorted(at, offsets), *parts)


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Distinct shingle hashes of one text's words, sorted; a shorter text is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return words
    length_used = min(n, length)
    total = np.full(n - length_used + 1, U(length_used * 0xD6E8FEB86659FD93 % 2**64), U)
    for k in range(length_used):
        total += mix(words[k : n - length_used + 1 + k] + _PLACE[k]) * _PLACE[k]
    return np.unique(mix(total))
