"""Anchors: places of a text that every long enough stretch around them picks alike.

For each window of ``width`` bytes the anchor is the position of its least ``GRAM``-byte string by
hash (the leftmost of equals).  The choice depends on the window's bytes alone, so equal windows
have their anchors at equal offsets, and the windows of one anchor start at consecutive positions.
"""

from __future__ import annotations

import numpy as np

from motorlake.llm import bytewords

U = np.uint64
GRAM = 40
_BITS = 21
_AT = U((1 << _BITS) - 1)
SEGMENT = 1 << 20
_END = np.uint64(2**64 - 1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = bytewords.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(bytewords._BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def stretch_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``stop``, the same wherever they stand."""
    return bytewords.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, _END, U)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, context, start, count, depth of each anchor of one text of at least ``width`` bytes.

    ``gram`` is the hash of the anchor's bytes, ``start`` the first window and ``count`` the number of
    windows that pick it; ``depth`` is the anchor's distance from the first; ``context`` is the hash of all bytes of these windows, with the anchor's
    place in them.  Long texts go in segments, whose ends may cut an anchor's windows in two.
    """
    out = []
    for lo in range(0, len(data) - width + 1, SEGMENT):
        part = data[lo : min(lo + SEGMENT + width - 1, len(data))]
        sums, down = _sums(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = stretch_hash(sums, down, at, at + GRAM)
        least = sliding_min((gram & ~_AT) | at.astype(U), width - GRAM + 1) & _AT
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(least)]]))
        place = least[starts].astype(np.int64)
        context = stretch_hash(sums, down, starts, starts + counts - 1 + width)
        context = bytewords.mix(context + (place - starts).astype(U) * U(0x9E3779B97F4A7C15) + counts.astype(U))
        out.append((gram[place], context, starts + lo, counts, place - starts))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hashes_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of stretches of one text."""
    lo, hi = int(start.min()), int(stop.max())
    if hi - lo <= 4 * SEGMENT:
        sums, down = _sums(data[lo:hi])
        return stretch_hash(sums, down, start - lo, stop - lo)
    out = np.zeros(len(start), U)
    for bucket in np.unique(start // SEGMENT):
        rows = np.flatnonzero(start // SEGMENT == bucket)
        out[rows] = hashes_of(data, start[rows], stop[rows])
    return out
