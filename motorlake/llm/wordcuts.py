"""Cuts of a text at which the tokens of both given vocabularies always end, and numbers for what lies between.

A single space or line feed between two characters that are surely no white space starts a new
segment: the byte-level pattern ends a token there whatever follows, no piece of the other
vocabulary holds a mark or a line feed beyond its start, and no special string holds either.  So a
segment's tokens depend on the segment alone.  A task numbers the distinct segments it meets and
encodes each once, all new ones of a batch in one call.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: What looks like a space to one library or the other besides white space, and the mark for a space in pieces.
OTHERS = "᠎​﻿▁"
SPACE = rf"\s\x1c-\x1f\x85{OTHERS}"
CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
BLANK = re.compile(f"[{SPACE}]")


def keys(text: str) -> list[str]:
    """The segments of a text that has a space before it, as keys for :func:`segment`."""
    if not text:
        return []
    if " ".join(text.split()) == text.replace("\n", " ") and not any(c in text for c in OTHERS):
        return text.replace("\n", " \n").split(" ")  # single spaces and line feeds only
    return [k if not (BLANK.match(k[0]) or BLANK.match(k[-1])) else " " + k for k in CUT.split(text)]


def segment(key: str) -> str:
    """The characters that a key stands for: most segments start with a space that keys leave out."""
    return key if key[0] in " \n" else " " + key


def is_odd(key: str) -> bool:
    """Whether a segment starts or ends with more than the cut, so that no other may stand beside it."""
    return key[0] == " "


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` lists those of this batch."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def numbers(self, wanted: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, wanted), dtype=np.int32, count=len(wanted))


class Ragged:
    """Rows of different length in one flat array that grows."""

    def __init__(self, dtype):
        self.flat, self.ends, self.rows, self.size = np.empty(1024, dtype), np.zeros(1025, np.int64), 0, 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = _room(self.flat, self.size + len(values))
        self.flat[self.size : self.size + len(values)] = values
        self.ends = _room(self.ends, self.rows + len(lengths) + 1)
        self.ends[self.rows + 1 : self.rows + len(lengths) + 1] = self.size + np.cumsum(lengths)
        self.size, self.rows = self.size + len(values), self.rows + len(lengths)

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The values of ``rows``, one row after the other."""
        return self.flat[spans(self.ends[rows], self.lengths(rows))]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    wider = np.empty(max(size, 2 * len(array)), array.dtype)
    wider[: len(array)] = array
    return wider


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each pair of start and length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def encode_joined(
    segments: list[str], encode: Callable[[str], np.ndarray], widths: np.ndarray, chars: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments, one after the other, and how many each has; they are encoded side by side.

    ``widths`` gives the bytes of each id, which tell where a segment's ids end.
    """
    ids, counts, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while start < len(segments):
        stop, size = start, 0
        while stop < len(segments) and size < chars:
            size += len(segments[stop])
            stop += 1
        part = segments[start:stop]
        found = encode("".join(part))
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in part), np.int64, len(part)))
        upto = np.searchsorted(np.cumsum(widths[found]), ends, "right")
        ids.append(found)
        counts.append(np.diff(upto, prepend=0))
        start = stop
    return np.concatenate(ids), np.concatenate(counts)
