"""Sampled suffixes of texts: from them every repeated string of a given length can be found.

Of the `length - gram + 1` grams inside a window of `length` bytes the one with the smallest hash
(the first, if several) is the window's anchor. Equal windows have equal anchors at equal places, so
only suffixes that begin at an anchor need to be kept. Consecutive windows mostly share an anchor
and form a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from triptally.llm.arrays import U64, Chunk, mix, powers, running
from triptally.llm.arrays import _INVERSE, _ODD  # noqa: PLC2701

_LOW = U64(0xFFFFFFFF)


@dataclass
class Runs:
    """One entry per run: windows starting at start .. start + count - 1 (in the chunk's data)."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray  # where the anchor begins
    anchor_hash: np.ndarray
    run_hash: np.ndarray  # of all bytes of the run's windows and the anchor's place in them


def fixed_ranges(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of `size` bytes, by their start."""
    n = len(total) - size
    if n <= 0:
        return np.zeros(0, U64)
    moved = (total[size:] - total[:n]) * powers(_INVERSE, n)
    return mix(moved + np.array([size], U64) * _ODD)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_runs(chunk: Chunk, length: int, gram: int) -> Runs:
    data, bounds = chunk.data, chunk.bounds
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= length)
    none = np.zeros(0, np.int64)
    if len(rows) == 0:
        return Runs(none, none, none, none, np.zeros(0, U64), np.zeros(0, U64))
    total = running(data)
    grams = fixed_ranges(total, gram)
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
    least = sliding_min(keys, length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int8)
    inside[bounds[rows]] += 1
    inside[bounds[rows + 1] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    anchors = (least[at] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    start, anchor = at[begin], anchors[begin]
    count = np.diff(np.append(begin, len(at)))
    end = start + count - 1 + length
    moved = (total[end] - total[start]) * powers(_INVERSE, len(total))[start]
    place = (anchor - start).astype(U64) * U64(0xA24BAED4963EE407)
    run_hash = mix(mix(moved + count.astype(U64) * _ODD) ^ place)
    row = np.searchsorted(bounds, start, "right") - 1
    return Runs(row, start, count, anchor, grams[anchor], run_hash)
