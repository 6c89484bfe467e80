"""Texts of an Arrow batch as numpy arrays: words, word n-grams, hashes of byte ranges.

All hashes are 64 bits wide and the same on every machine. A byte range is hashed by a polynomial
over random values of its bytes, so that one running sum gives the hash of any range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_STEP, -1, 1 << 64)
_WORD_STEP = 0xA0761D6478BD642F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finalizer)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> U64(27))) * U64(0x94D049BB133111EB)
        return values ^ (values >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """step**0 .. step**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(step)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), step, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=U64)
        if n <= 4 * CHUNK_BYTES:  # a single very long text does not stay in memory
            _powers[step] = have
    return have[:n]


def running(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums from which `ranges` takes the hash of any byte range."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_STEP, len(data)), out=total[1:])
    return total


def ranges(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], equal for equal bytes wherever they stand."""
    moved = (total[ends] - total[starts]) * powers(_INVERSE, len(total))[starts]
    return mix(moved + (ends - starts).astype(U64) * _ODD)


@dataclass
class Chunk:
    """Consecutive rows first..last of a batch; row i has data[bounds[i]:bounds[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string or binary column (null: empty) in runs of about `budget` bytes, so that working
    arrays stay small whatever the size of a batch. A longer text is a run of its own."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + budget, "right")) - 1)
        yield Chunk(i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


@dataclass
class Words:
    """The words of a chunk, lower-cased A-Z and cut at ASCII white space; row i has the words
    firsts[i]..firsts[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


def words(chunk: Chunk) -> Words:
    data = chunk.data
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(chunk) + 1, np.int64))
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[chunk.bounds] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (edge[:-1] | ~before))
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    hashes = ranges(running(data, lower=True), starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, chunk.bounds))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; short by n - 1. Rows are not heeded."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    step = powers(_WORD_STEP, n)
    total = np.zeros(len(hashes) - n + 1, U64)
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * step[j]
    return mix(total + np.array([n], U64) * _ODD)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """The hash of one whole sequence of words, as `gram_hashes` gives it."""
    return gram_hashes(hashes, len(hashes))


def row_of(firsts: np.ndarray, count: int) -> np.ndarray:
    """The row of each of `count` words."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:count]


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle; a row of fewer words has its whole sequence as one."""
    sizes = np.diff(found.firsts)
    grams = gram_hashes(found.hashes, n)
    whole = found.firsts[:-1][sizes >= n]
    keep = np.zeros(len(found.hashes) + 1, np.int64)  # +1 where a row's shingles begin, -1 behind
    np.add.at(keep, whole, 1)
    np.add.at(keep, whole + sizes[sizes >= n] - n + 1, -1)
    at = np.flatnonzero(np.cumsum(keep)[: len(grams)])
    rows = row_of(found.firsts, len(found.hashes))[at]
    hashes = grams[at]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        one = [sequence_hash(found.hashes[found.firsts[r] : found.firsts[r + 1]])[0] for r in short]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, np.array(one, U64)])
    return rows, hashes


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, hash) pairs."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array column whose row i takes the next sizes[i] values."""
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
