"""Fill-in-middle examples: texts cut at token boundaries and rearranged around marks.

The boundaries of all texts of a block form one ascending list of offsets. A learned index stands for
it: straight segments from rank to offset whose error is bounded, and one byte of residual a boundary.
A cut is predicted by its segment and corrected by its residual, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from triptally.llm.arrays import SPACE, Chunk, chunks
from triptally.llm.tables import unused

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
ERROR = 127  # a residual fits one signed byte


@dataclass
class RankIndex:
    """Offsets by rank: segment i starts at rank firsts[i] and offset bases[i]."""

    firsts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments through the first and last offset of runs of ranks, halved until every offset of a
        run lies within `error` (at most 127) of its line. `offsets` ascend."""
        if not 0 <= error <= 127:
            raise ValueError("error must be between 0 and 127")
        n = len(offsets)
        offsets = offsets.astype(np.int64)
        residuals = np.zeros(n, np.int8)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        first, last = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n - 1)
        while len(first):
            sizes = last - first + 1
            slope = (offsets[last] - offsets[first]) / np.maximum(sizes - 1, 1)
            starts = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
            rank = np.repeat(first, sizes) + step
            line = np.repeat(offsets[first], sizes) + _along(np.repeat(slope, sizes), step)
            off = offsets[rank] - line
            fits = np.maximum.reduceat(np.abs(off), starts) <= error
            fits |= sizes == 1
            told = np.repeat(fits, sizes)
            residuals[rank[told]] = off[told]
            done.append((first[fits], slope[fits]))
            first, last = first[~fits], last[~fits]
            middle = (first + last) // 2
            first, last = np.r_[first, middle + 1], np.r_[middle, last]
        firsts = np.concatenate([f for f, _ in done]) if done else np.zeros(0, np.int64)
        slopes = np.concatenate([s for _, s in done]) if done else np.zeros(0)
        order = np.argsort(firsts)
        firsts = firsts[order]
        return cls(firsts, offsets[firsts], slopes[order], residuals)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone; within the error bound."""
        at = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[at] + _along(self.slopes[at], ranks - self.firsts[at])

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets."""
        return self.predict(ranks) + self.residuals[ranks]


def _along(slopes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The whole number below each point of a line; the same on fitting and on lookup."""
    return np.floor(slopes * steps).astype(np.int64)


def boundaries(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, firsts) of token boundaries in bytes: those of text i are its begin and the ends of
    its tokens, from firsts[i] on. A token is a word with the white space before it; white space after
    the last word is one too."""
    data = chunk.data
    end = np.zeros(len(data) + 1, bool)
    if len(data):
        solid = ~SPACE[data]
        end[1:] = solid
        end[1:-1] &= ~solid[1:]
        edges = chunk.bounds[1:-1]
        inner = edges[(edges > 0) & (edges < len(data))]
        end[inner] |= solid[inner - 1]
    full = np.diff(chunk.bounds) > 0
    end[chunk.bounds[1:][full]] = True
    ends = np.flatnonzero(end)
    counts = np.diff(np.searchsorted(ends, chunk.bounds, "right"))
    firsts = np.r_[0, np.cumsum(counts + 1)]
    offsets = np.empty(int(firsts[-1]), np.int64)
    begins = np.zeros(len(offsets), bool)
    begins[firsts[:-1]] = True
    offsets[firsts[:-1]] = chunk.bounds[:-1]
    offsets[~begins] = ends
    return offsets, firsts


def _draw(seed: int, key: Column, number: int) -> Column:
    """The number-th of eight unsigned 32-bit draws of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks can be told from text only if none can begin within another."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"marks overlap: {a!r}, {b!r}")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80,
    marks: tuple[str, str, str] = MARKS, key: str = "doc_id", text: str = "text",
    into: str = "output",
) -> DataFrame:
    """All columns of `docs` with n, form, prefix_chars, middle_chars and `into`.

    n is the number of tokens. `rate` percent of the rows are rearranged, of these `spm` percent as
    suffix, prefix, middle and the others as prefix, suffix, middle; rows stay plain if the text is
    empty, null (output: empty) or holds a mark. Cuts and form depend on the seed and the row's key
    only, so rows with equal keys (or all without one) draw alike. Lengths are in code points, null
    for plain rows. An empty table gives no rows; columns of `docs` with one of the new names (in any
    case) are replaced.
    """
    _checked(marks)
    new = ["n", "form", "prefix_chars", "middle_chars", into]
    rest = [c for c in docs.columns if c.lower() not in {x.lower() for x in new}]
    hidden = [unused(docs.columns, f"__fim{i}") for i in range(4)]
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked |= F.contains(body, F.lit(mark))
    plain = (body == "") | marked | (_draw(seed, docs[key], 2) % 100 >= rate)
    form = (
        F.when(plain, "plain").when(_draw(seed, docs[key], 3) % 100 < spm, "spm").otherwise("psm")
    )
    frame = docs.select(
        body.alias(hidden[0]), _draw(seed, docs[key], 0).alias(hidden[1]),
        _draw(seed, docs[key], 1).alias(hidden[2]), form.alias(hidden[3]), *rest,
    )
    more = [
        StructField("n", LongType(), False), StructField("form", StringType(), False),
        StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
        StructField(into, StringType(), False),
    ]
    schema = StructType([*frame.schema.fields[4:], *more])
    p, s, m = (mark.encode() for mark in marks)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                rows = batch.slice(chunk.first, len(chunk))
                offsets, firsts = boundaries(chunk)
                index = RankIndex.fit(offsets)
                del offsets
                n = np.diff(firsts) - 1
                one, two = (rows.column(i).to_numpy() % (n + 1) for i in (1, 2))
                low = index.offsets(firsts[:-1] + np.minimum(one, two))
                high = index.offsets(firsts[:-1] + np.maximum(one, two))
                lead = np.r_[0, np.cumsum((chunk.data & 0xC0) != 0x80)]
                forms = rows.column(3)
                is_plain = np.array(pa.compute.equal(forms, "plain").to_pylist())
                raw, out = memoryview(chunk.data.tobytes()), []
                spans = zip(forms.to_pylist(), chunk.bounds[:-1].tolist(), low.tolist(),
                            high.tolist(), chunk.bounds[1:].tolist(), strict=True)
                for kind, a, x, y, b in spans:
                    if kind == "plain":
                        whole = bytes(raw[a:b])
                    elif kind == "psm":
                        whole = b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y]))
                    else:
                        whole = b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y]))
                    out.append(whole)
                arrays = [
                    *rows.columns[4:], pa.array(n, pa.int64()), forms,
                    pa.array(lead[low] - lead[chunk.bounds[:-1]], pa.int64(), mask=is_plain),
                    pa.array(lead[high] - lead[low], pa.int64(), mask=is_plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return frame.mapInArrow(run, schema)


def restored(
    output: Column, form: Column, marks: tuple[str, str, str] = MARKS
) -> Column:
    """The text, from output and form alone: the parts between the marks in their order."""
    _checked(marks)
    parts = F.split(output, "|".join(rf"\Q{mark}\E" for mark in marks), -1)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
