"""Repeated strings of a corpus, found by grouping sampled suffixes by fingerprint.

A level holds the distinct sampled suffixes of some batches, grouped by the fingerprint of their
anchor and of their run (`suffix_runs`), each with the number of its occurrences and one place. A
new batch gets a level of its own. Whenever the two smallest levels are equal in size they are
united and grouped again. Grouping stands in for suffix arrays and merge scans: a match needs only
equality of strings of a known length. Matches are told when all batches are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.llm.arrays import chunks, mix, running, signed
from triptally.llm.suffix_runs import find_runs, fixed_ranges
from triptally.llm.tables import Steps, fields, unused

ROW = "__row"
CELL = np.uint64(16)  # windows of a cell on average
SMALL_GROUP = 64  # larger groups of one anchor are compared window by window across tasks
CUT_ROWS = 2048  # entries whose windows a task holds at a time, and what completes their group
TEXT_BYTES = 1 << 18  # of texts that a task works on at a time


def sampled_suffixes(docs: DataFrame, text: str, length: int, gram: int, batches: int) -> DataFrame:
    """(row, start, n, anchor, run, batch): the runs of every text, starts in bytes."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0)
            for chunk in chunks(part.column(1), TEXT_BYTES):
                found = find_runs(chunk, length, gram)
                if len(found.row):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(found.row + chunk.first)),
                         pa.array((found.start - chunk.bounds[found.row]).astype(np.int32)),
                         pa.array(found.count.astype(np.int32)),
                         signed(found.anchor_hash), signed(found.run_hash)],
                        names=["row", "start", "n", "anchor", "run"],
                    )

    runs = docs.select(ROW, text).mapInArrow(
        run, "row long, start int, n int, anchor long, run long"
    )
    return runs.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))


@dataclass
class SuffixIndex:
    """The family of levels. `add` takes batches one by one; `merged` is the array over all."""

    steps: Steps
    levels: list[tuple[int, str, DataFrame]] = field(default_factory=list)  # (rank, name, array)
    made: int = 0

    def _array(self, entries: DataFrame) -> tuple[str, DataFrame]:
        """Entries put in order, equal suffixes as one."""
        array = entries.groupBy("anchor", "run").agg(
            F.sum("times").alias("times"), F.min("place").alias("place")
        )
        self.made += 1
        name = f"array-{self.made}"
        return name, self.steps.keep(array.sortWithinPartitions("anchor", "run"), name)

    def add(self, runs: DataFrame) -> None:
        """A suffix array for a new batch; equal levels merge until none are left."""
        place = F.struct("row", "start", "n").alias("place")
        name, array = self._array(runs.select("anchor", "run", F.lit(1).cast("long").alias("times"), place))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other_name, other = self.levels.pop()
            merged_name, merged = self._array(array.unionByName(other))
            self.steps.drop(name, other_name)
            rank, name, array = rank + 1, merged_name, merged
        self.levels.append((rank, name, array))

    def merged(self) -> DataFrame:
        """The array over all batches; levels left over are united and grouped once more."""
        if len(self.levels) == 1:
            return self.levels[0][2]
        whole = self.levels[0][2]
        for _, _, array in self.levels[1:]:
            whole = whole.unionByName(array)
        old = [name for _, name, _ in self.levels]
        name, array = self._array(whole)
        self.steps.drop(*old)
        self.levels = [(self.levels[0][0] + 1, name, array)]
        return array


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Texts (text, wanted: places in it) to (anchor, run, times, members, first, bytes) per place."""
    schema = "anchor long, run long, times long, members long, row long, first int, bytes binary"

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wanted = part.column("wanted")
            for chunk in chunks(part.column("text"), TEXT_BYTES):
                raw = chunk.data.tobytes()
                columns: list[list] = [[] for _ in range(7)]
                for i in range(len(chunk)):
                    base = int(chunk.bounds[i])
                    for w in wanted[chunk.first + i].as_py():
                        begin = base + w["start"]
                        if begin + w["n"] + length - 1 > chunk.bounds[i + 1]:
                            continue  # another text, whose row has the same hash
                        values = (
                            w["anchor"], w["run"], w["times"], w["members"],
                            part.column("row")[chunk.first + i].as_py(), w["start"],
                            raw[begin : begin + w["n"] + length - 1],
                        )
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["anchor", "run", "times", "members", "row", "first", "bytes"],
                )

    return texts.mapInArrow(run, schema)


def _windows(part: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, window within it, hash) of every window of the entries' bytes."""
    column = part.column("bytes")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    entries, offsets, hashes = [], [], []
    for chunk in chunks(column):
        all_windows = fixed_ranges(running(chunk.data), length)
        counts = np.diff(chunk.bounds) - length + 1
        entry = np.repeat(np.arange(len(chunk)), counts)
        offset = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
        entries.append(entry + chunk.first)
        offsets.append(offset)
        hashes.append(all_windows[chunk.bounds[:-1][entry] + offset])
    return np.concatenate(entries), np.concatenate(offsets), np.concatenate(hashes)


def _spans(entry: np.ndarray, offset: np.ndarray, part, length: int) -> pa.RecordBatch:
    """Sorted covered windows as spans (row, first byte, last byte + 1), consecutive ones joined."""
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(entry)) - 1
    rows = part.column("row").to_numpy()[entry[begin]]
    first = part.column("first").to_numpy()[entry[begin]]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array((first + offset[begin]).astype(np.int32)),
         pa.array((first + offset[last] + length).astype(np.int32))],
        names=["row", "lo", "hi"],
    )


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, at most CUT_ROWS at a time."""
    for part in parts:
        for i in range(0, part.num_rows, CUT_ROWS):
            yield part.slice(i, CUT_ROWS)


def _whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables of whole anchors; none has more than about CUT_ROWS rows and an
    anchor's besides."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for part in _slices(parts):
        anchors = part.column("anchor").to_numpy()
        begin = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
        begin = begin if anchors[0] == last else np.append(0, begin)
        at = 0
        if n >= CUT_ROWS and begin[0] < len(anchors):  # the group that is held ends in this slice
            at = int(begin[0])
            yield pa.Table.from_batches([*held, part.slice(0, at)])
            held, n = [], 0
        held.append(part.slice(at))
        n, last = n + len(anchors) - at, anchors[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compare_groups(cut: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that another entry of the same anchor holds too; groups are small, and a
    task, to which they come in order, holds the windows of some at a time."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(parts):
            entry, offset, hashes = _windows(part, length)
            _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            single = part.column("times").to_numpy()[entry] == 1
            keep = (counts[inverse] > 1) & single
            if keep.any():
                yield _spans(entry[keep], offset[keep], part, length)

    return cut.mapInArrow(run, "row long, lo int, hi int")


def _cells(cut: DataFrame, length: int) -> DataFrame:
    """(cell, row, first, single, bytes): the windows of each entry in stretches that end where a
    window's hash says so, so that entries which share a stretch share its cells but the outermost;
    cell is the hash of a stretch's bytes."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            entry, offset, hashes = _windows(part, length)
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (hashes[:-1] % CELL == 0)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(entry)) - 1
            with np.errstate(over="ignore"):
                nth = np.arange(len(entry)) - np.repeat(begin, last - begin + 1)
                cell = mix(np.add.reduceat(hashes * mix(nth.astype(np.uint64) + np.uint64(1)), begin))
            whole = part.column("bytes").to_pylist()
            pieces = [
                whole[e][a : b + length]
                for e, a, b in zip(entry[begin], offset[begin], offset[last], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [signed(cell), pa.array(part.column("row").to_numpy()[entry[begin]]),
                 pa.array((part.column("first").to_numpy()[entry[begin]] + offset[begin]).astype(np.int32)),
                 pa.array(part.column("times").to_numpy()[entry[begin]] == 1),
                 pa.array(pieces, pa.binary())],
                names=["cell", "row", "first", "single", "bytes"],
            )

    return cut.select("row", "first", "times", "bytes").mapInArrow(
        run, "cell long, row long, first int, single boolean, bytes binary"
    )


def _compare_windows(cut: DataFrame, length: int) -> DataFrame:
    """The same for entries of large groups: equal cells meet, and of cells that differ equal
    windows, whatever task they are in."""

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            entry, offset, hashes = _windows(part, length)
            yield pa.RecordBatch.from_arrays(
                [signed(hashes), pa.array(part.column("row").to_numpy()[entry]),
                 pa.array((part.column("first").to_numpy()[entry] + offset).astype(np.int32)),
                 pa.array(part.column("own").to_numpy(zero_copy_only=False)[entry])],
                names=["hash", "row", "lo", "own"],
            )

    cells = _cells(cut, length)
    place = F.struct("row", "first", "single", "bytes")
    kinds = cells.groupBy("cell").agg(F.count("*").alias("c"), F.min(place).alias("r"))
    met = kinds.where("c > 1").select("cell")
    whole = cells.where("single").join(met, "cell", "left_semi").select(
        "row", F.col("first").alias("lo"), (F.col("first") + F.length("bytes")).alias("hi")
    )
    one = kinds.select("r.row", "r.first", (F.col("r.single") & (F.col("c") == 1)).alias("own"), "r.bytes")
    windows = one.mapInArrow(run, "hash long, row long, lo int, own boolean")
    repeated = windows.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    some = windows.where("own").join(repeated, "hash", "left_semi")
    return whole.unionByName(some.select("row", "lo", (F.col("lo") + length).alias("hi")))


def repeated_spans(
    docs: DataFrame, steps: Steps, text: str = "text", length: int = 200, gram: int = 50,
    batches: int = 4,
) -> DataFrame:
    """(row, spans): for each row of `docs` that holds any, the byte ranges [lo, hi) covered by
    strings of `length` bytes that start anywhere else too. Rows of one `__row` have equal texts."""
    runs = steps.keep(sampled_suffixes(docs, text, length, gram, batches), "runs")
    index = SuffixIndex(steps)
    for batch in range(batches):
        index.add(runs.where(F.col("batch") == batch))
    array = index.merged()

    # Suffixes met twice or more: all their windows are repeated.
    again = array.where("times > 1").select("run")
    full = runs.join(again, "run", "left_semi").select(
        "row", F.col("start").alias("lo"), (F.col("start") + F.col("n") + length - 1).alias("hi")
    )
    # Suffixes with an anchor in common that differ further out: some windows may be repeated.
    groups = array.groupBy("anchor").agg(F.count("*").alias("members"), F.min("times").alias("t"))
    groups = groups.where("members > 1 and t = 1").select("anchor", "members")
    places = array.join(groups, "anchor").select(
        "place.row", F.struct("anchor", "run", "times", "members", "place.start", "place.n").alias("w")
    )
    by_row = places.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select(F.col(ROW).alias("row"), F.col(text).alias("text")).join(by_row, "row")
    cut = steps.keep(_cut(texts, length), "cut")
    small = cut.where(F.col("members") <= SMALL_GROUP).repartition("anchor").sortWithinPartitions("anchor")
    some = _compare_groups(small, length)
    large = _compare_windows(cut.where(F.col("members") > SMALL_GROUP), length)
    spans = full.unionByName(some).unionByName(large)
    return steps.keep(
        spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans"
    )


def _joined(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges (n x 2) as disjoint ranges that do not touch."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(new)
    return spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = 200, gram: int = 50, batches: int = 4,
    row: Column | str = "doc_id",
) -> DataFrame:
    """All columns of `docs` and `n_bytes`, `n_removed`, `n_spans`, `kept` (the remaining bytes).

    Removed is every byte of a string of `length` bytes that also starts anywhere else, in the same
    text or another; matches never cross texts and are judged on the input. Null is empty. Rows are
    told apart by a 64-bit hash of the column `row` (null and repeated values too) and the text; equal
    texts in two rows remove each other.
    `kept` is binary: a cut may divide a character. Columns of these names in `docs` are replaced.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    own_row = F.col(row) if isinstance(row, str) else row
    row_name, at_name, spans_name = (unused(docs.columns, n) for n in (ROW, "__at", "__spans"))
    columns = [c for c in docs.columns if c.lower() not in names]
    number = F.xxhash64(own_row, F.col(text))
    marked = docs.select(*[F.col(f"`{c}`") for c in columns], number.alias(row_name))
    schema = fields(marked.drop(row_name))
    steps = Steps(docs.sparkSession, "repeats")
    texts = marked.select(F.col(row_name).alias(ROW), F.col(text).alias("__text"))
    spans = repeated_spans(texts, steps, "__text", length, gram, batches)
    spans = spans.select(F.col("row").alias(at_name), F.col("spans").alias(spans_name))
    both = marked.join(spans, F.col(row_name) == F.col(at_name), "left").drop(row_name, at_name)
    at, where = both.columns.index(text), both.columns.index(spans_name)

    def run(parts) -> Iterator[pa.RecordBatch]:
        for part in parts:
            wanted = part.column(where)
            others = [part.column(k) for k in range(part.num_columns) if k != where]
            for chunk in chunks(part.column(at), TEXT_BYTES):
                sizes, gone, n, kept = [], [], [], []
                for i in range(len(chunk)):
                    own = chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]]
                    found = wanted[chunk.first + i]
                    sizes.append(len(own))
                    if not found.is_valid:
                        gone.append(0)
                        n.append(0)
                        kept.append(own.tobytes())
                        continue
                    flat = found.values
                    lo, hi = _joined(np.column_stack([
                        flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                    ]).astype(np.int64))
                    keep = np.ones(len(own), bool)
                    for a, b in zip(lo, hi, strict=True):
                        keep[a:b] = False
                    gone.append(int((hi - lo).sum()))
                    n.append(len(lo))
                    kept.append(own[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(chunk.first, len(chunk)) for c in others],
                     pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(kept, pa.binary())],
                    names=[*columns, *names],
                )

    return both.mapInArrow(
        run, schema + ", n_bytes long, n_removed long, n_spans long, kept binary"
    )

