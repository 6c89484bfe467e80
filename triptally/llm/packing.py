"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptally.llm.arrays import chunks
from triptally.llm.tables import Steps, fields
from triptally.llm.tokens import Encoder, as_bytes

GROUP = 16_000  # pieces packed together in one task


def pieces(
    docs: DataFrame, capacity: int, end_id: int, key: str = "doc_id", text: str = "text",
    tokenizer: str = "byte_bpe_50k", path: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the ids of each document and `end_id`, in pieces
    of `capacity`; the first piece takes what is left over. Null texts are empty: one piece of one id.
    """
    kind = docs.schema[key].dataType.simpleString()
    own = path or public_tokenizers.path(f"{tokenizer}.json")
    ranks = own.removesuffix(".json") + ".tiktoken"
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(own, ranks)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids, bounds = encoder.encode(chunk)
                columns: list[list] = [[] for _ in range(6)]
                for i in range(len(chunk)):
                    raw = as_bytes(np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = raw[4 * a : 4 * b]
                        values = (i, piece, a, b - a, zlib.crc32(part), part)
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                arrays = [
                    batch.column(0).take(pa.array([chunk.first + i for i in columns[0]], pa.int64())),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[2:5]],
                ]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(columns[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(key, text).mapInArrow(run, schema + (", ids binary" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, bins as few as matching and best fit give.

    Items above a third of the capacity pair at most twice in a bin: from the longest on, each is
    matched with the longest that still fits beside it. All others, from the longest on, go to the
    bin with the smallest gap that holds them, or to a new one.
    """
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        by_size[lengths[i]].append(int(i))
    bins = np.full(len(lengths), -1, np.int64)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = np.zeros(capacity + 1, bool)
    n = 0

    def put(item: int, bin_: int, gap: int) -> None:
        bins[item] = bin_
        if gap:
            gaps[gap].append(bin_)
            open_gaps[gap] = True

    large = capacity // 3 + 1
    present = np.array([bool(s) for s in by_size])
    for size in range(capacity, large - 1, -1):
        while by_size[size]:
            item = by_size[size].pop()
            present[size] = bool(by_size[size])
            room = capacity - size
            partner = -1
            if room >= large:
                fits = np.flatnonzero(present[large : room + 1])
                if len(fits):
                    partner = large + int(fits[-1])
            if partner < 0:
                put(item, n, room)
            else:
                other = by_size[partner].pop()
                present[partner] = bool(by_size[partner])
                bins[other] = n
                put(item, n, room - partner)
            n += 1
    for size in range(large - 1, 0, -1):
        for item in by_size[size]:
            fits = np.flatnonzero(open_gaps[size:])
            if len(fits):
                gap = size + int(fits[0])
                bin_ = gaps[gap].pop()
                open_gaps[gap] = bool(gaps[gap])
                put(item, bin_, gap - size)
            else:
                put(item, n, capacity - size)
                n += 1
    return bins


def pack(pieces_: DataFrame, steps: Steps, capacity: int, key: str = "doc_id") -> DataFrame:
    """The pieces with `sequence_id` and `offset`.

    Full pieces are sequences of their own. The others are dealt by a hash into groups of about
    `GROUP` pieces, each packed in one task; a group leaves at most a few sequences unfilled, a small
    share of its thousands. Numbers of sequences are unique, but not consecutive.
    """
    whole = F.col("length") == capacity
    n = pieces_.where(~whole).count()
    groups = max(1, -(-n // GROUP))
    full = pieces_.where(whole).select(
        "*",
        (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    dealt = pieces_.where(~whole).withColumn(
        "__group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups))
    )
    schema = fields(pieces_)

    def run(group: pa.Table) -> pa.Table:
        # In Arrow: a column of whole numbers stays exact beside nulls.
        order = [(key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order)
        lengths = group.column("length").to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.lexsort((-lengths, bins))
        sorted_bins, sizes = bins[order], lengths[order]
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.r_[True, sorted_bins[1:] != sorted_bins[:-1]])
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(order)]))
        number = group.column("__group")[0].as_py()
        packed = group.drop_columns("__group").append_column("offset", pa.array(offset))
        return packed.append_column("sequence_id", pa.array(number * (1 << 32) + bins))

    packed = dealt.groupBy("__group").applyInArrow(run, schema + ", offset long, sequence_id long")
    return full.unionByName(packed)


def pack_documents(
    docs: DataFrame, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
    tokenizer: str = "byte_bpe_50k", path: str | None = None,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are pieces of one id. Rows with equal keys are packed each on its own.
    An empty table gives no rows. The tokenizer's file and its ranks lie side by side under `path`.
    """
    steps = Steps(docs.sparkSession, "packing")
    found = steps.keep(pieces(docs, capacity, end_id, key, text, tokenizer, path), "pieces")
    return pack(found, steps, capacity, key)
