"""Conversations as training texts, assembled column by column into one Arrow buffer.

A turn is written `### role: text</turn>` and a line feed. Inside roles and texts a backslash goes
before every backslash and every place where a control string begins, so that the turns can be read
back exactly. The loss mask covers the texts of the roles that are learnt.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, TAIL = b"### ", b": ", b"</turn>\n"
_CONTROL = (b"###", b"</turn>")
PART_BYTES = 16 << 20  # a longer conversation is given in several parts, whole turns each


def _starts(data: np.ndarray, word: bytes) -> np.ndarray:
    """Whether the word begins at each byte."""
    hit = np.zeros(len(data), bool)
    if len(data) >= len(word):
        n = len(data) - len(word) + 1
        here = data[:n] == word[0]
        for j in range(1, len(word)):
            here = here & (data[j : n + j] == word[j])
        hit[:n] = here
    return hit


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where its values begin and end."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _escaped(data: np.ndarray, bounds: np.ndarray, more: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The same column with a backslash before what must be escaped."""
    hit = data == ord("\\")
    for word in (*_CONTROL, *(bytes([c]) for c in more)):
        at = np.flatnonzero(_starts(data, word))
        # What begins in one value and ends in the next is none.
        hit[at[at + len(word) <= bounds[np.searchsorted(bounds, at, "right")]]] = True
    shift = np.cumsum(hit)
    out = np.empty(len(data) + int(hit.sum()), np.uint8)
    to = np.arange(len(data)) + shift
    out[to] = data
    out[to[hit] - 1] = ord("\\")
    before = np.concatenate([[0], shift])
    return out, bounds + before[bounds]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
    """Copies value i of a column to out[at[i]:]."""
    sizes = np.diff(bounds)
    out[np.repeat(at - bounds[:-1], sizes) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array, learnt: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(buffer, turn bounds, mask begins, mask ends) of the formatted turns of a batch.

    Lengths of all segments give offsets by one cumulative sum; headers, roles, texts and tails are
    then copied to their places in a buffer allocated once.
    """
    n = len(roles)
    role, role_bounds = _escaped(*_column(roles), more=b":")
    text, text_bounds = _escaped(*_column(texts))
    sizes = np.column_stack([
        np.full(n, len(HEAD)), np.diff(role_bounds), np.full(n, len(AFTER_ROLE)),
        np.diff(text_bounds), np.full(n, len(TAIL)),
    ])
    ends = np.cumsum(sizes.reshape(-1)).reshape(n, 5)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, word in ((0, HEAD), (2, AFTER_ROLE), (4, TAIL)):
        out[begins[:, column, None] + np.arange(len(word))] = np.frombuffer(word, np.uint8)
    _scatter(out, begins[:, 1], role, role_bounds)
    _scatter(out, begins[:, 3], text, text_bounds)
    turns = np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64)
    own = pc.fill_null(pc.is_in(roles, pa.array(learnt, pa.string())), False)
    masked = own.to_numpy(zero_copy_only=False)
    return out, turns, np.where(masked, begins[:, 3], -1), np.where(masked, ends[:, 3], -1)


def format_chats(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
    text: str = "text", learnt: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(key, part, n_turns, formatted, mask): `mask` lists the bytes [lo, hi) of `formatted` to learn.

    Turns go by `order`, then role and text, so equal numbers and repeated rows have one defined
    order; nulls come first and are empty. Rows are brought together by a sort, not a list: a task
    holds one batch, and a conversation of any length comes in parts of about `PART_BYTES`, with
    number `part` from 0. Rows without a key are one conversation.
    """
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(
        F.col(key).alias("k"), F.col(role).alias("r"), F.col(text).alias("t"), F.col(order).alias("o")
    )
    dealt = rows.repartition("k").sortWithinPartitions("k", "o", "r", "t").select("k", "r", "t")
    mask = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        none = object()
        now, part, n, held, spans, size = none, 0, 0, [], [], 0

        def rows(ready):
            columns = list(zip(*ready, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.binary()).cast(pa.string()), pa.array(columns[4], mask)],
                names=[key, "part", "n_turns", "formatted", "mask"],
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            out, bounds, lo, hi = assemble(batch.column(1), batch.column(2), learnt)
            change = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            ready: list[tuple] = []
            for a, b in zip(change, change[1:], strict=False):
                if now is none or keys[a] != now or size > PART_BYTES:
                    if now is not none:
                        ready.append((now, part, n, b"".join(held), spans))
                    part = part + 1 if now is not none and keys[a] == now else 0
                    now, n, held, spans, size = keys[a], 0, [], [], 0
                base = size - int(bounds[a])
                held.append(out[bounds[a] : bounds[b]].tobytes())
                size += int(bounds[b] - bounds[a])
                n += b - a
                spans += [
                    {"lo": int(x) + base, "hi": int(y) + base}
                    for x, y in zip(lo[a:b], hi[a:b], strict=True) if x >= 0
                ]
            if ready:
                yield rows(ready)
        if now is not none:
            yield rows([(now, part, n, b"".join(held), spans)])

    return dealt.mapInArrow(
        run,
        f"`{key}` {kind}, part int, n_turns long, formatted string, mask array<struct<lo:long,hi:long>>",
    )


# Possessive: nothing is remembered for each character of a long turn.
_TURN = re.compile(
    rb"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL
)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def unescape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", text)


def read_back(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of every turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn begins at byte {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def chat_digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of conversations read back from `format_chats`, which gives the parts of one
    conversation one after the other in one task: (key, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars)."""
    kind = chats.schema[key].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        open_ = None  # (key, turns, digest, loss characters, loss digest, characters)

        def closed(o):
            return (o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5])

        for batch in batches:
            done = []
            for k, part, formatted, mask in zip(
                *[batch.column(c).to_pylist() for c in (0, 1, 3, 4)], strict=True
            ):
                if part == 0:
                    if open_ is not None:
                        done.append(closed(open_))
                    open_ = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = formatted.encode()
                for role, text in read_back(raw):
                    open_[1] += 1
                    open_[2].update(role + b"\n" + text + b"\n")
                for span in mask:
                    learnt = unescape(raw[span["lo"] : span["hi"]])
                    open_[3] += len(learnt.decode())
                    open_[4].update(learnt)
                open_[5] += len(formatted)
            if done:
                yield _batch(done, batch.column(0).type)
        if open_ is not None:
            yield _batch([closed(open_)], key_type(kind))

    def key_type(name: str) -> pa.DataType:
        return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]

    def _batch(rows: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )

    return chats.mapInArrow(
        run,
        f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
