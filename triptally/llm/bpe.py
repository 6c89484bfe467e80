"""Byte-level BPE in batches: merge rounds over one flat array, and back from ids to text.

Pretokens of a block of texts are told apart once; those not seen before go through merge rounds
together, as one flat array of symbols. A round looks up every neighbouring pair by binary search
among the sorted pair keys of the vocabulary and merges, in every word, all pairs of its lowest rank.
Words far longer than others would need as many rounds as they have ranks to merge, each over the
whole word; they are merged rank by rank over linked symbols instead, touching only what changes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from triptally.llm.arrays import CHUNK_BYTES, Chunk, chunks
from triptally.llm.tables import unused
from triptally.llm.tokens import pretokens

NONE = np.iinfo(np.int32).max  # the rank of a pair that does not merge
LONG = 2_048  # symbols of a word that is merged rank by rank
MOST_KNOWN = 400_000  # pretokens a worker remembers; beyond that it begins anew
MOST_IDS = 1 << 22  # ids it remembers for them


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next
    free code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in own}
    for b in sorted(set(range(256)) - set(own)):
        signs[chr(256 + len(signs) - len(own))] = b
    return signs


class Merges:
    """A byte-level BPE vocabulary as arrays; encodes words and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        model, cut, decoder = file["model"], file["pre_tokenizer"] or {}, file["decoder"] or {}
        plain = (
            model["type"] == "BPE" and cut.get("type") == decoder.get("type") == "ByteLevel"
            and not cut["add_prefix_space"] and cut["use_regex"] and not file["normalizer"]
            and not model["dropout"] and not model.get("ignore_merges")
        )
        odd = [t for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if not plain or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab, signs = model["vocab"], _byte_signs()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in file["added_tokens"])])
        self.first = np.zeros(256, np.int64)
        for sign, byte in signs.items():
            self.first[byte] = vocab[sign]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = np.append(made, 0)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # Whether no pair with the product of a merge ranks before the merge: only then may all
        # its occurrences in a word be merged in one round, as one after the other from the left.
        soonest = np.full(self.size, NONE, np.int64)
        rank = np.arange(len(pairs))
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        self.ordered = np.append(soonest[made] > rank, True)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        # Bytes of every id; an id without a token has none.
        tokens = [b""] * self.size
        for token, number in [*vocab.items(), *self.added.items()]:
            known = all(c in signs for c in token)
            tokens[number] = bytes(signs[c] for c in token) if known else token.encode()
        self.token_ends = np.cumsum([0, *map(len, tokens)])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search over the sorted pair keys."""
        if len(self.keys) == 0:
            return np.full(len(left), NONE, np.int32)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE).astype(np.int32)

    def merge_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words; word i has the bytes data[bounds[i]:bounds[i + 1]], none is empty."""
        sizes = np.diff(bounds)
        long = (sizes > LONG) & bool(self.ordered.all())
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word, its symbols in order)
        for i in np.flatnonzero(long):
            ids = self._by_rank(self.first[data[bounds[i] : bounds[i + 1]]])
            parts.append((np.full(len(ids), i), ids))
        word = np.repeat(np.arange(len(sizes)), sizes)
        short = ~long[word]
        word, symbols = word[short], self.first[data[short]]
        while len(word):
            rank = np.full(len(word), NONE, np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(word)])
            done = np.repeat(lowest == NONE, counts)
            if done.any():
                parts.append((word[done], symbols[done]))
                word, symbols, rank = word[~done], symbols[~done], rank[~done]
                counts, lowest = counts[lowest < NONE], lowest[lowest < NONE]
                starts = np.cumsum(counts) - counts
            hits = np.flatnonzero(rank == np.repeat(lowest, counts)) if len(word) else starts
            hits = self._apart(hits, hits[1:] == hits[:-1] + 1)
            late = ~self.ordered[rank[hits]]
            if late.any():  # only the leftmost of a word
                leftmost = np.r_[True, word[hits[1:]] != word[hits[:-1]]] if len(hits) else late
                hits = hits[~late | leftmost]
            symbols[hits] = self.made[rank[hits]]
            stays = np.ones(len(word), bool)
            stays[hits + 1] = False
            word, symbols = word[stays], symbols[stays]
        words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        ends = np.cumsum(np.bincount(words, minlength=len(sizes)))
        return ids[order].astype(np.uint32), np.r_[0, ends]

    @staticmethod
    def _apart(hits: np.ndarray, touches: np.ndarray) -> np.ndarray:
        """Of places where one pair stands, those that merge from the left: every second of a run
        (`touches`: the next place begins inside this pair)."""
        if not touches.any():
            return hits
        begins = np.r_[True, ~touches]
        number = np.arange(len(hits))
        since = number - np.maximum.accumulate(np.where(begins, number, 0))
        return hits[since % 2 == 0]

    def _by_rank(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of one long word: ranks in ascending order, every place of a rank at once. A merge
        makes pairs of later ranks only, so each rank comes up a few times at most."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            order = places[np.argsort(rank[places], kind="stable")]
            found = rank[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part in np.split(order, cuts) if len(order) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            places = self._apart(places, after[places[:-1]] == places[1:])
            gone = after[places]
            symbols[places] = self.made[r]
            rank[gone] = NONE
            symbols[gone] = -1
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places][inner]] = places[inner]
            left = before[places]
            changed = np.unique(np.concatenate([places, left[left >= 0]]))
            rank[changed] = NONE
            pair = changed[after[changed] < n]
            rank[pair] = self.rank(symbols[pair], symbols[after[pair]])
            wait(pair)
        return symbols[symbols >= 0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; ids that no token has are left out, bytes that are not UTF-8
        become U+FFFD."""
        known = (ids >= 0) & (ids < self.size)
        ids = np.where(known, ids, 0).astype(np.int64)
        starts = self.token_ends[ids]
        sizes = np.where(known, self.token_ends[ids + 1] - starts, 0)
        reach = np.r_[0, np.cumsum(sizes)]
        source = np.repeat(starts - reach[:-1], sizes) + np.arange(reach[-1])
        raw, cuts = self.token_bytes[source].tobytes(), reach[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Merges:
    """Read once per worker."""
    return Merges(path)


class Coder:
    """Encodes blocks of texts; keeps the ids of pretokens it has merged."""

    def __init__(self, merges: Merges):
        self.merges = merges
        # Of two added tokens at one place the longer counts.
        names = sorted(merges.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)).encode()) if names else None
        self._forget()

    def _forget(self) -> None:
        self.known = {name.encode(): i for i, name in enumerate(self.merges.added)}
        self.ids = np.fromiter(self.merges.added.values(), np.uint32)
        self.ends = np.arange(len(self.known) + 1)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number under which each word's ids are kept; new words are merged together."""
        if len(self.known) > MOST_KNOWN or len(self.ids) > MOST_IDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            data = np.frombuffer(b"".join(new), np.uint8)
            ids, bounds = self.merges.merge_words(data, np.r_[0, np.cumsum(sizes)])
            for number, w in enumerate(new, len(self.known)):
                self.known[w] = number
            self.ends = np.concatenate([self.ends, self.ends[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def _cuts(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(places, where an added token begins): ends of texts, ends of added tokens, and in long
        texts a blank after a letter or digit every now and then. Pretokens cross none of them."""
        spans = []
        if self.special is not None:
            raw, ends = chunk.data.tobytes(), chunk.bounds.tolist()
            for start, end in zip(ends, ends[1:], strict=False):
                spans += [hit.span() for hit in self.special.finditer(raw, start, end)]
        tokens = np.array(spans, np.int64).reshape(-1, 2)
        places = [chunk.bounds, tokens.ravel()]
        if len(chunk.data) > 2 * CHUNK_BYTES:
            data = chunk.data
            sign = (data[:-1] | 0x20) - np.uint8(ord("a")) < 26
            blank = np.flatnonzero((data[1:] == 0x20) & sign) + 1
            steps = np.searchsorted(blank, np.arange(CHUNK_BYTES, len(data), CHUNK_BYTES))
            far = blank[steps[steps < len(blank)]]
            # Not within an added token.
            places.append(far[np.searchsorted(tokens[:, 0], far) == np.searchsorted(tokens[:, 1], far, "right")])
        return np.unique(np.concatenate(places)), tokens[:, 0]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a chunk; text i has ids[bounds[i]:bounds[i + 1]]."""
        cuts, tokens = self._cuts(chunk)
        found, at, total, i = [], np.zeros(len(cuts), np.int64), 0, 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK_BYTES, "right")) - 1)
            ids, ends = self._block(chunk.data, cuts[i : j + 1], tokens)
            found.append(ids)
            at[i + 1 : j + 1] = total + ends
            total += len(ids)
            i = j
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return ids, at[np.searchsorted(cuts, chunk.bounds)]

    def _block(self, data: np.ndarray, cuts: np.ndarray, tokens: np.ndarray):
        """(ids, how many of them end at each cut but the first) of data[cuts[0]:cuts[-1]]."""
        data = np.ascontiguousarray(data[cuts[0] : cuts[-1]])
        tokens, cuts = tokens - cuts[0], cuts - cuts[0]
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = lead[pretokens(codes, np.searchsorted(lead, cuts))]
        if len(tokens):  # an added token is one pretoken
            within = np.searchsorted(cuts, begin, "right") - 1
            keep = ~np.isin(cuts[within], tokens) | (begin == cuts[within])
            begin = begin[keep]
        offsets = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, offsets, pa.py_buffer(data)])
        coded = words.dictionary_encode()
        which = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        reach = np.r_[0, np.cumsum(sizes)]
        source = np.repeat(starts - reach[:-1], sizes) + np.arange(reach[-1])
        return self.ids[source], reach[np.searchsorted(begin, cuts[1:])]


def _vocabulary_path(tokenizer: str, path: str | None) -> str:
    return path or public_tokenizers.path(f"{tokenizer}.json")


def encode(
    docs: DataFrame, text: str = "text", into: str = "ids", tokenizer: str = "byte_bpe_50k",
    path: str | None = None, packed: bool = False,
) -> DataFrame:
    """All columns of `docs` with `into`, the ids of each text: an array of ints or, if `packed`,
    little-endian unsigned 32-bit integers in one binary value.

    Ids equal those of the tokenizers library without special tokens added around a text; strings of
    added tokens inside a text are those tokens. Null and empty texts have no ids (an empty list).
    Rows keep their order within a partition and repeated rows stay; an empty table gives no rows.
    A column of `docs` already called `into` (in any case) is replaced.
    """
    own = _vocabulary_path(tokenizer, path)
    rest = [c for c in docs.columns if c.lower() != into.lower()]
    hidden = unused(docs.columns, "__text")
    frame = docs.select(docs[text].cast("string").alias(hidden), *rest)
    kind = BinaryType() if packed else ArrayType(IntegerType(), False)
    schema = StructType([*frame.schema.fields[1:], StructField(into, kind, False)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary(own))
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                ids, bounds = coder.encode(chunk)
                if packed:
                    raw, ends = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                    values = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                    column = pa.array(values, pa.binary())
                else:
                    column = pa.ListArray.from_arrays(
                        pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))
                    )
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], column], names=schema.names)

    return frame.mapInArrow(run, schema)


def decode(
    frame: DataFrame, ids: str = "ids", into: str = "text", tokenizer: str = "byte_bpe_50k",
    path: str | None = None,
) -> DataFrame:
    """All columns of `frame` with `into`, the text of its `ids` (an array, or packed as by `encode`).

    Null or no ids give the empty text. Ids outside the vocabulary and null ids are left out, and
    bytes that are not UTF-8 become U+FFFD, as in the tokenizers library. A column already called
    `into` (in any case) is replaced.
    """
    own = _vocabulary_path(tokenizer, path)
    packed = isinstance(frame.schema[ids].dataType, BinaryType)
    rest = [c for c in frame.columns if c.lower() != into.lower()]
    hidden = unused(frame.columns, "__ids")
    source = frame[ids] if packed else frame[ids].cast("array<long>")
    taken = frame.select(source.alias(hidden), *rest)
    schema = StructType([*taken.schema.fields[1:], StructField(into, StringType(), False)])

    def run(batches) -> Iterator[pa.RecordBatch]:
        merges = vocabulary(own)
        for batch in batches:
            part = batch.column(0)
            if packed:
                pieces = chunks(part)
            else:
                rows = part.fill_null([]) if part.null_count else part
                flat = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(pa.compute.list_value_length(rows).to_numpy())]
                pieces = _runs(flat, ends)
            for piece in pieces:
                if packed:
                    texts = merges.decode(np.frombuffer(piece.data, "<u4"), piece.bounds // 4)
                else:
                    texts = merges.decode(piece.data, piece.bounds)
                beside = batch.slice(piece.first, len(piece)).columns[1:]
                column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*beside, column], names=schema.names)

    return taken.mapInArrow(run, schema)


def _runs(flat: np.ndarray, ends: np.ndarray) -> Iterator[Chunk]:
    """Lists of ids in runs of bounded size."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_BYTES // 4, "right")) - 1)
        yield Chunk(i, j, flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j
