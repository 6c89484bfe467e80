"""Byte-level BPE ids of many texts at once.

Texts are cut into pretokens with numpy, by the rules of the tokenizer's pattern; each different
pretoken is encoded once per task and its ids are copied to wherever it occurs.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from triptally.llm.arrays import U64, Chunk, mix, powers

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_STEP = 0xE7037ED1A0B428DB
_INVERSE = pow(_STEP, -1, 1 << 64)
_ODD = U64(0x9E3779B97F4A7C15)
MOST_KNOWN = 400_000  # pretokens a task remembers; beyond that it begins anew


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = LETTER
        elif kind[0] == "N":
            table[code] = NUMBER
        elif kind == "Cn" and code < 0x40000:
            unknown.append(code)
    # Code points newer than Python's tables: the tokenizers library says what joins a letter or number.
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for kind, probe in ((LETTER, "a"), (NUMBER, "1")):
        found = cut.pre_tokenize_str("".join(f"{probe}{chr(c)}#" for c in unknown))
        starts = np.array([span[0] for _, span in found])
        joined = ~np.isin(np.arange(len(unknown)) * 3 + 1, starts)
        table[np.array(unknown)[joined]] = kind
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return table


def pretokens(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pretokens begin in code points of several texts (bounds: where each begins, and the end).

    A run of letters, numbers or other signs takes one blank before it; white space before something
    else leaves its last character to stand alone or, if a blank, to go with what follows. `'s 't 're
    've 'm 'll 'd` are pretokens of their own where an apostrophe begins one.
    """
    n = len(codes)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= edge
    blank = codes == 0x20
    space = kind == SPACE
    # A run of other kind right after a blank of the same text begins with the blank.
    absorbed = np.zeros(n + 1, bool)
    absorbed[1:n] = start[1:n] & ~edge[1:n] & blank[:-1] & ~space[1:]
    # The last white-space character before something else in the same text begins a pretoken.
    last = np.zeros(n + 1, bool)
    last[: n - 1] = space[:-1] & start[1:n] & ~edge[1:n] & ~space[1:] if n > 1 else False
    start = (start & ~absorbed) | last
    # Contractions.
    for at in np.flatnonzero((codes == 0x27) & start[:n]):
        text_end = bounds[np.searchsorted(bounds, at, "right")]
        for tail in _TAILS:
            end = at + 1 + len(tail)
            if end <= text_end and np.array_equal(codes[at + 1 : end], tail):
                start[at + 1 : end] = False
                start[end] = True
                break
    return np.flatnonzero(start[:n])


_TAILS = [np.array([ord(c) for c in t], np.uint32) for t in ("s", "t", "re", "ve", "m", "ll", "d")]


class Encoder:
    """Ids of the texts of chunks, equal to those of the tokenizers library for the given file."""

    def __init__(self, path: str, ranks_path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.bpe = tiktoken.Encoding(
            "pretokens", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of the ids of each known pretoken
        self.used = 0

    def _learn(self, name: int, pretoken: str) -> int:
        ids = self.bpe.encode_ordinary(pretoken)
        number = len(self.known)
        if number >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.ends[number] = self.used
        self.known[name] = number
        return number

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts of a chunk; text i has ids[bounds[i]:bounds[i + 1]]."""
        if len(self.known) > MOST_KNOWN:
            self._forget()
        raw = chunk.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(chunk.bounds, chunk.bounds[1:], strict=False)]
        if any(s.encode() in raw for s in self.special):
            return self._whole(texts)
        joined = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = pretokens(codes, bounds)
        end = np.append(begin[1:], len(codes))
        total = np.zeros(len(codes) + 1, U64)
        spread = mix(codes.astype(U64) * _ODD + U64(1))
        np.cumsum(spread * powers(_STEP, len(codes)), out=total[1:])
        moved = (total[end] - total[begin]) * powers(_INVERSE, len(codes))[begin]
        names = mix(moved + (end - begin).astype(U64) * _ODD)
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        numbers = np.empty(len(distinct), np.int64)
        for i, name in enumerate(distinct.tolist()):
            number = self.known.get(name)
            if number is None:
                at = first[i]
                number = self._learn(name, joined[begin[at] : end[at]])
            numbers[i] = number
        which = numbers[inverse]
        starts = np.where(which > 0, self.ends[which - 1], 0)
        counts = self.ends[which] - starts
        reach = np.cumsum(counts)
        total_ids = int(reach[-1])
        source = np.repeat(starts - (reach - counts), counts) + np.arange(total_ids)
        by_text = np.concatenate([[0], reach])[np.searchsorted(begin, bounds)]
        return self.ids[source], by_text

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with strings of special tokens, as the library takes them."""
        ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        return np.array([x for i in ids for x in i], np.uint32), bounds


def as_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()
