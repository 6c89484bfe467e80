"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries only the best
score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from triptally.llm.arrays import chunks
from triptally.llm.tables import fields

BLANK = "▁"
PENALTY = 10.0  # by which an unknown character is worse than the worst piece (the library's value)
MOST_KNOWN = 500_000  # words a task remembers; beyond that it begins anew


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores; `byte_fallback`: an unknown character counts as its UTF-8 bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_fallback: bool = True


def read_vocabulary(path: str | None = None) -> Vocabulary:
    """The ordinary pieces of a sentencepiece file with their scores. Control and byte pieces never
    match a text."""
    model = sentencepiece.SentencePieceProcessor(
        model_file=path or public_tokenizers.path("piece_bpe_32k.model")
    )
    own = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in own), tuple(float(model.get_score(i)) for i in own)
    )


class Counter:
    """Counts pieces of texts. Blanks are written as `BLANK`; a text that does not begin with one
    gets one."""

    def __init__(self, vocabulary: Vocabulary):
        self.scores = dict(zip(vocabulary.pieces, vocabulary.scores, strict=True))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # The library looks for the worst score over the whole vocabulary.
        self.unknown = min(vocabulary.scores, default=0.0) - PENALTY
        self.byte_fallback = vocabulary.byte_fallback
        self.known: dict[str, int] = {}
        # A piece never goes over these places, so words can be counted one by one.
        self.cuts_at_blank = not any(
            BLANK in p.lstrip(BLANK) for p in self.scores
        )
        self.cuts_at_line = not any("\n" in p for p in self.scores)

    def best(self, text: str) -> int:
        """The number of pieces of the best path. Of paths with equal scores into one place the one
        whose last piece begins first is kept, as by the library."""
        n = len(text)
        score = [0.0] + [-np.inf] * n
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)  # whether the best path ends with an unknown character
        single = [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, value) in self.automaton.iter(text):
            found[last + 1].append((length, value))
            if length == 1:
                single[last] = True
        for end in range(1, n + 1):
            best, count, plain = -np.inf, 0, False
            for length, value in sorted(found[end], reverse=True):
                start = end - length
                if score[start] + value > best:
                    best, count, plain = score[start] + value, pieces[start] + 1, False
            if not single[end - 1]:
                if score[end - 1] + self.unknown > best:
                    best, plain = score[end - 1] + self.unknown, True
                    if self.byte_fallback:
                        count = pieces[end - 1] + len(text[end - 1].encode())
                    else:
                        # Unknown characters side by side are one piece.
                        count = pieces[end - 1] + (0 if unknown[end - 1] else 1)
            score[end], pieces[end], unknown[end] = best, count, plain
        return pieces[n]

    def _word(self, word: str) -> int:
        count = self.known.get(word)
        if count is None:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            count = self.known[word] = self.best(word)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        if not text.startswith(BLANK):
            text = BLANK + text
        if not (self.cuts_at_blank and self.byte_fallback):
            return self.best(text)
        total = 0
        lines = text.split("\n") if self.cuts_at_line else [text]
        total += len(lines) - 1  # a line feed no piece has is one byte
        known = self.known
        for line in lines:
            if not line:
                continue
            words = line.split(BLANK)
            if words[0]:
                total += self._word(words[0])
            if "" in words[1:]:
                total += self._runs(words[1:])
                continue
            for word in words[1:]:
                word = BLANK + word
                count = known.get(word)
                total += self._word(word) if count is None else count
        return total

    def _runs(self, words: list[str]) -> int:
        """Words each behind one blank; empty ones lengthen the blanks of the next."""
        total, blanks = 0, ""
        for word in words:
            blanks += BLANK
            if word:
                total += self._word(blanks + word)
                blanks = ""
        return total + (self._word(blanks) if blanks else 0)


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", column: str = "n_tokens"
) -> DataFrame:
    """All columns of `docs` and the number of tokens of each whole text; null and empty texts have
    none. A column of that name is replaced. The vocabulary, a file of fixed size, goes to every task.
    """
    docs = docs.drop(column)
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = fields(docs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            counts = []
            for chunk in chunks(batch.column(at)):
                raw = chunk.data.tobytes()
                counts += [
                    counter.count(raw[a:b].decode())
                    for a, b in zip(chunk.bounds, chunk.bounds[1:], strict=False)
                ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, column]
            )

    return docs.mapInArrow(run, f"{schema}, `{column}` long")
