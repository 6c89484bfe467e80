"""Benchmark decontamination: rare n-grams find candidates, local alignment decides.

The n-grams of the test items are counted over all documents in a first pass. In a second pass the
rare ones are seeds: where a text holds several seeds of one item close together, the passage is
aligned with the item word by word (Smith-Waterman), so that edited and paraphrased copies count too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptally.llm.arrays import U64, Chunk, Words, chunks, gram_hashes, words
from triptally.llm.tables import fields

MATCH, MISMATCH, GAP = 2, -1, -1  # alignment scores per word
REMEMBERED = 64 << 20  # bytes of passages whose alignments a task remembers


@dataclass(frozen=True)
class LeakRule:
    gram: int = 3  # words of a seed
    seeds: int = 2  # different seeds of one item that make a candidate
    common: int = 20  # a gram found this many times as often as the item's median gram is no seed
    floor: int = 50  # and in more documents than this
    score: float = 0.5  # least alignment score, as a share of the item's own
    words: int = 50  # or the alignment score of so many equal words, however long the item is
    block: int = 200_000  # words of test items handled at once; more items are read in blocks


@dataclass
class Items:
    """A block of test items as word hashes, item i having words firsts[i]..firsts[i + 1]."""

    ids: list[int]
    words: np.ndarray
    firsts: np.ndarray
    grams: np.ndarray  # sorted distinct hashes of seeds (or of all grams, before counting)
    item: np.ndarray  # postings: item and position of each seed, in runs per gram
    position: np.ndarray
    bounds: np.ndarray  # postings of gram g are bounds[g]..bounds[g + 1]
    flags: np.ndarray  # which 16-bit heads of hashes occur

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram number) of the hashes that are seeds."""
        at = np.flatnonzero(self.flags[(hashes >> U64(44)).astype(np.int64)])
        if len(at) == 0 or len(self.grams) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.searchsorted(self.grams, hashes[at])
        number[number == len(self.grams)] = 0
        good = self.grams[number] == hashes[at]
        return at[good], number[good]


def content_words(chunk: Chunk) -> Words:
    """Words without ASCII punctuation at either end, which edits and quoting often change."""
    return words(Chunk(chunk.first, chunk.last, _PLAIN[chunk.data], chunk.bounds))


_PLAIN = np.arange(256, dtype=np.uint8)
for _mark in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PLAIN[_mark] = 0x20


def _postings(ids, hashes, firsts, gram: int, allowed: np.ndarray | None) -> Items:
    grams = gram_hashes(hashes, gram)
    item = np.repeat(np.arange(len(ids)), np.diff(firsts))[: len(grams)]
    position = np.arange(len(grams)) - firsts[:-1][item]
    inside = position + gram <= np.diff(firsts)[item]
    grams, item, position = grams[inside], item[inside], position[inside]
    if allowed is not None:
        keep = allowed[inside]
        grams, item, position = grams[keep], item[keep], position[keep]
    order = np.argsort(grams, kind="stable")
    grams, item, position = grams[order], item[order], position[order]
    distinct, begin = np.unique(grams, return_index=True)
    flags = np.zeros(1 << 20, bool)
    flags[(distinct >> U64(44)).astype(np.int64)] = True
    return Items(ids, hashes, firsts, distinct, item, position, np.append(begin, len(grams)), flags)


def _read_items(rows: list[tuple], gram: int) -> Items:
    column = pa.array([t for _, t in rows], pa.string())
    whole = next(chunks(column, 1 << 62))
    found = content_words(whole)
    return _postings([i for i, _ in rows], found.hashes, found.firsts, gram, None)


def _document_counts(docs: DataFrame, text: str, items: Items, gram: int) -> dict[int, int]:
    """In how many documents each gram of the items occurs; counted in tasks, summed by a shuffle of
    one row per gram and task. The result has at most one entry per gram of the block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                found = content_words(chunk)
                at, number = items.find(gram_hashes(found.hashes, gram))
                if len(at):
                    row = np.searchsorted(found.firsts, at, "right") - 1
                    inside = at + gram <= found.firsts[row + 1]
                    once = np.unique(row[inside] * len(counts) + number[inside])
                    counts += np.bincount(once % len(counts), minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["g", "n"])

    found = docs.select(text).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n"))
    return {r[0]: r[1] for r in found.collect()}


def rare_seeds(items: Items, counts: dict[int, int], rule: LeakRule) -> Items:
    """The items with their rare grams only. A gram is common if far more documents hold it than the
    item's median gram, so an item that leaked very often keeps its seeds."""
    grams = gram_hashes(items.words, rule.gram)
    number = np.searchsorted(items.grams, grams)
    number[number == len(items.grams)] = 0
    by_number = np.zeros(max(len(items.grams), 1), np.int64)
    for g, n in counts.items():
        by_number[g] = n
    allowed = np.zeros(len(grams), bool)
    for i in range(len(items.ids)):
        a, b = items.firsts[i], items.firsts[i + 1] - rule.gram + 1
        if b > a:
            held = by_number[number[a:b]]
            allowed[a:b] = held <= max(rule.floor, rule.common * float(np.median(held)))
    return _postings(items.ids, items.words, items.firsts, rule.gram, allowed)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last + 1) of the best local alignment of an item's words in a passage."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = row + GAP
        new, source = np.zeros(n + 1, np.int64), np.arange(n + 1)
        better = diagonal > up[1:]
        new[1:] = np.where(better, diagonal, up[1:])
        source[1:] = np.where(better, origin[:-1], origin[1:])
        fresh = new <= 0
        new[fresh] = 0
        source[fresh] = np.flatnonzero(fresh)
        # Gaps in the item: the best value to the left less its distance.
        reach = np.maximum.accumulate(new + steps)
        holder = np.maximum.accumulate(np.where(new + steps == reach, np.arange(n + 1), 0))
        row = reach - steps
        origin = source[holder]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top]), top)
    return best


def _candidates(at, row, number, items: Items, rule: LeakRule) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first, last): where `rule.seeds` different seeds of an item lie within its length;
    overlapping places are one."""
    counts = np.diff(items.bounds)[number]
    hit = np.repeat(np.arange(len(at)), counts)
    slot = np.repeat(items.bounds[number] - np.cumsum(counts) + counts, counts) + np.arange(len(hit))
    item, position = items.item[slot], items.position[slot]
    place, of = at[hit], row[hit]
    order = np.lexsort((place, item, of))
    item, position, place, of = item[order], position[order], place[order], of[order]
    length = np.diff(items.firsts)[item]
    new = np.ones(len(item), bool)
    new[1:] = (
        (of[1:] != of[:-1]) | (item[1:] != item[:-1])
        | (place[1:] - place[:-1] > length[1:])
    )
    begin = np.flatnonzero(new)
    for a, b in zip(begin, np.append(begin[1:], len(item)), strict=True):
        size = int(length[a])
        grams = size - rule.gram + 1
        if len(set(position[a:b].tolist())) >= min(rule.seeds, grams):
            yield int(of[a]), int(item[a]), int(place[a]) - size, int(place[b - 1]) + size + rule.gram


def _passages(chunk: Chunk, items: Items, rule: LeakRule, known: dict) -> Iterator[tuple]:
    """(row, item number, score, first byte, last byte + 1) of every leaked passage of a chunk."""
    found = content_words(chunk)
    at, number = items.find(gram_hashes(found.hashes, rule.gram))
    if len(at) == 0:
        return
    row = np.searchsorted(found.firsts, at, "right") - 1
    inside = at + rule.gram <= found.firsts[row + 1]
    at, row, number = at[inside], row[inside], number[inside]
    for r, i, first, last in _candidates(at, row, number, items, rule):
        first, last = max(first, found.firsts[r]), min(last, found.firsts[r + 1])
        passage = found.hashes[first:last]
        own = items.words[items.firsts[i] : items.firsts[i + 1]]
        key = (i, passage.tobytes()) if len(passage) <= 4096 else None
        result = known.get(key) if key else None
        if result is None:
            result = align(own, passage)
            if key:
                if known.get("bytes", 0) > REMEMBERED:
                    known.clear()
                known[key] = result
                known["bytes"] = known.get("bytes", 0) + len(key[1])
        score = result[0] / (MATCH * len(own))
        if score >= rule.score or result[0] >= MATCH * rule.words:
            a, b = first + result[1], first + result[2] - 1
            base = chunk.bounds[r]
            yield r, i, score, int(found.starts[a] - base), int(found.ends[b] - base)


def _blocks(benchmark: DataFrame, item: str, text: str, rule: LeakRule) -> Iterator[list[tuple]]:
    """Test items in blocks of bounded size: a block is what tasks get as broadcast data. Nulls and
    items of fewer words than a seed are never found."""
    sized = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text)
    total = sized.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // (6 * rule.block)) or 1
    for k in range(n):
        part = sized.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k).distinct()
        yield sorted((r[0], r[1]) for r in part.collect())


def _prepared(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str,
              rule: LeakRule) -> list[Items]:
    prepared = []
    for rows in _blocks(benchmark, item, item_text, rule):
        if rows:
            items = _read_items(rows, rule.gram)
            if len(items.grams):
                counts = _document_counts(docs, text, items, rule.gram)
                prepared.append(rare_seeds(items, counts, rule))
    return prepared


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", rule: LeakRule = LeakRule(),
) -> DataFrame:
    """(key, item, score, first, last): the best-aligned passage of each document and test item whose
    score reaches `rule.score`, or is that of `rule.words` equal words, in bytes of the text.

    Words are lower-cased A-Z and end at white space and ASCII punctuation. The score is the local
    alignment score over that of the whole item; a passage from a long item may have a small one. Null and empty texts hold no passage. A document
    that repeats an item has one row for it, the best and first; repeated rows give repeated rows.
    Both passes read the texts where they lie; nothing of them is shuffled but the results.
    """
    kind, item_kind = (f.schema[c].dataType.simpleString()
                       for f, c in ((docs, key), (benchmark, item)))
    schema = f"`{key}` {kind}, `{item}` {item_kind}, score double, first long, last long"
    result = None
    for items in _prepared(docs, benchmark, text, item, item_text, rule):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                ids = batch.column(0)
                for chunk in chunks(batch.column(1)):
                    best: dict = {}
                    for r, i, score, first, last in _passages(chunk, sent.value, rule, known):
                        if (r, i) not in best or score > best[r, i][0]:
                            best[r, i] = (score, first, last)
                    if best:
                        rows = pa.array([r + chunk.first for r, _ in best])
                        columns = [ids.take(rows), pa.array([sent.value.ids[i] for _, i in best])]
                        columns += [pa.array(c) for c in zip(*best.values(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            columns, names=[key, item, "score", "first", "last"]
                        )

        part = docs.select(key, text).mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", rule: LeakRule = LeakRule(),
) -> DataFrame:
    """The rows of `docs` that hold no passage of a test item; columns stay as they are."""
    at = docs.columns.index(text)
    schema = fields(docs)
    for items in _prepared(docs, benchmark, text, item, item_text, rule):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for chunk in chunks(batch.column(at)):
                    for r, *_ in _passages(chunk, sent.value, rule, known):
                        keep[chunk.first + r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
