"""Frequent phrases and how strongly their words attract each other.

Every n-gram of words gets a 64-bit fingerprint from prefix polynomials over the hashes of its words.
Counting goes by fingerprints, level by level: only an n-gram whose shorter parts are frequent can be
frequent itself. Frequent fingerprints are then counted once more by the text at their occurrences, so
that collisions change nothing, and only these phrases ever become strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptally.llm.arrays import CHUNK_BYTES, LOWER, U64, Chunk, chunks, mix, powers, ranges, running
from triptally.llm.tables import Steps

LONGEST = 5
FILTER_BITS = 1 << 27  # at most; 16 MB whatever the number of frequent phrases
HELD = 1 << 22  # fingerprints a task gathers before it counts them
HELD_PHRASES = 300_000  # phrases it gathers before it hands on their counts
BLOCK_BYTES = 1 << 16  # of a text whose words are hashed at once
OUT_ROWS = 1 << 16  # rows of a batch that a task hands on
SALTS = 64  # parts of a language that are ranked apart before the last ranking
_ODD = U64(0x9E3779B97F4A7C15)
_STEP = 0xA24BAED4963EE407
_INVERSE = pow(_STEP, -1, 1 << 64)
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


class Grams:
    """The words of a chunk and the fingerprints of its n-grams.

    `width` is the number of bits of a fingerprint that count; fewer than 64 are for tests."""

    def __init__(self, chunk: Chunk, salts: np.ndarray, width: int = 64):
        data = chunk.data
        self.bounds = chunk.bounds
        self.mask = U64((1 << width) - 1)
        cut = _CUT[data]
        solid = ~(cut | _BLANK[data])
        begins, ends = solid.copy(), solid.copy()
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[chunk.bounds] = True
            begins[1:] &= ~solid[:-1] | edge[1:-1]
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(chunk.bounds, self.starts, "right") - 1
        # A piece is named by its row and the number of cuts before it.
        self.piece = np.searchsorted(np.flatnonzero(cut), self.starts) + self.row
        hashes = _word_hashes(data, self.starts, self.ends)
        self.total = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * powers(_STEP, len(hashes)), out=self.total[1:])
        self.salts = salts[self.row] if len(self.row) else np.zeros(0, U64)

    def places(self, n: int) -> np.ndarray:
        """The words from which n words stand in one piece."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n words from each place on, apart for each language and length."""
        moved = (self.total[at + n] - self.total[at]) * powers(_INVERSE, len(self.total))[at]
        return mix(moved + self.salts[at] + np.array([n], U64) * _ODD) & self.mask


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, from running sums over a block of words at a time: sums over the whole
    chunk would take some forty bytes for each of its bytes."""
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        first = starts[i]
        total = running(data[first : ends[j - 1]], lower=True)
        hashes[i:j] = ranges(total, starts[i:j] - first, ends[i:j] - first)
        i = j
    return hashes


def _salts(batch: pa.RecordBatch, chunk: Chunk) -> tuple[np.ndarray, list[str]]:
    """A random value for the language of each row, and the languages."""
    langs = batch.column(1).slice(chunk.first, len(chunk)).to_pylist()
    kinds = {name: _salt(name) for name in set(langs)}
    return np.array([kinds[x] for x in langs], U64), langs


def _salt(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    place = np.array([0])
    return int(ranges(running(data), place, place + len(data))[0])


class Known:
    """A Bloom filter of fingerprints: two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # 64-bit words; their number is a power of two
        self.shift = U64(64 - (len(bits) * 64).bit_length() + 1)

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        return self._has(mix(prints ^ _ODD)) & self._has(mix(prints + _ODD))

    def _has(self, spread: np.ndarray) -> np.ndarray:
        at = spread >> self.shift
        return (self.bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == U64(1)


def known_prints(frequent: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """The bits of a filter of all `fp` of a table: about 16 a fingerprint, but never more than
    `most`. With more fingerprints than fit well it lets more through, and never less."""
    rows = frequent.count()
    size = 1 << 12
    while size < most and size < 16 * rows:
        size *= 2
    shift = U64(64 - size.bit_length() + 1)

    def places(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(U64)
            at = np.concatenate([mix(prints ^ _ODD), mix(prints + _ODD)]) >> shift
            word, bit = (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["w", "b"])

    told = frequent.select("fp").mapInArrow(places, "w long, b long")
    words = told.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, U64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(U64)
    return bits


def _counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct fingerprints with their counts, in small batches; `held` is emptied."""
    prints = np.concatenate(held)
    held.clear()
    prints.sort()
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    first = np.append(np.flatnonzero(new), len(prints))
    for i in range(0, len(first) - 1, OUT_ROWS):
        bounds = first[i : i + OUT_ROWS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(prints[bounds[:-1]].view(np.int64)), pa.array(np.diff(bounds).astype(np.int32))],
            names=["fp", "c"],
        )


def _level(
    docs: DataFrame, sizes: list[int], inner: int, known, least: int, width: int
) -> DataFrame:
    """(fp, f) of n-grams that occur `least` times, for n in `sizes`, of those whose `inner`-grams all
    pass the filter (inner 0: of all)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        has = Known(known.value) if inner else None
        held: list[np.ndarray] = []
        amount = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                grams = Grams(chunk, _salts(batch, chunk)[0], width)
                if inner:
                    good = np.zeros(len(grams.starts) + 1, np.int64)
                    at = grams.places(inner)
                    good[at + 1] = has(grams.prints(at, inner))
                    good = np.cumsum(good)  # how many before each place pass
                for n in sizes:
                    at = grams.places(n)
                    if inner:
                        inside = n - inner + 1
                        at = at[good[at + inside] - good[at] == inside]
                    held.append(grams.prints(at, n))
                    amount += len(at)
                if amount >= HELD:
                    yield from _counted(held)
                    amount = 0
        if amount:
            yield from _counted(held)

    found = docs.mapInArrow(run, "fp long, c int")
    return found.groupBy("fp").agg(F.sum("c").alias("f")).where(F.col("f") >= least).select("fp")


def _phrases(docs: DataFrame, known, width: int) -> DataFrame:
    """(lang, phrase, m, f, doc, place): every n-gram with a known fingerprint, counted by its text,
    with the pointer to one occurrence (the smallest key, then byte offset; rows without key last).
    m is its number of words; m = 0 counts all words of a language."""
    kind = docs.schema["__key"].dataType.simpleString()

    names = ["lang", "phrase", "m", "c", "doc", "place"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        has = Known(known.value)
        held: dict[tuple[str, bytes], list] = {}  # [m, count, no key, key, place]

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            entries = iter(held.items())
            while some := list(islice(entries, OUT_ROWS)):
                rows = [row for _, row in some]
                arrays = [
                    pa.array([lang for (lang, _), _ in some], pa.string()),
                    pa.array([phrase for (_, phrase), _ in some], pa.binary()).cast(pa.string()),
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([None if r[2] else r[3] for r in rows], kind),
                    pa.array([r[4] for r in rows], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            held.clear()

        def add(told: list[tuple], values: list) -> None:
            for lang, phrase, m, count, row, place in told:
                entry = held.get((lang, phrase))
                where = [values[row] is None, values[row], place]
                if entry is None:
                    held[lang, phrase] = [m, count, *where]
                else:
                    entry[1] += count
                    if not where[0] and (entry[2] or where[1:] < entry[3:]):
                        entry[2:] = where

        column = None
        for batch in batches:
            column = batch.column(2).type
            for chunk in chunks(batch.column(0), 4 * CHUNK_BYTES):
                salts, langs = _salts(batch, chunk)
                grams = Grams(chunk, salts, width)
                keys = batch.column(2).slice(chunk.first, len(chunk))
                rank = np.argsort(pa.compute.sort_indices(keys).to_numpy())  # null keys last
                values = keys.to_pylist()
                words = np.bincount(grams.row, minlength=len(chunk)).tolist()
                add([(name, b"", 0, n, r, 0) for r, (name, n) in enumerate(zip(langs, words, strict=True)) if n], values)
                lowered = LOWER[chunk.data].tobytes()
                same = _word_numbers(lowered, grams)
                for n in range(1, LONGEST + 1):
                    at = grams.places(n)
                    at = at[has(grams.prints(at, n))]
                    at = at[np.argsort(rank[grams.row[at]], kind="stable")]
                    add(_by_text(at, grams.prints(at, n), n, grams, same, lowered, langs), values)
                if len(held) >= HELD_PHRASES:
                    yield from flush(column)
        if held:
            yield from flush(column)

    found = docs.mapInArrow(
        run, f"lang string, phrase string, m int, c long, doc {kind}, place long"
    )
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "place")).alias("first")
    return (
        found.groupBy("lang", "phrase", "m").agg(F.sum("c").alias("f"), first)
        .select("lang", "phrase", "m", "f", "first.doc", "first.place")
    )


def _word_numbers(lowered: bytes, grams: Grams) -> np.ndarray:
    """Equal numbers for equal words of a chunk, told by their text."""
    if not len(grams.starts):
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * len(grams.starts) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = grams.starts, grams.ends, len(lowered)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(lowered)]
    )
    words = pieces.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
    return words.dictionary_encode().indices.to_numpy()


def _by_text(at, prints, n, grams, same, lowered, langs) -> list[tuple]:
    """(lang, phrase, n, count, row, place) of occurrences: one for each fingerprint, taken from its
    first occurrence, and one for each other text that turns out to have the same fingerprint."""
    if not len(at):
        return []
    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    lead = at[first][inverse]
    alike = grams.salts[at] == grams.salts[lead]
    for j in range(n):
        alike &= same[at + j] == same[lead + j]
    counts = np.bincount(inverse[alike], minlength=len(first))

    def text(place: int) -> bytes:
        spans = zip(grams.starts[place : place + n].tolist(), grams.ends[place : place + n].tolist(), strict=True)
        return b" ".join([lowered[a:b] for a, b in spans])

    out = []
    for place, count in zip(at[first].tolist(), counts.tolist(), strict=True):
        row = int(grams.row[place])
        out.append((langs[row], text(place), n, count, row, int(grams.starts[place] - grams.bounds[row])))
    others: dict[tuple[str, bytes], list[int]] = {}
    for place in at[~alike].tolist():
        row = int(grams.row[place])
        name = (langs[row], text(place))
        if name in others:
            others[name][0] += 1
        else:
            others[name] = [1, row, int(grams.starts[place] - grams.bounds[row])]
    return out + [(lang, phrase, n, c, row, p) for (lang, phrase), (c, row, p) in others.items()]


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact in 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big(a) * big(n), big(left) * big(right))


def _words(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def frequent_phrases(
    docs: DataFrame, least: int, steps: Steps, text: str = "text", lang: str = "lang",
    key: str = "doc_id", width: int = 64,
) -> DataFrame:
    """(lang, phrase, m, f, doc, place) of all phrases of 1 to 5 words that occur `least` times in a
    language, and of every language a row of m = 0 with its number of words."""
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"),
        F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("__lang"),
        docs[key].alias("__key"),
    )
    known = None
    levels: list[DataFrame] = []
    # Three passes: words, pairs of frequent words, longer ones whose pairs are all frequent.
    for inner, sizes in enumerate([[1], [2], list(range(3, LONGEST + 1))]):
        found = _level(base, sizes, inner, known, least, width)
        levels.append(steps.keep(found, f"level-{inner}"))
        known = spark.sparkContext.broadcast(known_prints(levels[-1]))
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    known = spark.sparkContext.broadcast(known_prints(every))
    told = _phrases(base, known, width).where((F.col("f") >= least) | (F.col("m") == 0))
    return steps.keep(told, "phrases")


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, text: str = "text",
    lang: str = "lang", key: str = "doc_id", width: int = 64,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, example_doc, example_place): the `top` phrases of 2 to 5
    words of each language that occur `least` times.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and pieces into words at
    blanks and tabs. n counts all words of the language, a the phrase; cut after any word, its two parts
    occur l and r times, and the cut with the lowest floor(1000 a n / (l r)) counts (of equal ones the
    first). Phrases that stand within a longer candidate with at least `absorb` percent of their
    occurrences are left out. Order: score and a descending, then phrase by its bytes. The example is
    the pointer to one occurrence: the smallest key and the byte where it begins in that text.

    A null language is `und`, a null text empty; rows without key count like others, and repeated rows
    count each. A table without frequent phrases gives no rows. Other columns are not read.
    """
    steps = Steps(docs.sparkSession, "phrases")
    found = frequent_phrases(docs, least, steps, text, lang, key, width)
    counts = found.where("m > 0")
    totals = found.where("m = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.where("m > 1")
    cut = candidates.select(
        "lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", _words(F.col("phrase"), 1, F.col("k")).alias("head"),
        _words(F.col("phrase"), F.col("k") + 1, F.col("m")).alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    scored = scored.withColumn(
        "score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    ).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What a direct extension does not take up, no longer one does: it occurs no more often.
    longer = counts.where("m > 2")
    parts = [
        longer.select("lang", _words(F.col("phrase"), start, F.col("m") - 1).alias("phrase"), "f")
        for start in (1, 2)
    ]
    within = parts[0].unionByName(parts[1]).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored.join(within, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < absorb * F.col("a"))
    )
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranked in parts first, so that no task sorts all phrases of a language.
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    first = salted.withColumn("part", part).where(F.col("part") <= top).drop("part", "salt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = steps.keep(first.withColumn("rank", rank).where(F.col("rank") <= top), "best")
    example = candidates.select(
        "lang", "phrase", F.col("doc").alias("example_doc"), F.col("place").alias("example_place")
    )
    return best.join(example, ["lang", "phrase"]).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "example_doc", "example_place"
    )
