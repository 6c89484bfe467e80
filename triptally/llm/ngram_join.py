"""Similarity join of shingle sets by PartEnum signatures, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptally.llm.arrays import U64, chunks, distinct, lists, mix, shingles, signed, words
from triptally.llm.components import components
from triptally.llm.tables import Steps, unused

BAND_RATIO = 2  # a band holds sizes from its lower end to this many times it
PER_PART = 3  # shingles per part of the domain, for the largest sets of a band
CROWD = 8  # a signature of more sets is crowded: a passage of many texts, or a group of copies
FAMILY_BLOCK = 64  # sets of a family are compared in pairs of blocks of this many
BUCKETS = 128  # of the counts that bound a difference from below
FINE = 4 * BUCKETS  # sets of at least this many elements have finer counts too
FREE = 1 << 20  # size and signatures to do without share a number: size * FREE + these
SIGNATURE_PARTS = 4  # signatures are brought together in this many steps
ROWS_PER_TASK = 2_000_000  # signatures one task sorts; more of them get more tasks


@dataclass(frozen=True)
class Similarity:
    """Two sets link when den * |intersection| >= num * |union|."""

    shingle: int = 5
    num: int = 80
    den: int = 100

    def furthest(self, size: np.ndarray | int) -> np.ndarray | int:
        """The most elements by which a set of `size` and one it links with can differ.

        With sizes a and b, the difference is at most (a + b)(1 - t)/(1 + t), and b <= a/t.
        """
        return size * (self.den - self.num) // self.num

    def spare(self, size: np.ndarray | int) -> np.ndarray | int:
        """How many more signatures than needed a set gives, so that crowded ones can go."""
        return size // 16 + 3

    def droppable(self, size: np.ndarray | int) -> np.ndarray | int:
        """How many signatures a set can do without at most: what the smallest set that it can link
        with has to spare."""
        return self.spare(size * self.num // self.den)


def _signatures(
    rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, rule: Similarity
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of every set, given its sorted distinct (row, hash) pairs, and how many
    signatures each set can do without.

    A band covers sizes of one range; a set whose partner may be in the band below also signs there.
    In a band the domain of shingles is cut into a fixed number of parts by a hash. Sets that link
    differ in at most `furthest` parts, so of the first furthest + 1 + spare parts that are not
    empty, in one order for all sets, at least 1 + spare are the same in both: their contents are
    the signatures. A set with fewer non-empty parts signs all of them; with no more than furthest,
    also its first furthest + 1 shingles, each as a part of its own: two such sets meet there.

    Sets that link share more signatures of their band than either can do without. If the set whose
    parts end first does not sign all of them, 1 + spare are shared, and neither can do without more than
    its spare; if both sign all, all but furthest of either are shared. So of the shared ones the last in
    an order that all sets follow is left when each goes without its first ones.
    """
    edges = BAND_RATIO ** np.arange(30, dtype=np.int64)
    band = np.maximum(np.searchsorted(edges, sizes, "right") - 1, 0)
    # The smallest partner has ceil(size * t) elements.
    smallest = -(-sizes * rule.num // rule.den)
    out_rows, out = [], []
    need = rule.furthest(sizes) + 1
    wanted = need + rule.spare(sizes)
    free = rule.droppable(sizes)
    for step in (0, 1):
        # All sets sign in their own band; those with partners in the band below sign there too.
        chosen = (sizes > 0) if step == 0 else (sizes > 0) & (smallest < edges[band])
        mine = chosen[rows]
        r, h = rows[mine], hashes[mine]
        if len(r) == 0:
            continue
        own_band = (band - step)[r]
        parts = (edges[own_band + 1] // PER_PART).astype(U64)
        with np.errstate(over="ignore"):
            part = mix(h ^ (own_band.astype(U64) + U64(77))) % np.maximum(parts, U64(1))
            part = np.where(own_band <= 3, h, part)  # small sets: every shingle is a part
            order = np.lexsort((part, r))
            r, h, part, own_band = r[order], h[order], part[order], own_band[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            content = np.add.reduceat(mix(h + U64(0x51ED270B)), at)
            key = mix(content ^ mix(part[at] + (own_band[at].astype(U64) << U64(56))))
        owner = r[at]
        first = np.ones(len(at), bool)
        first[1:] = owner[1:] != owner[:-1]
        begin = np.flatnonzero(first)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        take = rank < wanted[owner]
        out_rows.append(owner[take])
        out.append(key[take])
        filled = np.bincount(owner, minlength=len(sizes))
        free = np.where(chosen, np.minimum(free, np.maximum(filled - need, 0)), free)
        few = chosen & (filled < need)
        if few.any():
            mine = few[r]
            rr, hh, bb = r[mine], h[mine], own_band[mine]
            order = np.lexsort((hh, rr))
            rr, hh, bb = rr[order], hh[order], bb[order]
            start = np.ones(len(rr), bool)
            start[1:] = rr[1:] != rr[:-1]
            begin = np.flatnonzero(start)
            rank = np.arange(len(rr)) - np.repeat(begin, np.diff(np.append(begin, len(rr))))
            take = rank < need[rr]
            out_rows.append(rr[take])
            out.append(mix(hh[take] ^ (bb[take].astype(U64) + U64(0xFE0000))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64), free
    return np.concatenate(out_rows), np.concatenate(out), free


def _sets(chunk, rule: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, hash) pairs of a chunk, set sizes and set hashes."""
    rows, hashes = distinct(*shingles(words(chunk), rule.shingle))
    sizes = np.bincount(rows, minlength=len(chunk)).astype(np.int64)
    whole = np.zeros(len(chunk), U64)
    if len(rows):
        full = np.flatnonzero(sizes)
        begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            whole[full] = mix(np.add.reduceat(mix(hashes ^ U64(0xC2B2AE35)), begin))
    return rows, hashes, sizes, whole


def _bucket_counts(rows: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """How many elements of each set fall in each bucket of a hash, 255 for more."""
    bucket = rows * BUCKETS + (mix(hashes) % U64(BUCKETS)).astype(np.int64)
    counts = np.bincount(bucket, minlength=n * BUCKETS)
    flat = np.minimum(counts, 255).astype(np.uint8)
    bounds = pa.array(np.arange(n + 1, dtype=np.int32) * BUCKETS)
    return pa.Array.from_buffers(pa.binary(), n, [None, bounds.buffers()[1], pa.py_buffer(flat)])


def _fine_counts(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """As _bucket_counts, for sets of at least FINE elements, with buckets in proportion to their size:
    a power of two that leaves two to four elements a bucket. Null for smaller sets."""
    out: list[bytes | None] = [None] * len(sizes)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes >= FINE).tolist():
        n = 1 << (int(sizes[i]).bit_length() - 2)
        bucket = (mix(hashes[ends[i] - sizes[i] : ends[i]]) % U64(n)).astype(np.int64)
        out[i] = np.minimum(np.bincount(bucket, minlength=n), 255).astype(np.uint8).tobytes()
    return pa.array(out, pa.binary())


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of differences of two sets' counts; the finer ones are folded to as many buckets as the
    others have, which gives the counts that set would have with so few."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = np.minimum(x[:half].astype(np.int16) + x[half:], 255)
    return int(np.abs(x.astype(np.int16) - y).sum(dtype=np.int64))


def row_mark(key: str, text: str) -> Column:
    """Tells apart texts of one key, and those without a key. One column to join by, so that what is
    joined already lies as dropping repeated rows needs it, and no text is shuffled twice."""
    return F.xxhash64(F.col(key), F.col(text))


def signed_sets(docs: DataFrame, rule: Similarity, key: str, text: str) -> DataFrame:
    """(key, mark, n_shingles, cls, free, counts, fine, sigs): mark is a hash of key and text; cls names
    a set, equal sets share it; counts are those of its buckets, fine those of a large set's many
    buckets; sigs only where a task meets the set for the first time, of which it can do without `free`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows, hashes, sizes, whole = _sets(chunk, rule)
                fresh = np.zeros(len(chunk), bool)
                for i in np.flatnonzero(sizes):
                    if (name := int(whole[i])) not in seen:
                        seen.add(name)
                        fresh[i] = True
                mine = fresh[rows]
                owner, sigs, free = _signatures(rows[mine], hashes[mine], sizes * fresh, rule)
                order = np.argsort(owner, kind="stable")
                counts = np.bincount(owner, minlength=len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)),
                     batch.column(2).slice(chunk.first, len(chunk)), pa.array(sizes),
                     signed(whole), pa.array(free, pa.int64()),
                     _bucket_counts(rows, hashes, len(chunk)), _fine_counts(rows, hashes, sizes),
                     lists(sigs[order].view(np.int64), counts)],
                    names=["key", "mark", "n_shingles", "cls", "free", "counts", "fine", "sigs"],
                )

    return docs.select(F.col(key), F.col(text), row_mark(key, text)).mapInArrow(
        run,
        f"key {kind}, mark long, n_shingles long, cls long, free long, counts binary, "
        "fine binary, sigs array<long>",
    )


def shared_signatures(signatures: DataFrame, tasks: int) -> DataFrame:
    """(sig, cls, tag, pivot, crowd) of every signature that several sets have; pivot is its smallest
    set, crowd their number."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not columns:
            return
        sig, cls, tag = (np.concatenate(c) for c in zip(*columns, strict=True))
        del columns
        order = np.lexsort((cls, sig))
        sig, cls, tag = sig[order], cls[order], tag[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls, tag = sig[new], cls[new], tag[new]
        start = np.ones(len(sig), bool)
        start[1:] = sig[1:] != sig[:-1]
        begin = np.flatnonzero(start)
        sizes = np.diff(np.append(begin, len(sig)))
        several = np.repeat(sizes > 1, sizes)
        columns = (sig, cls, tag, np.repeat(cls[begin], sizes), np.repeat(sizes, sizes))
        columns = [c[several] for c in columns]
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[i : i + (1 << 16)]) for c in columns],
                names=["sig", "cls", "tag", "pivot", "crowd"],
            )

    return signatures.repartition(tasks, "sig").mapInArrow(
        run, "sig long, cls long, tag long, pivot long, crowd long"
    )


def set_table(docs: DataFrame, rule: Similarity, text: str) -> DataFrame:
    """(cls, elements): the sorted shingle hashes of the set of each text as bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                _, hashes, sizes, whole = _sets(chunk, rule)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                elements = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [signed(whole), pa.array(elements, pa.binary())], names=["cls", "elements"]
                )

    return docs.select(text).mapInArrow(run, "cls long, elements binary")


def possible(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs that may link by the counts of their buckets: two sets differ in at least as many
    elements as the counts differ in sum."""
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("counts").alias("c1"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("counts").alias("c2"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
                .reshape(-1, BUCKETS).astype(np.int16)
                for c in (4, 5)
            )
            apart = np.abs(x - y).sum(1, dtype=np.int64)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            # With intersection (both - apart) / 2 and union (both + apart) / 2 at best.
            keep = rule.den * (both - apart) >= rule.num * (both + apart)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sized = pairs.join(one, "a").join(two, "b").where(
        F.least("n1", "n2") * rule.den >= F.greatest("n1", "n2") * rule.num
    )
    return sized.select("a", "b", "n1", "n2", "c1", "c2").mapInArrow(run, "a long, b long")


def fine_possible(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs that may link by the fine counts, where both sets have them. In a large set each of the
    few buckets holds so many elements that unlike sets look alike; with fine counts they do not."""
    fine = sets.where("fine is not null")
    one = fine.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("fine").alias("f1"))
    two = fine.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("fine").alias("f2"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            both = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i] for c in (3, 4))
                if x.is_valid and y.is_valid:
                    apart = _apart(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y)))
                    keep[i] = rule.den * (both[i] - apart) >= rule.num * (both[i] + apart)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    counted = pairs.join(one, "a", "left").join(two, "b", "left")
    return counted.select("a", "b", F.expr("n1 + n2").alias("both"), "f1", "f2").mapInArrow(
        run, "a long, b long"
    )


def _link(x: np.ndarray, y: np.ndarray, rule: Similarity) -> bool:
    """Whether two sets, sorted arrays, are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if rule.den * len(x) < rule.num * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return rule.den * common >= rule.num * (len(x) + len(y) - common)


def linked(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, each compared in full."""
    one = sets.select(F.col("cls").alias("a"), F.col("elements").alias("one"))
    two = sets.select(F.col("cls").alias("b"), F.col("elements").alias("two"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), U64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), U64)
                keep[i] = _link(x, y, rule)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return both.mapInArrow(run, "a long, b long")


def stars(ties: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the components of `ties`: each node is linked with the smallest of its
    smaller neighbours only, and they with that one. A node has few of them, one for each of its signatures or
    of the sets in its groups of blocks."""
    ends = ties.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    least = F.min("y").over(Window.partitionBy("x"))
    other = F.when(F.col("y") == F.col("least"), F.col("x")).otherwise(F.col("y"))
    return ends.distinct().withColumn("least", least).select(F.col("least").alias("a"), other.alias("b"))


def _by_key(batches, n_keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, key by key; keys are the first columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in range(n_keys)], strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if now is not None and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Members (fam, cls, n, counts, ...) dealt into blocks, once for each pair of blocks (lo, hi) of
    their family, sorted by these; families of one set are left out."""
    sizes = members.groupBy("fam").agg(F.count("*").alias("m")).where("m > 1")
    more = [c for c in members.columns if c not in ("fam", "cls", "n", "counts")]
    size = F.lit(block) * F.ceil(F.col("m") / (64 * block))
    keys = ("fam", "lo", "hi")
    return (
        members.join(sizes, "fam")
        .withColumn("n_blocks", F.ceil(F.col("m") / size).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(
            "fam", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
            "block", "cls", "n", "counts", *more,
        )
        .repartition(*keys).sortWithinPartitions(*keys)
    )


class _Group:
    """One pair of blocks, its sets by size; those joined already have one root."""

    def __init__(self, group: pa.Table, rule: Similarity):
        self.rule = rule
        size = group.column("n").to_numpy()
        self.order = np.argsort(size, kind="stable")
        self.size, self.cls = size[self.order], group.column("cls").to_numpy()[self.order]
        self.side = group.column("block").to_numpy()[self.order]
        self.alone = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        self.root = np.arange(len(size))
        if "comp" in group.column_names:
            comp = group.column("comp").to_numpy()[self.order]
            self.root = np.unique(comp, return_inverse=True)[1]
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8)
        self.counts = counts.reshape(-1, BUCKETS).astype(np.int16)[self.order]

    def partners(self, i: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sets of the other block, at least as large, that may link with set i by their counts."""
        rule, size = self.rule, self.size
        last = np.searchsorted(size * rule.num, size[i] * rule.den, "right")
        j = np.arange(i + 1, last)
        if wanted is not None:
            j = j[wanted[j]]
        if not self.alone:
            j = j[self.side[j] != self.side[i]]
        apart = np.abs(self.counts[j] - self.counts[i]).sum(1, dtype=np.int64)
        both = size[j] + size[i]
        return j[rule.den * (both - apart) >= rule.num * (both + apart)]


def close_ties(members: DataFrame, rule: Similarity) -> DataFrame:
    """Ties (a, b, lead) between sets of a family that may link by their counts; only those that join sets
    which a group has not joined yet, so fewer than sets. Leading are those within a block and the first
    between two blocks: few, and mostly enough to hold a family together."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table_ in _by_key(batches, 3):
            group = _Group(table_, rule)
            root = group.root
            one, two = [], []
            for i in range(len(root) - 1):
                j = group.partners(i, root != root[i])
                if len(j):
                    joined, first = np.unique(root[j], return_index=True)
                    root[np.isin(root, joined)] = root[i]
                    one.append(np.full(len(first), group.cls[i]))
                    two.append(group.cls[j[first]])
            if one:
                lead = np.full(sum(map(len, one)), group.alone)
                lead[0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(lead)],
                    names=["a", "b", "lead"],
                )

    return _block_pairs(members, FAMILY_BLOCK).mapInArrow(run, "a long, b long, lead boolean")


def unjoined(members: DataFrame, rule: Similarity) -> DataFrame:
    """The members (fam, cls, n, counts, comp) that may link, by their counts, with one of their family
    that is in another component. Only counts are brought together, block by block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table_ in _by_key(batches, 3):
            group = _Group(table_, rule)
            found = np.zeros(len(group.cls), bool)
            for i in range(len(found) - 1):
                j = group.partners(i, group.root != group.root[i])
                if len(j):
                    found[i] = True
                    found[j] = True
            if found.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(found.sum()), table_.column("fam")[0].as_py())),
                     pa.array(group.cls[found])],
                    names=["fam", "cls"],
                )

    ends = members.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    several = members.join(ends.where("lo <> hi").select("fam"), "fam", "left_semi")
    open_ = _block_pairs(several, FAMILY_BLOCK).mapInArrow(run, "fam long, cls long")
    return members.join(open_.distinct(), ["fam", "cls"], "left_semi")


def family_links(members: DataFrame, rule: Similarity) -> DataFrame:
    """Links (a, b) that join whatever links within families and is in no component yet; members are
    (fam, cls, n, counts, comp, elements).

    All sets of a family are compared, but no pair is written: a family is dealt into blocks, each
    pair of blocks meets in one group of bounded size, and a group tells only links that join sets
    it has not joined yet.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for table_ in _by_key(batches, 3):
            group = _Group(table_, rule)
            order, cls = group.order, group.cls
            elements = table_.column("elements").to_pylist()
            root = group.root
            told = []
            for i in range(len(cls) - 1):
                j = group.partners(i, root != root[i])
                if len(j) == 0:
                    continue
                x = np.frombuffer(elements[order[i]], U64)
                for k in j.tolist():
                    y = np.frombuffer(elements[order[k]], U64)
                    if root[k] != root[i] and _link(x, y, rule):
                        root[root == root[k]] = root[i]
                        told.append((int(cls[i]), int(cls[k])))
            if told:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*told, strict=True)], names=["a", "b"]
                )

    return _block_pairs(members, 4 * FAMILY_BLOCK).mapInArrow(run, "a long, b long")


def linked_classes(
    docs: DataFrame, rule: Similarity, key: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """Rows (key, mark, n_shingles, cls, ...) of `docs`, and (cls, key, mark, comp) of every class
    that has shingles: the smallest key and mark of its rows, and what is reachable by links.

    Equal sets are one class, named by a 64-bit hash. Classes that share a PartEnum signature are
    candidates. A class does without its most crowded signatures, as many as it can, for it shares others
    with whatever it links with; the classes of signatures that are crowded even so are families, compared
    block by block, by bucket counts first. Of signatures that are not crowded, each class is first compared with
    the smallest only, and so are a few sets of each family that are alike by counts; then every pair of classes that share one, or are of one family and may link by
    their counts, and are not yet in one component, is compared in full, so no link is lost. Elements of a class are read from one text, found by its mark, so classes whose
    rows have no key, or share one with other texts, are compared like any other.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "similar")
    found = steps.keep(signed_sets(docs, rule, key, text), "signed")
    tag = (F.col("n_shingles") * FREE + F.least("free", F.lit(FREE - 1))).alias("tag")
    signatures = found.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "cls", tag)
    n = found.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (SIGNATURE_PARTS * ROWS_PER_TASK)))
    shared = None
    for part in range(SIGNATURE_PARTS):  # so that only a part of them lies in shuffle files at a time
        own = signatures.where(F.pmod(F.col("sig"), F.lit(SIGNATURE_PARTS)) == part)
        own = steps.keep(shared_signatures(own, tasks), f"shared-{part}")
        shared = own if shared is None else shared.unionByName(own)
        steps.release()
    found = steps.keep(found.drop("free", "sigs"), "sets")
    steps.drop("signed")
    steps.release()

    # Each class goes without its most crowded signatures; what is left of a crowd may be none.
    most = Window.partitionBy("cls").orderBy(F.desc("crowd"), "sig")
    crowded = shared.where(F.col("crowd") > CROWD).withColumn("nth", F.row_number().over(most))
    crowded = crowded.where(F.col("nth") > F.col("tag") % FREE).select("sig", "cls", "tag")
    crowded = steps.keep(crowded, "crowded")
    least = crowded.groupBy("sig").agg(F.min("cls").alias("pivot"), F.count("*").alias("crowd"))
    needed = steps.keep(crowded.join(least.where("crowd > 1"), "sig"), "needed")
    steps.drop("crowded")
    columns = ("sig", "cls", "tag", "pivot")
    told = shared.where(F.col("crowd") <= CROWD).select(*columns).unionByName(
        needed.where(F.col("crowd") <= CROWD).select(*columns)
    )
    ties = needed.where((F.col("crowd") > CROWD) & (F.col("cls") != F.col("pivot")))
    ties = ties.select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    families = steps.keep(components(stars(ties), steps, "families"), "families")

    filled = found.where("n_shingles > 0")
    told_classes = told.select("cls").unionByName(families.select(F.col("node").alias("cls")))
    bounds = steps.keep(
        filled.join(told_classes.distinct(), "cls", "left_semi").groupBy("cls").agg(
            F.min("n_shingles").alias("n"), F.min("counts").alias("counts"),
            F.min("fine").alias("fine"),
        ),
        "bounds",
    )
    least_row = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "mark")).alias("row")
    first = filled.groupBy("cls").agg(least_row).select("cls", "row.key", "row.mark")
    texts = docs.select(row_mark(key, text).alias("mark"), F.col(text).alias("text"))

    def compare(pairs: DataFrame, name: str, members: DataFrame | None = None) -> DataFrame:
        """Links of pairs and families, written; one text of each class is read that may have any."""
        coarse = steps.keep(possible(pairs, bounds, rule), f"coarse-{name}")
        open_pairs = steps.keep(fine_possible(coarse, bounds, rule), f"open-{name}")
        classes = open_pairs.select(F.explode(F.array("a", "b")).alias("cls"))
        if members is not None:
            classes = classes.unionByName(members.select("cls"))
        chosen = first.join(classes.distinct(), "cls", "left_semi")
        chosen = chosen.select(F.col("mark").alias("own"))
        own = texts.join(chosen, F.col("mark") == F.col("own")).dropDuplicates(["mark"])
        sets = steps.keep(set_table(own, rule, "text"), f"elements-{name}")
        steps.release()
        links = linked(open_pairs, sets, rule)
        if members is not None:
            links = links.unionByName(family_links(members.join(sets, "cls"), rule))
        links = steps.keep(links, f"links-{name}")
        steps.drop(f"elements-{name}", f"open-{name}", f"coarse-{name}")
        steps.release()
        return links

    near = told.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    members = families.select(F.col("comp").alias("fam"), F.col("node").alias("cls"))
    members = members.join(bounds, "cls").select("fam", "cls", "n", "counts")
    ties = steps.keep(close_ties(members, rule), "ties")
    near = steps.keep(near.unionByName(ties.where("lead").select("a", "b")).distinct(), "near")
    near_families = components(stars(ties), steps, "close")
    members = near_families.select(F.col("comp").alias("fam"), F.col("node").alias("cls"))
    members = steps.keep(members.join(bounds, "cls").select("fam", "cls", "n", "counts"), "members")
    steps.release()
    links = compare(near, "1")
    groups = steps.keep(components(links, steps, "groups"), "groups")

    # Signatures whose sets are in several components: all pairs across components.
    placed = told.select("sig", "cls", F.expr(f"tag div {FREE}").alias("n")).join(
        groups.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("comp", F.coalesce("comp", "cls"))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.where("lo <> hi").select("sig")
    open_ = steps.keep(placed.join(mixed, "sig", "left_semi"), "open")
    x = open_.select("sig", *[F.col(c).alias(f"{c}1") for c in ("cls", "comp", "n")])
    y = open_.select(F.col("sig").alias("sig2"), *[F.col(c).alias(f"{c}2") for c in ("cls", "comp", "n")])
    across = x.join(
        y,
        (F.col("sig") == F.col("sig2")) & (F.col("comp1") != F.col("comp2"))
        & (F.col("cls1") < F.col("cls2"))
        & (F.least("n1", "n2") * rule.den >= F.greatest("n1", "n2") * rule.num),
    ).select(F.col("cls1").alias("a"), F.col("cls2").alias("b")).distinct()
    across = across.join(near, ["a", "b"], "left_anti")
    placed = members.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "cls"))
    rest = steps.keep(unjoined(placed.select("fam", "cls", "n", "counts", "comp"), rule), "rest")
    more = compare(across, "2", rest)
    whole = steps.keep(components(links.unionByName(more), steps, "classes"), "classes")

    return found, (
        first.join(whole.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "key", "mark", F.coalesce("comp", "cls").alias("comp"))
    )


def similar_documents(
    docs: DataFrame, rule: Similarity = Similarity(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component): every row of `docs` with the smallest key reachable by links.

    Null and empty texts have no shingles and link with nothing; repeated rows are returned as they
    are; rows without a key take part, but never give a component its name.
    """
    found, named = linked_classes(docs, rule, key, text)
    names = named.groupBy("comp").agg(F.min("key").alias("component"))
    lookup = named.join(names, "comp").select(F.col("cls").alias("of"), "component")
    result = found.select("key", "n_shingles", "cls").join(
        lookup, (F.col("cls") == F.col("of")) & (F.col("n_shingles") > 0), "left"
    )
    return result.select(
        F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component")
    )


def without_near_copies(
    docs: DataFrame, rule: Similarity = Similarity(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of `docs` without near copies: of linked rows the one with the smallest key, of equal
    rows one. Rows without a key stay, but link others; different texts of one key are judged each
    for itself."""
    found, named = linked_classes(docs, rule, key, text)
    least = F.min(F.struct("key", "mark")).alias("row")
    heads = named.where(F.col("key").isNotNull()).groupBy("comp").agg(least)
    blank = found.where((F.col("n_shingles") == 0) & F.col("key").isNotNull())
    kept = heads.select("row.mark").unionByName(blank.select("mark").distinct())
    mark_name, own = (unused(docs.columns, n) for n in ("__mark", "__own"))
    kept = kept.select(F.col("mark").alias(mark_name))
    marked = docs.withColumn(own, row_mark(key, text))
    rows = marked.join(kept, F.col(own) == F.col(mark_name), "left_semi").dropDuplicates([own])
    return rows.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
