from __future__ import annotations

import importlib
import random

import numpy as np
import pyarrow as pa
import pytest
from corpora import documents, linked_components, prose, repeated_ranges, shingle_set, texts

from triptally.llm import ngram_join, suffix_dedup
from triptally.llm.arrays import U64
from triptally.llm.components import components
from triptally.llm.tables import Steps


def test_join_equals_brute_force(spark):
    rows = texts()
    expected = linked_components(rows)
    found = ngram_join.similar_documents(documents(spark)).collect()
    assert len(found) == len(rows)  # repeated rows and the one without id too
    for row in found:
        if row.doc_id is not None:
            assert (row.n_shingles, row.component) == expected[row.doc_id], row
    assert expected[30][1] == 25 and expected[55][1] == 25 and expected[60] == (0, 60)


def _bridged(shared: bool) -> list[tuple[int | None, str]]:
    """Two texts that link only through a third, which has no id or, if `shared`, that of another
    text; and two unlike texts of one id."""
    rng = random.Random(5)
    word = [f"{w}{i}" for i, w in enumerate(prose(rng, 200).split())]
    one, two, three = list(word), list(word), list(word)
    for i in (10, 40, 70):
        two[i] = three[i] = f"edit{i}"
    for i in (100, 130, 160):
        three[i] = f"edit{i}"
    rows = [(3, " ".join(one)), (2 if shared else None, " ".join(two)), (4, " ".join(three))]
    return [*rows, (2, prose(rng, 90)), (9, prose(rng, 60)), (9, prose(rng, 70))]


@pytest.mark.parametrize("shared", [False, True])
def test_join_through_texts_without_own_id(spark, shared):
    rows = _bridged(shared)
    one, two, three = (shingle_set(t) for _, t in rows[:3])
    for x, y, link in ((one, two, True), (two, three, True), (one, three, False)):
        assert (100 * len(x & y) >= 80 * len(x | y)) == link
    found = ngram_join.similar_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    size = len(one)
    # The smallest key reachable; the text without a key is named by its component too.
    first = 2 if shared else 3
    chain = [(r.doc_id, r.component) for r in found if r.n_shingles == size]
    assert sorted(chain, key=str) == sorted([(3, first), (2 if shared else None, first), (4, first)], key=str)

    kept = ngram_join.without_near_copies(documents(spark, rows)).collect()
    told = sorted(((r.doc_id, r.text) for r in kept), key=str)
    chosen = [rows[1], *rows[3:]] if shared else [rows[0], rows[1], *rows[3:]]
    assert told == sorted(chosen, key=str)


def test_join_without_spare_crowds(spark, monkeypatch):
    """Crowded signatures of one set and more: the same result by the other path."""
    monkeypatch.setattr(ngram_join, "CROWD", 1)
    expected = linked_components(texts())
    for row in ngram_join.similar_documents(documents(spark)).collect():
        if row.doc_id is not None:
            assert (row.n_shingles, row.component) == expected[row.doc_id]


def test_join_of_empty_table(spark):
    assert ngram_join.similar_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1, 4, 5, 9, 16, 40, 63, 64, 130, 257, 1000])
def test_similar_sets_share_a_signature(size):
    """Sets as far apart as the rule allows always share one, whatever their sizes."""
    rule = ngram_join.Similarity()
    rng = np.random.default_rng(size)
    for _ in range(40):
        one = rng.integers(1, 1 << 62, size).astype(U64)
        common = rng.integers(-(-4 * size // 5), size + 1)
        most = 5 * common // 4 - size  # elements the other may have besides the common ones
        more = rng.integers(1, 1 << 62, rng.integers(0, max(most, 0) + 1)).astype(U64)
        two = np.concatenate([rng.permutation(one)[:common], more])
        union = size + len(two) - common
        if 100 * common < 80 * union:
            continue
        sets = [np.unique(one), np.unique(two)]
        sizes = np.array([len(s) for s in sets])
        rows, keys, _ = ngram_join._signatures(np.repeat([0, 1], sizes), np.concatenate(sets), sizes, rule)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


@pytest.mark.parametrize("size", [16, 40, 63, 64, 130, 257, 1040, 1270, 2100, 4500])
def test_similar_sets_keep_a_signature_in_common(size):
    """Each goes without as many as it can, those shared first, in one order: one is left to both. Also
    for sets little larger than the lower end of a band, which fill few parts of the band below."""
    rule = ngram_join.Similarity()
    rng = np.random.default_rng(size)
    for _ in range(20):
        common = rng.integers(1, 1 << 62, size * 9 // 10).astype(U64)
        parts = [rng.integers(1, 1 << 62, n).astype(U64) for n in rng.multinomial(size // 10, [0.5, 0.5])]
        sets = [np.unique(np.concatenate([common, p])) for p in parts]
        both = len(np.intersect1d(*sets))
        assert 100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both)
        sizes = np.array([len(s) for s in sets])
        rows, keys, free = ngram_join._signatures(np.repeat([0, 1], sizes), np.concatenate(sets), sizes, rule)
        shared = np.intersect1d(keys[rows == 0], keys[rows == 1])
        left = [set(shared[int(n):].tolist()) for n in free]
        assert left[0] & left[1]
        if size >= 1000:
            assert (free > 1).all()


def test_unlike_texts_with_a_common_passage_are_no_family(spark, monkeypatch):
    """A passage of many texts, a small share of each, brings none of them together."""
    rng = random.Random(31)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(30)]
    rows = [
        (i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(1040)] + passage)) for i in range(24)
    ]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    met = {}

    def counted(links, steps, name, found=ngram_join.components):
        met[name] = links.count()
        return found(links, steps, name)

    monkeypatch.setattr(ngram_join, "components", counted)
    found = ngram_join.similar_documents(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in found} == linked_components(rows)
    assert met["families"] == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.comp for r in components(frame, Steps(spark, "test"), "c").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_stars_have_the_components_of_many_ties(spark):
    """Each of a group tied with several others: the same components by about one link each."""
    ties = [(j, i) for i in range(60) for j in range(i % 10, 10)] + [(70, 71), (72, 71), (80, 80)]
    frame = spark.createDataFrame(ties, "a long, b long")
    links = ngram_join.stars(frame)
    found = {r.node: r.comp for r in components(links, Steps(spark, "test"), "stars").collect()}
    assert found == {i: 0 for i in range(60)} | {i: 70 for i in (70, 71, 72)}
    assert links.distinct().count() < 100 < len(ties)


def test_components_with_hot_centres(spark, monkeypatch):
    """Centres looked up by a broadcast: the same components."""
    monkeypatch.setattr(module := importlib.import_module("triptally.llm.components"), "FEW", 3)
    monkeypatch.setattr(module, "HOT", 20)
    links = [(500, i) for i in range(80)] + [(79, 600), (600, 601)] + [(700 + i, 701 + i) for i in range(9)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.comp for r in components(frame, Steps(spark, "test"), "hot").collect()}
    assert found == {i: 0 for i in [*range(80), 500, 600, 601]} | {i: 700 for i in range(700, 710)}


@pytest.mark.parametrize("size", [600, 1023, 1024, 5000, 70_000])
def test_fine_counts_bound_the_difference(size):
    """Never more than the true difference, whatever the sizes; for unlike sets too much to link."""
    rng = np.random.default_rng(size)
    one = np.unique(rng.integers(1, 1 << 62, size).astype(U64))
    other = np.unique(rng.integers(1, 1 << 62, size * 5 // 4).astype(U64))
    near = np.union1d(one[size // 20 :], other[: size // 4])
    many = np.union1d(one, other)  # in finer buckets
    sets = [one, near, many, other]
    sizes = np.array([len(x) for x in sets])
    counts = ngram_join._fine_counts(np.repeat(np.arange(4), sizes), np.concatenate(sets), sizes)
    counts = [np.frombuffer(c, np.uint8) for c in counts.to_pylist()]
    for i in range(4):
        for j in range(4):
            assert ngram_join._apart(counts[i], counts[j]) <= len(np.setxor1d(sets[i], sets[j]))
    both, apart = sizes[0] + sizes[3], ngram_join._apart(counts[0], counts[3])
    assert 100 * (both - apart) < 80 * (both + apart)
    few = ngram_join._fine_counts(np.zeros(3, np.int64), one[:3], np.array([3]))
    assert few.to_pylist() == [None]


def test_join_of_long_texts(spark):
    """Texts of thousands of words: near copies, and others that share passages only."""
    rng = random.Random(21)
    word = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    rows = []
    for i in range(6):
        copy = list(word)
        for k in rng.sample(range(4000), 25):
            copy[k] = f"edit{i}"
        rows.append((10 + i, " ".join(copy)))
    for i in range(6):
        own = [f"x{rng.randrange(10**6)}" for _ in range(3000)]
        rows.append((30 + i, " ".join(own + word[:900])))
    expected = linked_components(rows)
    found = ngram_join.similar_documents(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in found} == expected
    assert len({c for _, c in expected.values()}) == 7


def _check_removal(spark, rows, **options):
    found = suffix_dedup.remove_repeats(documents(spark, rows), **options).collect()
    unique = {i: (t or "").encode() for i, t in rows}
    occurrences = [(i, (t or "").encode()) for i, t in rows]
    ranges = repeated_ranges([t for _, t in occurrences], options.get("length", 200))
    expected = {i: r for (i, _), r in zip(occurrences, ranges, strict=True)}
    assert len(found) == len(rows)
    for row in found:
        if row.doc_id is None:
            continue
        text, cut = unique[row.doc_id], expected[row.doc_id]
        kept, at = b"", 0
        for a, b in cut:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        assert row.n_bytes == len(text) and row.n_spans == len(cut), row.doc_id
        assert row.n_removed == sum(b - a for a, b in cut)
        assert bytes(row.kept) == kept
    assert any(r.n_removed for r in found)


def test_removal_equals_brute_force(spark):
    _check_removal(spark, [r for r in texts() if r[0] != 70])


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_removal_is_the_same_for_any_batches(spark, batches):
    rng = random.Random(batches)
    rows = [(i, prose(rng, 80)) for i in range(30)]
    rows += [(100 + i, prose(rng, 20) + rows[i][1][50 : 50 + rng.randrange(30, 200)]) for i in range(20)]
    _check_removal(spark, rows, length=60, gram=20, batches=batches)


def test_removal_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL_GROUP", 2)
    rng = random.Random(3)
    passage = prose(rng, 50)
    rows = [(i, prose(rng, 20) + passage[: rng.randrange(150, 300)] + prose(rng, 20)) for i in range(25)]
    _check_removal(spark, rows, length=60, gram=20, batches=3)


class _Caught:
    """Takes the function of a mapInArrow, to call it here."""

    def mapInArrow(self, run, schema):
        return run


def test_removal_compares_few_groups_at_a_time(monkeypatch):
    """Whatever the rows of a task: the same spans as from all groups at once, of a bounded number of
    entries at a time."""
    monkeypatch.setattr(suffix_dedup, "CUT_ROWS", 50, raising=False)
    rng = random.Random(8)
    rows = []
    for anchor in range(300):
        base = bytes(rng.choices(b"abcd", k=40))
        for _ in range(64 if anchor == 100 else rng.randrange(1, 9)):
            rows.append((anchor, rng.randrange(1, 3), len(rows), 7, base[rng.randrange(12) :]))
    names = ["anchor", "times", "row", "first", "bytes"]
    types = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    met = []

    def recorded(part, length, found=suffix_dedup._windows):
        met.append(part.num_rows)
        return found(part, length)

    monkeypatch.setattr(suffix_dedup, "_windows", recorded)
    run = suffix_dedup._compare_groups(_Caught(), 20)
    sizes = [0, 1, 333, 340, 400, whole.num_rows]
    parts = [whole.slice(a, b - a) for a, b in zip(sizes, sizes[1:])]
    spans = [tuple(r.values()) for batch in run(iter(parts)) for r in batch.to_pylist()]
    expected = []
    for anchor in range(300):
        mine = [r for r in rows if r[0] == anchor]
        cuts = repeated_ranges([r[4] for r in mine], 20)
        expected += [(r[2], 7 + a, 7 + b) for r, cut in zip(mine, cuts) if r[1] == 1 for a, b in cut]
    covered = lambda found: {(row, at) for row, a, b in found for at in range(a, b)}
    assert covered(spans) == covered(expected) != set()
    assert sum(met) == len(rows) and max(met) <= 2 * 50 + 64


def test_removal_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CUT_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", 500)
    _check_removal(spark, [r for r in texts() if r[0] != 70])


def _check_rows(spark, rows):
    """What is removed of every row, told by its key and text."""
    ranges = repeated_ranges([(t or "").encode() for _, t in rows], 60)
    expected = []
    for (i, t), cut in zip(rows, ranges, strict=True):
        kept = bytearray((t or "").encode())
        for a, b in reversed(cut):
            del kept[a:b]
        expected.append((str(i), t or "", sum(b - a for a, b in cut), len(cut), bytes(kept)))
    found = suffix_dedup.remove_repeats(documents(spark, rows), length=60, gram=20).collect()
    given = [(str(r.doc_id), r.text or "", r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(given) == sorted(expected)
    return given


def test_removal_from_rows_without_id(spark):
    """Rows without doc_id that share passages of several lengths with others and with each other,
    two of them equal, one without text: their places are cut like those of any row."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 20) + passage[10 * i : 150 + 20 * i] + prose(rng, 20)) for i in range(6)]
    alone = prose(rng, 40)
    rows += [(None, prose(rng, 20) + passage[a:b] + prose(rng, 20)) for a, b in ((0, 130), (45, 260))]
    rows += [(None, alone), (None, alone), (None, None), (None, prose(rng, 30))]
    given = _check_rows(spark, rows)
    assert sum(n > 0 for i, _, n, _, _ in given if i == "None") == 4


def test_removal_from_different_texts_of_one_id(spark):
    """Different texts with one doc_id, one of them twice: each is cut at its own places."""
    rng = random.Random(12)
    passage = prose(rng, 60)
    rows = [(i // 3, prose(rng, 20) + passage[10 * i : 150 + 20 * i] + prose(rng, 20)) for i in range(9)]
    rows += [(1, rows[4][1]), (1, None), (1, ""), (1, prose(rng, 30))]
    given = _check_rows(spark, rows)
    assert sum(n > 0 for i, _, n, _, _ in given if i == "1") == 4


def test_removal_of_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
