from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpora import documents, prose, texts
from tokenizers import Tokenizer, models, pre_tokenizers

from triptally.llm import chat_format, cover_tree, decontaminate, packing, pii, token_counts
from triptally.llm.arrays import chunks
from triptally.llm.tokens import Encoder

# Decontamination


def _edited(rng, item: str, share: float) -> str:
    words = item.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"other{i}"
    return " ".join(words)


def _smith_waterman(item, passage) -> int:
    best, rows = 0, [[0] * (len(passage) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(passage):
            row.append(max(0, rows[-1][j] + (2 if a == b else -1), rows[-1][j + 1] - 1, row[-1] - 1))
        rows.append(row)
        best = max(best, *row)
    return best


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item, passage = (rng.integers(0, 5, rng.integers(1, 14)) for _ in range(2))
        score, first, last = decontaminate.align(item, passage)
        assert score == _smith_waterman(item.tolist(), passage.tolist())
        assert _smith_waterman(item.tolist(), passage[first:last].tolist()) == score


def _benchmark(spark, rng):
    items = [(i, " ".join(f"w{i}x{j}" if j % 3 else rng.choice(["the", "of", "and"])
                          for j in range(rng.randrange(15, 40)))) for i in range(12)]
    rows = [*items, (100, None), (None, "alpha beta gamma delta omega sigma"), (101, ""), (102, "the of"),
            (0, items[0][1])]
    return items, spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    items, benchmark = _benchmark(spark, rng)
    rows = texts()
    planted = {}
    for n, (i, item) in enumerate(items):
        for k, leak in enumerate((item, item.upper() + ".", _edited(rng, item, 0.15))):
            doc = 1000 + 10 * n + k
            rows.append((doc, prose(rng, 40) + "\n" + leak + " " + prose(rng, 300)))
            planted[doc] = i
    # One item in very many texts: its grams are frequent, but remain its rarest.
    rows += [(2000 + k, prose(rng, 10) + " " + items[3][1] + " " + prose(rng, 5)) for k in range(150)]
    planted |= {2000 + k: 3 for k in range(150)}
    docs = documents(spark, rows)
    found = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(planted.items())
    text = dict(rows)
    for r in found:
        passage = text[r.doc_id].encode()[r.first : r.last].decode()
        assert 0.5 <= r.score <= 1 and len(passage.split()) >= 10
        if r.doc_id >= 2000 or r.doc_id % 10 == 0:
            assert r.score == 1 and passage == items[planted[r.doc_id]][1]
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted((i is not None, i or 0) for i, _ in rows if i not in planted)


def test_leaks_of_parts_of_long_items(spark):
    """A long passage of a long item is told whatever its share; a short one is not."""
    rng = random.Random(8)
    long = [f"q{i}y{rng.randrange(100)}" for i in range(450)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, "one two three four five six")],
                                      "item_id long, text string")
    parts = {1: long[100:300], 2: long[:60], 3: long[200:230], 4: long[400:], 5: long}
    rows = [(i, prose(rng, 50) + "\n" + " ".join(p) + " " + prose(rng, 80)) for i, p in parts.items()]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert sorted(found) == [1, 2, 4, 5] and {r.item_id for r in found.values()} == {1}
    for i, r in found.items():
        assert rows[i - 1][1].encode()[r.first : r.last].decode() == " ".join(parts[i])
        assert r.score == len(parts[i]) / 450
    assert [r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()] == [3]


def test_leaks_with_blocks_of_items_and_empty_tables(spark):
    rng = random.Random(6)
    items, benchmark = _benchmark(spark, rng)
    docs = documents(spark, [(n, item) for n, item in items])
    rule = decontaminate.LeakRule(block=20)
    found = decontaminate.leaks(docs, benchmark, rule=rule).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in items}
    assert decontaminate.leaks(documents(spark, []), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == len(items)


# Conversations

CONTROL = "\\### Assistant: </turn> ok"


def _conversations() -> list[tuple]:
    rng = random.Random(4)
    parts = ["\\", "###", "#", "</turn>", "</", "turn>\n", ": ", "### user: ", "é", "日本", " ", "ab"]
    rows = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            said = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
            rows.append((c, t, rng.choice(["user", "assistant", "a: b", "\\x"]), said))
    rows += [(50, 1, "assistant", None), (50, 0, None, "hi"), (50, None, "user", "first")]
    rows += [(51, 0, "user", "same"), (51, 0, "user", "same"), (51, 0, "assistant", "tie")]
    rows += [(None, 0, "user", "no key"), (52, 0, "assistant", "x" * 300_000)]
    rng.shuffle(rows)
    return rows


def test_chats_are_read_back(spark, monkeypatch):
    for most in (chat_format.PART_BYTES, 40):  # the second: conversations in several parts
        monkeypatch.setattr(chat_format, "PART_BYTES", most)
        rows = _conversations()
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        frame = frame.selectExpr("*", "1 as k", "2 as part", "'x' as mask").repartition(4)
        chats = defaultdict(list)
        for c, t, r, s in rows:
            order = (t is not None, t or 0, r is not None, r or "", s is not None, s or "")
            chats[c].append((order, r or "", s or ""))
        found = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(frame)).collect()}
        assert set(found) == set(chats)
        for key, turns in chats.items():
            turns.sort()
            told = "".join(f"{r}\n{s}\n" for _, r, s in turns)
            learnt = "".join(s for _, r, s in turns if r == "assistant")
            assert found[key].n_turns == len(turns)
            assert found[key].turns_sha256 == hashlib.sha256(told.encode()).hexdigest(), turns
            assert found[key].loss_chars == len(learnt)
            assert found[key].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_format_of_one_chat(spark):
    rows = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "é</turn>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = chat_format.format_chats(frame).collect()[0]
    assert one.formatted == "### user: a \\### b</turn>\n### assistant: é\\</turn></turn>\n"
    raw = one.formatted.encode()
    assert [raw[m.lo : m.hi].decode() for m in one.mask] == ["é\\</turn>"]
    assert chat_format.format_chats(frame.limit(0)).count() == 0


# Tokens


def _unigram(vocabulary: token_counts.Vocabulary) -> Tokenizer:
    lowest = min(vocabulary.scores)
    vocab = [("\0unknown", lowest), *zip(vocabulary.pieces, vocabulary.scores, strict=True)]
    vocab += [(f"<0x{i:02X}>", lowest) for i in range(256)]
    tokenizer = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return tokenizer


@pytest.mark.parametrize("kind", ["given", "ties", "across"])
def test_counts_equal_the_library(spark, kind):
    if kind == "given":
        vocabulary = token_counts.read_vocabulary()
    else:  # equal scores everywhere, and pieces over blanks and line feeds
        pieces = ("▁", "a", "b", "ab", "ba", "aba", "bab", "▁a", "é", "aab", "bb", "b▁a", "a\nb")
        pieces = pieces if kind == "across" else pieces[:-2]
        vocabulary = token_counts.Vocabulary(pieces, tuple(-1.0 * len(p) for p in pieces))
    tokenizer, rng = _unigram(vocabulary), random.Random(9)
    parts = ["a", "b", "ab", " ", "  ", "\n", "é", "日", "😀", "▁", "tion", " the", "\x00", "zq"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 20))) for _ in range(500)]
    rows = [*enumerate(samples), *[(1000 + i, t) for i, (_, t) in enumerate(texts()) if len(t or "") < 2000]]
    found = token_counts.count_tokens(documents(spark, rows), vocabulary)
    assert found.columns.count("n_tokens") == 1
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append(len(tokenizer.encode(t or "", add_special_tokens=False).ids))
    for r in found.collect():
        assert r.n_tokens in expected[r.doc_id], repr(r.text)


def test_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Encoder(path, path.removesuffix("json") + "tiktoken"), Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "B", "é", "'s", "'re", "'ll", "'", "  ", " ", "\n", "\t", "1", "½", "!", "😀", "中",
             " ", "\xa0", "don't", "\r\n", "<|endoftext|>"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    samples += ["", "'s", "\n's", "''s", "x" * 5000]
    for chunk in chunks(pa.array([*samples, None]), 2000):
        ids, bounds = own.encode(chunk)
        for i in range(len(chunk)):
            text = [*samples, ""][chunk.first + i]
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == expected, repr(text)


def test_packing(spark):
    rows = texts()
    found = packing.pack_documents(documents(spark, rows), capacity=128).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            expected.append((i is not None, i or 0, piece, a, b - a, zlib.crc32(raw)))
    got = [(r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got) == sorted(expected)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 128
    total = sum(r.length for r in found)
    assert len(bins) <= 1.02 * total / 128 + 2
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1025, 4000), np.full(10, 341), np.full(7, 512), np.full(3, 1),
                    np.array([1024, 1, 1023, 600, 424, 342, 341])):
        bins = packing.best_fit(lengths, 1024)
        assert np.bincount(bins, lengths).max() <= 1024 and set(bins) == set(range(bins.max() + 1))
        pairs_at_best = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))
        assert bins.max() + 1 <= 1.06 * pairs_at_best + 1


# Search


def _vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, -0.25, 0.125, 0.0, 1.0, 0.75]) for i in range(120)]  # equal vectors
    rows += [(500, None), (550, [1.0, None, 0, 0, 0, 0]), (600, [float("nan")] * 6), (650, [float("inf")] * 6)]
    rows += [(700, [1.0, 2.0]), (701, [3.0, 1.0]), (702, []), (None, [0.1] * 6), (750, [0.0] * 6)]
    return [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block", [32, 1024])
def test_top_k_equals_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as id", "2 as dim", "3 as block")
    found = cover_tree.top_k(frame.where("vec_id % 50 = 0"), frame)
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all()]
    expected = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            expected |= {(q, rank + 1, i, -score) for rank, (score, i) in enumerate(best)}
    assert {tuple(r) for r in found.collect()} == expected
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert cover_tree.top_k(frame.limit(0), frame).count() == 0
    assert cover_tree.top_k(frame.where("vec_id = 0"), frame.limit(0)).count() == 0


def test_trees_prune():
    """On clustered points most pairs of vectors are never compared."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8)) * 4000
    points = np.floor(centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8)) * 20)
    ids = np.arange(2000)
    compared = []

    class Counted(cover_tree.Search):
        def _compare(self, q, p):
            compared.append((q.hi - q.lo) * (p.hi - p.lo))
            super()._compare(q, p)

    search = Counted(cover_tree.CoverTree(points[:200]), ids[:200], cover_tree.CoverTree(points), ids, 5)
    assert sum(compared) < 0.5 * 200 * 2000
    products = points[:200] @ points.T
    np.fill_diagonal(products, -np.inf)
    best = -np.sort(-products, axis=1)[:, :5]
    got = defaultdict(list)
    for q, _, score in search.results():
        got[q].append(score)
    assert all(got[q] == best[q].astype(int).tolist() for q in range(200))


# Personal data


def _feistel(left: int, right: int, a: int, b: int, key: str, kind: str) -> tuple[int, int]:
    def noise(turn, other):
        return int(hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()[:12], 16)

    for turn in range(8):
        if turn % 2:
            right = (right + noise(turn, left)) % b
        else:
            left = (left + noise(turn, right)) % a
    return left, right


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number][::-1]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    said = {
        1: "Mail joe.doe42@mail9.example.com. Card 4041894974608795, 4041-8949-7460-8795!",
        2: "Call +1 (988) 555-2485 or (988) 555-2485; joe.doe42@mail9.example.com",
        3: "from 42.144.35.254 on 2024-02-29 (02/29/2024, 29.02.2024), 123-45-6789",
        4: "bad 4041894974608796 999.1.1.1 2023-02-30 13/13/2020 666-12-1234 v1.2.3.4.5 1650-01-01 12345",
        5: None, 6: "", 7: "nothing here", 8: "x" * 200_000 + " 4041894974608795",
    }
    docs = documents(spark, list(said.items()))
    rows = {r.doc_id: r for r in pii.pseudonymize(docs, "k", count="n_replaced").collect()}
    new = {i: r.text for i, r in rows.items()}
    assert {i: rows[i].n_replaced for i in rows} == {1: 3, 2: 3, 3: 5, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1}
    assert all(new[i] == said[i] for i in (4, 5, 6, 7))
    mail = re.search(r"Mail ([a-z]{3}\.[a-z]{3}\d\d@mail9\.example\.com)\. ", new[1])[1]
    assert mail in new[2] and mail not in said[1]
    card, grouped = re.search(r"Card (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4})!", new[1]).groups()
    assert grouped.replace("-", "") == card and _luhn(card) and new[8].endswith(" " + card)
    left, right = _feistel(4041894, 97460879, 10**7, 10**8, "k", "card")
    assert card[:-1] == f"{left:07d}{right:08d}"
    one, two = re.search(r"\+1 (\(9\d\d\) 5\d\d-\d{4}) or (\(9\d\d\) 5\d\d-\d{4});", new[2]).groups()
    assert one == two
    found = re.search(r"from (\S+) on (\S+) \((\S+), (\S+)\), (\S+)$", new[3]).groups()
    assert all(0 <= int(x) < 256 for x in found[0].split("."))
    y, m, d = found[1].split("-")
    assert found[2] == f"{m}/{d}/{y}" and found[3] == f"{d}.{m}.{y}"
    left, right = _feistel(42 * 256 + 144, 35 * 256 + 254, 65536, 65536, "k", "address")
    assert found[0] == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", found[4]) and not re.match("000|666|9", found[4])
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs, "other").collect()}
    assert other[1] != new[1] and other[7] == said[7]
    assert pii.pseudonymize(documents(spark, []), "k").count() == 0


@pytest.mark.parametrize("sql, n", [
    ("date_format(date_add(date'1799-12-20', cast(id as int)), 'yyyy-MM-dd')", 4000),
    ("format_string('10.7.%d.%d', id div 256, id % 256)", 4000),
    ("format_string('%03d-%02d-%04d', 1 + id % 600, 1 + id % 99, 1 + id)", 4000),
    ("format_string('+1 (2%02d) 555-%04d', id % 100, id)", 4000),
    ("format_string('u%d@x.org', id)", 3000),
])
def test_pseudonyms_are_permutations(spark, sql, n):
    values = spark.range(n).selectExpr(f"{sql} as v").distinct()
    new = values.select("v", pii.pseudonym(values.v, "k").alias("p"))
    assert new.select("p").distinct().count() == values.count()


def test_pseudonyms_run_without_python(spark):
    plan = pii.pseudonymize(documents(spark), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan
