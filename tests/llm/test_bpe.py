"""Batched merges against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpora import documents, texts
from tokenizers import Tokenizer

from triptally.llm import bpe
from triptally.llm.arrays import chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*map(ord, " \n\t'aAsdrev1.,#"), 0x301, 0x85, 0xA0, 0x3000, 0x1F600, 0x660, 0x1C89, 0xA7CB, 0x105C0]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts() -> list[str]:
    rng = random.Random(3)
    special = "<|endoftext|>"
    rows = ["", "aaaa aaaaa", "x" * 450, "ab" * 300, "don't  we'll 'sx", " \n\t ", "é日本" * 40]
    rows += [special, f"a{special} {special}{special} <|endof", f"'s{special}'s"]
    for _ in range(1500):
        some = [chr(rng.choice([*SIGNS, rng.randrange(1, 0xD800)])) for _ in range(rng.randrange(60))]
        rows.append("".join(some))
    return rows


def test_ids_and_texts_equal_the_library(library):
    rows = odd_texts()
    coder = bpe.Coder(bpe.vocabulary(PATH))
    for chunk in chunks(pa.array(rows)):
        ids, bounds = coder.encode(chunk)
        for i in range(len(chunk)):
            text = rows[chunk.first + i]
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == expected, repr(text)
        assert coder.merges.decode(ids.astype(np.int64), bounds) == rows[chunk.first : chunk.last]


def test_long_words_merge_rank_by_rank(library):
    rng = random.Random(4)
    merges = bpe.vocabulary(PATH)
    for letters, n in (("abcdefgh", 5_000), ("aeiourstn", 30_000), ("x", 4_099), ("ab", 9_001)):
        word = "".join(rng.choice(letters) for _ in range(n))
        data = np.frombuffer(word.encode(), np.uint8)
        assert n > bpe.LONG
        ids, bounds = merges.merge_words(data, np.array([0, n]))
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
        assert bounds.tolist() == [0, len(ids)]


def test_long_texts_in_blocks(library):
    rng = random.Random(5)
    text = " ".join(rng.choice(["the", "river", "<|endoftext|>", "don't", "\n\n", "7 8"]) for _ in range(700_000))
    coder = bpe.Coder(bpe.vocabulary(PATH))
    (chunk,) = chunks(pa.array([text]))
    ids, bounds = coder.encode(chunk)
    assert len(chunk.data) > 2 * bpe.CHUNK_BYTES
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bounds.tolist() == [0, len(ids)]


def _reference_merge(symbols: list[str], ranks: dict) -> list[str]:
    """One merge at a time: the lowest rank, the leftmost of equal ones."""
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@pytest.mark.parametrize("merges", [
    ["a b", "b c", "a bc", "abc a", "ab c", "abc abc"],  # `abc` is made by two merges
    ["a a", "aa a", "aa aa", "b a", "a ba"],
])
def test_vocabularies_out_of_order(tmp_path, merges):
    import json

    signs = list(bpe._byte_signs())
    made = sorted({m.replace(" ", "") for m in merges})
    vocab = {t: i for i, t in enumerate([*signs, *made])}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": True}
    file = {"normalizer": None, "pre_tokenizer": level, "decoder": level, "added_tokens": [],
            "model": {"type": "BPE", "dropout": None, "vocab": vocab, "merges": merges}}
    path = tmp_path / "own.json"
    path.write_text(json.dumps(file))
    own = bpe.Merges(str(path))
    ranks = {tuple(m.split(" ")): r for r, m in enumerate(merges)}
    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
        ids, _ = own.merge_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == [vocab[t] for t in _reference_merge(list(word), ranks)], word


@pytest.mark.parametrize("packed", [False, True])
def test_frames_round_trip(spark, library, packed):
    docs = documents(spark).withColumnRenamed("key", "IDS").withColumnRenamed("score", "__text")
    coded = bpe.encode(docs, packed=packed)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"]
    again = bpe.decode(coded, into="Decoded").select("doc_id", "text", "ids", "Decoded").collect()
    assert len(again) == len(texts())
    for row in again:
        ids = np.frombuffer(row.ids, "<u4").tolist() if packed else row.ids
        assert ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.Decoded == (row.text or "")
    assert bpe.decode(bpe.encode(docs.limit(0), packed=packed), into="t").count() == 0


def test_decoding_odd_ids(spark, library):
    rng = random.Random(7)
    rows = [[rng.randrange(50_300) for _ in range(rng.randrange(30))] for _ in range(300)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, ids array<int>")
    for row in bpe.decode(frame).collect():
        assert row.text == library.decode(rows[row.i], skip_special_tokens=False)
    empty = spark.createDataFrame([(1, None), (2, []), (3, [None, 40, -5])], "i long, ids array<int>")
    assert [r.text for r in bpe.decode(empty).orderBy("i").collect()] == ["", "", library.decode([40])]


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Merges(public_tokenizers.path("word_bpe_49k.json"))
