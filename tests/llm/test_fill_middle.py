"""Fill-in-middle against regular expressions and whole strings."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpora import documents, texts
from pyspark.sql import functions as F

from triptally.llm.arrays import chunks
from triptally.llm.fill_middle import RankIndex, boundaries, fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, rate=50, spm=80, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100])
def test_equals_plain_strings(spark, rate):
    extra = [(100, "a <S> b"), (101, "<P"), (102, "< <S >M>"), (103, "x<\x0b<P >P>"), (104, "  \n"), (105, " é\x1f日 ")]
    rows = texts() + extra + [(200 + i, f"w{i}  x\ty \n") for i in range(300)]
    docs = documents(spark, rows).withColumnRenamed("score", "FORM").withColumnRenamed("key", "output")
    made = fill_in_middle(docs, rate=rate)
    assert [c.lower() for c in made.columns].count("form") == 1
    found = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        got = r.n, r.form, r.prefix_chars, r.middle_chars, r.output
        assert got == plain(r.doc_id, r.text, rate), r.doc_id
        assert r.again == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_boundaries_of_odd_texts():
    rng = random.Random(1)
    rows = ["", " ", "a", " a", "a ", "", "\x1c\x85é", "日 本　x"]
    rows += ["".join(rng.choice(" \n\tab日") for _ in range(rng.randrange(12))) for _ in range(2000)]
    for chunk in chunks(pa.array(rows), budget=300):
        offsets, firsts = boundaries(chunk)
        for i in range(len(chunk)):
            sizes = [len(t.encode()) for t in TOKEN.findall(rows[chunk.first + i])]
            expected = chunk.bounds[i] + np.cumsum([0, *sizes])
            assert offsets[firsts[i] : firsts[i + 1]].tolist() == expected.tolist()


@pytest.mark.parametrize("error", [0, 3, 127])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(2)
    for steps in (rng.integers(0, 12, 20_000), rng.pareto(1, 5_000).astype(np.int64), np.full(9_000, 5), [0], []):
        offsets = np.cumsum(steps)
        index = RankIndex.fit(offsets, error)
        ranks = np.arange(len(offsets))
        assert index.offsets(ranks).tolist() == offsets.tolist()
        if len(offsets):
            assert np.abs(index.predict(ranks) - offsets).max() <= error
    assert len(RankIndex.fit(np.arange(0, 45_000, 5), error).firsts) == 1  # one straight line
    with pytest.raises(ValueError, match="error"):
        RankIndex.fit(np.arange(3), 128)


def test_marks_that_overlap_are_refused(spark):
    docs = documents(spark)
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("a", "bab", "c"), ("", "b", "c"), ("aa", "b", "aca")):
        with pytest.raises(ValueError, match="marks"):
            fill_in_middle(docs, marks=marks)
    own = ("[[pre]]", "[[suf]]", "[[mid]]")
    made = fill_in_middle(docs, marks=own, rate=100, into="x")
    again = made.withColumn("again", restored(F.col("x"), F.col("form"), own))
    assert all(r.again == (r.text or "") for r in again.collect())
