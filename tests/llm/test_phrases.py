"""Phrase mining against plain counting of strings."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpora import documents, prose
from pyspark.sql import functions as F

from triptally.llm import arrays, phrases


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least, top, absorb=100):
    """The same results from whole lists of words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", lowered(text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    kept = {k: a for k, a in f.items() if a >= least}
    within = Counter()
    for (lang, words), a in kept.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = lang, words[i : i + m]
                within[part] = max(within[part], a)
    out = {}
    for (lang, words), a in kept.items():
        if len(words) < 2 or (within[lang, words] and 100 * within[lang, words] >= absorb * a):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, n[lang]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, total, -score)
        for lang, found in out.items()
        for i, (score, a, p, left, right, total) in enumerate(sorted(found)[:top])
    )


def corpus(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(200):
        text = prose(rng, rng.randrange(1, 60)).replace(" the ", rng.choice([" The ", ", the ", "\tthe ", ";the "]))
        if i % 3 == 0:
            text += " New York City hall. new york CITY\x0bhall"
        rows.append(([None, "en", "de"][i % 3], text))
    rows += [("en", None), ("en", ""), ("fr", " \t"), (None, "a a a a a a a"), ("en", "é ü. É " * 30)]
    rows += [("de", prose(rng, 20_000))]
    return rows


def told(frame):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in frame.collect())


def frame(spark, rows):
    data = [(i if i % 7 else None, t, lang, "x", 3) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, phrase string, f long").repartition(3)


@pytest.mark.parametrize("width", [64, 8])  # with 8 bits nearly all fingerprints collide
def test_equals_plain_counts(spark, width):
    rows = corpus()
    assert told(phrases.collocations(frame(spark, rows), least=8, width=width)) == plain(rows, 8, 2000)


def test_limits_and_absorption(spark):
    rows = corpus(3)
    found = told(phrases.collocations(frame(spark, rows), least=5, top=7, absorb=60))
    assert found == plain(rows, 5, 7, 60)
    assert max(r[1] for r in found) == 7


def test_pointers_lead_to_the_phrase(spark):
    rows = corpus()
    for r in phrases.collocations(frame(spark, rows), least=8).collect():
        assert r.example_doc is not None
        lang, text = rows[r.example_doc]
        at = lowered(text.encode()[r.example_place :].decode())
        assert (lang or "und") == r.lang and re.sub(r"[ \t]+", " ", at).startswith(r.phrase)


def test_nothing_frequent_and_clashing_columns(spark):
    assert phrases.collocations(documents(spark).limit(0)).count() == 0
    assert phrases.collocations(documents(spark), least=10**6).count() == 0
    found = told(phrases.collocations(documents(spark), least=20))
    rows = [(r.lang, r.text) for r in documents(spark).select("lang", "text").collect()]
    assert found == plain(rows, 20, 2000)


def test_scores_pass_64_bits(spark):
    cases = [(10**13, 9 * 10**13, 10**13 + 7, 10**13 + 9), (3, 10, 3, 7), (10**12, 10**14, 10**12, 10**12)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, a long, n long, l long, r long")
    got = rows.withColumn("s", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert {r.i: r.s for r in got} == {i: 1000 * a * n // (x * y) for i, (a, n, x, y) in enumerate(cases)}


def test_a_full_filter_only_lets_more_through(spark):
    rng = np.random.default_rng(1)
    prints = rng.integers(-(2**63), 2**63 - 1, 5_000)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    for most in (phrases.FILTER_BITS, 1 << 12):
        bits = phrases.known_prints(table, most)
        assert len(bits) * 64 <= most
        assert phrases.Known(bits)(prints.view(np.uint64)).all()
    others = rng.integers(-(2**63), 2**63 - 1, 50_000).view(np.uint64)
    assert phrases.Known(phrases.known_prints(table))(others).mean() < 0.05


def test_words_are_hashed_in_little_memory():
    """Hashes do not depend on the blocks; working arrays stay far below the sums over a whole chunk."""
    rng = random.Random(5)
    text = prose(rng, 200_000) + " " + "x" * 200_000 + " é. " + prose(rng, 200_000)
    chunk = next(arrays.chunks(pa.array([text, ""]), len(text) * 4))
    arrays._powers.clear()
    tracemalloc.start()
    grams = phrases.Grams(chunk, np.zeros(len(chunk), np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(chunk.data)
    whole = arrays.ranges(arrays.running(chunk.data, lower=True), grams.starts, grams.ends)
    assert (phrases._word_hashes(chunk.data, grams.starts, grams.ends) == whole).all()
