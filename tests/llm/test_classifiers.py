from __future__ import annotations

import random


import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from triptally.llm import compression, language_id, queries, toxicity

SYLLABLES = {
    "xx": ["ka", "to", "ri", "mu", "sen"], "yy": ["blo", "fra", "gri", "sti", "wem"],
    "zz": ["ouille", "eaux", "que", "ment", "é"],
}


def _spoken(rng, language: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randrange(1, 4)))
                    for _ in range(n))


def test_languages_are_told(spark):
    rng = random.Random(1)
    rows = [(i, _spoken(rng, lang, rng.randrange(3, 200)), lang) for i in range(600)
            for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "123 !?", "yy"), (None, _spoken(rng, "xx", 30), None),
             (1003, _spoken(rng, "zz", 60_000), None), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'old' as lang_pred", "1 as score", "'m' as margin")
    model = language_id.fit_languages(language_id.learn_from(frame))
    told = language_id.identify(frame, model)
    assert sorted(told.columns) == sorted([*frame.columns, "rejected"])
    result = told.withColumn("held", compression.held_out(F.col("doc_id"))).collect()
    held = [r for r in result if r.held and r.lang and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in result}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "zz" and by[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in result)
    kept = language_id.known_languages(frame, model)
    assert kept.columns == frame.columns and kept.count() >= len(rows) - 6
    none = language_id.fit_languages(frame.limit(0))
    assert {r.lang_pred for r in language_id.identify(frame, none).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), model).count() == 0


def test_toxic_texts_score_higher(spark):
    rng = random.Random(2)
    insults = ["blockhead", "nitwit", "dunderhead", "numbskull"]
    rows = []
    for i in range(1200):
        words = _spoken(rng, rng.choice(["xx", "yy"]), rng.randrange(20, 200)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), int(bad)))
    rows += [(5000, None, None), (5001, "", None), (5002, _spoken(rng, "xx", 50_000), None), (None, "ka", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").selectExpr(
        "*", "9 as score", "'p' as predicted")
    labels = frame.where("toxic is not null").select("doc_id", "toxic")
    learnt = labels.where(~compression.held_out(F.col("doc_id")))
    model = toxicity.fit_toxicity(frame, learnt)
    found = toxicity.score_toxicity(frame, model)
    assert sorted(found.columns) == sorted(frame.columns)
    result = found.withColumn("held", compression.held_out(F.col("doc_id"))).collect()
    held = [r for r in result if r.held and r.toxic is not None]
    bad = [r.score for r in held if r.toxic]
    good = [r.score for r in held if not r.toxic]
    pairs = sum((a > b) + (a == b) / 2 for a in bad for b in good)
    assert len(held) > 150 and pairs >= 0.97 * len(bad) * len(good)
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in result)
    assert all(r.predicted == 0 for r in result if r.doc_id in (5000, 5001, 5002))
    assert toxicity.fit_toxicity(frame, learnt.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score_toxicity(frame, None).collect()} == {0.0}
    assert toxicity.score_toxicity(frame.limit(0), model).count() == 0


def test_held_out_rows_follow_the_checksum(spark):
    import zlib

    rows = spark.range(200).select("id", compression.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    leak = " ".join(f"item{j}" for j in range(30))
    rows = [(i, _spoken(rng, "xx" if i % 2 else "yy", 60), "xx" if i % 2 else "yy", "s", 9) for i in range(60)]
    copy = rows[10][1].split()
    copy[5] = "other"
    rows += [(100, " ".join(copy), "yy", "s", 9), (101, rows[10][1], None, "s", 9),
             (102, rows[11][1] + " " + leak, "xx", "s", 9),
             (103, _spoken(rng, "xx", 40) + " 10.20.30.40", "xx", "s", 9),
             (104, None, "xx", "s", 9), (105, "12345 !", "yy", "s", 9), (20, rows[20][1], "yy", "s", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
        kept.append(sorted(r.doc_id for r in frame.collect()))
    everything = sorted(r.doc_id for r in docs.collect())
    assert kept[0] == [i for i in everything if i not in (104, 105)]
    assert kept[1] == [i for i in sorted(set(kept[0])) if i not in (100, 101)]
    assert kept[2] == [i for i in kept[1] if i != 102] == kept[3]
    private = {r.doc_id: r for r in frame.collect()}
    assert "10.20.30.40" not in private[103].text and private[103].n_chars == len(private[103].text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r.doc_id for r in packed}) == kept[3]


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
