"""Toxicity by compression distance: a text's windows under a toxic and an ordinary dictionary."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptally.llm.arrays import chunks
from triptally.llm.compression import Lengths, fast, sample_by_label
from triptally.llm.tables import Steps, fields

_WORD = re.compile(rb"[^\s.,!?;:\"'()]+")
GRAMS = (5, 6, 7, 8, 10, 12)  # bytes of the strings a dictionary is made of
GRAMS_AT_ONCE = 400_000  # strings a task holds
SIGNIFICANCE = (6.0, 8.0, 10.0, 12.0, 14.0)  # least standard scores tried for them


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    window: int = 512
    min_match: int = 5


def _gram_sets(text: bytes) -> Iterator[set[bytes]]:
    """The strings of a text's words, a set of about `GRAMS_AT_ONCE` at a time. One text mostly gives one set;
    a very long one gives several, which may hold strings in common."""
    found: set[bytes] = set()
    seen: set[bytes] = set()
    for match in _WORD.finditer(text.lower()):
        word = match.group()
        if word in seen:
            continue
        seen.add(word)
        word = b" " + word + b" "
        for i in range(len(word)):
            found.update(word[i : i + k] for k in GRAMS if i + k <= len(word))
            if len(found) >= GRAMS_AT_ONCE:
                yield found
                found, seen = set(), set()
    yield found


def _gram_counts(sample: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """(gram, ordinary, toxic): how many texts of each label hold a string. A task adds up what it
    has read; texts of several sets go by their key, so that a string counts once a text."""

    def run(batches):
        totals: dict[bytes, list[int]] = {}

        def rows(counts: dict[bytes, list[int]], own):
            grams, (zero, one) = list(counts), zip(*counts.values(), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.binary()), pa.array([own] * len(grams), pa.string()),
                 pa.array(zero, pa.int64()), pa.array(one, pa.int64())],
                names=["gram", "own", "ordinary", "toxic"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                toxic = batch.column(1)[i].as_py()
                once = [1 - toxic, toxic]
                sets = _gram_sets(batch.column(2)[i].as_py().encode())
                first, second = next(sets), next(sets, None)
                if second is None:
                    for gram in first:
                        total = totals.setdefault(gram, [0, 0])
                        total[toxic] += 1
                    if len(totals) >= GRAMS_AT_ONCE:
                        yield rows(totals, None)
                        totals = {}
                    continue
                for grams in itertools.chain((first, second), sets):
                    if grams:
                        yield rows(dict.fromkeys(grams, once), batch.column(0)[i].as_py())
        if totals:
            yield rows(totals, None)

    found = sample.select(F.col(key).cast("string"), F.col(label).cast("int"), text).mapInArrow(
        run, "gram binary, own string, ordinary long, toxic long"
    )
    long = found.where("own is not null").dropDuplicates(["gram", "own"])
    both = found.where("own is null").unionByName(long)
    return both.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _strings(own: Counter, n_own: int, other: Counter, n_other: int, least: int) -> list[tuple]:
    """(standard score, string), best first: how much more documents of one class hold a string."""
    scored = []
    for gram, a in own.items():
        if a >= least:
            share = (a + other[gram]) / (n_own + n_other)
            expected = n_own * share
            spread = np.sqrt(expected * (1 - share) * n_other / (n_own + n_other) + 1e-9)
            scored.append(((a - expected) / spread, gram))
    return sorted(scored, reverse=True)


def _dictionary(scored: Iterable[tuple], least: float, most_bytes: int) -> bytes:
    """The strings of the highest scores, the best at the end, without strings inside others."""
    kept: list[bytes] = []
    size = 0
    for score, gram in scored:
        if score < least or size + len(gram) > most_bytes:
            break
        if not any(gram in k for k in kept):
            kept = [k for k in kept if k not in gram] + [gram]
            size = sum(map(len, kept))
    return b"".join(reversed(kept))


def _features(differences: np.ndarray, n_bytes: int) -> list[float]:
    """differences: by how many bytes the toxic dictionary shortens each window more."""
    total = float(differences.sum())
    return [
        1000 * total / (n_bytes + 1000), float(differences.max()),
        float(np.sign(total) * np.log1p(abs(total))), float((differences > 2).mean()),
    ]


def _text_features(lengths: Lengths, text: bytes) -> list[float]:
    both = lengths.of(text.lower())
    return _features(both[:, 1] - both[:, 0], len(text))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta -= np.linalg.solve(h, g)
    return beta


def _ranking(score: np.ndarray, y: np.ndarray) -> float:
    """The area under the ROC curve."""
    values, inverse = np.unique(score, return_inverse=True)
    counts = np.bincount(inverse, minlength=len(values))
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    a, b = int(y.sum()), int((1 - y).sum())
    return 0.5 if not a or not b else float((ranks[y == 1].sum() - a * (a + 1) / 2) / (a * b))


def _calibration(check: DataFrame, text: str, label: str, pairs: list[tuple[bytes, bytes]]) -> list:
    """(label, features under each pair of dictionaries) of whole texts."""

    def run(batches):
        lengths = [Lengths(p, ToxicityModel.window, fast(ToxicityModel.min_match)) for p in pairs]
        for batch in batches:
            features = []
            for chunk in chunks(batch.column(1)):
                raw = chunk.data.tobytes()
                for i in range(len(chunk)):
                    own = raw[chunk.bounds[i] : chunk.bounds[i + 1]]
                    features.append([x for each in lengths for x in _text_features(each, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features, pa.list_(pa.float64()))], names=["label", "x"]
            )

    rows = check.select(F.col(label).cast("int").alias("label"), text).mapInArrow(
        run, "label int, x array<double>"
    )
    return sorted((r.label, r.x) for r in rows.collect())


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic",
    key: str = "doc_id", per_class: int = 3000, dictionary_bytes: int = 2048,
    toxic_share: float | None = None,
) -> ToxicityModel | None:
    """Learns from about `per_class` rows of each label (the bound of the sample; `labels` has key and
    label, `docs` key and text), whole texts. Two thirds give the dictionaries: strings that documents
    of one class hold significantly more often. The last third calibrates: it chooses the significance
    asked for and fits the score, weighted to the classes' true shares. Tasks count strings and compress
    texts; the driver gets the strings that 1 % of a class hold (3 texts at least), and numbers.
    A key with both labels counts as toxic. None without rows of both labels.
    """
    known = labels.where(F.col(label).isin(0, 1))
    sizes, sample = sample_by_label(docs, known, label, text, key, per_class)
    if len(sizes) < 2:
        return None
    third = F.pmod(F.xxhash64(F.lit("third"), key), F.lit(3)) == 0
    sample = Steps(docs.sparkSession, "toxicity").keep(sample.withColumn("third", third), "sample")
    n = {(r[0], r[1]): r[2] for r in sample.groupBy(label, "third").count().collect()}
    if not all(any(n.get((k, part)) for part in (True, False)) for k in (0, 1)):
        return None
    if all(n.get((k, part)) for k in (0, 1) for part in (True, False)):
        learn, check = sample.where("not third"), sample.where("third")
        n = {k: n[k, False] for k in (0, 1)}
    else:  # a handful of rows
        learn = check = sample
        n = {k: n.get((k, True), 0) + n.get((k, False), 0) for k in (0, 1)}
    share = toxic_share if toxic_share is not None else sizes[1] / (sizes[0] + sizes[1])
    least = {k: max(3, n[k] // 100) for k in n}
    grams = _gram_counts(learn, text, label, key)
    grams = grams.where((F.col("ordinary") >= least[0]) | (F.col("toxic") >= least[1])).collect()
    counts = {0: Counter({bytes(r.gram): r.ordinary for r in grams}),
              1: Counter({bytes(r.gram): r.toxic for r in grams})}
    toxic = _strings(counts[1], n[1], counts[0], n[0], least[1])
    ordinary = _strings(counts[0], n[0], counts[1], n[1], least[0])
    pairs = []
    for asked, ordinary_least in [(z, low) for z in SIGNIFICANCE for low in (0.0, z)]:
        one = _dictionary(toxic, asked, dictionary_bytes) or b"".join(g for _, g in toxic[:4][::-1])
        one = one or b" " * 8
        # The strings ordinary text has most of, or only those it has significantly more of.
        two = _dictionary(ordinary, ordinary_least, len(one)).ljust(max(8, len(one)))
        pairs.append((one, two))
    rows = _calibration(check, text, label, pairs)
    y = np.array([k for k, _ in rows], float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    features = np.array([x for _, x in rows]).reshape(len(rows), len(pairs), -1)
    best = None
    for pair, (one, two) in enumerate(pairs):
        x = features[:, pair]
        center, scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - center) / scale])
        beta = _logistic(z, y, weight)
        quality = _ranking(z @ beta, y)
        if best is None or quality > best[0]:
            best = quality, ToxicityModel(one, two, tuple(beta), tuple(center), tuple(scale))
    return best[1]


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """All columns of `docs`, `score` (0 to 1) and `predicted` (1 from the threshold on).

    Whole texts are cut into windows, each compressed with both dictionaries. Null and empty texts
    get the score of a text without any toxic string. Without a model (no labels) the score is 0.
    Columns of these names in `docs` are replaced; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    at = docs.columns.index(text)

    def run(batches):
        lengths = Lengths((model.toxic, model.ordinary), model.window, fast(model.min_match))
        weights, center, scale = map(np.array, (model.weights, model.center, model.scale))
        for batch in batches:
            features = []
            for chunk in chunks(batch.column(at)):
                raw = chunk.data.tobytes()
                features += [
                    _text_features(lengths, raw[chunk.bounds[i] : chunk.bounds[i + 1]])
                    for i in range(len(chunk))
                ]
            x = (np.array(features).reshape(-1, len(center)) - center) / scale
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(run, fields(docs) + ", score double, predicted int")
