"""Language identification: the language whose dictionary compresses a text best."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptally.llm.arrays import chunks
from triptally.llm.compression import Lengths, fast, held_out, sample_by_class, thorough
from triptally.llm.tables import fields

UNKNOWN = "und"
NARROW = 0.02  # below this margin a text is compressed again, more thoroughly


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    window: int = 1024
    min_match: int = 4


def fit_languages(
    rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    per_language: int = 400, max_chars: int = 4000, dictionary_bytes: int = 24_576,
) -> LanguageModel:
    """Raw-content dictionaries from about `per_language` texts of each language (the bound of the
    sample). A text gives a piece that begins anywhere in it, and more where few texts are known. Rows
    without text or language teach nothing."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    texts: dict[str, list[bytes]] = {}
    for language, sample in sample_by_class(known, lang, text, key, per_language, max_chars):
        texts.setdefault(language, []).append(sample.encode())
    languages = tuple(sorted(texts))
    dictionaries = []
    for language in languages:
        own = texts[language]
        piece = max(1, dictionary_bytes // len(own))
        parts = [t[:piece] for t in own]
        rest = b" ".join(t[piece : 16 * piece] for t in own)
        fill = rest[: max(0, dictionary_bytes - sum(map(len, parts)) - len(parts))]
        dictionaries.append(fill + b" " + b" ".join(parts))
    return LanguageModel(languages, tuple(dictionaries))


def _best(total: np.ndarray) -> tuple[int, float]:
    """The dictionary with the smallest length and how much longer the second best is."""
    order = np.argsort(total, kind="stable")
    second = total[order[1]] if len(order) > 1 else 2 * total[order[0]]
    return int(order[0]), float(second / total[order[0]] - 1)


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = 0.002,
    prefix: str = "",
) -> DataFrame:
    """All columns of `docs` and `{prefix}lang_pred`, `{prefix}score`, `{prefix}margin`,
    `{prefix}rejected`.

    Each window of the whole text is compressed with every language's dictionary; the language with
    the smallest total wins, ties go to the first by name. `margin` is how much longer the second
    best is, as a share of the best; `score` turns it into 0 to 1. A text is rejected if it is
    null or has no letter (`und`, score and margin 0), or if the margin is below `min_margin`.
    Without a learned language every text is `und`. Columns of these names in `docs` are
    replaced; a `prefix` keeps them.
    """
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "margin", "rejected")]
    docs = docs.drop(*names)
    schema = fields(docs) + "".join(
        f", `{n}` {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True)
    )
    at = docs.columns.index(text)

    def run(batches):
        lengths = Lengths(model.dictionaries, model.window, fast(model.min_match))
        finer = Lengths(model.dictionaries, model.window, thorough())
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\p{L}"), False)
            letters = letters.to_numpy(zero_copy_only=False)
            best: list[str] = []
            margins = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column(at)):
                raw = chunk.data.tobytes()
                for i in range(len(chunk)):
                    row = chunk.first + i
                    if not letters[row] or not model.languages:
                        best.append(UNKNOWN)
                        continue
                    own = raw[chunk.bounds[i] : chunk.bounds[i + 1]]
                    total = lengths.of(own).sum(0)
                    first, margin = _best(total)
                    if margin < NARROW:
                        first, margin = _best(total + finer.of(own).sum(0))
                    best.append(model.languages[first])
                    margins[row] = margin
            known = np.array([b != UNKNOWN for b in best], bool)
            scores = np.where(known, 1 - 0.5 * np.exp(-40 * margins), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(scores), pa.array(margins),
                 pa.array(~known | (margins < min_margin))],
                names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, schema)


def known_languages(docs: DataFrame, model: LanguageModel, min_margin: float = 0.002) -> DataFrame:
    """The documents whose language is told; the others go. Columns stay as they are."""
    prefix = "__language_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    told = identify(docs, model, min_margin=min_margin, prefix=prefix)
    return told.where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def learn_from(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))
