"""Training data from raw documents, stage by stage.

Each stage takes all rows its predecessor kept, as a table read back from storage, and calls one of
the operators of `triptally.llm`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptally.llm import decontaminate, language_id, ngram_join, packing, pii
from triptally.llm.shipping import ship
from triptally.llm.tables import Steps, table, unused

KEY = "corpus pipeline"  # a real run has a secret one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; those rejected go."""
    ship(spark)
    model = language_id.fit_languages(language_id.learn_from(docs))
    return language_id.known_languages(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id; of equal
    rows with one doc_id, one. Rows without doc_id stay."""
    ship(spark)
    return ngram_join.without_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of `benchmark`."""
    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with pseudonyms for personal data; n_chars follows the text."""
    ship(spark)
    replaced = unused(docs.columns, "__replaced")
    told = pii.pseudonymize(docs, KEY, count=replaced)
    chars = F.when(F.col(replaced) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return told.withColumn("n_chars", chars.cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

# The stages are classifiers, alignments and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = steps.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
