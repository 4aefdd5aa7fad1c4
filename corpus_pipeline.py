"""A training corpus out of `documents`: language, near-copies, benchmark, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; `run` writes every stage's
rows to the shared folder, hands the table to the next one and deletes what the stage wrote on
the way. All but the last return the columns of `documents`; the last returns the mixed blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelwatch.llm import decontaminate, langid, mixing, pii, simhash
from parcelwatch.llm.common import prepare, settled, table

#: Below this probability a document counts as being in no known language.
MIN_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without letters or a clear language goes."""
    prepare(spark)
    return langid.keep_identified(docs, langid.train(docs), min_score=MIN_LANGUAGE_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: fingerprints that differ in three bits or fewer."""
    return simhash.deduplicate(docs, simhash.CLOSE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or not."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return pii.redact_documents(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of words, mixed to the sources' target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: No SQL can state a trained classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
