"""Corpus cleaning: toxicity, near-duplicates, benchmark passages, personal data, mixing.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and
further columns, and an empty table, as the operator it calls defines; all but the last hand
on the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oscilla.llm import decontam, mixing, pii, simhash, toxicity
from oscilla.llm.common import discard, materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic; null and empty texts stay."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id; rows without an id stay."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts as they are."""
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose weights meet source, language and topic targets; null sources and languages are a value of their own."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # learned models: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of a folder, each written and read again; the tables between are deleted once read."""
    docs = read_table(spark, sf_dir, "documents")
    done: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*done)  # what a stage read is no longer needed
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
