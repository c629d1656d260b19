"""The corpus pipeline: documents without toxic ones, near copies and benchmark leaks, secrets masked, mixed by source.

Each stage takes the documents that its predecessor left and gives documents with the same columns; the last gives a row for
each draw of a document, with the columns of documents and those of the draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import decontam, mixing, ngram_join, secrets, toxicity
from logweir.llm.common import forget, freed, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it learns from all labels of documents that are here."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by [kind]."""
    return secrets.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the temperature mix, within a budget of as many tokens as the documents have."""
    return mixing.mix(docs, keep=tuple(docs.columns))


STAGES = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("secret scans", masked),
    ("temperature mixing", mixed),
]

#: None: what the first stage rejects depends on weights that are fitted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with freed() as stays:
            before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
            stays(docs)
        if hasattr(before, "_scratch_path"):  # a stage's table, not the input
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
