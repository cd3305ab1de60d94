"""A corpus pipeline of five stages; each takes all documents that the stage before it kept.

1. quality_classifier: documents that a factorisation machine rejects as low quality or toxic go.
2. ngram_jaccard_join: of each group of near copies the lowest doc_id stays.
3. benchmark_decontamination: documents that hold a benchmark item, or a near copy of one, go.
4. pii: personal data become format-preserving pseudonyms.
5. packing: the documents are packed into training windows of three lengths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, ngram_join, packing, pseudonyms, quality
from glyphmill.scratch import delete, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither machine rejects; null texts and texts without words go, null ids are judged like others."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, repeated rows included; null ids and texts without words are in no group."""
    return ngram_join.drop_near_duplicates(docs, n=3, least=0.5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window like a benchmark item; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data; null and empty texts stay as they are."""
    return pseudonyms.pseudonyms(docs, pseudonyms.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each training window with its pieces of documents; null and empty texts aren't packed."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", pack),
]

# The classifier, the keyed pseudonyms and the greedy packing have no SQL form; tests/llm checks the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A stage's table goes once the next one is written, the last with the session.
    """
    root, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if number:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    delete(spark, root, at_end=True)
    return docs
