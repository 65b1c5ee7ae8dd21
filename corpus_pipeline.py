"""From raw documents to packed bins: five stages over all documents.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns documents, with all their columns; the last returns the bins: a row for each
piece of a document, with its bin, its place in the document and its token ids. Between
stages the documents are written as Parquet and read again, which ends their lineage.

Handling of nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns is that of the operators: a null or empty text is rejected by the first
stage, and a row without a doc_id goes through to the last, judged by its text; extra
columns travel up to the last stage, whose pieces name their document by doc_id and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import decontam, exact, packing, quality, simhash
from veilspan.llm.common import fresh_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text the first stays."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one document stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins and token ids."""
    return packing.with_tokens(docs, packing.packed(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier is fitted iteratively, which SQL can't express. tests/llm takes the documents that the classifier and
#: SimHash name (both tested on their own), does all else by hand and compares run()'s tokens with that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
