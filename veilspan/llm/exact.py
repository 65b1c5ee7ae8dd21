"""Exact deduplication against a persistent digest index.

The index is a Parquet table of (digest, doc_id), bucketed and sorted by digest.
New documents are reduced to one row a digest, go through a sort-merge anti-join
against the index, and those that are new are appended. ``ingest`` and ``duplicates``
shuffle digests and ids only; ``deduplicated`` moves the documents once, by doc_id, or
not at all where the list of those that go is small enough for Spark to broadcast it.
Every append adds one sorted file a bucket; ``compacted`` merges them again.

Defined results
* null text: never a duplicate, never in the index;
* empty text: a text like any other;
* null doc_id: neither in the index nor reported; ``deduplicated`` keeps the row;
* very long texts: only their digest is kept;
* ties: a text stays with the document that was ingested first, of one ingest's the smallest doc_id;
* repeated rows (same doc_id and text): one stays where documents are filtered,
  none is reported as a duplicate of itself;
* empty tables: empty results;
* extra columns: passed on by ``deduplicated``, ignored by ``ingest``; columns
  named like ours do no harm, as only doc_id and text are ever taken by name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored


def digest_of(text):
    """SHA-256 of the UTF-8 bytes of a text."""
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """A digest table at ``path``; opening it again finds what earlier runs left."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        # as many tasks as buckets: each writes one sorted file
        fresh.select("digest", "doc_id").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """The same index at another path, with one sorted file a bucket."""
        new = DigestIndex(self.spark, path, self.buckets)
        new.append(self.rows())
        return new


def ingest(index: DigestIndex, docs: DataFrame) -> DataFrame:
    """Add ``docs`` to ``index``; returns (doc_id, digest, owner): owner is the document that keeps the text."""
    slim = stored(docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest")), "digests")
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    fresh = firsts.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh)
    owners = index.rows().select("digest", F.col("doc_id").alias("owner"))
    return slim.join(owners.hint("merge"), "digest").select("doc_id", "digest", "owner")


def _losers(docs: DataFrame, index: DigestIndex | None) -> DataFrame:
    index = index or DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    return ingest(index, docs).where("doc_id <> owner")


def duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """(doc_id, duplicate_of): each document whose text another one keeps, and that one."""
    return _losers(docs, index).select("doc_id", F.col("owner").alias("duplicate_of"))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns. Of repeated rows one stays."""
    lost = _losers(docs, index).select(F.col("doc_id").alias("__lost"), F.col("digest").alias("__digest")).distinct()
    kept = docs.join(lost, (docs["doc_id"] == lost["__lost"]) & (digest_of(docs["text"]) == lost["__digest"]), "left_anti")
    # only ids that occur twice can be repeated rows; where there is none, the documents are read and moved once
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__twice"))
    twice = stored(twice, "repeated-ids")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti")
    again = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi")
    return once.unionByName(again.where("text IS NOT NULL").dropDuplicates(["doc_id", "text"])).unionByName(again.where("text IS NULL"))
