"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest. New rows are reduced to one
row for each digest, compared with the index by a sort-merge anti-join that
reads the index without a shuffle, and what is new is appended.

Defined cases: a null text counts as empty. Of equal texts in one batch the row
with the largest doc_id stays; a digest that an earlier batch brought keeps that
batch's row. Null ids lose against any id; if a group has no id at all, its
keep_id is null. Rows that repeat both id and text are one document: the query
marks all of them as kept, ``drop_exact_copies`` leaves one. Extra columns are
carried by ``drop_exact_copies`` and ignored by ``exact_groups``. An empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeshift.llm.common import join_unique, scratch, staged


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the id that stands for it.

    ``path`` is a folder all executors share; an index that exists there is
    opened again. ``buckets`` only counts at creation and defaults to the
    session's shuffle partitions: choose it for the final size of the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, entries: DataFrame) -> None:
        """Append the entries (digest, keep_id; one row a digest) that the index lacks."""
        known = self.table().select("digest").hint("merge")
        new = entries.select("digest", F.col("keep_id").cast("bigint")).join(known, "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )


def resolve(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """Bring a batch (digest, doc_id) into the index; its digests with keep_id and group_size."""
    entries = staged(
        digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "digest-groups",
    )
    index.add(entries)
    return staged(entries.drop("keep_id").join(index.table(), "digest"), "digest-kept")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch(spark, "digest-index"))
    digests = staged(docs.select("doc_id", text_digest().alias("digest")), "digests")
    found = join_unique(digests, resolve(digests, index), "digest", "group_size")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row of each text; texts of the index that came earlier go."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch(spark, "digest-index"))
    as_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digests = docs.select("doc_id", text_digest().alias("digest"))
    kept = resolve(staged(digests, "digests"), index).select(
        "digest", F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("id")
    )
    # the row goes as one column, so that names do not clash; the id is part of the
    # key, so even a huge group of copies is spread evenly
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return (
        docs.select(text_digest().alias("digest"), as_key.alias("id"), row)
        .join(kept, ["digest", "id"], "left_semi")
        .dropDuplicates(["digest", "id"])
        .select("row.*")
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       max(doc_id) OVER same IS NOT DISTINCT FROM doc_id AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
