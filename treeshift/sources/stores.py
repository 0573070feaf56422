"""Tables keyed by blob id that outlive a run: contents, and symbols extracted once.

Both are bucketed and sorted by their key, so looking up some blobs moves only the
keys that are asked for; what is stored stays where it is. A blob never changes,
so a store only grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeshift.operators.function_diff import new_blobs
from treeshift.operators.symbols import extract_symbols
from treeshift.session import cut

BUCKETS = 64


class BlobStore:
    """A table ``name`` in the warehouse, or at ``path``, one row for each ``blob_id``.

    ``buckets`` is fixed when the table is made: a few times the cores that will
    read it, or more for tables of many terabytes.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str | None = None, path: str | None = None) -> None:
        # one task for each bucket, so an append adds one file to a bucket at most
        out = rows.repartition(self.buckets, "blob_id").write.bucketBy(self.buckets, "blob_id").sortBy("blob_id")
        where = path or self.path
        out = out.option("path", where) if where else out
        out.format("parquet").mode("append").saveAsTable(name or self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the rows whose blob is not known yet."""
        rows = rows.dropDuplicates(["blob_id"])
        self._append(new_blobs(rows, self.table()) if self.exists() else rows)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted(blob_id)``; only these ids are shuffled."""
        return self.table().join(wanted.select("blob_id").distinct(), "blob_id")

    def files_per_bucket(self) -> float:
        return len(self.table().inputFiles()) / self.buckets

    def compact(self, name: str, path: str | None = None) -> BlobStore:
        """A store ``name`` of the same rows with one sorted file for each bucket."""
        # under another expression, or Spark drops the shuffle and keeps the files apart
        self._append(self.table().withColumn("blob_id", F.concat("blob_id", F.lit(""))), name, path)
        return BlobStore(self.spark, name, path, self.buckets)


class ContentStore(BlobStore):
    """``(blob_id, content, ...)``: the text of every blob."""

    def write_blobs(self, tree: DataFrame) -> None:
        """Bring the blobs of a tree with ``blob_id`` and ``content`` into the store."""
        self.add(tree.select("blob_id", "content"))


class SymbolStore(BlobStore):
    """``(blob_id, language, functions, imports, calls)``, keyed by blob and language."""

    def update(self, wanted: DataFrame, content_of: Callable[[DataFrame], DataFrame]) -> int:
        """Extract the ``wanted(blob_id)`` that are not known yet and append them; how many were new.

        ``content_of`` gives ``(blob_id, language, content)`` of some ids. The ids are
        compared alone, so content of known blobs is not read.
        """
        ids = wanted.select("blob_id").distinct()
        fresh = cut(new_blobs(ids, self.table()) if self.exists() else ids)
        count = fresh.count()
        if count or not self.exists():
            self._append(extract_symbols(content_of(fresh)))
        return count
