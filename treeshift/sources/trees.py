"""Source trees: ``tree(repo, ref, path, content[, blob_id, size, binary, lines])``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeshift.functions import text as T
from treeshift.functions.languages import EXTENSIONS

STATISTICS = ["size", "binary", "lines"]


def scan_tree(spark: SparkSession, root: str, repo: str, ref: str) -> DataFrame:
    """The files below a directory as a tree; content is NULL unless valid UTF-8.

    ``blob_id`` is the SHA-256 of the raw bytes, so undecodable files still
    compare by identity. Paths are relative to the root, with or without the
    scheme and host that the file system puts in front.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    )
    bare = re.sub(r"^[A-Za-z0-9+.-]+:(?://[^/]*)?", "", base).strip("/")
    relative = F.regexp_replace("path", rf"^(?:[A-Za-z0-9+.-]+:(?://[^/]*)?)?/*\Q{bare}\E/+", "")
    return files.select(
        F.lit(repo).alias("repo"),
        F.lit(ref).alias("ref"),
        relative.alias("path"),
        T.decode_utf8(F.col("content")).alias("content"),
        F.sha2("content", 256).alias("blob_id"),
    )


def with_blob_id(tree: DataFrame) -> DataFrame:
    if "blob_id" in tree.columns:
        return tree
    return tree.withColumn("blob_id", F.sha2("content", 256))


def with_statistics(tree: DataFrame) -> DataFrame:
    """A tree with the blob id, size, binary flag and line count of each file; those it has are kept."""
    t = with_blob_id(tree)
    content = F.col("content")
    found = {"size": T.size_bytes(content), "binary": T.is_binary(content), "lines": T.text_lines(content)}
    return t.withColumns({name: found[name] for name in STATISTICS if name not in tree.columns})


def write_tree(tree: DataFrame, path: str, buckets: int | None = None) -> None:
    """Land a tree as Parquet by repository, clustered so that a ref prunes well.

    Identities and statistics are landed with it, so comparing trees reads no
    content. Replaces the repositories it brings and leaves all others in
    ``path`` alone.
    """
    out = with_statistics(tree)
    if buckets:
        out = out.repartition(buckets, "repo", "ref")
    out.sortWithinPartitions("ref", "path").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("repo").parquet(path)


def list_files(tree: DataFrame, repo: str, ref: str) -> DataFrame:
    return tree.filter((F.col("repo") == repo) & (F.col("ref") == ref)).select("path")


def file_index(tree: DataFrame) -> DataFrame:
    """A tree without its content: identity and statistics per file.

    A landed tree (see ``write_tree``) has them as columns, and its content is
    not read. Otherwise all is computed where the content is read, so that only
    these narrow columns enter a shuffle.
    """
    return with_statistics(tree).select("repo", "ref", "path", "blob_id", *STATISTICS)


def blobs(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(blob_id, content)``, once per distinct content; only the ``wanted(blob_id)`` ones if given.

    Unwanted content leaves before the shuffle that removes duplicates.
    """
    found = with_blob_id(tree).select("blob_id", "content")
    if wanted is not None:
        found = found.join(wanted.select("blob_id"), "blob_id", "left_semi")
    return found.dropDuplicates(["blob_id"])


def read_file_at_ref(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of ``wanted(repo, ref, path)``; missing or undecodable is an error."""
    found = with_blob_id(tree).select("repo", "ref", "path", "blob_id", "content")
    joined = wanted.join(found, ["repo", "ref", "path"], "left")
    error = F.when(F.col("blob_id").isNull(), "file_not_found").when(
        F.col("content").isNull(), "not_utf8"
    )
    return joined.withColumn("error", error)


def read_blob(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of ``wanted(blob_id)``."""
    return wanted.join(blobs(tree, wanted), "blob_id", "left")


def languages(spark: SparkSession) -> DataFrame:
    """The supported languages with their extensions."""
    rows = [(name, exts) for name, exts in sorted(EXTENSIONS.items())]
    return spark.createDataFrame(rows, "language string, extensions array<string>")
