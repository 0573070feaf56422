"""Full content of chosen files before and after a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions import paths as P
from treeshift.functions.text import file_content, size_bytes, tokens_of_bytes
from treeshift.sources.trees import with_blob_id

MAX_FILES = 20  # of one request, where a caller asks for the first ones only


def limit_snapshot_files(requested: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """The first paths of each request, in the order asked (``ord``)."""
    asked = Window.partitionBy("range_id").orderBy("ord")
    return (
        requested.withColumn("rn", F.row_number().over(asked)).filter(F.col("rn") <= limit).drop("rn")
    )


def file_snapshots(
    tree: DataFrame,
    ranges: DataFrame,
    requested: DataFrame,
    include_before: bool = True,
    include_after: bool = True,
    max_file_size_bytes: int | None = None,
    line_range: tuple[int, int] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``requested(range_id, path, ord)``; a missing or undecodable side is NULL.

    All requested files with their whole content; ``limit`` and
    ``max_file_size_bytes`` cut on request only.
    """
    wanted = requested if limit is None else limit_snapshot_files(requested, limit)
    wanted = wanted.join(ranges, "range_id")
    content = with_blob_id(tree).select("repo", "ref", "path", "content")

    def side(ref: str, name: str, wanted_side: bool, into: DataFrame) -> DataFrame:
        if not wanted_side:
            return into.withColumn(name, F.lit(None).cast("string"))
        found = content.select(
            "repo", F.col("ref").alias(ref), "path", F.col("content").alias(name)
        )
        return into.join(found, ["repo", ref, "path"], "left")

    both = side("base_ref", "_before", include_before, wanted)
    both = side("head_ref", "_after", include_after, both)
    shown = both.withColumn("before", file_content(F.col("_before"), max_file_size_bytes, line_range)).withColumn(
        "after", file_content(F.col("_after"), max_file_size_bytes, line_range)
    )

    def binary(column: str) -> Column:
        c = F.col(column)
        return F.coalesce((c["content"] == "") & (c["size_bytes"] > 0), F.lit(False))

    return shown.select(
        "range_id",
        "ord",
        "path",
        P.detect_language(F.col("path")).alias("language"),
        (binary("before") | binary("after")).alias("is_binary"),
        "before",
        "after",
        F.lit(None).cast("string").alias("error"),
    )


def snapshot_tokens(snapshots: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    shown = F.coalesce(size_bytes(F.col("before.content")), zero) + F.coalesce(
        size_bytes(F.col("after.content")), zero
    )
    return snapshots.groupBy("range_id").agg(tokens_of_bytes(F.sum(shown)).alias("token_estimate"))
