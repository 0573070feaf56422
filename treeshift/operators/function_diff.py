"""Function and import changes of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions import paths as P
from treeshift.operators.symbols import extract_symbols, functions_of
from treeshift.sources.trees import with_blob_id

KEY = ["range_id", "path"]


def symbol_key(blob: Column, path: Column) -> Column:
    """A blob as one language: the same text may be both a ``.ts`` and a ``.js``."""
    return F.concat(blob, F.lit(":"), P.detect_language(path))


def source_blobs(tree: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Analysable blobs of a tree, once each; only the ``wanted(blob_id)`` ones if given."""
    files = with_blob_id(tree).filter(P.has_analyzer(F.col("path"))).select(
        symbol_key(F.col("blob_id"), F.col("path")).alias("blob_id"),
        P.detect_language(F.col("path")).alias("language"),
        "content",
    )
    if wanted is not None:
        files = files.join(wanted, "blob_id", "left_semi")
    return files.dropDuplicates(["blob_id"])


def new_blobs(blobs: DataFrame, known_symbols: DataFrame) -> DataFrame:
    """Blobs that earlier runs have not extracted yet."""
    return blobs.join(known_symbols.select("blob_id"), "blob_id", "left_anti")


def changed_keys(changes: DataFrame, pair_renamed: bool = False) -> DataFrame:
    """Changed analysable files with the symbol keys of both sides.

    A renamed file has no base under its new path, so its functions are all
    added; ``pair_renamed`` compares with the old path's content instead.
    """
    base = symbol_key(F.col("base_blob"), F.coalesce("old_path", "path"))
    if not pair_renamed:
        base = F.when(F.col("old_path").isNull(), base)
    return changes.filter(P.has_analyzer(F.col("path"))).select(
        *KEY, "change_scope", base.alias("base_key"), symbol_key(F.col("head_blob"), F.col("path")).alias("head_key")
    )


def changed_sides(changes: DataFrame, pair_renamed: bool = False) -> DataFrame:
    """``(range_id, path, change_scope, side, blob_id)``, a row per existing side."""
    return (
        changed_keys(changes, pair_renamed)
        .select(
            *KEY,
            "change_scope",
            F.explode(
                F.array(
                    F.struct(F.lit("base").alias("side"), F.col("base_key").alias("blob_id")),
                    F.struct(F.lit("head").alias("side"), F.col("head_key").alias("blob_id")),
                )
            ).alias("s"),
        )
        .select(*KEY, "change_scope", "s.*")
        .filter("blob_id IS NOT NULL")
    )


def changed_symbols(
    tree: DataFrame, changes: DataFrame, languages: list[str] | None = None, pair_renamed: bool = False
) -> DataFrame:
    """Symbols of the changed files only, both sides."""
    wanted = changed_sides(changes, pair_renamed).select("blob_id").distinct()
    return extract_symbols(source_blobs(tree, wanted), languages)


def function_diff(changes: DataFrame, symbols: DataFrame, pair_renamed: bool = False) -> DataFrame:
    """Functions compared by name; a mere change of order or line is no change.

    Both sides come from one join with the functions and meet in one
    aggregation by (range, path, name), so a huge file is spread by name.
    """
    # of several functions of one name in a file the last one counts
    last = Window.partitionBy("blob_id", "name").orderBy(F.desc("ordinal"))
    functions = functions_of(symbols).withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    fields = ["signature", "body_hash", "start_line", "end_line"]

    def side(name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.struct(*fields))).alias(name)

    both = (
        changed_sides(changes, pair_renamed)
        .join(functions.select("blob_id", "name", *fields), "blob_id")
        .groupBy(*KEY, "change_scope", "name")
        .agg(side("base"), side("head"))
        .select(
            *KEY,
            "change_scope",
            "name",
            *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("base", "head") for f in fields],
        )
    )
    kind = (
        F.when(F.col("base_body_hash").isNull(), "added")
        .when(F.col("head_body_hash").isNull(), "deleted")
        .when(F.col("base_signature") != F.col("head_signature"), "signature_changed")
        .when(F.col("base_body_hash") != F.col("head_body_hash"), "modified")
    )

    def shown(column: str) -> Column:
        return F.coalesce(f"head_{column}", f"base_{column}").alias(column)

    return (
        both.withColumn("change_type", kind)
        .filter("change_type IS NOT NULL")
        .select(
            *KEY,
            "change_scope",
            "name",
            "change_type",
            shown("start_line"),
            shown("end_line"),
            shown("signature"),
            shown("body_hash"),
        )
    )


def function_renames(diff: DataFrame) -> DataFrame:
    """Pair added with deleted functions of one file that have the same body.

    Only functions that changed by name are paired, one to one in name order;
    a group is the functions of one file that share a body.
    """
    same = Window.partitionBy(*KEY, "change_scope", "body_hash", "change_type").orderBy("name")
    loose = diff.filter(F.col("change_type").isin("added", "deleted")).withColumn(
        "rn", F.row_number().over(same)
    )
    keys = [*KEY, "change_scope", "body_hash", "rn"]
    deleted = loose.filter("change_type = 'deleted'").select(*keys, F.col("name").alias("old_name"))
    return loose.filter("change_type = 'added'").join(deleted, keys).select(
        *KEY, "change_scope", "name", "old_name"
    )


def function_changes(changes: DataFrame, symbols: DataFrame, pair_renamed: bool = False) -> DataFrame:
    """All function changes, with renames folded into one row.

    Pairs are formed by a second numbering within the rows of ``function_diff``
    instead of a join back, so the extraction is read once.
    """
    diff = function_diff(changes, symbols, pair_renamed)
    group = [*KEY, "change_scope", "body_hash"]
    loose = F.col("change_type").isin("added", "deleted")
    within = Window.partitionBy(*group, "change_type").orderBy("name")
    numbered = diff.withColumn("rn", F.when(loose, F.row_number().over(within)))
    # the added and the deleted function with the same number are a rename
    pair = Window.partitionBy(*group, F.coalesce("rn", F.lit(0)), F.when(loose, F.lit(1)))
    paired = numbered.withColumn(
        "old_name",
        F.when(loose, F.max(F.when(F.col("change_type") == "deleted", F.col("name"))).over(pair)),
    ).withColumn(
        "has_new", F.when(loose, F.max(F.when(F.col("change_type") == "added", F.lit(True))).over(pair))
    )
    is_new = F.col("change_type") == "added"
    renamed = is_new & F.col("old_name").isNotNull()
    gone = (F.col("change_type") == "deleted") & F.coalesce(F.col("has_new"), F.lit(False))
    return paired.filter(~gone).select(
        *KEY,
        "change_scope",
        "name",
        F.when(renamed, F.col("old_name")).alias("old_name"),
        F.when(renamed, F.lit("renamed")).otherwise(F.col("change_type")).alias("change_type"),
        "start_line",
        "end_line",
        "signature",
    )


def import_diff(changes: DataFrame, symbols: DataFrame, pair_renamed: bool = False) -> DataFrame:
    """Sorted imports added to and removed from each analysable changed file."""
    empty = F.array().cast("array<string>")

    def side(name: str) -> Column:
        return F.coalesce(
            F.first(F.when(F.col("side") == name, F.col("imports")), ignorenulls=True), empty
        ).alias(name)

    joined = (
        changed_sides(changes, pair_renamed)
        .join(symbols.select("blob_id", "imports"), "blob_id", "left")
        .groupBy(*KEY, "change_scope")
        .agg(side("base"), side("head"))
    )
    return joined.select(
        *KEY,
        "change_scope",
        F.array_sort(F.array_except("head", "base")).alias("added"),
        F.array_sort(F.array_except("base", "head")).alias("removed"),
    )
