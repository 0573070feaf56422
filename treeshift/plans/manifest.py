"""The change manifest: files, summary, functions, imports and dependencies of ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from treeshift.functions import paths as P
from treeshift.functions.languages import UNKNOWN
from treeshift.functions.text import json_bytes, tokens_of_bytes
from treeshift.operators.dependencies import dependency_diff
from treeshift.operators.file_diff import diff_trees, diff_worktree
from treeshift.operators.function_diff import changed_symbols, function_changes, import_diff
from treeshift.operators.line_churn import counted_lines
from treeshift.operators.paging import FILE_ENTRY, MAX_PAGE, clamp_page_size, manifest_budget, page_files
from treeshift.operators.renames import SIMILARITY, file_copies, file_renames, scoped_renames
from treeshift.session import settled

FUNCTION_CHANGE = ["name", "old_name", "change_type", "start_line", "end_line", "signature"]
STAMP_BYTES = 32  # a UTC timestamp with nanoseconds, quoted


@dataclass(frozen=True)
class Manifest:
    """A manifest whose parts are worked out when they are first read.

    ``changes`` are the changed files as compared, written; lines of modified files
    are counted for ``files`` and ``summary`` only.
    """

    changes: DataFrame
    tree: DataFrame
    analyse: bool = True
    page_size: int = MAX_PAGE
    exact_churn: bool = True

    @cached_property
    def counted(self) -> DataFrame:
        return settled(lambda: counted_lines(self.changes, self.tree, self.exact_churn))

    @cached_property
    def symbols(self) -> DataFrame:
        return settled(lambda: changed_symbols(self.tree, self.changes))

    @cached_property
    def function_changes(self) -> DataFrame | None:
        if not self.analyse:
            return None
        symbols = self.symbols  # kept, so not made on the way
        return settled(lambda: function_changes(self.changes, symbols))

    @cached_property
    def files(self) -> DataFrame:
        imports = import_diff(self.changes, self.symbols) if self.analyse else None
        return manifest_files(self.counted, self.function_changes, imports)

    @cached_property
    def summary(self) -> DataFrame:
        return manifest_summary(self.counted).join(total_functions_changed(self.files, self.page_size), "range_id")

    @cached_property
    def dependency_changes(self) -> DataFrame:
        return dependency_diff(self.changes, self.tree)


def manifest_summary(changes: DataFrame) -> DataFrame:
    """Counts over all changed files of a range, whatever is shown of them."""

    def of(*kinds: str) -> Column:
        return F.count_if(F.col("change_type").isin(*kinds))

    language = P.detect_language(F.col("path"))
    return changes.groupBy("range_id").agg(
        F.count("*").alias("total_files_changed"),
        of("added").alias("files_added"),
        of("modified").alias("files_modified"),
        of("deleted").alias("files_deleted"),
        of("renamed", "copied").alias("files_renamed"),
        F.sum("lines_added").alias("total_lines_added"),
        F.sum("lines_removed").alias("total_lines_removed"),
        languages_affected(language).alias("languages_affected"),
    )


def languages_affected(language: Column) -> Column:
    """Sorted known languages; at most as many as there are languages."""
    return F.array_sort(F.collect_set(F.when(language != UNKNOWN, language)))


def total_functions_changed(files: DataFrame, page_size: int) -> DataFrame:
    """NULL when nothing was analysed; ``needs_more_pages`` tells if the files exceed one page."""
    return files.groupBy("range_id").agg(
        F.sum(F.size(F.col("functions_changed")).cast("bigint")).alias("total_functions_changed"),
        (F.count("*") > clamp_page_size(page_size)).alias("needs_more_pages"),
    )


def functions_per_language(files: DataFrame) -> DataFrame:
    """Changed functions by known language, each file counted once."""
    return (
        files.filter((F.col("language") != UNKNOWN) & F.col("functions_changed").isNotNull())
        .groupBy("range_id", "language")
        .agg(F.sum(F.size("functions_changed")).alias("functions"))
    )


def manifest_files(
    changes: DataFrame, functions: DataFrame | None = None, imports: DataFrame | None = None
) -> DataFrame:
    """Changed files as they are reported.

    ``functions_changed`` and ``imports_changed`` are NULL for files that are
    not analysed and empty for files that are and did not change.
    """
    keys = ["range_id", "path", "change_scope"]
    path = F.col("path")
    entry_type = "array<struct<name:string,old_name:string,change_type:string,start_line:bigint,end_line:bigint,signature:string>>"
    import_type = "struct<added:array<string>,removed:array<string>>"
    files = changes.withColumn("language", P.detect_language(path)).withColumn(
        "is_generated", P.is_generated_path(path)
    )
    if functions is None or imports is None:
        files = files.withColumn("functions_changed", F.lit(None).cast(entry_type)).withColumn(
            "imports_changed", F.lit(None).cast(import_type)
        )
    else:
        # a group is the functions of one file
        listed = functions.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct(*FUNCTION_CHANGE))).alias("listed")
        )
        moved = imports.select(*keys, F.struct("added", "removed").alias("imports_changed"))
        analysed = P.has_analyzer(path)
        files = (
            files.join(listed, keys, "left")
            .join(moved, keys, "left")
            .withColumn(
                "functions_changed",
                F.when(analysed, F.coalesce("listed", F.array()).cast(entry_type)),
            )
        )
    return files.select("range_id", *FILE_ENTRY)


def change_manifest(
    tree: DataFrame,
    ranges: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    analyse: bool = True,
    renames: float | None = SIMILARITY,
    detect_renames: bool = True,
    exact_churn: bool = True,
    page_size: int = MAX_PAGE,
    detect_copies: bool = False,
) -> Manifest:
    """Everything that changed in every range.

    Paths are filtered before renames are looked for. ``renames=None`` pairs
    files of equal content only.
    """
    def compared() -> DataFrame:
        changes = diff_trees(tree, ranges, include, exclude)
        if detect_renames:
            changes = file_renames(changes, tree, renames)
        return file_copies(changes, tree, ranges, renames) if detect_copies else changes

    return Manifest(settled(compared), tree, analyse, page_size, exact_churn)


def worktree_manifest(
    tree: DataFrame,
    ranges: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    analyse: bool = True,
    page_size: int = MAX_PAGE,
    renames: float | None = SIMILARITY,
    detect_renames: bool = True,
) -> Manifest:
    """Staged and unstaged changes against each range's base, with renames among the staged ones."""
    def compared() -> DataFrame:
        changes = diff_worktree(tree, ranges, include, exclude)
        return scoped_renames(changes, tree, renames) if detect_renames else changes

    return Manifest(settled(compared), tree, analyse, page_size)


def budgeted_files(manifest: Manifest, ranges: DataFrame, budget: int, page_size: int = 100) -> DataFrame:
    """A manifest's files in pages, each trimmed to a token budget; every file is on one page.

    The skeleton is what a page costs without its files: refs, summary, paging.
    """
    deps = manifest.dependency_changes.groupBy("range_id").agg(
        F.sum(json_bytes(F.struct("name", "old_version", "new_version")) + 1).alias("dep_bytes")
    )
    fixed = json_bytes(
        F.struct(
            F.struct("repo", "base_ref", "head_ref", F.lit(0).alias("token_estimate")).alias("metadata"),
            F.struct(*[c for c in manifest.summary.columns if c != "range_id"]).alias("summary"),
            F.array().cast("array<string>").alias("files"),
            F.array().cast("array<string>").alias("dependency_changes"),
            F.struct(
                F.col("total_files_changed").alias("total_items"),
                F.lit(page_size).alias("page_start"),
                F.lit(page_size).alias("page_size"),
                F.lit(None).cast("string").alias("next_cursor"),
            ).alias("pagination"),
        )
    )
    skeleton = (
        manifest.summary.join(ranges, "range_id")
        .join(deps, "range_id", "left")
        .select(
            "range_id",
            tokens_of_bytes(fixed + STAMP_BYTES + F.coalesce("dep_bytes", F.lit(0))).alias("skeleton"),
        )
    )
    files = page_files(manifest.files, page_size).join(skeleton, "range_id")
    return manifest_budget(files, budget, F.col("skeleton"), page_size).drop("skeleton")
