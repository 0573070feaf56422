"""Pages, stale ranges and size budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions.text import json_bytes, tokens_of_bytes
from treeshift.operators.greedy_pages import greedy_pages
from treeshift.operators.numbering import number_rows
from treeshift.session import cut

MAX_PAGE = 500  # the usual page of files; larger ones are made on request
TOP_CALLERS, TOP_CALLEES, TOP_TESTS = 5, 5, 3


def clamp_page_size(size: int) -> int:
    return max(1, size)


def paged(df: DataFrame, by: list[str], order: list[str], page_size: int) -> DataFrame:
    """All pages at once: adds ``position``, ``page`` and ``offset`` in the page."""
    size = clamp_page_size(page_size)
    numbered = number_rows(df, by, order)
    return numbered.withColumn("page", F.floor(F.col("position") / size)).withColumn(
        "offset", F.col("position") % size
    )


def page_files(changes: DataFrame, page_size: int) -> DataFrame:
    return paged(changes, ["range_id"], ["path", "change_scope"], page_size)


def page_functions(
    functions: DataFrame, page_size: int = 25, names: DataFrame | None = None
) -> DataFrame:
    """Changed functions by (name, path); a name filter narrows them before paging."""
    if names is not None:
        functions = functions.join(names.select("name").distinct(), "name", "left_semi")
    return paged(functions, ["range_id"], ["name", "path", "change_scope"], page_size)


def page_commits(walk: DataFrame, page_size: int) -> DataFrame:
    """A walk is numbered already, so its pages are plain arithmetic."""
    size = clamp_page_size(page_size)
    return walk.filter("error IS NULL").withColumn("page", F.floor(F.col("seq") / size)).withColumn(
        "offset", F.col("seq") % size
    )


def stale_ranges(recorded: DataFrame, refs: DataFrame) -> DataFrame:
    """Recorded ranges whose base or head has moved since, or is gone."""

    def now(side: str) -> DataFrame:
        return refs.select("repo", F.col("ref").alias(f"{side}_ref"), F.col("sha").alias(f"{side}_now"))

    return (
        recorded.join(now("base"), ["repo", "base_ref"], "left")
        .join(now("head"), ["repo", "head_ref"], "left")
        .filter(
            ~F.col("base_sha").eqNullSafe(F.col("base_now"))
            | ~F.col("head_sha").eqNullSafe(F.col("head_now"))
        )
    )


def next_offset(budget_cutoff: Column, page_cutoff: Column) -> Column:
    """The earlier of two cut-offs, either of which may be missing."""
    return F.least(budget_cutoff, page_cutoff)


def split_budget(budget: Column) -> Column:
    """Shares of 40 and 60 percent; 0 stays 0, which means no limit."""
    return F.struct(
        F.floor(budget * F.lit(0.4).cast("double")).cast("bigint").alias("manifest_budget"),
        F.round(budget * F.lit(0.6).cast("double")).cast("bigint").alias("context_budget"),
    )


def clamp_lists(edges: DataFrame, by: list[str], order: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group; Spark limits groups before the shuffle."""
    first = Window.partitionBy(*by).orderBy(*order)
    return edges.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= keep)


def _room(budget: int | Column, skeleton: int | Column, share: int, least: int) -> Column:
    """What a page has for its rows: the budget without skeleton and safety margin."""
    whole = F.lit(budget) if isinstance(budget, int) else budget
    fixed = F.lit(skeleton) if isinstance(skeleton, int) else skeleton
    margin = F.greatest(F.floor(whole / share), F.lit(least))
    return F.greatest(F.greatest(whole - fixed, F.lit(0)) - margin, F.lit(0)).cast("bigint")


def _on_pages(priced: DataFrame, page_size: int, whole: list, choices: list) -> DataFrame:
    """``priced(range_id, position, _room, ...)`` with its pages and where each goes on."""
    pages = greedy_pages(priced, ["range_id"], F.col("_room"), clamp_page_size(page_size), whole, choices)
    following = next_offset(F.col("budget_cutoff"), F.col("page_cutoff"))
    return priced.join(
        pages.withColumn("next_offset", following).drop("budget_cutoff", "page_cutoff"), ["range_id", "position"]
    ).drop("_room")


def manifest_budget(
    files: DataFrame, budget: int | Column, skeleton: Column | int = 0, page_size: int = MAX_PAGE
) -> DataFrame:
    """Cut the files of a range into pages that keep a token budget.

    ``files(range_id, position, ..., functions_changed, imports_changed)`` with the
    entry's columns as they are serialised. Adds ``page``, ``page_start``,
    ``offset``, ``next_offset`` (of the page behind, if there is one) and ``tier``:
    ``full``; ``functions`` when an entry's imports go; ``bare`` when functions go
    too. A page ends before the first file that does not even fit bare, and the
    next one starts with it; a file that fits on no page is ``over_budget`` and
    has its own.
    """
    none_imports = F.lit(None).cast(files.schema["imports_changed"].dataType).alias("imports_changed")
    none_functions = F.lit(None).cast(files.schema["functions_changed"].dataType).alias("functions_changed")
    plain = [c for c in FILE_ENTRY if c not in ("functions_changed", "imports_changed")]

    def cost(*tail: Column | str) -> Column:
        return tokens_of_bytes(json_bytes(F.struct(*plain, *tail)))

    priced = cut(
        files.drop("page", "offset").select(
            "*",
            _room(budget, skeleton, 20, 16).alias("_room"),
            cost("functions_changed", "imports_changed").alias("_full"),
            cost("functions_changed", none_imports).alias("_some"),
            cost(none_functions, none_imports).alias("_bare"),
        )
    )
    analysed = F.when(F.col("functions_changed").isNotNull(), F.col("_some"))
    paged_files = _on_pages(
        priced,
        page_size,
        whole=[("full", F.col("_full")), ("no_imports", F.col("_some"))],
        choices=[("functions", analysed), ("bare", F.col("_bare"))],
    )
    lost = F.when(F.col("imports_changed").isNull(), "full").otherwise("functions")
    return (
        paged_files.withColumn("tier", F.when(F.col("tier") == "no_imports", lost).otherwise(F.col("tier")))
        .withColumn("imports_changed", F.when(F.col("tier") == "full", F.col("imports_changed")))
        .withColumn("functions_changed", F.when(F.col("tier") != "bare", F.col("functions_changed")))
        .drop("_full", "_some", "_bare")
    )


# a file of a manifest as it is serialised, in order
FILE_ENTRY = [
    "path",
    "old_path",
    "change_type",
    "change_scope",
    "language",
    "is_binary",
    "is_generated",
    "lines_added",
    "lines_removed",
    "size_before",
    "size_after",
    "functions_changed",
    "imports_changed",
]


def context_budget(
    entries: DataFrame, budget: int | Column, skeleton: Column | int = 0, page_size: int = 25
) -> DataFrame:
    """Cut the entries of a range into pages that keep a token budget.

    ``entries(range_id, position, full_tokens, clamped_tokens, ...)``. Adds the same
    columns as ``manifest_budget``; an entry is ``full`` if it fits so, else
    ``clamped``, and else it starts the next page.
    """
    priced = cut(entries.drop("page", "offset").withColumn("_room", _room(budget, skeleton, 4, 128)))
    full = ("full", F.col("full_tokens"))
    return _on_pages(priced, page_size, [full], [full, ("clamped", F.col("clamped_tokens"))]).withColumn(
        "truncated", F.col("tier") == "clamped"
    )


def trimmed_entries(kept: DataFrame, name: str) -> DataFrame:
    """(range_id, page, offset, ``name``) of the entries that a budget has shortened."""
    return kept.filter(F.col("tier").isin("functions", "clamped")).select("range_id", "page", "offset", name)


def mark_last_truncated(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Flag a page's last kept entry when entries of its range follow it.

    ``totals(range_id, total_items)``.
    """
    page = Window.partitionBy("range_id", "page")
    last = (F.col("offset") == F.max("offset").over(page)) & (F.col("position") + 1 < F.col("total_items"))
    return kept.join(totals, "range_id").withColumn("truncated", F.col("truncated") | last)
