"""Function context: who calls each changed function, what it calls, how risky it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from treeshift.functions.text import json_bytes, tokens_of_bytes
from treeshift.operators.call_graph import (
    FUNCTION,
    blast_radius,
    call_symbols,
    callees,
    caller_counts,
    callers,
    changed_modules,
    head_files,
    scan_scope,
    scanned_calls,
    scanned_files,
    scoping_mode,
)
from treeshift.operators.function_diff import source_blobs
from treeshift.operators.numbering import number_rows
from treeshift.operators.paging import (
    TOP_CALLEES,
    TOP_CALLERS,
    TOP_TESTS,
    clamp_lists,
    context_budget,
    mark_last_truncated,
    page_functions,
)
from treeshift.operators.symbols import extract_symbols
from treeshift.plans.manifest import STAMP_BYTES, Manifest
from treeshift.session import cut, settled
from treeshift.sources.repo_context import repo_context


CALLER_SHAPE = "file:string,line:bigint,caller:string,is_test:boolean"


@dataclass(frozen=True)
class Context:
    """Entries with their counts, and the lists behind them in long form.

    ``callers`` has production callers and test references, told apart by
    ``is_test``; a list of any length stays spread over tasks.
    """

    functions: DataFrame
    callers: DataFrame
    callees: DataFrame
    totals: DataFrame


def head_symbols(tree: DataFrame, ranges: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Symbols of every analysable blob at the ranges' heads, extracted once each."""
    files = head_files(tree, ranges)
    return extract_symbols(source_blobs(tree, files.select("blob_id").distinct()), languages)


def function_context(
    tree: DataFrame,
    ranges: DataFrame,
    function_changes: DataFrame,
    page_size: int | None = None,
    names: DataFrame | None = None,
    symbols: DataFrame | None = None,
) -> Context:
    """Context of all changed functions.

    Which files are scanned depends on the changed files of a page; without a
    ``page_size`` a range is one page.
    """
    if page_size is None:
        chosen = function_changes
        if names is not None:
            chosen = chosen.join(names.select("name").distinct(), "name", "left_semi")
        chosen = chosen.withColumn("page", F.lit(0).cast("bigint"))
    else:
        chosen = page_functions(function_changes, page_size, names)
    extra = [c for c in ("position", "offset") if c in chosen.columns]
    changed = cut(
        chosen.select("range_id", "page", *extra, "name", F.col("path").alias("file"), "change_type")
    )
    files = cut(head_files(tree, ranges))
    if symbols is None:
        blobs = source_blobs(tree, files.select("blob_id").distinct())
        symbols = settled(lambda: call_symbols(extract_symbols(blobs)))
    ctx = repo_context(tree, ranges)
    modules = cut(changed_modules(changed, ctx))
    scope = scan_scope(files, symbols, modules, ctx)
    calls = settled(lambda: scanned_calls(files, symbols, changed, scope))
    entries = scoping_mode(blast_radius(caller_counts(changed, calls)), modules)
    return Context(
        functions=entries,
        callers=callers(changed, calls),
        callees=callees(changed, files, symbols),
        totals=context_totals(entries, scanned_files(files, symbols, scope)),
    )


def context_totals(entries: DataFrame, scanned: DataFrame) -> DataFrame:
    """Functions, scanned files that hold any symbol, and callers, per page."""
    return (
        entries.groupBy("range_id", "page")
        .agg(F.count("*").alias("functions"), F.sum("caller_count").alias("total_callers"))
        .join(scanned, ["range_id", "page"], "left")
        .withColumn("files_scanned", F.coalesce("files_scanned", F.lit(0).cast("bigint")))
    )


def _edge_costs(edges: DataFrame, entry: list[str], order: list[str], keep: int, name: str) -> DataFrame:
    """Bytes of each function's list, whole and cut to its first ``keep`` edges."""
    size = json_bytes(F.struct(*entry)) + 1  # with its comma
    priced = edges.select(*FUNCTION, *order, *[c for c in entry if c not in order], size.alias("bytes"))
    whole = priced.groupBy(*FUNCTION).agg(F.sum("bytes").alias(f"{name}_all"))
    first = clamp_lists(priced, FUNCTION, order, keep)
    short = first.groupBy(*FUNCTION).agg(
        F.sum("bytes").alias(f"{name}_some"),
        F.sort_array(F.collect_list(F.struct(*order, F.struct(*entry).alias("entry")))).alias(f"{name}_first"),
    )
    return whole.join(short, FUNCTION)


def budgeted_context(context: Context, ranges: DataFrame, budget: int, page_size: int = 25) -> DataFrame:
    """A range's entries in pages that keep a token budget, with nested lists.

    Pages go on where the one before was cut; the edges of an entry are those found
    with the files of its page in ``context``, its ``scan_page``.

    List sizes are summed where the edges are. Lists are nested only for
    entries that are kept, so their length is bounded by the budget, or by
    5 callers, 5 callees and 3 tests where an entry is clamped.
    """
    # read for the sizes of the lists, for their first edges, and for the lists
    edges = cut(context.callers).withColumn("other", F.col("file")).withColumn("file", F.col("function_file"))
    called = cut(context.callees)
    caller_entry = ["site", "line", "caller", "is_test"]
    sites = edges.withColumn("site", F.col("other"))
    lists = {
        "callers": (sites.filter("NOT is_test"), caller_entry, ["site", "line", "ordinal"], TOP_CALLERS),
        "test_references": (sites.filter("is_test"), caller_entry, ["site", "line", "ordinal"], TOP_TESTS),
        "callees": (called, ["callee", "line"], ["line", "ordinal"], TOP_CALLEES),
    }
    entries = context.functions
    if "position" not in entries.columns:
        entries = number_rows(entries, ["range_id"], ["name", "file", "change_type"])
    for name, (df, entry, order, keep) in lists.items():
        entries = entries.join(_edge_costs(df, entry, order, keep, name), FUNCTION, "left")
    blast = F.struct("production_callers", "test_callers", "has_tests", "risk").alias("blast_radius")
    none = F.array().cast("array<string>")
    fixed = json_bytes(
        F.struct(
            "name", "file", "change_type", blast, "scoping_mode",
            none.alias("callers"), none.alias("callees"), none.alias("test_references"), "caller_count",
        )
    )

    def listed(suffix: str) -> Column:
        # n edges have n - 1 commas
        total = fixed
        for name in lists:
            size = F.col(f"{name}_{suffix}")
            total = total + F.coalesce(size - 1, F.lit(0))
        return tokens_of_bytes(total)

    totals = context.functions.groupBy("range_id").agg(F.count("*").alias("total_items"))
    skeleton = tokens_of_bytes(
        json_bytes(
            F.struct(
                F.struct("base_ref", "head_ref", F.lit(0).alias("token_estimate")).alias("metadata"),
                none.alias("functions"),
                F.struct(
                    "total_items",
                    F.lit(0).alias("page_start"),
                    F.lit(25).alias("page_size"),
                    F.lit(None).cast("string").alias("next_cursor"),
                ).alias("pagination"),
            )
        )
        + STAMP_BYTES
    )
    priced = cut(
        entries.withColumn("full_tokens", listed("all"))
        .withColumn("clamped_tokens", listed("some"))
        .join(ranges.select("range_id", "base_ref", "head_ref"), "range_id")
        .join(totals, "range_id")
        .withColumn("skeleton", skeleton)
        .withColumnRenamed("page", "scan_page")
        .drop("base_ref", "head_ref", "total_items")
    )
    kept = settled(lambda: mark_last_truncated(context_budget(priced, budget, F.col("skeleton"), page_size), totals))
    scanned = ["range_id", "scan_page", "name", "file"]
    out = kept
    for name, (df, entry, order, keep) in lists.items():
        whole = (
            df.withColumnRenamed("page", "scan_page")
            .join(kept.filter("tier = 'full'").select(*scanned), scanned, "left_semi")
            .groupBy(*scanned)
            .agg(
                F.sort_array(F.collect_list(F.struct(*order, F.struct(*entry).alias("entry")))).alias("_whole")
            )
        )
        shape = "callee:string,line:bigint" if name == "callees" else CALLER_SHAPE
        out = out.join(whole, scanned, "left").withColumn(
            name,
            F.coalesce(
                F.transform(
                    F.when(F.col("tier") == "full", F.col("_whole")).otherwise(F.col(f"{name}_first")),
                    lambda e: e["entry"],
                ),
                F.array(),
            ).cast(f"array<struct<{shape}>>"),
        ).drop("_whole", f"{name}_all", f"{name}_some", f"{name}_first")
    return out.drop("skeleton", "total_items")
