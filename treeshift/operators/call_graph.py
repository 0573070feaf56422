"""Callers, callees, test references and risk of changed functions.

A page's callers are looked for in some files only. These are never listed as
pages x files: the facts that decide meet the calls of changed leaf names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions import paths as P
from treeshift.functions.text import leaf_name
from treeshift.operators.function_diff import symbol_key
from treeshift.operators.modules import import_targets, module_keys, module_path, references
from treeshift.operators.symbols import calls_of, functions_of, imports_of
from treeshift.session import cut
from treeshift.sources.trees import with_blob_id

PAGE = ["range_id", "page"]
FUNCTION = [*PAGE, "name", "file"]


def head_files(tree: DataFrame, ranges: DataFrame) -> DataFrame:
    """Analysable files of every range's head: ``(range_id, path, blob_id)``."""
    t = with_blob_id(tree).filter(P.has_analyzer(F.col("path")))
    return (
        t.select("repo", F.col("ref").alias("head_ref"), "path", symbol_key(F.col("blob_id"), F.col("path")).alias("blob_id"))
        .join(ranges.select("range_id", "repo", "head_ref"), ["repo", "head_ref"])
        .select("range_id", "path", "blob_id")
    )


def call_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols to be written for a call graph, which reads no lines, signatures and digests of functions."""
    kept = F.transform("functions", lambda f: F.struct(f["ordinal"], f["name"], f["head"]))
    return symbols.withColumn("functions", kept)


def changed_modules(functions: DataFrame, repo_ctx: DataFrame) -> DataFrame:
    """Distinct changed files of a page with their module and whether it can be scoped."""
    return (
        functions.select(*PAGE, F.col("file").alias("path"))
        .distinct()
        .join(repo_ctx.select("range_id", "go_module"), "range_id", "left")
        .select(
            *PAGE,
            "path",
            module_path(F.col("path"), F.col("go_module")).alias("module"),
            P.supports_scoping(F.col("path")).alias("supports"),
        )
    )


def import_scope(files: DataFrame, symbols: DataFrame, modules: DataFrame, repo_ctx: DataFrame) -> DataFrame:
    """Files whose imports refer to a changed module: ``(range_id, page, path)``."""
    imports = (
        files.filter(P.supports_scoping(F.col("path")))
        .join(imports_of(symbols).select("blob_id", "import_text"), "blob_id")
        .join(repo_ctx, "range_id", "left")
    )
    targets = import_targets(imports)
    return references(targets, module_keys(modules)).select(*PAGE, "path").distinct()


def same_package(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Go files in the directory of a changed file, which need no import."""
    folder = P.parent_dir(F.col("path"))
    go = files.filter(P.extension_from_path(F.col("path")) == "go").select("range_id", "path", folder.alias("folder"))
    return go.join(modules.select(*PAGE, folder.alias("folder")).distinct(), ["range_id", "folder"]).select(
        *PAGE, "path"
    )


def page_fallback(modules: DataFrame) -> DataFrame:
    """``(range_id, page, fallback)``: does some changed file force a full scan?"""
    return modules.groupBy(*PAGE).agg(
        F.max(~F.col("supports") | F.col("module").isNull()).alias("fallback")
    )


@dataclass(frozen=True)
class Scope:
    """Where callers are looked for: everywhere for a page that falls back, else in the
    changed files, files whose language cannot be scoped, Go files of the same folder,
    and importers of a changed module."""

    pages: DataFrame  # range_id, page, fallback
    changed: DataFrame  # range_id, page, path
    folders: DataFrame  # range_id, page, folder
    modules: DataFrame  # range_id, page, kind, target: names a changed module is imported by
    imports: DataFrame  # range_id, path, kind, target: what a file imports


def scan_scope(files: DataFrame, symbols: DataFrame, modules: DataFrame, repo_ctx: DataFrame) -> Scope:
    imports = (
        files.filter(P.supports_scoping(F.col("path")))
        .join(imports_of(symbols).select("blob_id", "import_text"), "blob_id")
        .join(repo_ctx, "range_id", "left")
    )
    return Scope(
        pages=cut(page_fallback(modules)),
        changed=modules.select(*PAGE, "path").distinct(),
        folders=modules.select(*PAGE, P.parent_dir(F.col("path")).alias("folder")).distinct(),
        modules=module_keys(modules),
        imports=cut(import_targets(imports).distinct()),
    )


def _is_go(path: Column) -> Column:
    return P.extension_from_path(path) == "go"


def _listed(places: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Places with what their file imports, and others with the names of their page's modules.

    Each of ``places(range_id, page, path)`` has the shorter of the two lists: a page has
    few modules, a range may have many. Places without either import no changed module.
    """
    imports = scope.imports.groupBy("range_id", "path").agg(F.count("*").alias("imported"))
    modules = scope.modules.groupBy(*PAGE).agg(F.count("*").alias("names"))
    sized = cut(places.join(imports, ["range_id", "path"]).join(modules, PAGE))
    short, at = F.col("imported") <= F.col("names"), [*PAGE, "path"]
    return (
        sized.filter(short).select(at).join(scope.imports, ["range_id", "path"]),
        sized.filter(~short).select(at).join(scope.modules, PAGE),
    )


def _importers(places: DataFrame, scope: Scope) -> DataFrame:
    """Those of ``places(range_id, page, path)`` that import a changed module of their page."""
    at = [*PAGE, "path"]
    by_import, by_module = _listed(places, scope)
    named = by_import.join(scope.modules.hint("merge"), [*PAGE, "kind", "target"], "left_semi")
    told = by_module.join(scope.imports.hint("merge"), ["range_id", "path", "kind", "target"], "left_semi")
    return named.select(at).unionByName(told.select(at))


def _narrow(places: DataFrame, scope: Scope) -> DataFrame:
    """Those of distinct ``places(range_id, page, path)`` that a page reaches without falling back."""
    at = [*PAGE, "path"]
    in_folder = places.filter(_is_go(F.col("path"))).withColumn("folder", P.parent_dir(F.col("path")))
    return (
        places.join(scope.changed, at, "left_semi")
        .unionByName(in_folder.join(scope.folders, [*PAGE, "folder"], "left_semi").select(at))
        .unionByName(_importers(places, scope))
        .distinct()
    )


def scan_set(files: DataFrame, scope: Scope) -> DataFrame:
    """Files in which any page of a range looks for callers: ``(range_id, path, blob_id)``."""
    whole = scope.pages.groupBy("range_id").agg(F.max("fallback").alias("fallback"))
    one = lambda df: df.drop("page").distinct().withColumn("page", F.lit(0))  # noqa: E731  a range as one page
    marked = files.join(whole, "range_id").withColumn("open", F.col("fallback") | ~P.supports_scoping(F.col("path")))
    closed = marked.filter("NOT open").select("range_id", F.lit(0).alias("page"), "path")
    reached = _narrow(
        closed, Scope(scope.pages, one(scope.changed), one(scope.folders), one(scope.modules), scope.imports)
    ).select("range_id", "path")
    columns = ["range_id", "path", "blob_id"]
    found = marked.filter("NOT open").join(reached, ["range_id", "path"], "left_semi")
    return marked.filter("open").select(columns).unionByName(found.select(columns))


def scanned_files(files: DataFrame, symbols: DataFrame, scope: Scope) -> DataFrame:
    """``(range_id, page, files_scanned)``: scanned files that hold any symbol."""
    some = symbols.filter((F.size("functions") > 0) | (F.size("calls") > 0)).select("blob_id")
    path = F.col("path")
    held = files.join(some, "blob_id", "left_semi").select("range_id", "path")
    totals = held.groupBy("range_id").agg(
        F.count("*").alias("every"), F.count_if(~P.supports_scoping(path)).alias("unscoped")
    )
    narrow = scope.pages.filter("NOT fallback").select(*PAGE)
    go = held.filter(_is_go(path)).withColumn("folder", P.parent_dir(path))
    reached = (
        scope.changed.unionByName(go.join(scope.folders, ["range_id", "folder"]).select(*PAGE, "path"))
        .unionByName(references(scope.imports, scope.modules).select(*PAGE, "path"))
        .filter(P.supports_scoping(path))
        .join(narrow, PAGE, "left_semi")
        .distinct()
        .join(held, ["range_id", "path"], "left_semi")
        .groupBy(*PAGE)
        .agg(F.count("*").alias("reached"))
    )
    zero = F.lit(0).cast("bigint")
    scanned = F.when(F.col("fallback"), F.col("every")).otherwise(F.col("unscoped") + F.coalesce("reached", zero))
    return (
        scope.pages.join(totals, "range_id", "left")
        .join(reached, PAGE, "left")
        .select(*PAGE, F.coalesce(scanned, F.col("reached"), zero).alias("files_scanned"))
    )


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], share: int = 1000) -> DataFrame:
    """Inner join in which a hot key of ``rows`` is worked on by many tasks.

    Fewer than ``share`` keys can have more than 1/``share`` of all rows each. They
    are dealt out by a hash of ``spread`` in parts of about that size, and their
    ``facts`` go to every part.
    """
    weights = cut(rows.groupBy(*keys).agg(F.count("*").alias("weight")))
    limit = max(1, (weights.agg(F.sum("weight")).first()[0] or 0) // share)
    heavy = F.broadcast(  # fewer than ``share`` keys
        weights.filter(F.col("weight") > limit).select(*keys, F.ceil(F.col("weight") / limit).alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    salted = rows.join(heavy, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*spread), parts)).drop("parts")
    copied = facts.join(heavy, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    )
    return salted.join(copied.drop("parts"), [*keys, "salt"]).drop("salt")


def scanned_calls(files: DataFrame, symbols: DataFrame, functions: DataFrame, scope: Scope) -> DataFrame:
    """Calls in scanned files whose leaf name is that of a changed function of the page."""
    leaves = functions.select(*PAGE, leaf_name(F.col("name")).alias("leaf")).distinct()
    calls = calls_of(symbols).select("blob_id", "leaf", "line", "ordinal", "caller")
    sites = (
        calls.join(leaves.select("leaf").distinct(), "leaf", "left_semi")
        .join(files, "blob_id")
        .select("range_id", "path", "leaf", "line", "ordinal", "caller")
    )
    found = cut(salted_join(sites, leaves, ["range_id", "leaf"], ["path", "line", "ordinal"]))
    places = cut(found.select(*PAGE, "path").distinct().join(scope.pages, PAGE))
    everywhere = F.col("fallback") | ~P.supports_scoping(F.col("path"))
    kept = (
        places.filter(everywhere)
        .drop("fallback")
        .unionByName(_narrow(places.filter(~everywhere).drop("fallback"), scope))
    )
    return found.join(kept, [*PAGE, "path"], "left_semi").select(
        *PAGE, "leaf", F.col("path").alias("file"), "line", "ordinal", "caller",
        P.is_test_path(F.col("path")).alias("is_test"),
    )


def callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """A row per changed function and call of its leaf name, tests included."""
    wanted = functions.select(
        *PAGE, "name", F.col("file").alias("function_file"), leaf_name(F.col("name")).alias("leaf")
    )
    return salted_join(calls, wanted, [*PAGE, "leaf"], ["file", "line", "ordinal"]).select(
        *PAGE, "name", "function_file", "file", "line", "ordinal", "caller", "is_test"
    )


def caller_counts(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Production and test callers of every changed function.

    Calls are counted by leaf name before they meet the functions, so a name
    like ``new`` costs one row per page and not one per pair.
    """
    test = F.col("is_test")
    counted = calls.groupBy(*PAGE, "leaf").agg(
        F.count_if(~test).alias("production_callers"), F.count_if(test).alias("test_callers")
    )
    zero = F.lit(0).cast("bigint")
    joined = functions.withColumn("leaf", leaf_name(F.col("name"))).join(counted, [*PAGE, "leaf"], "left")
    production, tests = F.coalesce("production_callers", zero), F.coalesce("test_callers", zero)
    return joined.withColumn("production_callers", production).withColumn("test_callers", tests).withColumn(
        "caller_count", F.col("production_callers") + F.col("test_callers")
    ).drop("leaf")


def risk(production: Column, has_tests: Column) -> Column:
    return (
        F.when(production == 0, "none")
        .when((production <= 2) & has_tests, "low")
        .when((production <= 2) | has_tests, "medium")
        .otherwise("high")
    )


def blast_radius(counts: DataFrame) -> DataFrame:
    has_tests = F.col("test_callers") > 0
    return counts.withColumn("has_tests", has_tests).withColumn(
        "risk", risk(F.col("production_callers"), has_tests)
    )


def callees(functions: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls inside each changed function's lines at the head.

    Every call knows the functions it is in, and these are in its blob's row, so calls
    and functions meet there and are shuffled once, to meet the changed functions.
    """
    # by name; the first function of a name is the one that is looked into
    by_name = F.sort_array(F.transform("functions", lambda f: F.struct(f["name"], f["ordinal"], f["head"])))
    first = F.filter("named", lambda f, i: (i == 0) | (f["name"] != F.get("named", i - 1)["name"]))
    within = F.transform(
        "calls",
        lambda c: F.transform(
            c["inside"],
            lambda at: F.struct(
                F.get("named", F.array_position("named.head", at).cast("int") - 1)["name"].alias("name"),
                c["callee"].alias("callee"), c["line"].alias("line"), c["ordinal"].alias("ordinal"),
            ),
        ),
    )
    inside = (
        symbols.filter(F.size("calls") > 0)
        .select("blob_id", "calls", by_name.alias("named"))
        .withColumn("named", first)
        .select("blob_id", F.explode(F.flatten(within)).alias("c"))
        .select("blob_id", "c.*")
        .filter("name IS NOT NULL")
    )
    return (
        functions.select(*FUNCTION)
        .join(files.select("range_id", F.col("path").alias("file"), "blob_id"), ["range_id", "file"])
        .join(inside, ["blob_id", "name"])
        .select(*FUNCTION, "callee", "line", "ordinal")
    )


def containing_function(symbols: DataFrame, innermost: bool = False) -> DataFrame:
    """``(blob_id, line, ordinal, callee, caller)`` for every call.

    The caller is the first function in file order around the call, which for a
    method in Python or Ruby is its class; ``innermost`` gives the method.
    """
    calls = calls_of(symbols)
    if not innermost:
        return calls.select("blob_id", "line", "ordinal", "callee", "caller")
    names = functions_of(symbols).select("blob_id", F.col("head").alias("at"), "name")
    return (
        calls.withColumn("at", F.try_element_at("inside", F.lit(-1)))
        .join(names, ["blob_id", "at"], "left")
        .select("blob_id", "line", "ordinal", "callee", F.coalesce("name", F.lit("")).alias("caller"))
    )


def scoping_mode(functions: DataFrame, modules: DataFrame) -> DataFrame:
    """``scoped`` unless the language cannot be, or the page fell back."""
    mode = F.when(P.supports_scoping(F.col("file")) & ~F.col("fallback"), "scoped").otherwise("fallback")
    return functions.join(page_fallback(modules), PAGE).withColumn("scoping_mode", mode).drop("fallback")
