"""Call graph and function context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeshift import fixtures as fx
from treeshift.catalog.changes import CODE_FILES, FILE_TIER, code_functions, file_costs
from treeshift.catalog.files import over_paths
from treeshift.catalog.registry import greedy_sql, once, one_range, query, recursive, sql, written
from treeshift.operators import call_graph as K, modules as Mo, paging as G
from treeshift.operators.function_diff import source_blobs
from treeshift.operators.symbols import extract_symbols
from treeshift.operators.telemetry import files_touched
from treeshift.plans import context as X, review as V
from treeshift.session import cut, settled
from treeshift.sources.trees import with_blob_id


def graph_tree(spark, sf) -> DataFrame:
    """The crate with its callers, written once with its blob ids."""
    return written(spark, sf, "graph_tree", lambda: with_blob_id(fx.view(spark, sf, "graph_tree")))


def graph_files(spark, sf) -> DataFrame:
    return written(spark, sf, "graph_files", lambda: K.head_files(graph_tree(spark, sf), one_range(spark, "r1")))


def graph(spark, sf):
    """Tree, range, head files and symbols of the crate with its callers."""
    tree, files = graph_tree(spark, sf), graph_files(spark, sf)
    symbols = once(
        spark, sf, "graph_symbols",
        lambda: settled(
            lambda: K.call_symbols(extract_symbols(source_blobs(tree, files.select("blob_id").distinct()), ["rust"]))
        ),
    )
    return tree, one_range(spark, "r1"), files, symbols


def changed(spark, sf) -> DataFrame:
    return code_functions(spark, sf).select(
        "range_id", F.lit(0).cast("bigint").alias("page"), "name", F.col("path").alias("file"), "change_type"
    )


def no_context(ranges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return ranges.select("range_id", none.alias("rust_crate_name"), none.alias("go_module"))


def modules(spark, sf) -> DataFrame:
    return K.changed_modules(changed(spark, sf), no_context(one_range(spark, "r1")))


def scope(spark, sf) -> K.Scope:
    _, ranges, files, symbols = graph(spark, sf)
    return once(
        spark, sf, "graph_scope", lambda: K.scan_scope(files, symbols, modules(spark, sf), no_context(ranges))
    )


def calls(spark, sf) -> DataFrame:
    _, _, files, symbols = graph(spark, sf)
    functions, at = changed(spark, sf), scope(spark, sf)
    return once(
        spark, sf, "graph_calls", lambda: settled(lambda: K.scanned_calls(files, symbols, functions, at))
    )


# calls of a changed function from files that import its module (even suppliers)
EDGES = """, e AS (SELECT t.name, t.path AS function_file, r.path AS file, r.caller, l_suppkey % 5 = 0 AS is_test,
  2 * row_number() OVER (PARTITION BY r.path ORDER BY k) AS line, t.change_type
  FROM (SELECT *, 'function_' || CAST(l_partkey AS VARCHAR) AS callee FROM call_rows WHERE l_suppkey % 2 = 0) r
  LEFT JOIN code_truth t ON t.name = r.callee),
n AS (SELECT t.name, t.path, count(*) FILTER (WHERE NOT is_test) AS production_callers,
  count(*) FILTER (WHERE is_test) AS test_callers FROM code_truth t LEFT JOIN e ON e.name = t.name GROUP BY t.name, t.path)
"""
VIEWS = ["call_rows", "code_truth"]


@query("callers", sql(VIEWS, EDGES + "SELECT name, file, line, caller, is_test FROM e WHERE name IS NOT NULL"))
def callers(spark, sf):
    return K.callers(changed(spark, sf), calls(spark, sf)).select("name", "file", "line", "caller", "is_test")


@query("caller_counts", sql(VIEWS, EDGES + "SELECT name, path AS file, production_callers, test_callers FROM n"))
def caller_counts(spark, sf):
    return K.caller_counts(changed(spark, sf), calls(spark, sf)).select(
        "name", "file", "production_callers", "test_callers"
    )


RISK = """CASE WHEN production_callers = 0 THEN 'none' WHEN production_callers <= 2 AND test_callers > 0 THEN 'low'
  WHEN production_callers <= 2 THEN 'medium' WHEN test_callers > 0 THEN 'medium' ELSE 'high' END"""


@query("blast_radius", sql(VIEWS, EDGES + f"SELECT name, path AS file, test_callers > 0 AS has_tests, {RISK} AS risk FROM n"))
def blast_radius(spark, sf):
    counts = K.caller_counts(changed(spark, sf), calls(spark, sf))
    return K.blast_radius(counts).select("name", "file", "has_tests", "risk")


@query(
    "containing_function",
    sql(["call_rows"], "SELECT 'function_' || CAST(l_partkey AS VARCHAR) AS callee, caller FROM call_rows"),
)
def containing_function(spark, sf):
    return K.containing_function(graph(spark, sf)[3]).select("callee", "caller")


@query(
    "callees",
    sql(["call_rows"], "SELECT caller AS name, path AS file, 'function_' || CAST(l_partkey AS VARCHAR) AS callee FROM call_rows"),
)
def callees(spark, sf):
    _, _, files, symbols = graph(spark, sf)
    # names stay in lists until they are distinct in their file
    names = symbols.select("blob_id", F.filter("functions.name", lambda n: n.like("c_%")).alias("names"))
    functions = (
        files.join(names, "blob_id")
        .groupBy("range_id", F.col("path").alias("file"))
        .agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
        .select("range_id", F.lit(0).cast("bigint").alias("page"), F.explode("names").alias("name"), "file")
    )
    return K.callees(functions, files, symbols).select("name", "file", "callee")


SCOPED = "SELECT DISTINCT path FROM call_rows WHERE l_suppkey % 2 = 0"
HEAD_CODE = f"SELECT DISTINCT {fx.CODE_PATH} AS path FROM part WHERE p_partkey % 10 <> 0"


@query("import_scope", sql(["call_rows"], SCOPED))
def import_scope(spark, sf):
    _, ranges, files, symbols = graph(spark, sf)
    return K.import_scope(files, symbols, modules(spark, sf), no_context(ranges)).select("path")


@query("scan_set", sql(["call_rows"], f"SELECT * FROM ({SCOPED}) s UNION SELECT * FROM ({HEAD_CODE}) h"))
def q_scan_set(spark, sf):
    return K.scan_set(graph(spark, sf)[2], scope(spark, sf)).select("path")


GO_FILES = """SELECT 'x' AS range_id, 'd' || CAST(l_suppkey % 20 AS STRING) || '/f_' || CAST(l_partkey AS STRING) || '.go' AS path,
  CAST(l_partkey AS STRING) AS blob_id FROM @lineitem@
  GROUP BY l_suppkey, l_partkey"""


@query(
    "same_package",
    f"SELECT path FROM ({fx.to_duckdb(GO_FILES)}) g",
)
def same_package(spark, sf):
    files = fx.from_sql(spark, sf, GO_FILES)
    folders = files.select(
        "range_id", F.lit(0).cast("bigint").alias("page"),
        F.concat(F.substring_index("path", "/", 1), F.lit("/changed.go")).alias("path"),
    ).distinct()
    return K.same_package(files, folders).select("path")


@query(
    "distinct_modules",
    sql(["code_truth"], """SELECT DISTINCT path, 'crate::' || replace(replace(path, 'src/', ''), '.rs', '') AS module,
      true AS supports FROM code_truth"""),
)
def distinct_modules(spark, sf):
    return modules(spark, sf).select("path", "module", "supports")


@query(
    "context_totals",
    sql(VIEWS, EDGES + f"""SELECT (SELECT count(*) FROM code_truth) AS functions,
      (SELECT count(*) FROM (SELECT * FROM ({SCOPED}) s UNION SELECT * FROM ({HEAD_CODE}) h) u) AS files_scanned,
      CAST(sum(production_callers + test_callers) AS BIGINT) AS total_callers FROM n"""),
)
def context_totals(spark, sf):
    _, _, files, symbols = graph(spark, sf)
    entries = K.caller_counts(changed(spark, sf), calls(spark, sf))
    return X.context_totals(entries, K.scanned_files(files, symbols, scope(spark, sf))).select(
        "functions", "files_scanned", "total_callers"
    )


@query("files_touched", sql(["code_truth"], "SELECT count(DISTINCT path) AS files FROM code_truth"))
def q_files_touched(spark, sf):
    return files_touched(changed(spark, sf)).select("files")


@query(
    "function_context",
    sql(VIEWS, EDGES + f"""SELECT 'entry' AS kind, t.name, t.path AS file, t.change_type AS what, {RISK} AS other, production_callers AS n, test_callers AS tests,
      'scoped' AS scoping_mode FROM code_truth t JOIN n ON n.name = t.name
      UNION ALL SELECT 'caller', name, function_file, file, caller, line, CAST(is_test AS BIGINT), NULL FROM e WHERE name IS NOT NULL"""),
)
def function_context(spark, sf):
    tree, ranges, _, symbols = graph(spark, sf)
    found = X.function_context(tree, ranges, code_functions(spark, sf), symbols=symbols)
    entries = found.functions.select(
        F.lit("entry").alias("kind"), "name", "file", F.col("change_type").alias("what"), F.col("risk").alias("other"),
        F.col("production_callers").alias("n"), F.col("test_callers").alias("tests"), "scoping_mode",
    )
    return entries.unionByName(
        found.callers.select(
            F.lit("caller").alias("kind"), "name", F.col("function_file").alias("file"), F.col("file").alias("what"),
            F.col("caller").alias("other"), F.col("line").alias("n"), F.col("is_test").cast("bigint").alias("tests"),
            F.lit(None).cast("string").alias("scoping_mode"),
        )
    )


def entry_costs(budget: int, functions: str, size: int) -> str:
    """Costs of context entries, whole and with clamped lists, for pages of ``budget`` tokens.

    ``functions`` selects name, path, change_type, the counts and the bytes of the
    lists: p_all, p_some, t_all, t_some (0 for none).
    """
    fixed = f"""strlen(CAST(to_json({{'name': name, 'file': path, 'change_type': change_type, 'blast_radius': {{'production_callers': production_callers,
      'test_callers': test_callers, 'has_tests': test_callers > 0, 'risk': {RISK}}}, 'scoping_mode': 'scoped', 'callers': CAST([] AS VARCHAR[]),
      'callees': CAST([] AS VARCHAR[]), 'test_references': CAST([] AS VARCHAR[]), 'caller_count': production_callers + test_callers}}) AS VARCHAR))"""
    skeleton = f"""(strlen(CAST(to_json({{'metadata': {{'base_ref': 'base', 'head_ref': 'head', 'token_estimate': 0}}, 'functions': CAST([] AS VARCHAR[]),
      'pagination': {{'total_items': count(*) OVER (), 'page_start': 0, 'page_size': 25, 'next_cursor': NULL}}}}) AS VARCHAR)) + 32) // 4"""
    full = f"({fixed} + greatest(p_all - 1, 0) + greatest(t_all - 1, 0)) // 4"
    return f"""SELECT row_number() OVER (ORDER BY name, path) - 1 AS i, {budget} - {skeleton} - {max(budget // 4, 128)} AS room,
      {full} AS all_1, {full} AS all_2, {full} AS one, ({fixed} + greatest(p_some - 1, 0) + greatest(t_some - 1, 0)) // 4 AS two,
      name, path, production_callers + test_callers AS caller_count, production_callers, test_callers FROM ({functions}) f"""


ENTRY_TIER = "CASE tier WHEN 4 THEN 'clamped' ELSE 'full' END"
# each function's edges with their bytes, and the bytes of the first of them
EDGE_BYTES = """, j AS (SELECT name, function_file, is_test, strlen(CAST(to_json({'site': file, 'line': line, 'caller': caller, 'is_test': is_test}) AS VARCHAR)) + 1 AS bytes,
    row_number() OVER (PARTITION BY name, function_file, is_test ORDER BY file, line) AS rn FROM e WHERE name IS NOT NULL),
listed AS (SELECT t.name, t.path, t.change_type, production_callers, test_callers,
    coalesce(sum(bytes) FILTER (WHERE NOT is_test), 0) AS p_all, coalesce(sum(bytes) FILTER (WHERE NOT is_test AND rn <= 5), 0) AS p_some,
    coalesce(sum(bytes) FILTER (WHERE is_test), 0) AS t_all, coalesce(sum(bytes) FILTER (WHERE is_test AND rn <= 3), 0) AS t_some
  FROM code_truth t JOIN n ON n.name = t.name AND n.path = t.path LEFT JOIN j ON j.name = t.name AND j.function_file = t.path
  GROUP BY ALL)
"""


@query(
    "context_budget",
    recursive(sql(VIEWS, EDGES + EDGE_BYTES + ", " + greedy_sql(entry_costs(2458, "SELECT * FROM listed", 25), 25)
        + f"""SELECT name, path AS file, page, page_start, p."offset", {ENTRY_TIER} AS tier, over_budget, next_offset, caller_count,
        tier = 4 OR coalesce(p.i + 1 = next_offset, false) AS truncated,
        CASE tier WHEN 4 THEN least(production_callers, 5) ELSE production_callers END AS callers,
        CASE tier WHEN 4 THEN least(test_callers, 3) ELSE test_callers END AS tests FROM pages p JOIN costs c ON c.i = p.i""")),
)
def context_budget(spark, sf):
    tree, ranges, _, symbols = graph(spark, sf)
    found = X.function_context(tree, ranges, code_functions(spark, sf), page_size=25, symbols=symbols)
    kept = X.budgeted_context(found, ranges, 2458)
    return kept.select(
        "name", "file", "page", "page_start", "offset", "tier", "over_budget", "next_offset", "truncated", "caller_count",
        F.size("callers").alias("callers"), F.size("test_references").alias("tests"),
    )


@query(
    "mark_last_truncated",
    sql(["code_truth"], """, n AS (SELECT name, path, row_number() OVER (ORDER BY name, path) - 1 AS i, count(*) OVER () AS c FROM code_truth)
      SELECT name, path, i % 25 = 24 AND i + 1 < c AS truncated FROM n"""),
)
def mark_last_truncated(spark, sf):
    pages = cut(G.page_functions(code_functions(spark, sf), 25)).withColumn("truncated", F.lit(False))
    totals = pages.groupBy("range_id").agg(F.count("*").alias("total_items"))
    return G.mark_last_truncated(pages, totals).select("name", "path", "truncated")


# what a page of the manifest costs without its files
FILES_SKELETON = """(SELECT (strlen(CAST(to_json({'metadata': {'repo': 'r1', 'base_ref': 'base', 'head_ref': 'head', 'token_estimate': 0},
  'summary': {'total_files_changed': count(*), 'files_added': count(*) FILTER (WHERE change_type = 'added'),
    'files_modified': count(*) FILTER (WHERE change_type = 'modified'), 'files_deleted': count(*) FILTER (WHERE change_type = 'deleted'),
    'files_renamed': 0, 'total_lines_added': sum(added), 'total_lines_removed': sum(removed), 'languages_affected': ['rust'],
    'total_functions_changed': sum(functions), 'needs_more_pages': count(*) > 25},
  'files': CAST([] AS VARCHAR[]), 'dependency_changes': CAST([] AS VARCHAR[]),
  'pagination': {'total_items': count(*), 'page_start': 25, 'page_size': 25, 'next_cursor': NULL}}) AS VARCHAR)) + 32) // 4 FROM files)"""
NO_CALLERS = "SELECT name, path, change_type, 0 AS production_callers, 0 AS test_callers, 0 AS p_all, 0 AS p_some, 0 AS t_all, 0 AS t_some FROM code_truth"
HALF = """SELECT '{half}' AS half, {item} AS item, page, page_start, p."offset", {tier} AS tier, over_budget, next_offset
  FROM pages p JOIN costs c ON c.i = p.i"""


@query(
    "review_change",
    "SELECT * FROM ("
    + recursive(sql(["code_tree", "code_truth"], CODE_FILES + ", "
        + greedy_sql(file_costs(f"819 - {FILES_SKELETON} - 819 // 20", "added", "removed"), 25)
        + HALF.format(half="file", item="path", tier=FILE_TIER)))
    + ") a UNION ALL SELECT * FROM ("
    + recursive(sql(["code_truth"], ", " + greedy_sql(entry_costs(1229, NO_CALLERS, 25), 25)
        + HALF.format(half="function", item="name", tier=ENTRY_TIER)))
    + ") b",
)
def review_change(spark, sf):
    tree = fx.view(spark, sf, "code_tree")
    review = V.review_change(tree, one_range(spark, "r1"), 2048)
    shown = ["page", "page_start", "offset", "tier", "over_budget", "next_offset"]
    files = review.files.select(F.lit("file").alias("half"), F.col("path").alias("item"), *shown)
    return files.unionByName(
        review.functions.select(F.lit("function").alias("half"), F.col("name").alias("item"), *shown)
    )


# --- modules and imports ---------------------------------------------------------------

over_paths(
    "module_rust", Mo.module_rust,
    """CASE regexp_replace(regexp_replace(path, '\\.rs$', ''), '^src/', '') WHEN 'lib' THEN 'crate' WHEN 'main' THEN 'crate'
    ELSE 'crate::' || replace(regexp_replace(regexp_replace(regexp_replace(path, '\\.rs$', ''), '^src/', ''), '/mod$', ''), '/', '::') END""",
)
over_paths(
    "module_python", Mo.module_python,
    "replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.')",
)
GO_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
over_paths(
    "module_go", lambda p: Mo.module_go(p, F.when(F.length(p) % 2 == 0, F.lit("example.com/m"))),
    f"""CASE WHEN length(path) % 2 = 0 THEN 'example.com/m' || CASE WHEN ({GO_DIR}) = '' THEN '' ELSE '/' || ({GO_DIR}) END
    WHEN ({GO_DIR}) = '' THEN '.' ELSE ({GO_DIR}) END""",
)
over_paths(
    "module_ts", Mo.module_ts,
    "regexp_replace(regexp_replace(path, '\\.(tsx|ts|jsx|js)$', ''), '/index$', '')",
)

# importers of each language, one import each; part k's module may be referred to
IMPORTS = """SELECT 'x' AS range_id, p_partkey AS k, {path} AS path, {text} AS import_text,
  {crate} AS rust_crate_name, {go} AS go_module FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS p FROM @part@) q"""
NONE = "CAST(NULL AS STRING)"
REFERS = {
    # (path, import text, crate, go module, target module per part, does it refer)
    "imports_ref_rust": (
        "'src/a/b.rs'",
        """CASE p_partkey % 8 WHEN 0 THEN 'use crate::m_' || p || '::Thing;' WHEN 1 THEN 'pub use crate::m_' || p || ';'
        WHEN 2 THEN 'use my_crate::m_' || p || '::x;' WHEN 3 THEN 'use super::m_' || p || '::x;'
        WHEN 4 THEN 'use self::m_' || p || ';' WHEN 5 THEN 'use other::m_' || p || ';'
        WHEN 6 THEN 'use crate::{z, m_' || p || '::y};' ELSE 'use crate::m_' || p || 'x;' END""",
        "'my_crate'", NONE,
        """CASE p_partkey % 8 WHEN 3 THEN 'crate::a::m_' || p WHEN 4 THEN 'crate::a::b::m_' || p ELSE 'crate::m_' || p END""",
        "p_partkey % 8 NOT IN (5, 7)",
    ),
    "imports_ref_python": (
        "'pkg/sub/mod.py'",
        """CASE p_partkey % 8 WHEN 0 THEN 'import m_' || p || '.x as y' WHEN 1 THEN 'import os, m_' || p
        WHEN 2 THEN 'from m_' || p || ' import (a, b)' WHEN 3 THEN 'from .m_' || p || ' import a'
        WHEN 4 THEN 'from .. import q, m_' || p WHEN 5 THEN 'from m_' || p || 'x import a'
        WHEN 6 THEN 'import top_' || p ELSE 'from z import m_' || p || ' as w' END""",
        NONE, NONE,
        """CASE p_partkey % 8 WHEN 3 THEN 'pkg.sub.m_' || p WHEN 4 THEN 'pkg.m_' || p WHEN 6 THEN 'top_' || p || '.deep.er'
        WHEN 7 THEN 'z.m_' || p ELSE 'm_' || p END""",
        "p_partkey % 8 <> 5",
    ),
    "imports_ref_go": (
        "'cmd/main.go'",
        """CASE p_partkey % 4 WHEN 0 THEN 'example.com/x/lib/m_' || p WHEN 1 THEN 'lib/m_' || p
        WHEN 2 THEN 'example.com/x/m_' || p || '/y' ELSE 'xlib/m_' || p END""",
        NONE, NONE, "'lib/m_' || p", "p_partkey % 4 < 2",
    ),
    "imports_ref_ts": (
        "'src/ui/view.ts'",
        """CASE p_partkey % 5 WHEN 0 THEN 'import a from "./m_' || p || '";' WHEN 1 THEN 'import { b } from "../m_' || p || '";'
        WHEN 2 THEN 'import c from "m_' || p || '";' WHEN 3 THEN 'import d from "../../lib/./m_' || p || '";'
        ELSE 'import "./m_' || p || '";' END""",
        NONE, NONE,
        """CASE p_partkey % 5 WHEN 0 THEN 'src/ui/m_' || p WHEN 1 THEN 'src/m_' || p WHEN 3 THEN 'lib/m_' || p ELSE 'src/ui/m_' || p END""",
        "p_partkey % 5 NOT IN (2, 4)",
    ),
}


def _refers(name: str) -> None:
    path, text, crate, go, module, hit = REFERS[name]

    @query(name, f"SELECT p_partkey AS k FROM part WHERE {hit}")
    def run(spark, sf):
        # every part is its own range, so a reference is found for its own module only
        imports = fx.from_sql(spark, sf, IMPORTS.format(path=path, text=text, crate=crate, go=go)).withColumn(
            "range_id", F.col("k")
        )
        targets = fx.from_sql(
            spark, sf,
            f"SELECT p_partkey AS range_id, 0 AS page, '' AS path, {module} AS module "
            "FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS p FROM @part@) q",
        )
        keys = Mo.module_keys(targets)
        found = Mo.references(Mo.import_targets(imports), keys)
        return found.select(F.col("range_id").alias("k")).distinct()


for _name in REFERS:
    _refers(_name)
