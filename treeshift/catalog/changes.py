"""Functions, imports, dependencies, manifests, histories, snapshots, pages and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeshift import fixtures as fx
from treeshift.catalog.files import DIFF, DOC_DIFF, LANG, DUCK_LINES, MOVED, doc_changes, log_ranges
from treeshift.catalog.registry import greedy_sql, joined, one_range, query, recursive, sql, written
from treeshift.functions import paths as P
from treeshift.operators import dependencies as D, paging as G
from treeshift.operators.file_diff import diff_trees
from treeshift.operators.function_diff import (
    changed_symbols,
    function_changes,
    function_diff,
    function_renames,
    import_diff,
)
from treeshift.operators.line_churn import with_line_churn
from treeshift.plans import history as H, manifest as M, snapshots as S
from treeshift.sources import commits as C
from treeshift.sources.trees import with_statistics


def code_changes(spark, sf):
    """The crate with its statistics and what changed in it, each written once."""
    tree = written(spark, sf, "code_tree", lambda: with_statistics(fx.view(spark, sf, "code_tree")))
    return tree, written(spark, sf, "code_changes", lambda: diff_trees(tree, one_range(spark, "r1")))


def code_symbols(spark, sf) -> DataFrame:
    tree, changes = code_changes(spark, sf)
    return written(spark, sf, "code_symbols", lambda: changed_symbols(tree, changes, ["rust"]))


def code_functions(spark, sf) -> DataFrame:
    _, changes = code_changes(spark, sf)
    return written(
        spark, sf, "code_functions", lambda: function_changes(changes, code_symbols(spark, sf))
    )


# --- functions and imports --------------------------------------------------------


@query(
    "function_diff",
    sql(
        ["code_truth"],
        """SELECT path, name, CASE change_type WHEN 'renamed' THEN 'added' ELSE change_type END AS change_type FROM code_truth
        UNION ALL SELECT path, old_name, 'deleted' FROM code_truth WHERE old_name IS NOT NULL""",
    ),
)
def q_function_diff(spark, sf):
    _, changes = code_changes(spark, sf)
    return function_diff(changes, code_symbols(spark, sf)).select("path", "name", "change_type")


@query(
    "function_renames",
    sql(["code_truth"], "SELECT path, name, old_name FROM code_truth WHERE change_type = 'renamed'"),
)
def q_function_renames(spark, sf):
    _, changes = code_changes(spark, sf)
    diff = function_diff(changes, code_symbols(spark, sf))
    return function_renames(diff).select("path", "name", "old_name")


@query(
    "function_changes",
    sql(["code_truth"], "SELECT path, name, change_type, old_name FROM code_truth"),
)
def q_function_changes(spark, sf):
    return code_functions(spark, sf).select("path", "name", "change_type", "old_name")


@query(
    "sort_function_changes",
    sql(["code_truth"], "SELECT path, string_agg(name, '|' ORDER BY name) AS names FROM code_truth GROUP BY path"),
)
def sort_function_changes(spark, sf):
    _, changes = code_changes(spark, sf)
    symbols = code_symbols(spark, sf)
    files = M.manifest_files(changes, code_functions(spark, sf), import_diff(changes, symbols))
    return files.select("path", joined(F.col("functions_changed.name")).alias("names"))


@query(
    "sort_changed_functions",
    sql(
        ["code_truth"],
        "SELECT name, path, row_number() OVER (ORDER BY name, path) - 1 AS position FROM code_truth",
    ),
)
def sort_changed_functions(spark, sf):
    return G.page_functions(code_functions(spark, sf)).select("name", "path", "position")


@query(
    "function_name_filter",
    sql(
        ["code_truth"],
        """SELECT name, path FROM code_truth WHERE name IN
        (SELECT 'function_' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 40)""",
    ),
)
def function_name_filter(spark, sf):
    names = fx.table(spark, sf, "lineitem").filter("l_quantity > 40").select(
        F.concat(F.lit("function_"), F.col("l_partkey").cast("string")).alias("name")
    )
    return G.page_functions(code_functions(spark, sf), 25, names).select("name", "path")


@query(
    "page_functions",
    sql(
        ["code_truth"],
        """, n AS (SELECT name, path, row_number() OVER (ORDER BY name, path) - 1 AS i FROM code_truth)
        SELECT name, path, i // 25 AS page, i % 25 AS "offset" FROM n""",
    ),
)
def page_functions(spark, sf):
    return G.page_functions(code_functions(spark, sf), 25).select("name", "path", "page", "offset")


# imports of both sides: base knows part k and k + 1 of a file, head k and k + 2
IMPORTS = """
SELECT 'r5' AS repo, '{ref}' AS ref, 'm_' || CAST(p_size AS STRING) || '.py' AS path,
  listagg('import part_' || CAST(p_partkey + {step} AS STRING), chr(10)) WITHIN GROUP (ORDER BY p_partkey) || chr(10) AS content
FROM (SELECT p_partkey, CAST(floor(p_partkey / 40) AS BIGINT) AS p_size FROM @part@ WHERE p_partkey % 3 <> {skip}) q GROUP BY p_size"""


def import_tree(spark, sf):
    return fx.from_sql(
        spark, sf,
        IMPORTS.format(ref="base", step=1, skip=0) + " UNION ALL " + IMPORTS.format(ref="head", step=2, skip=1),
    )


DUCK_IMPORTS = """WITH b AS (SELECT DISTINCT 'm_' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS VARCHAR) || '.py' AS path,
  'import part_' || CAST(p_partkey + 1 AS VARCHAR) AS i FROM part WHERE p_partkey % 3 <> 0),
h AS (SELECT DISTINCT 'm_' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS VARCHAR) || '.py' AS path,
  'import part_' || CAST(p_partkey + 2 AS VARCHAR) AS i FROM part WHERE p_partkey % 3 <> 1),
a AS (SELECT * FROM h EXCEPT SELECT * FROM b), r AS (SELECT * FROM b EXCEPT SELECT * FROM h),
p AS (SELECT path FROM b UNION SELECT path FROM h)
"""


def import_changes(spark, sf) -> DataFrame:
    tree = import_tree(spark, sf)
    changes = diff_trees(tree, one_range(spark, "r5"))
    return written(
        spark, sf, "import_changes",
        lambda: import_diff(changes, changed_symbols(tree, changes, ["python"])),
    )


@query(
    "import_diff",
    DUCK_IMPORTS
    + """SELECT p.path, coalesce((SELECT string_agg(i, '|' ORDER BY i) FROM a WHERE a.path = p.path), '') AS added,
    coalesce((SELECT string_agg(i, '|' ORDER BY i) FROM r WHERE r.path = p.path), '') AS removed FROM p""",
)
def q_import_diff(spark, sf):
    return import_changes(spark, sf).select("path", joined("added").alias("added"), joined("removed").alias("removed"))


@query("except_imports", DUCK_IMPORTS + "SELECT path, i AS import_text FROM a")
def except_imports(spark, sf):
    return import_changes(spark, sf).select("path", F.explode("added").alias("import_text"))


# --- dependencies -----------------------------------------------------------------

DEPS = ["path", "name", "kind", "old_version", "new_version"]


@query("dependency_diff", sql(["dep_truth"], "SELECT path, name, kind, old_version, new_version FROM dep_truth"))
def q_dependency_diff(spark, sf):
    tree = fx.view(spark, sf, "dep_tree")
    return D.dependency_diff(diff_trees(tree, one_range(spark, "r2")), tree).select(*DEPS)


def _parser(key: str, view: str, parse, prefix: str) -> None:
    name = "'dep_' || CAST(p_partkey AS VARCHAR)"

    @query(
        key,
        f"""SELECT ref, 'pkg_' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS pkg, {name} AS name,
        '{prefix}' || CAST(CASE WHEN ref = 'head' AND p_partkey % 10 = 2 THEN p_size + 1 ELSE p_size END AS VARCHAR) || '.0' AS version
        FROM part, (VALUES ('base'), ('head')) r(ref)
        WHERE p_partkey % 10 <> CASE ref WHEN 'base' THEN 1 ELSE 0 END""",
    )
    def run(spark, sf):
        files = fx.view(spark, sf, view).select(F.concat_ws(" ", "ref", "path").alias("blob_id"), "content")
        parts = F.split("blob_id", "[ /]")
        return parse(files).select(parts[0].alias("ref"), parts[1].alias("pkg"), "name", "version")


_parser("parse_cargo_toml", "cargo_tree", D.parse_cargo_toml, "")
_parser("parse_package_json", "package_json_tree", D.parse_package_json, "")
_parser("parse_go_mod", "go_mod_tree", D.parse_go_mod, "v")
_parser("parse_pyproject", "pyproject_tree", D.parse_pyproject, ">=")


# --- summaries ----------------------------------------------------------------------

# lines as the multiset diff counts them; edits here are pure insertions
CHURN = f""", c AS (SELECT path, change_type,
  CASE change_type WHEN 'added' THEN {DUCK_LINES.format(c='h')} WHEN 'deleted' THEN 0
    ELSE CASE WHEN h = 'head line' || chr(10) || b THEN 1 ELSE 2 END END AS added,
  CASE change_type WHEN 'deleted' THEN {DUCK_LINES.format(c='b')} WHEN 'added' THEN 0
    ELSE CASE WHEN h = 'head line' || chr(10) || b OR b = '' OR right(b, 1) = chr(10) THEN 0 ELSE 1 END END AS removed
  FROM d)
"""
SUMMARY = """SELECT count(*) AS total_files_changed, count(*) FILTER (WHERE change_type = 'added') AS files_added,
  count(*) FILTER (WHERE change_type = 'modified') AS files_modified, count(*) FILTER (WHERE change_type = 'deleted') AS files_deleted,
  CAST(0 AS BIGINT) AS files_renamed, CAST(sum(added) AS BIGINT) AS total_lines_added, CAST(sum(removed) AS BIGINT) AS total_lines_removed"""


@query(
    "manifest_summary",
    sql(["doc_tree"], DOC_DIFF + CHURN + SUMMARY
        + f", string_agg(DISTINCT {LANG}, '|' ORDER BY {LANG}) FILTER (WHERE {LANG} <> 'unknown') AS languages_affected FROM c"),
)
def manifest_summary(spark, sf):
    tree, changes = doc_changes(spark, sf)
    summary = M.manifest_summary(with_line_churn(changes, tree))
    return summary.drop("range_id").withColumn("languages_affected", joined("languages_affected"))


@query(
    "languages_affected",
    sql(["commit_files"], f"""SELECT sha, coalesce(string_agg(DISTINCT {LANG}, '|' ORDER BY {LANG})
      FILTER (WHERE {LANG} <> 'unknown'), '') AS languages FROM commit_files GROUP BY sha"""),
)
def languages_affected(spark, sf):
    files = fx.view(spark, sf, "commit_files")
    language = P.detect_language(F.col("path"))
    return files.groupBy("sha").agg(M.languages_affected(language).alias("l")).select(
        "sha", joined("l").alias("languages")
    )


def code_files(spark, sf) -> DataFrame:
    _, changes = code_changes(spark, sf)
    symbols = code_symbols(spark, sf)
    return written(
        spark, sf, "code_files",
        lambda: M.manifest_files(changes, code_functions(spark, sf), import_diff(changes, symbols)),
    )


@query(
    "total_functions_changed",
    sql(["code_truth"], """SELECT count(*) AS total_functions_changed, count(DISTINCT path) > 500 AS needs_more_pages,
      count(DISTINCT path) > 1 AS when_paging FROM code_truth"""),
)
def total_functions_changed(spark, sf):
    files = code_files(spark, sf)
    small = M.total_functions_changed(files, 1).select("range_id", F.col("needs_more_pages").alias("when_paging"))
    return M.total_functions_changed(files, 500).join(small, "range_id").drop("range_id")


@query(
    "functions_per_language",
    sql(["code_truth"], "SELECT 'rust' AS language, count(*) AS functions FROM code_truth"),
)
def functions_per_language(spark, sf):
    return M.functions_per_language(code_files(spark, sf)).select("language", "functions")


@query(
    "change_manifest_documents",
    sql(
        ["doc_tree"],
        DOC_DIFF + CHURN + f"""SELECT c.path, c.change_type, {LANG.replace('path', 'c.path')} AS language, added AS lines_added, removed AS lines_removed,
        coalesce(strlen(b), 0) AS size_before, coalesce(strlen(h), 0) AS size_after,
        c.path NOT SIMILAR TO '.*\\.(py|rs|go|ts)' AS not_analysed FROM c JOIN d ON c.path = d.path""",
    ),
)
def change_manifest_documents(spark, sf):
    tree = fx.view(spark, sf, "doc_tree")
    manifest = M.change_manifest(tree, one_range(spark, "r0"), detect_renames=False)
    return manifest.files.select(
        "path", "change_type", "language", "lines_added", "lines_removed", "size_before", "size_after",
        F.col("functions_changed").isNull().alias("not_analysed"),
    )


@query(
    "worktree_manifest",
    f"""SELECT count(*) AS total_files_changed, count(*) FILTER (WHERE change_scope = 'staged') AS staged,
    count(*) FILTER (WHERE change_type = 'added') AS files_added, count(*) FILTER (WHERE change_type = 'deleted') AS files_deleted
    FROM (SELECT * FROM ({sql(['work_tree'], DIFF.format(t='work_tree', base='HEAD', head='INDEX'))}
      SELECT path, change_type, 'staged' AS change_scope FROM d) s
    UNION ALL SELECT * FROM ({sql(['work_tree'], DIFF.format(t='work_tree', base='INDEX', head='WORKTREE'))}
      SELECT path, change_type, 'unstaged' FROM d WHERE change_type <> 'added') u) t""",
)
def worktree_manifest(spark, sf):
    manifest = M.worktree_manifest(
        fx.view(spark, sf, "work_tree"), one_range(spark, "r3", "HEAD", "WORKTREE"), detect_renames=False
    )
    staged = manifest.files.filter("change_scope = 'staged'").groupBy("range_id").agg(F.count("*").alias("staged"))
    return manifest.summary.join(staged, "range_id").select(
        "total_files_changed", "staged", "files_added", "files_deleted"
    )


# --- history -------------------------------------------------------------------------

# file j differs from the commit before when (seq + j) is a multiple of 3
HISTORY = f"""WITH c AS (SELECT o_orderkey AS seq, o_orderkey // {fx.HISTORY_BLOCK} AS b,
  min(o_orderkey) OVER (PARTITION BY o_orderkey // {fx.HISTORY_BLOCK}) AS first FROM orders),
  f AS (SELECT 'h' || CAST(b AS VARCHAR) AS range_id, sha256('h' || CAST(seq AS VARCHAR)) AS sha, seq - first - 1 AS seq,
    (seq + j) % 3 = 0 AS hit, j FROM c, range(0, 5) t(j) WHERE seq > first)
"""


def history(spark, sf, **options) -> H.History:
    log = fx.view(spark, sf, "history_log")
    options = {"analyse": False, "detect_renames": False} | options
    return H.commit_history(fx.view(spark, sf, "history_tree"), log, log_ranges(log), **options)


@query(
    "commit_history",
    HISTORY + """SELECT range_id, sha, seq, count(*) FILTER (WHERE hit) AS files,
      CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM f GROUP BY range_id, sha, seq
      HAVING count(*) FILTER (WHERE hit) > 0""",
)
def commit_history(spark, sf):
    found = history(spark, sf)
    summary = found.manifest.summary.withColumnRenamed("range_id", "commit_range_id")
    return found.commits.join(summary, "commit_range_id").select(
        "range_id", "sha", "seq", F.col("total_files_changed").alias("files"), F.col("total_lines_added").alias("lines")
    )


# the functions of files 0 and 1 change with their file
@query(
    "files_per_history",
    HISTORY + """SELECT range_id, count(*) FILTER (WHERE hit) AS files, count(*) FILTER (WHERE hit AND j < 2) AS functions
      FROM f GROUP BY range_id""",
)
def files_per_history(spark, sf):
    found = history(spark, sf, analyse=True, detect_renames=True)
    of_range = F.substring_index("range_id", "@", 1).alias("range_id")
    functions = found.manifest.function_changes.groupBy(of_range).agg(F.count("*").alias("functions"))
    zero = F.lit(0).cast("bigint")
    return H.files_per_history(found).join(functions, "range_id", "left").withColumn("functions", F.coalesce("functions", zero))


@query(
    "page_commits",
    sql(["commit_log"], """, w AS (SELECT repo AS range_id, sha, row_number() OVER (PARTITION BY repo ORDER BY seq) - 2 AS seq
      FROM commit_log) SELECT range_id, sha, seq // 20 AS page, seq % 20 AS "offset" FROM w WHERE seq >= 0"""),
)
def page_commits(spark, sf):
    log = fx.view(spark, sf, "commit_log")
    walk = C.first_parent_walk(log, log_ranges(log))
    return G.page_commits(walk, 20).select("range_id", "sha", "page", "offset")


# --- snapshots -----------------------------------------------------------------------

WANTED = "SELECT DISTINCT path, dense_rank() OVER (ORDER BY path) AS ord FROM doc_tree"


def snapshots(spark, sf, limit=None) -> DataFrame:
    tree = fx.view(spark, sf, "doc_tree")
    paths = tree.select("path").distinct()
    numbered = G.number_rows(paths.withColumn("range_id", F.lit("x")), ["range_id"], ["path"], "ord")
    return S.file_snapshots(tree, one_range(spark, "r0"), numbered, limit=limit)


@query(
    "file_snapshots",
    sql(["doc_tree"], """SELECT p.path, b.content AS before, h.content AS after, strlen(h.content) AS size_after
      FROM (SELECT DISTINCT path FROM doc_tree) p LEFT JOIN doc_tree b ON b.ref = 'base' AND b.path = p.path
      LEFT JOIN doc_tree h ON h.ref = 'head' AND h.path = p.path"""),
)
def file_snapshots(spark, sf):
    return snapshots(spark, sf).select(
        "path", F.col("before.content").alias("before"), F.col("after.content").alias("after"),
        F.col("after.size_bytes").alias("size_after"),
    )


@query(
    "limit_snapshot_files",
    sql(["doc_tree"], "SELECT DISTINCT path FROM doc_tree ORDER BY path LIMIT 20"),
)
def limit_snapshot_files(spark, sf):
    return snapshots(spark, sf, limit=20).select("path")


@query(
    "snapshot_tokens",
    sql(["doc_tree"], "SELECT CAST(floor(sum(strlen(content)) / 4) AS BIGINT) AS token_estimate FROM doc_tree"),
)
def snapshot_tokens(spark, sf):
    return S.snapshot_tokens(snapshots(spark, sf)).select("token_estimate")


# --- pages and budgets ---------------------------------------------------------------


@query(
    "page_files",
    sql(["doc_tree"], DOC_DIFF + """, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM d)
      SELECT path, i // 50 AS page, i % 50 AS "offset" FROM n"""),
)
def page_files(spark, sf):
    return G.page_files(doc_changes(spark, sf)[1], 50).select("path", "page", "offset")


@query("collect_pages", sql(["doc_tree"], DOC_DIFF + "SELECT count(*) AS files, count(DISTINCT path) AS paths FROM d"))
def collect_pages(spark, sf):
    pages = G.page_files(doc_changes(spark, sf)[1], 50)
    return pages.agg(F.count("*").alias("files"), F.count_distinct("path").alias("paths"))


STALE = """SELECT seq AS range_id, repo, 'tag_' || CAST(seq AS STRING) AS base_ref, 'tag_' || CAST(seq + 40 AS STRING) AS head_ref,
  sha AS base_sha, sha AS head_sha FROM {log}"""


@query(
    "stale_ranges",
    sql(["commit_log"], f""", rec AS ({STALE.format(log='commit_log')}),
      refs AS (SELECT repo, 'tag_' || CAST(seq AS VARCHAR) AS ref,
        CASE WHEN seq % 3 = 0 THEN sha256('c' || CAST(seq - 40 AS VARCHAR)) ELSE sha END AS sha FROM commit_log)
      SELECT r.range_id FROM rec r LEFT JOIN refs b ON b.repo = r.repo AND b.ref = r.base_ref
      LEFT JOIN refs h ON h.repo = r.repo AND h.ref = r.head_ref
      WHERE b.sha IS DISTINCT FROM r.base_sha OR h.sha IS DISTINCT FROM r.head_sha"""),
)
def stale_ranges(spark, sf):
    log = fx.view(spark, sf, "commit_log")
    refs = log.select(
        "repo",
        F.concat(F.lit("tag_"), F.col("seq").cast("string")).alias("ref"),
        F.when(
            F.col("seq") % 3 == 0, F.sha2(F.concat(F.lit("c"), (F.col("seq") - 40).cast("string")), 256)
        ).otherwise(F.col("sha")).alias("sha"),
    )
    return G.stale_ranges(spark.sql(STALE, log=log), refs).select("range_id")


@query(
    "next_offset",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END
      WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE least(o_custkey, o_orderkey % 100) END AS v FROM orders""",
)
def next_offset(spark, sf):
    orders = fx.table(spark, sf, "orders")
    budget = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100)
    page = F.when(F.col("o_orderkey") % 2 != 0, F.col("o_custkey"))
    return orders.select("o_orderkey", G.next_offset(budget, page).alias("v"))


@query(
    "split_budget",
    """SELECT o_orderkey, CAST(floor(o_orderkey * CAST(0.4 AS DOUBLE)) AS BIGINT) AS manifest_budget,
    CAST(round(o_orderkey * CAST(0.6 AS DOUBLE)) AS BIGINT) AS context_budget FROM orders""",
)
def split_budget(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return orders.select("o_orderkey", G.split_budget(F.col("o_orderkey")).alias("s")).select("o_orderkey", "s.*")


@query(
    "clamp_lists",
    sql(["call_rows"], """, n AS (SELECT l_partkey, path, k, row_number() OVER (PARTITION BY l_partkey ORDER BY path, k) AS rn
      FROM call_rows) SELECT l_partkey, path, k FROM n WHERE rn <= 5"""),
)
def clamp_lists(spark, sf):
    edges = fx.view(spark, sf, "call_rows")
    return G.clamp_lists(edges, ["l_partkey"], ["path", "k"], G.TOP_CALLERS).select("l_partkey", "path", "k")


# what the generated crate's manifest says, file by file; both sides are blocks of
# three lines, the head's in reversed order
CODE_FILES = """, side AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN head THEN -p ELSE p END) AS at,
    count(*) OVER (PARTITION BY path, head) AS blocks
  FROM (SELECT p_partkey AS p, {path} AS path, false AS head FROM part WHERE p_partkey % 10 <> 1
    UNION ALL SELECT p_partkey, {path}, true FROM part WHERE p_partkey % 10 <> 0) s),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, head ORDER BY CASE WHEN head THEN -p ELSE p END) AS k FROM side) x WHERE NOT head),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, head ORDER BY CASE WHEN head THEN -p ELSE p END) AS k FROM side) x WHERE head),
-- the longest common subsequence: closing braces, and the other lines of one block in both
lcs AS (SELECT b.path, max(least(b.k, h.k) - 1 + least(b.blocks - b.k, h.blocks - h.k) + 1
    + CASE WHEN b.p % 10 IN (2, 3, 4) THEN 1 ELSE 2 END) AS both_lines, max(least(b.blocks, h.blocks)) AS braces
  FROM b JOIN h ON b.path = h.path AND b.p = h.p GROUP BY b.path),
fns AS (SELECT t.path, list({{'name': name, 'old_name': old_name, 'change_type': change_type,
    'start_line': 3 * (CASE WHEN change_type = 'deleted' THEN b.k ELSE h.k END) - 2,
    'end_line': 3 * (CASE WHEN change_type = 'deleted' THEN b.k ELSE h.k END),
    'signature': 'pub fn ' || name || CASE WHEN change_type = 'signature_changed' THEN '(x: i32)' ELSE '()' END || ' -> i32'}}
    ORDER BY name) AS functions_changed, count(*) AS functions
  FROM (SELECT *, CAST(split_part(name, '_', 2) AS BIGINT) AS p FROM code_truth) t
  LEFT JOIN b ON b.path = t.path AND b.p = t.p LEFT JOIN h ON h.path = t.path AND h.p = t.p GROUP BY t.path),
sizes AS (SELECT path, max(strlen(content)) FILTER (WHERE ref = 'base') AS base_size, max(strlen(content)) FILTER (WHERE ref = 'head') AS head_size
  FROM code_tree GROUP BY path),
files AS (SELECT s.path, CASE WHEN base_size IS NULL THEN 'added' WHEN head_size IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
    coalesce(base_size, 0) AS size_before, coalesce(head_size, 0) AS size_after, functions_changed, functions,
    coalesce(3 * (SELECT max(blocks) FROM h WHERE h.path = s.path), 0) - coalesce(greatest(both_lines, braces), 0) AS added,
    coalesce(3 * (SELECT max(blocks) FROM b WHERE b.path = s.path), 0) - coalesce(greatest(both_lines, braces), 0) AS removed
  FROM sizes s LEFT JOIN fns f ON f.path = s.path LEFT JOIN lcs l ON l.path = s.path)
""".format(path=fx.CODE_PATH)


def file_costs(budget: str, added: str = "CAST(NULL AS BIGINT)", removed: str = "CAST(NULL AS BIGINT)") -> str:
    """Costs of ``files`` as they are serialised, for pages of ``budget`` tokens."""

    def cost(functions: str, imports: str) -> str:
        return f"""strlen(CAST(to_json({{'path': path, 'old_path': NULL, 'change_type': change_type, 'change_scope': 'committed',
          'language': 'rust', 'is_binary': false, 'is_generated': false, 'lines_added': {added}, 'lines_removed': {removed},
          'size_before': size_before, 'size_after': size_after, 'functions_changed': {functions}, 'imports_changed': {imports}}}) AS VARCHAR)) // 4"""

    none = "{'added': CAST([] AS VARCHAR[]), 'removed': CAST([] AS VARCHAR[])}"
    some = cost("functions_changed", "NULL")
    return f"""SELECT row_number() OVER (ORDER BY path) - 1 AS i, {budget} AS room, {cost("functions_changed", none)} AS all_1,
      {some} AS all_2, {some} AS one, {cost("NULL", "NULL")} AS two, path, functions FROM files"""


# moved files, a crate and its dependencies in one tree: files, functions and dependencies
@query(
    "change_manifest",
    sql(["code_tree", "code_truth", "dep_truth"], CODE_FILES + f"""SELECT 'file' AS kind, path, old_path AS name, change_type, lines_added AS n, lines_removed AS m FROM ({MOVED}) x
      UNION ALL SELECT 'file', path, NULL, change_type, added, removed FROM files
      UNION ALL SELECT 'file', {fx.DEP_DIR} || '/Cargo.toml', NULL,
        CASE WHEN count(*) FILTER (WHERE p_partkey % 10 <> 0) = 0 THEN 'deleted' WHEN count(*) FILTER (WHERE p_partkey % 10 <> 1) = 0 THEN 'added' ELSE 'modified' END,
        CASE WHEN count(*) FILTER (WHERE p_partkey % 10 <> 0) = 0 THEN 0 ELSE count(*) FILTER (WHERE p_partkey % 10 IN (1, 2)) END,
        CASE WHEN count(*) FILTER (WHERE p_partkey % 10 <> 0) = 0 THEN 3 + count(*) ELSE count(*) FILTER (WHERE p_partkey % 10 IN (0, 2)) END
        FROM part GROUP BY {fx.DEP_DIR}
      UNION ALL SELECT 'function', path, name, change_type, NULL, NULL FROM code_truth
      UNION ALL SELECT 'dependency', path, name, kind, NULL, NULL FROM dep_truth WHERE path LIKE '%Cargo.toml'"""),
)
def change_manifest(spark, sf):
    one = F.lit("r6")
    trees = [fx.view(spark, sf, view).withColumn("repo", one) for view in ("moved_tree", "code_tree", "cargo_tree")]
    tree = trees[0].unionByName(trees[1]).unionByName(trees[2])
    manifest = M.change_manifest(tree, one_range(spark, "r6"))
    none = F.lit(None).cast("bigint")
    files = manifest.files.select(
        F.lit("file").alias("kind"), "path", F.col("old_path").alias("name"), "change_type",
        F.col("lines_added").alias("n"), F.col("lines_removed").alias("m"),
    )
    functions = manifest.function_changes.select(
        F.lit("function").alias("kind"), "path", "name", "change_type", none.alias("n"), none.alias("m")
    )
    dependencies = manifest.dependency_changes.select(
        F.lit("dependency").alias("kind"), "path", "name", F.col("kind").alias("change_type"), none.alias("n"), none.alias("m")
    )
    return files.unionByName(functions).unionByName(dependencies)


FILE_TIER = "CASE tier WHEN 1 THEN 'full' WHEN 4 THEN 'bare' ELSE 'functions' END"


@query(
    "manifest_budget",
    recursive(sql(["code_tree", "code_truth"], CODE_FILES + ", " + greedy_sql(file_costs("4096 - 200 - 4096 // 20"), 25)
        + f"""SELECT path, page, page_start, p."offset", {FILE_TIER} AS tier, over_budget, next_offset,
        CASE WHEN tier < 4 THEN functions END AS functions FROM pages p JOIN costs c ON c.i = p.i""")),
)
def manifest_budget(spark, sf):
    files = G.page_files(code_files(spark, sf), 25)
    kept = G.manifest_budget(files, 4096, 200, 25)
    return kept.select(
        "path", "page", "page_start", "offset", "tier", "over_budget", "next_offset",
        F.size("functions_changed").alias("functions"),
    )
