"""Sources, file diff and scalar expressions."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from treeshift import fixtures as fx
from treeshift.catalog.registry import joined, one_range, query, sql
from treeshift.functions import labels as L, paths as P, text as T
from treeshift.functions.languages import language_table
from treeshift.operators.file_diff import diff_trees, diff_worktree
from treeshift.operators.line_churn import with_line_churn
from treeshift.operators.renames import exact_renames, file_copies, file_renames, scoped_renames
from treeshift.session import ensure_checkpoint_dir
from treeshift.sources import commits as C, repo_context as R, trees

NL = "chr(10)"
DUCK_LINES = (
    "(length({c}) - length(replace({c}, chr(10), '')) + "
    "CASE WHEN {c} = '' OR right({c}, 1) = chr(10) THEN 0 ELSE 1 END)"
)

# paths of every kind, from the part table
PATHS = """
SELECT p_partkey AS k, CASE p_partkey % 30
  WHEN 0 THEN 'vendor/a_' || p WHEN 1 THEN 'src/node_modules/b_' || p || '.js'
  WHEN 2 THEN 'pkg_' || p || '/Cargo.lock' WHEN 3 THEN 'web/app_' || p || '.min.js'
  WHEN 4 THEN 'gen/x_' || p || '_generated.go' WHEN 5 THEN '.gitignore'
  WHEN 6 THEN 'tests/test_' || p || '.rs' WHEN 7 THEN 'src/tests/m_' || p || '.py'
  WHEN 8 THEN 'go/h_' || p || '_test.go' WHEN 9 THEN 'src/latest.java'
  WHEN 10 THEN 'Makefile' WHEN 11 THEN 'ui/C_' || p || '.TSX' WHEN 12 THEN 'm_' || p || '/go.mod'
  WHEN 13 THEN 'src/lib.rs' WHEN 14 THEN 'src/a/mod.rs' WHEN 15 THEN 'src/a/b_' || p || '.rs'
  WHEN 16 THEN 'pkg/__init__.py' WHEN 17 THEN 'pkg/sub/m_' || p || '.py'
  WHEN 18 THEN 'ui/comp_' || p || '/index.tsx' WHEN 19 THEN 'ui/v_' || p || '.test.ts'
  WHEN 20 THEN 'c/x_' || p || '.hpp' WHEN 21 THEN 'spec/u_' || p || '_spec.rb'
  WHEN 22 THEN 'a.b/c_' || p WHEN 23 THEN 'x/K_' || p || '.kt' WHEN 24 THEN 'x/y_' || p || '.pb.go'
  WHEN 25 THEN 'p_' || p || '/package.json' WHEN 26 THEN 'App/FooTests.cs'
  WHEN 27 THEN 'e2e/__tests__/z_' || p || '.jsx' WHEN 28 THEN 'main_' || p || '.go'
  ELSE 'docs/r_' || p || '.md' END AS path
FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS p FROM @part@) q"""
DUCK_PATHS = "WITH paths AS (" + fx.to_duckdb(PATHS) + ")\n"
EXT = "list_last(string_split(path, '.'))"
EXT_SAFE = f"CASE WHEN length(path) > length({EXT}) + 1 THEN {EXT} ELSE '' END"
BASENAME = "list_last(string_split(path, '/'))"
LANG_CASES = """CASE {e} WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript'
 WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'rb' THEN 'ruby'
 WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'php' THEN 'php' WHEN 'swift' THEN 'swift'
 WHEN 'kt' THEN 'kotlin' WHEN 'kts' THEN 'kotlin' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp'
 WHEN 'hpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hh' THEN 'cpp' WHEN 'hxx' THEN 'cpp'
 WHEN 'cs' THEN 'csharp' ELSE 'unknown' END"""
LANG = LANG_CASES.format(e=EXT)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return fx.from_sql(spark, sf, PATHS)


# --- sources ------------------------------------------------------------------


def write_folders(rows: DataFrame, folder: str) -> None:
    """A folder for each value of the first column, with a text file of the second one's lines.

    A value's rows have to be in one task. Where the folder is in a file system of the
    machine, tasks write plain files: Spark's writer would start several processes for
    each of them there, to set permissions of the file, its folder and its checksums.
    """
    key, text = rows.columns
    local = re.match(r"(?:file:(?://(?=/))?)?(/.*)$", folder)
    if not local:
        rows.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
        return
    root = local[1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: str | None = None
        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
                at = f"{root}/{key}={name}"
                os.makedirs(at, exist_ok=True)
                # sorted, so a value's first row begins its file, whatever an earlier attempt left
                with open(f"{at}/part.txt", "ab" if name == begun else "wb") as file:
                    file.write((line or "").encode() + b"\n")
                begun = name
        yield from ()

    rows.sortWithinPartitions(key).mapInArrow(put, rows.schema).write.format("noop").mode("overwrite").save()


@query(
    "scan_tree",
    """SELECT 'f' || CAST(p_partkey AS VARCHAR) AS folder, sha256(p_name || chr(10)) AS blob_id,
      strlen(p_name) + 1 AS size FROM part""",
)
def scan_tree(spark, sf):
    """A directory of files that is written first: the part names, one to a file."""
    folder = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"
    parts = fx.table(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("at"), "p_name")
    write_folders(parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at"), folder)
    found = trees.scan_tree(spark, folder, "r", "head").filter("path LIKE '%.txt'")
    return found.select(
        F.regexp_extract("path", "^at=([^/]*)/", 1).alias("folder"), "blob_id", F.octet_length("content").cast("bigint").alias("size")
    )


@query(
    "read_file_at_ref",
    sql(
        ["doc_tree"],
        """SELECT b.path, length(h.content) AS n, CASE WHEN h.path IS NULL THEN 'file_not_found' END AS error
        FROM doc_tree b LEFT JOIN doc_tree h ON h.ref = 'head' AND h.path = b.path WHERE b.ref = 'base'""",
    ),
)
def read_file_at_ref(spark, sf):
    tree = fx.view(spark, sf, "doc_tree")
    wanted = tree.filter("ref = 'base'").select("repo", F.lit("head").alias("ref"), "path")
    found = trees.read_file_at_ref(tree, wanted)
    return found.select("path", F.length("content").cast("bigint").alias("n"), "error")


@query(
    "read_blob",
    sql(
        ["doc_tree"],
        """, w AS (SELECT DISTINCT sha256(text) AS blob_id FROM documents),
        b AS (SELECT DISTINCT sha256(content) AS blob_id, content FROM doc_tree)
        SELECT w.blob_id, length(b.content) AS n FROM w LEFT JOIN b USING (blob_id)""",
    ),
)
def read_blob(spark, sf):
    wanted = fx.table(spark, sf, "documents").select(F.sha2("text", 256).alias("blob_id")).distinct()
    found = trees.read_blob(fx.view(spark, sf, "doc_tree"), wanted)
    return found.select("blob_id", F.length("content").cast("bigint").alias("n"))


REFS = "SELECT repo, 'tag_' || CAST(seq AS STRING) AS ref, sha FROM {log} WHERE seq % 5 = 0"
RANGES = """SELECT seq AS range_id, repo, 'tag_' || CAST(seq AS STRING) AS base_ref,
  'tag_' || CAST(seq + 40 AS STRING) AS head_ref FROM {log}"""


@query(
    "resolve_refs",
    sql(
        ["commit_log"],
        f""", refs AS ({REFS.format(log='commit_log')}), ranges AS ({RANGES.format(log='commit_log')})
        SELECT r.range_id, b.sha AS base_sha, trim(bc.message) AS base_message, h.sha AS head_sha,
          CASE WHEN b.sha IS NULL OR h.sha IS NULL THEN 'ref_not_found' END AS error
        FROM ranges r LEFT JOIN refs b ON b.repo = r.repo AND b.ref = r.base_ref
        LEFT JOIN commit_log bc ON bc.sha = b.sha
        LEFT JOIN refs h ON h.repo = r.repo AND h.ref = r.head_ref""",
    ),
)
def resolve_refs(spark, sf):
    log = fx.view(spark, sf, "commit_log")
    refs = spark.sql(REFS.replace("{log}", "{log}"), log=log)
    ranges = spark.sql(RANGES, log=log)
    return C.resolve_refs(ranges, refs, log).select(
        "range_id", "base_sha", "base_message", "head_sha", "error"
    )


@query("commit_author", sql(["commit_log"], "SELECT repo, sha, author FROM commit_log"))
def commit_author(spark, sf):
    return C.commit_author(fx.view(spark, sf, "commit_log"))


@query(
    "commit_time",
    sql(["commit_log"], "SELECT repo, sha, strftime(authored_at, '%Y-%m-%d %H:%M:%S') AS authored_at FROM commit_log"),
)
def commit_time(spark, sf):
    times = C.commit_time(fx.view(spark, sf, "commit_log"))
    return times.withColumn("authored_at", F.date_format("authored_at", "yyyy-MM-dd HH:mm:ss"))


def log_ranges(log: DataFrame) -> DataFrame:
    return log.groupBy("repo").agg(
        F.min_by("sha", "seq").alias("base_sha"), F.max_by("sha", "seq").alias("head_sha")
    ).withColumn("range_id", F.col("repo"))


WALK = """, w AS (SELECT repo AS range_id, sha, row_number() OVER (PARTITION BY repo ORDER BY seq) - 2 AS seq,
  lag(sha) OVER (PARTITION BY repo ORDER BY seq) AS previous FROM commit_log)"""


@query("first_parent_walk", sql(["commit_log"], WALK + "SELECT range_id, sha, seq FROM w WHERE seq >= 0"))
def first_parent_walk(spark, sf):
    log = fx.view(spark, sf, "commit_log")
    return C.first_parent_walk(log, log_ranges(log)).select("range_id", "sha", "seq")


@query(
    "consecutive_snapshots",
    sql(["history_log"], WALK.replace("commit_log", "history_log")
        + "SELECT range_id, seq, previous AS base_ref, sha AS head_ref FROM w WHERE seq >= 0"),
)
def consecutive_snapshots(spark, sf):
    log = fx.view(spark, sf, "history_log")
    ranges = log_ranges(log)
    walk = C.first_parent_walk(log, ranges)
    return C.consecutive_snapshots(walk, ranges).select("range_id", "seq", "base_ref", "head_ref")


ROOT_FILES = """
SELECT replace(replace(path, '/Cargo.toml', ''), '/go.mod', '') AS repo, ref,
  CASE WHEN path LIKE '%go.mod' THEN 'go.mod' ELSE 'Cargo.toml' END AS path,
  replace(content, '"x"', '"crate-' || replace(path, '/Cargo.toml', '') || '"') AS content
FROM (SELECT * FROM ({cargo}) c UNION ALL SELECT * FROM ({go}) g) t"""


@query(
    "repo_context",
    """SELECT DISTINCT 'pkg_' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS range_id,
    'crate_pkg_' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS rust_crate_name,
    'example.com/x' AS go_module FROM part WHERE p_partkey % 10 <> 0""",
)
def repo_context(spark, sf):
    d = fx.spark_dialect()
    tree = fx.from_sql(
        spark, sf, ROOT_FILES.format(cargo=fx.VIEWS["cargo_tree"](d), go=fx.VIEWS["go_mod_tree"](d))
    )
    ranges = tree.filter("ref = 'head'").select(
        F.col("repo").alias("range_id"), "repo", F.lit("head").alias("head_ref")
    ).distinct()
    return R.repo_context(tree, ranges)


@query(
    "languages",
    sql(
        ["doc_tree"],
        f"""SELECT {EXT} AS extension, {LANG} AS language, count(*) AS files FROM doc_tree
        WHERE {LANG} <> 'unknown' GROUP BY ALL""",
    ),
)
def languages(spark, sf):
    known = language_table(spark)  # one row per extension
    files = fx.view(spark, sf, "doc_tree").select(P.last_dot_part(F.col("path")).alias("extension"))
    return files.join(F.broadcast(known), "extension").groupBy("extension", "language").agg(
        F.count("*").alias("files")
    )


# --- file diff ------------------------------------------------------------------

DIFF = """, b AS (SELECT * FROM {t} WHERE ref = '{base}'), h AS (SELECT * FROM {t} WHERE ref = '{head}'),
d AS (SELECT coalesce(b.path, h.path) AS path, b.content AS b, h.content AS h,
  CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
  FROM b FULL OUTER JOIN h ON b.path = h.path
  WHERE b.content IS DISTINCT FROM h.content)
"""
DOC_DIFF = DIFF.format(t="doc_tree", base="base", head="head")
STAGED = DIFF.format(t="work_tree", base="HEAD", head="INDEX")
UNSTAGED = DIFF.format(t="work_tree", base="INDEX", head="WORKTREE")


def doc_changes(spark, sf, **options):
    tree = fx.view(spark, sf, "doc_tree")
    return tree, diff_trees(tree, one_range(spark, "r0"), **options)


@query("diff_trees", sql(["doc_tree"], DOC_DIFF + "SELECT path, change_type FROM d"))
def q_diff_trees(spark, sf):
    return doc_changes(spark, sf)[1].select("path", "change_type")


@query(
    "blob_stats",
    sql(["doc_tree"], f"""SELECT ref, path, strlen(content) AS size, contains(content, chr(0)) AS is_binary,
      {DUCK_LINES.format(c='content')} AS lines FROM doc_tree"""),
)
def blob_stats(spark, sf):
    index = trees.file_index(fx.view(spark, sf, "doc_tree"))
    return index.select("ref", "path", "size", F.col("binary").alias("is_binary"), "lines")


@query("count_lines", f"SELECT doc_id, {DUCK_LINES.format(c='text')} AS lines FROM documents")
def count_lines(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", T.count_lines(F.col("text")).alias("lines"))


@query(
    "line_churn",
    # by construction: a line in front adds one; a line behind adds two, and
    # removes the old last line where that had no newline
    sql(
        ["doc_tree"],
        DOC_DIFF
        + """SELECT path, CASE WHEN h = 'head line' || chr(10) || b THEN 1 ELSE 2 END AS lines_added,
        CASE WHEN h = 'head line' || chr(10) || b OR b = '' OR right(b, 1) = chr(10) THEN 0 ELSE 1 END AS lines_removed
        FROM d WHERE change_type = 'modified'""",
    ),
)
def line_churn(spark, sf):
    tree, changes = doc_changes(spark, sf)
    changed = changes.filter("change_type = 'modified'")
    return with_line_churn(changed, tree).select("path", "lines_added", "lines_removed")


@query(
    "line_churn_multiset",
    sql(
        ["doc_tree"],
        DOC_DIFF
        + """, m AS (SELECT * FROM d WHERE change_type = 'modified'),
        s AS (SELECT path, 1 AS n, string_split(h, chr(10)) AS l FROM m
              UNION ALL SELECT path, -1, string_split(b, chr(10)) FROM m),
        e AS (SELECT path, n, i, len(l) AS k, l[i] AS line FROM s, unnest(range(1, len(l) + 1)) AS u(i)),
        t AS (SELECT path, n, CASE WHEN i < k THEN line || chr(10) ELSE line END AS line FROM e
              WHERE i < k OR line <> ''),
        c AS (SELECT path, line, sum(n) AS net FROM t GROUP BY ALL)
        SELECT path, CAST(sum(greatest(net, 0)) AS BIGINT) AS lines_added,
          CAST(sum(greatest(-net, 0)) AS BIGINT) AS lines_removed FROM c GROUP BY path""",
    ),
)
def line_churn_multiset(spark, sf):
    tree, changes = doc_changes(spark, sf)
    changed = changes.filter("change_type = 'modified'")
    return with_line_churn(changed, tree, exact=False).select("path", "lines_added", "lines_removed")


@query(
    "file_renames_exact",
    sql(
        ["doc_tree"],
        DOC_DIFF
        + """, a AS (SELECT path, h AS c, row_number() OVER (PARTITION BY h ORDER BY path) AS rn FROM d
               WHERE change_type = 'added' AND h <> ''),
        x AS (SELECT path, b AS c, row_number() OVER (PARTITION BY b ORDER BY path) AS rn FROM d
               WHERE change_type = 'deleted' AND b <> '')
        SELECT x.path AS old_path, a.path FROM a JOIN x ON a.c = x.c AND a.rn = x.rn""",
    ),
)
def file_renames_exact(spark, sf):
    return exact_renames(doc_changes(spark, sf)[1]).select("old_path", "path")


# files of the moved tree: unchanged content, one line of ten, most lines, edited in place
MOVED = """SELECT 'src/q_' || p_partkey || '.txt' AS path, CASE WHEN p_partkey % 5 < 2 THEN 'lib/p_' || p_partkey || '.txt' END AS old_path,
    CASE WHEN p_partkey % 5 < 2 THEN 'renamed' ELSE 'added' END AS change_type,
    CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 10 END AS lines_added,
    CASE p_partkey % 5 WHEN 1 THEN 1 ELSE 0 END AS lines_removed FROM part WHERE p_partkey % 5 < 3
  UNION ALL SELECT 'lib/p_' || p_partkey || '.txt', NULL, CASE p_partkey % 5 WHEN 2 THEN 'deleted' ELSE 'modified' END,
    CASE p_partkey % 5 WHEN 2 THEN 0 ELSE 1 END, CASE p_partkey % 5 WHEN 2 THEN 10 ELSE 1 END FROM part WHERE p_partkey % 5 IN (2, 3)"""


@query("file_renames", MOVED)
def q_file_renames(spark, sf):
    tree = fx.view(spark, sf, "moved_tree")
    changes = diff_trees(tree, one_range(spark, "r4"))
    found = with_line_churn(file_renames(changes, tree), tree)
    return found.select("path", "old_path", "change_type", "lines_added", "lines_removed")


@query("file_renames_documents")
def file_renames_documents(spark, sf):
    tree, changes = doc_changes(spark, sf)
    found = with_line_churn(file_renames(changes, tree), tree)
    return found.select("path", "old_path", "change_type", "lines_added", "lines_removed")


# the same files staged: base is HEAD, the head's files are in the index
@query(
    "staged_renames",
    f"SELECT path, old_path, change_type, lines_added, lines_removed, 'staged' AS change_scope FROM ({MOVED}) m",
)
def staged_renames(spark, sf):
    ref = F.when(F.col("ref") == "base", "HEAD").otherwise("INDEX")
    tree = fx.view(spark, sf, "moved_tree").withColumn("ref", ref)
    tree = tree.unionByName(tree.filter("ref = 'INDEX'").withColumn("ref", F.lit("WORKTREE")))
    changes = diff_worktree(tree, one_range(spark, "r4", "HEAD", "WORKTREE"))
    found = with_line_churn(scoped_renames(changes, tree), tree)
    return found.select("path", "old_path", "change_type", "lines_added", "lines_removed", "change_scope")


# an added copy of every third file that stays, one of it edited
@query(
    "file_copies",
    """SELECT 'copy/c_' || p_partkey || '.txt' AS path, 'lib/p_' || p_partkey || '.txt' AS old_path, 'copied' AS change_type,
      0 AS lines_added, 0 AS lines_removed FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 3 = 0
    UNION ALL SELECT 'copy/c_' || p_partkey || '.txt', 'lib/p_' || p_partkey || '.txt', 'copied', 1, 1 FROM part
      WHERE p_partkey % 5 = 3 AND p_partkey % 3 = 0""",
)
def q_file_copies(spark, sf):
    tree = fx.view(spark, sf, "moved_tree")
    copies = tree.filter("ref = 'head' AND path LIKE 'lib/%'").withColumn("key", F.regexp_extract("path", "([0-9]+)", 1).cast("long"))
    copies = copies.filter("key % 3 = 0").withColumn("path", F.concat(F.lit("copy/c_"), F.col("key"), F.lit(".txt"))).drop("key")
    tree, ranges = tree.unionByName(copies), one_range(spark, "r4")
    found = with_line_churn(file_copies(file_renames(diff_trees(tree, ranges), tree), tree, ranges), tree)
    return found.filter("change_type = 'copied'").select("path", "old_path", "change_type", "lines_added", "lines_removed")


def _worktree(spark, sf):
    return diff_worktree(
        fx.view(spark, sf, "work_tree"), one_range(spark, "r3", "HEAD", "WORKTREE")
    ).select("path", "change_type", "change_scope", "size_before", "size_after")


SCOPED = (
    "SELECT path, change_type, '{s}' AS change_scope, coalesce(strlen(b), 0) AS size_before, "
    "coalesce(strlen(h), 0) AS size_after FROM d"
)
SQL_STAGED = sql(["work_tree"], STAGED + SCOPED.format(s="staged"))
SQL_UNSTAGED = sql(["work_tree"], UNSTAGED + SCOPED.format(s="unstaged") + " WHERE change_type <> 'added'")
SQL_BOTH = f"SELECT * FROM ({SQL_STAGED}) s UNION ALL SELECT * FROM ({SQL_UNSTAGED}) u"


@query("diff_worktree", SQL_BOTH)
def q_diff_worktree(spark, sf):
    return _worktree(spark, sf)


@query("staged_changes", SQL_STAGED)
def staged_changes(spark, sf):
    return _worktree(spark, sf).filter("change_scope = 'staged'")


@query("unstaged_changes", SQL_UNSTAGED)
def unstaged_changes(spark, sf):
    return _worktree(spark, sf).filter("change_scope = 'unstaged'")


@query("union_scopes", f"SELECT path, count(*) AS scopes FROM ({SQL_BOTH}) b GROUP BY path")
def union_scopes(spark, sf):
    return _worktree(spark, sf).groupBy("path").agg(F.count("*").alias("scopes"))


# --- scalars ----------------------------------------------------------------------


def over_paths(name: str, expr, oracle: str) -> None:
    @query(name, DUCK_PATHS + f"SELECT k, path, {oracle} AS v FROM paths")
    def run(spark, sf, expr=expr):
        return paths(spark, sf).select("k", "path", expr(F.col("path")).alias("v"))


ANY_LANG = LANG_CASES.format(e=f"({EXT_SAFE})") + " <> 'unknown'"
over_paths("detect_language", P.detect_language, LANG)
over_paths("extension_from_path", P.extension_from_path, EXT_SAFE)
over_paths("has_analyzer", P.has_analyzer, ANY_LANG)
over_paths(
    "is_generated_path",
    P.is_generated_path,
    f"""(starts_with(path, 'vendor/') OR contains(path, '/vendor/') OR starts_with(path, 'node_modules/')
    OR contains(path, '/node_modules/') OR {BASENAME} IN ('Cargo.lock','package-lock.json','poetry.lock','go.sum',
    'yarn.lock','pnpm-lock.yaml','Gemfile.lock','composer.lock') OR path LIKE '%.min.js' OR path LIKE '%.min.css'
    OR path LIKE '%.pb.go' OR suffix(path, '_generated.go'))""",
)
over_paths(
    "is_test_path",
    P.is_test_path,
    """(contains(lower(path), '/test/') OR contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/')
    OR contains(lower(path), '/spec/') OR suffix(lower(path), '_test.go') OR suffix(lower(path), '_test.rs')
    OR suffix(lower(path), '.test.ts') OR suffix(lower(path), '.test.js') OR suffix(lower(path), '.test.tsx')
    OR suffix(lower(path), '.test.jsx') OR suffix(lower(path), '_spec.rb') OR suffix(lower(path), 'test.java')
    OR suffix(lower(path), 'tests.cs') OR starts_with(lower(list_last(string_split(path, '/'))), 'test_'))""",
)
over_paths(
    "is_dependency_file", P.is_dependency_file,
    f"{BASENAME} IN ('Cargo.toml', 'package.json', 'go.mod', 'pyproject.toml')",
)
over_paths(
    "supports_scoping", P.supports_scoping,
    f"({EXT_SAFE}) IN ('rs', 'py', 'go', 'ts', 'tsx', 'js', 'jsx')",
)
over_paths("glob_include", lambda p: P.glob_include(p, ["*.rs", "src/**/*.py", "pkg_?*"]),
           "(path LIKE '%.rs' OR regexp_matches(path, '^src/(.*/)?.*\\.py$') OR regexp_matches(path, '^pkg_..*$'))")
over_paths("glob_exclude", lambda p: P.glob_exclude(p, ["**/tests/**", "[mv]*", "bad[", "*.md"]),
           "NOT (regexp_matches(path, '^(.*/)?tests/.*$') OR regexp_matches(path, '^[mv].*$') OR path LIKE '%.md')")


@query(
    "same_directory",
    DUCK_PATHS + """, d AS (SELECT k, regexp_replace(path, '/?[^/]*$', '') AS d FROM paths)
    SELECT a.k, a.d = b.d AS v FROM d a JOIN d b ON b.k = a.k + 30""",
)
def same_directory(spark, sf):
    a = paths(spark, sf)
    b = a.select((F.col("k") - 30).alias("k"), F.col("path").alias("other"))
    return a.join(b, "k").select("k", P.same_directory(F.col("path"), F.col("other")).alias("v"))


# the longest prefix of so many bytes, whole characters only
DUCK_CUT = "left(text, (SELECT max(n) FROM range(0, {n} + 1) t(n) WHERE strlen(left(text, n)) <= {n}))"


@query(
    "is_generated_content",
    f"""SELECT doc_id, regexp_matches(lower({DUCK_CUT.format(n=1024)}), 'do not edit|generated by|auto-generated') AS v
    FROM documents""",
)
def is_generated_content(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", P.is_generated_content(F.col("text")).alias("v"))


NAMES = """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'std::a::' || p_name
  WHEN 1 THEN 'x.y.' || p_name WHEN 2 THEN 'A::b.c' ELSE p_name END AS name FROM @part@"""


@query(
    "leaf_name",
    "SELECT k, CASE WHEN contains(name, '::') THEN list_last(string_split(name, '::')) "
    f"ELSE list_last(string_split(name, '.')) END AS v FROM ({fx.to_duckdb(NAMES)}) n",
)
def leaf_name(spark, sf):
    return fx.from_sql(spark, sf, NAMES).select("k", T.leaf_name(F.col("name")).alias("v"))


@query("sha256_hex", "SELECT doc_id, sha256(text) AS v FROM documents")
def sha256_hex(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.sha256_hex(F.col("text")).alias("v"))


def over_requests(name: str, expr, oracle: str) -> None:
    @query(name, sql(["requests"], f"SELECT event_id, {oracle} AS v FROM requests"))
    def run(spark, sf, expr=expr):
        return fx.view(spark, sf, "requests").select("event_id", expr().alias("v"))


PATTERN = """CASE base_ref WHEN 'main' THEN 'branch' WHEN 'HEAD~1' THEN 'single_commit'
 WHEN 'a..b' THEN 'range_double_dot' WHEN 'a...b' THEN 'range_triple_dot' ELSE 'sha' END"""
ERROR = """CASE error WHEN 'could not resolve ref' THEN 'ref_not_found' WHEN 'not a git repository' THEN 'repo_not_found'
 WHEN 'parse failure' THEN 'parse_failed' WHEN 'permission denied' THEN 'io_error' END"""
REASON = "CASE WHEN truncation_reason = 'tokn_budget' THEN 'unknown' ELSE truncation_reason END"
over_requests("hash_repo_path", lambda: L.hash_repo_path(F.col("repo_path")), "sha256(repo_path)")
over_requests("ref_pattern", lambda: L.ref_pattern(F.col("base_ref")), PATTERN)
over_requests(
    "ref_mode", lambda: L.ref_mode(F.col("base_ref"), F.col("head_ref")),
    f"CASE WHEN head_ref IS NULL THEN 'worktree' ELSE {PATTERN} END",
)
over_requests(
    "truncation_reason",
    lambda: F.when(F.col("truncation_reason").isNotNull(), L.truncation_reason(F.col("truncation_reason"))),
    REASON,
)
over_requests(
    "error_kind", lambda: F.when(F.col("error").isNotNull(), L.error_kind(F.col("error"))), ERROR
)


@query(
    "estimate_tokens",
    """SELECT s_suppkey, CAST(floor(strlen('{"s_suppkey":' || CAST(s_suppkey AS VARCHAR) || ',"s_name":"' || s_name ||
    '","old_name":null}') / 4) AS BIGINT) AS v FROM supplier""",
)
def estimate_tokens(spark, sf):
    entry = F.struct("s_suppkey", "s_name", F.lit(None).cast("string").alias("old_name"))
    return fx.table(spark, sf, "supplier").select("s_suppkey", T.estimate_tokens(entry).alias("v"))


@query(
    "truncate_content",
    f"""SELECT doc_id, strlen(text) AS size_bytes, strlen(text) > 500 AS truncated,
    {DUCK_CUT.format(n=500)} AS content FROM documents""",
)
def truncate_content(spark, sf):
    shown = T.file_content(F.col("text"), 500)
    docs = fx.table(spark, sf, "documents").select("doc_id", shown.alias("c"))
    return docs.select("doc_id", "c.size_bytes", "c.truncated", "c.content")


@query(
    "line_range",
    """, l AS (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1)
      ELSE text END, chr(10))[3:5] AS ls FROM documents)
    SELECT doc_id, CASE WHEN len(ls) = 0 OR array_to_string(ls, chr(10)) = '' THEN ''
      ELSE array_to_string(ls, chr(10)) || chr(10) END AS content FROM l""".replace(", l AS", "WITH l AS", 1),
)
def line_range(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", T.file_content(F.col("text"), line_range=(3, 5))["content"].alias("content"))


BINARY = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(0) ELSE text END AS content FROM @documents@"


@query(
    "binary_content",
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE {DUCK_LINES.format(c='content')} END AS line_count,
    CASE WHEN doc_id % 4 = 0 THEN 0 ELSE length(content) END AS shown, strlen(content) AS size_bytes
    FROM ({fx.to_duckdb(BINARY)}) b""",
)
def binary_content(spark, sf):
    shown = T.file_content(F.col("content"))
    return fx.from_sql(spark, sf, BINARY).select("doc_id", shown.alias("c")).select(
        "doc_id", "c.line_count", F.length("c.content").cast("bigint").alias("shown"), "c.size_bytes"
    )
