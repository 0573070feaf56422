"""Source trees, commits, requests and commands derived from the test tables.

The driver's tables hold no code, so each view below is one SELECT that Spark
and DuckDB both run. ``view(name)`` gives a DataFrame, ``cte(names)`` the same
SELECTs as a WITH clause for the oracle. Files are cut in blocks of fixed size,
so more input means more files and not longer ones.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ["documents", "part", "supplier", "lineitem", "orders", "events"]


class _Spark:
    def lines(self, expr: str, order: str) -> str:
        return f"listagg({expr}, chr(10)) WITHIN GROUP (ORDER BY {order})"

    def sha(self, expr: str) -> str:
        return f"sha2({expr}, 256)"


class _DuckDB:
    def lines(self, expr: str, order: str) -> str:
        return f"string_agg({expr}, chr(10) ORDER BY {order})"

    def sha(self, expr: str) -> str:
        return f"sha256({expr})"


DOC_NAME = """source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) ||
       CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.go'
                       WHEN 3 THEN '.ts' WHEN 4 THEN '.md' ELSE '.txt' END"""


def _doc_tree(d) -> str:
    # about 10% added, 10% deleted, the rest unchanged, edited or moved
    return f"""
SELECT 'r0' AS repo, 'base' AS ref, {DOC_NAME} AS path, text AS content
FROM @documents@ WHERE doc_id % 10 <> 0
UNION ALL
SELECT 'r0' AS repo, 'head' AS ref,
       CASE WHEN doc_id % 13 = 5 THEN 'moved/' ELSE '' END || {DOC_NAME} AS path,
       CASE WHEN doc_id % 5 = 2 THEN text || chr(10) || 'tail line'
            WHEN doc_id % 7 = 3 THEN 'head line' || chr(10) || text
            ELSE text END AS content
FROM @documents@ WHERE doc_id % 10 <> 1"""


# a crate of generated Rust: 40 parts to a file. By p_partkey % 10: 0 deleted,
# 1 added, 2 body changed, 3 renamed, 4 signature changed; head order reversed.
MODULE = "lpad(CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING), 9, '0')"
CODE_PATH = f"'src/src_' || {MODULE} || '.rs'"


def _code_tree(d) -> str:
    base_fn = """'pub fn function_' || CAST(p_partkey AS STRING) || '() -> i32 {' || chr(10) ||
               '    ' || CAST(p_partkey * 7 AS STRING) || chr(10) || '}'"""
    head_fn = """'pub fn ' || CASE WHEN p_partkey % 10 = 3 THEN 'renamed_' ELSE 'function_' END ||
               CAST(p_partkey AS STRING) ||
               CASE WHEN p_partkey % 10 = 4 THEN '(x: i32)' ELSE '()' END || ' -> i32 {' || chr(10) ||
               '    ' || CAST(p_partkey * 7 AS STRING) ||
               CASE WHEN p_partkey % 10 = 2 THEN ' + 1' ELSE '' END || chr(10) || '}'"""
    return f"""
SELECT 'r1' AS repo, 'base' AS ref, path, {d.lines('body', 'p_partkey')} || chr(10) AS content
FROM (SELECT p_partkey, {CODE_PATH} AS path, {base_fn} AS body
      FROM @part@ WHERE p_partkey % 10 <> 1) b GROUP BY path
UNION ALL
SELECT 'r1' AS repo, 'head' AS ref, path, {d.lines('body', '0 - p_partkey')} || chr(10) AS content
FROM (SELECT p_partkey, {CODE_PATH} AS path, {head_fn} AS body
      FROM @part@ WHERE p_partkey % 10 <> 0) h GROUP BY path"""


def _code_truth(d) -> str:
    return f"""
SELECT {CODE_PATH} AS path,
       CASE WHEN p_partkey % 10 = 3 THEN 'renamed_' ELSE 'function_' END || CAST(p_partkey AS STRING) AS name,
       CASE p_partkey % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' WHEN 2 THEN 'modified'
                           WHEN 3 THEN 'renamed' ELSE 'signature_changed' END AS change_type,
       CASE WHEN p_partkey % 10 = 3 THEN 'function_' || CAST(p_partkey AS STRING) END AS old_name
FROM @part@ WHERE p_partkey % 10 < 5"""


# one row per wrapper function: supplier s calls the function of part p.
# Even suppliers import the part's module, keys divisible by 5 are tests.
def _call_rows(d) -> str:
    return f"""
SELECT l_suppkey, l_partkey, k, block,
       CASE WHEN l_suppkey % 5 = 0 THEN 'tests/test_' ELSE 'src/call_' END ||
       lpad(CAST(l_suppkey AS STRING), 9, '0') || '_' || CAST(block AS STRING) || '.rs' AS path,
       'c_' || CAST(k AS STRING) AS caller,
       {MODULE} AS module
FROM (SELECT DISTINCT l_suppkey, l_partkey, p_partkey,
             l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS k,
             CAST(floor(l_orderkey / 16384) AS BIGINT) AS block
      FROM @lineitem@ JOIN @part@ ON l_partkey = p_partkey) x"""


def _call_tree(d) -> str:
    body = """CASE WHEN l_suppkey % 2 = 0
                    THEN 'use crate::src_' || module || '::function_' ||
                         CAST(l_partkey AS STRING) || ';' || chr(10) ELSE '' END ||
               'pub fn ' || caller || '() -> i32 { function_' || CAST(l_partkey AS STRING) || '() }'"""
    return f"""
SELECT 'r1' AS repo, 'head' AS ref, path, {d.lines('body', 'k')} || chr(10) AS content
FROM (SELECT path, k, {body} AS body FROM ({_call_rows(d)}) r) b GROUP BY path"""


def _graph_tree(d) -> str:
    return f"SELECT * FROM ({_code_tree(d)}) c UNION ALL SELECT * FROM ({_call_tree(d)}) t"


# one file of ten lines to a part. By p_partkey % 5: 0 moved, 1 moved with one line
# changed, 2 moved with seven changed, 3 one changed in place, 4 as it was
def _moved_tree(d) -> str:
    def text(changed: int) -> str:
        return " || ".join(f"'{'new ' if i < changed else ''}{c} ' || k || chr(10)" for i, c in enumerate("abcdefghij"))

    return f"""
SELECT 'r4' AS repo, 'base' AS ref, 'lib/p_' || k || '.txt' AS path, {text(0)} AS content
FROM (SELECT CAST(p_partkey AS STRING) AS k FROM @part@) b
UNION ALL
SELECT 'r4' AS repo, 'head' AS ref, CASE WHEN p_partkey % 5 < 3 THEN 'src/q_' ELSE 'lib/p_' END || k || '.txt' AS path,
       CASE p_partkey % 5 WHEN 2 THEN {text(7)} WHEN 0 THEN {text(0)} WHEN 4 THEN {text(0)} ELSE {text(1)} END AS content
FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS k FROM @part@) h"""


# eight linear histories, one per repository
def _commit_log(d) -> str:
    return f"""
SELECT 'r' || CAST(c.o_orderkey % 8 AS STRING) AS repo,
       {d.sha("'c' || CAST(c.o_orderkey AS STRING)")} AS sha,
       CASE WHEN p.o_orderkey IS NOT NULL
            THEN {d.sha("'c' || CAST(c.o_orderkey - 8 AS STRING)")} END AS parent_sha,
       c.o_orderkey AS seq, CAST(c.o_custkey AS STRING) AS author,
       c.o_orderdate AS authored_at, c.o_orderpriority AS message
FROM @orders@ c LEFT JOIN @orders@ p ON p.o_orderkey = c.o_orderkey - 8"""


def _commit_files(d) -> str:
    return f"""
SELECT {d.sha("'c' || CAST(l_orderkey AS STRING)")} AS sha,
       'src/p_' || CAST(l_partkey AS STRING) ||
       CASE l_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.txt' END AS path,
       CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type,
       CAST(l_quantity AS BIGINT) AS lines_added, CAST(floor(l_tax * 100) AS BIGINT) AS lines_removed
FROM @lineitem@"""


# trees after each commit of short histories: 60 orders to a repository, the
# file of part class p_size holds the last order that touched it
HISTORY_BLOCK = 30


def _history_log(d) -> str:
    return f"""
SELECT 'h' || CAST(CAST(floor(c.o_orderkey / {HISTORY_BLOCK}) AS BIGINT) AS STRING) AS repo,
       {d.sha("'h' || CAST(c.o_orderkey AS STRING)")} AS sha,
       CASE WHEN c.o_orderkey % {HISTORY_BLOCK} <> 0 AND p.o_orderkey IS NOT NULL
            THEN {d.sha("'h' || CAST(c.o_orderkey - 1 AS STRING)")} END AS parent_sha,
       c.o_orderkey AS seq, CAST(c.o_custkey AS STRING) AS author,
       c.o_orderdate AS authored_at, c.o_orderpriority AS message
FROM @orders@ c LEFT JOIN @orders@ p ON p.o_orderkey = c.o_orderkey - 1"""


def _history_tree(d) -> str:
    # five files per commit; file j changes when (seq + j) % 3 = 0
    rows = "\nUNION ALL\n".join(
        f"""SELECT o_orderkey, {j} AS j FROM @orders@""" for j in range(5)
    )
    return f"""
SELECT 'h' || CAST(CAST(floor(o_orderkey / {HISTORY_BLOCK}) AS BIGINT) AS STRING) AS repo,
       {d.sha("'h' || CAST(o_orderkey AS STRING)")} AS ref,
       'lib/f' || CAST(j AS STRING) || CASE j WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.txt' END AS path,
       CASE j WHEN 0 THEN 'def f():' || chr(10) || '    return ' || v || chr(10)
              WHEN 1 THEN 'fn f() -> i64 {{' || chr(10) || '    ' || v || chr(10) || '}}' || chr(10)
              ELSE 'value ' || v || chr(10) END AS content
FROM (SELECT o_orderkey, j,
             CAST(CAST(floor((o_orderkey + j) / 3) AS BIGINT) AS STRING) AS v
      FROM ({rows}) r) x"""


def _requests(d) -> str:
    return """
SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'change_manifest' WHEN 1 THEN 'file_snapshots'
                WHEN 2 THEN 'commit_history' WHEN 3 THEN 'function_context' ELSE 'review_change' END AS tool,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN
            CASE event_id % 4 WHEN 0 THEN 'could not resolve ref' WHEN 1 THEN 'not a git repository'
                 WHEN 2 THEN 'parse failure' ELSE 'permission denied' END END AS error,
       value AS duration_ms, (event_id * 37) % 200000 AS bytes,
       CASE user_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'HEAD~1' WHEN 2 THEN 'a..b'
            WHEN 3 THEN 'a...b' ELSE '0123456789abcdef' END AS base_ref,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'HEAD' END AS head_ref,
       CASE event_id % 6 WHEN 0 THEN 'paginated' WHEN 1 THEN 'token_budget'
            WHEN 2 THEN 'max_file_size' WHEN 3 THEN 'tokn_budget' END AS truncation_reason,
       CASE event_id % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'staged' WHEN 2 THEN 'unstaged' END AS change_scope,
       CASE event_id % 7 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go'
            WHEN 3 THEN 'unknown' END AS language,
       '/home/u' || CAST(user_id AS STRING) || '/repo' AS repo_path,
       user_id AS session_id,
       (event_id * 7) % 30000 AS files, (event_id * 13) % 700 AS functions,
       event_id % 9 = 0 AS has_cursor
FROM @events@"""


def _commands(d) -> str:
    return """
SELECT event_id AS id, ts, user_id AS user,
       CASE event_id % 11 WHEN 9 THEN 'mcp__github__get_commit' ELSE 'Bash' END AS tool_name,
       CASE event_id % 11 WHEN 0 THEN 'git diff main..HEAD' WHEN 1 THEN 'git log -S term'
            WHEN 2 THEN 'cd /tmp && git log a..b | head' WHEN 3 THEN 'git status'
            WHEN 4 THEN 'git blame src/a.rs' WHEN 5 THEN 'cd /tmp && gh pr diff 12'
            WHEN 6 THEN '(git show abc)' WHEN 7 THEN 'git diff ..' WHEN 8 THEN 'echo `git diff x..y`'
            WHEN 9 THEN '' ELSE 'cat <<EOF' || chr(10) || 'git diff a..b' || chr(10) || 'EOF' || chr(10) || 'git status' END AS command
FROM @events@"""


# 50 parts to a manifest file; p_partkey % 10 = 0 removed, 1 added, 2 version bumped
DEP_DIR = "'pkg_' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING)"


def _dep_file(d, name: str, head: str, line: str, changed: str, tail: str, glue: str) -> str:
    def side(ref: str, skip: int) -> str:
        item = line if ref == "base" else f"CASE WHEN p_partkey % 10 = 2 THEN {changed} ELSE {line} END"
        body = d.lines("item", "p_partkey")
        if glue:
            body = body.replace("chr(10)", f"'{glue}' || chr(10)", 1)
        return f"""
SELECT 'r2' AS repo, '{ref}' AS ref, dir || '/{name}' AS path,
       {head} || {body} || {tail} AS content
FROM (SELECT p_partkey, {DEP_DIR} AS dir, {item} AS item
      FROM @part@ WHERE p_partkey % 10 <> {skip}) s GROUP BY dir"""

    return side("base", 1) + "\nUNION ALL" + side("head", 0)


_DEP = "'dep_' || CAST(p_partkey AS STRING)"
_VER = "CAST(p_size AS STRING) || '.0'"
_NEW = "CAST(p_size + 1 AS STRING) || '.0'"


def _cargo_tree(d) -> str:
    return _dep_file(
        d, "Cargo.toml",
        "'[package]' || chr(10) || 'name = \"x\"' || chr(10) || '[dependencies]' || chr(10)",
        f"{_DEP} || ' = \"' || {_VER} || '\"'",
        f"{_DEP} || ' = {{ version = \"' || {_NEW} || '\", optional = true }}'",
        "chr(10)", "",
    )


def _package_json_tree(d) -> str:
    return _dep_file(
        d, "package.json",
        "'{\"name\": \"x\", \"dependencies\": {' || chr(10)",
        f"'    \"' || {_DEP} || '\": \"' || {_VER} || '\"'",
        f"'    \"' || {_DEP} || '\": \"' || {_NEW} || '\"'",
        "chr(10) || '}}' || chr(10)", ",",
    )


def _go_mod_tree(d) -> str:
    return _dep_file(
        d, "go.mod",
        "'module example.com/x' || chr(10) || 'require (' || chr(10)",
        f"'    ' || {_DEP} || ' v' || {_VER}",
        f"'    ' || {_DEP} || ' v' || {_NEW}",
        "chr(10) || ')' || chr(10)", "",
    )


def _pyproject_tree(d) -> str:
    return _dep_file(
        d, "pyproject.toml",
        "'[project]' || chr(10) || 'dependencies = [' || chr(10)",
        f"'    \"' || {_DEP} || '>=' || {_VER} || '\",'",
        f"'    \"' || {_DEP} || '>=' || {_NEW} || '\",'",
        "chr(10) || ']' || chr(10)", "",
    )


def _dep_tree(d) -> str:
    parts = [_cargo_tree(d), _package_json_tree(d), _go_mod_tree(d), _pyproject_tree(d)]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) t{i}" for i, p in enumerate(parts))


# what the four formats say: name, old and new version per dependency
def _dep_truth(d) -> str:
    rows = []
    for name, pre in [("Cargo.toml", ""), ("package.json", ""), ("go.mod", "v"), ("pyproject.toml", ">=")]:
        rows.append(f"""
SELECT {DEP_DIR} || '/{name}' AS path, {_DEP} AS name,
       CASE p_partkey % 10 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS kind,
       CASE WHEN p_partkey % 10 <> 1 THEN '{pre}' || {_VER} END AS old_version,
       CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 2 THEN '{pre}' || {_NEW}
            ELSE '{pre}' || {_VER} END AS new_version
FROM @part@ WHERE p_partkey % 10 < 3""")
    return "\nUNION ALL".join(rows)


# HEAD, index and disk of one working copy
def _work_tree(d) -> str:
    edit = "CASE WHEN doc_id % {m} = {r} THEN text || chr(10) || '{t}' ELSE text END"
    return f"""
SELECT 'r3' AS repo, 'HEAD' AS ref, {DOC_NAME} AS path, text AS content
FROM @documents@ WHERE doc_id % 11 <> 0
UNION ALL
SELECT 'r3' AS repo, 'INDEX' AS ref, {DOC_NAME} AS path,
       {edit.format(m=5, r=1, t='staged')} AS content
FROM @documents@ WHERE doc_id % 11 <> 1
UNION ALL
SELECT 'r3' AS repo, 'WORKTREE' AS ref, {DOC_NAME} AS path,
       CASE WHEN doc_id % 7 = 2 THEN {edit.format(m=5, r=1, t='staged')} || chr(10) || 'unstaged'
            ELSE {edit.format(m=5, r=1, t='staged')} END AS content
FROM @documents@ WHERE doc_id % 11 <> 2"""


VIEWS = {
    "doc_tree": _doc_tree,
    "code_tree": _code_tree,
    "code_truth": _code_truth,
    "moved_tree": _moved_tree,
    "call_rows": _call_rows,
    "call_tree": _call_tree,
    "graph_tree": _graph_tree,
    "commit_log": _commit_log,
    "commit_files": _commit_files,
    "history_log": _history_log,
    "history_tree": _history_tree,
    "requests": _requests,
    "commands": _commands,
    "cargo_tree": _cargo_tree,
    "package_json_tree": _package_json_tree,
    "go_mod_tree": _go_mod_tree,
    "pyproject_tree": _pyproject_tree,
    "dep_tree": _dep_tree,
    "dep_truth": _dep_truth,
    "work_tree": _work_tree,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _merged(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table as a view whose joins are merged, whatever its size is taken for."""
    view = f"treeshift_{name}_{zlib.crc32(sf_dir.encode()):08x}"
    table(spark, sf_dir, name).hint("merge").createOrReplaceTempView(view)
    return view


def from_sql(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    # orders meet themselves by their key, whose size is estimated from the compressed
    # file, far below that of the table that a broadcast makes of it in each executor
    if "@orders@" in template:
        template = template.replace("@orders@", _merged(spark, sf_dir, "orders"))
    for t in TABLES:
        template = template.replace(f"@{t}@", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(template)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_sql(spark, sf_dir, VIEWS[name](_Spark()))


def spark_dialect() -> _Spark:
    return _Spark()


def duckdb_dialect() -> _DuckDB:
    return _DuckDB()


def to_duckdb(template: str) -> str:
    for t in TABLES:
        template = template.replace(f"@{t}@", t)
    return template


def cte(*names: str) -> str:
    """``WITH name AS (...), ...`` for the oracle."""
    parts = [f"{n} AS ({to_duckdb(VIEWS[n](_DuckDB()))})" for n in names]
    return "WITH " + ",\n".join(parts)
