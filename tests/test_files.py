import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeshift.functions import paths as P
from treeshift.catalog.files import write_folders
from treeshift.operators import line_churn
from treeshift.operators.file_diff import diff_trees, diff_worktree
from treeshift.operators.line_churn import _common_lines, _trimmed, _trimmed_short, with_line_churn
from treeshift.operators.numbering import number_rows
from treeshift.operators.renames import best_matches, file_copies, file_renames, similar_pairs
from treeshift.plans import history
from treeshift.plans.manifest import worktree_manifest
from treeshift.plans.refresh import facts_of, refresh_ranges
from treeshift.sources.commits import first_parent_walk
from treeshift.functions.text import file_content, packed, unpacked
from treeshift.sources.stores import ContentStore, SymbolStore
from treeshift.sources.trees import blobs, read_file_at_ref, scan_tree, write_tree


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_common_lines_is_exact():
    rng = random.Random(7)
    for _ in range(300):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(30))], dtype="int64")
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(30))], dtype="int64")
        want = lcs(a.tolist(), b.tolist())
        assert _common_lines(a, b) == want
        assert _common_lines(a, b, width=7) == want  # carries between blocks


def test_diff_of_equal_trees_is_empty_and_mirrors(spark, make_tree, one_range):
    a = {"a.rs": "x\n", "b.txt": "one\ntwo", "c.bin": "\x00"}
    b = {"a.rs": "y\n", "d.txt": "", "c.bin": "\x00\x00"}
    assert diff_trees(make_tree(a, a), one_range).isEmpty()
    kinds = {r.path: r for r in diff_trees(make_tree(a, b), one_range).collect()}
    assert {p: r.change_type for p, r in kinds.items()} == {
        "a.rs": "modified", "b.txt": "deleted", "d.txt": "added", "c.bin": "modified"
    }
    assert kinds["c.bin"].is_binary and kinds["c.bin"].lines_added == 0
    assert kinds["b.txt"].lines_removed == 2 and kinds["d.txt"].lines_added == 0
    back = {r.path: r.change_type for r in diff_trees(make_tree(b, a), one_range).collect()}
    swap = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert back == {p: swap[r.change_type] for p, r in kinds.items()}


def test_churn_respects_order(make_tree, one_range):
    tree = make_tree({"a.txt": "1\n2\n3\n"}, {"a.txt": "3\n1\n2\n"})
    changes = diff_trees(tree, one_range)
    exact = with_line_churn(changes, tree).first()
    assert (exact.lines_added, exact.lines_removed) == (1, 1)
    loose = with_line_churn(changes, tree, exact=False).first()
    assert (loose.lines_added, loose.lines_removed) == (0, 0)


def test_worktree_scopes(make_tree, one_range):
    tree = make_tree(
        {"a": "1", "b": "1", "c": "1"}, {},
        INDEX={"a": "2", "b": "1", "c": "1", "new": "1"},
        WORKTREE={"a": "3", "b": "2", "new": "1", "untracked": "1"},
    )
    got = {(r.path, r.change_scope, r.change_type) for r in diff_worktree(tree, one_range).collect()}
    assert got == {
        ("a", "staged", "modified"), ("new", "staged", "added"),
        ("a", "unstaged", "modified"), ("b", "unstaged", "modified"), ("c", "unstaged", "deleted"),
    }


def _multiset_bytes(a, b):
    from collections import Counter

    ca, cb = Counter(a.splitlines(True)), Counter(b.splitlines(True))
    return sum(len(line) * n for line, n in (ca & cb).items())


def test_similar_pairs_match_brute_force(make_tree, one_range):
    rng = random.Random(3)
    lines = [f"line number {i}\n" for i in range(12)] + ["}\n"] * 6
    old = {f"old{i}": "".join(rng.sample(lines, rng.randrange(3, 14))) for i in range(25)}
    new = {f"new{i}": "".join(rng.sample(lines, rng.randrange(3, 14))) for i in range(25)}
    tree = make_tree(old, new)
    got = {
        (r.old_path, r.path): round(r.similarity, 9)
        for r in similar_pairs(diff_trees(tree, one_range), tree).collect()
    }
    want = {}
    for o, a in old.items():
        for n, b in new.items():
            share = _multiset_bytes(a, b) / max(len(a), len(b))
            if share >= 0.5:
                want[(o, n)] = round(share, 9)
    assert got == want


def test_best_matches_is_greedy(spark):
    rng = random.Random(5)
    pairs = [("x", f"o{i}", f"n{j}", rng.choice([0.5, 0.6, 0.7, 0.9])) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(pairs, "range_id string, old_path string, path string, similarity double")
    ranked = df.orderBy(F.desc("similarity"), F.desc(F.xxhash64("old_path", "path"))).collect()
    olds, news, want = set(), set(), set()
    for r in ranked:
        if r.old_path not in olds and r.path not in news:
            olds.add(r.old_path), news.add(r.path), want.add((r.old_path, r.path))
    assert {(r.old_path, r.path) for r in best_matches(df).collect()} == want


def test_renames_fold_into_one_row(make_tree, one_range):
    body = "".join(f"line {i}\n" for i in range(20))
    tree = make_tree(
        {"a.txt": body, "copy1": "same\n", "copy2": "same\n", "gone": "bye\n"},
        {"moved/a.txt": body + "tail\n", "z1": "same\n", "z2": "same\n", "fresh": "hello\n"},
    )
    found = with_line_churn(file_renames(diff_trees(tree, one_range), tree), tree)
    rows = {r.path: (r.change_type, r.old_path, r.lines_added) for r in found.collect()}
    assert rows == {
        "moved/a.txt": ("renamed", "a.txt", 1),
        "z1": ("renamed", "copy1", 0),
        "z2": ("renamed", "copy2", 0),
        "gone": ("deleted", None, 0),
        "fresh": ("added", None, 1),
    }


def test_numbering_of_one_hot_group(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.xxhash64("id").alias("o"),
    )
    got = number_rows(df.repartition(16), ["g"], ["o"])
    from pyspark.sql import Window

    want = got.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert want.count() == 20_000
    assert want.filter("w <> position").isEmpty()


def test_globs(spark):
    cases = [
        ("src/a/b.rs", "*.rs", True), ("src/a.rs", "src/*", True), (".env", "*", True),
        ("a/b/c.py", "a/**/c.py", True), ("a/c.py", "a/**/c.py", True), ("A.rs", "a.rs", False),
        ("ab", "a?", True), ("a.txt", "a[", False), ("x1", "x[0-9]", True), ("xb", "x[!0-9]", True), ("ab", "a**b", False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "path string")
    for path, pattern, want in cases:
        hit = df.filter(F.col("path") == path).select(P.matches_any_glob(F.col("path"), [pattern])).first()[0]
        assert hit is want, (path, pattern)


def test_walk_over_branches(spark):
    rows = [("r", f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    rows += [("r", f"b{i}", f"b{i - 1}" if i else "c10") for i in range(5)]
    commits = spark.createDataFrame(rows, "repo string, sha string, parent_sha string")
    ranges = spark.createDataFrame(
        [("main", "r", "c3", "c39"), ("branch", "r", "c8", "b4"), ("none", "r", "b2", "c20"), ("same", "r", "c5", "c5")],
        "range_id string, repo string, base_sha string, head_sha string",
    )
    got = {}
    for r in first_parent_walk(commits, ranges).orderBy("range_id", "seq").collect():
        got.setdefault(r.range_id, []).append(r.sha or r.error)
    assert got["main"] == [f"c{i}" for i in range(4, 40)]
    assert got["branch"] == ["c9", "c10", "b0", "b1", "b2", "b3", "b4"]
    assert got["none"] == ["base_not_an_ancestor"]
    assert "same" not in got


def test_walk_in_a_circle_ends(spark):
    rows = [("r", f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("s", "a", None), ("s", "b", "a")]
    commits = spark.createDataFrame(rows, "repo string, sha string, parent_sha string")
    ranges = spark.createDataFrame(
        [("lost", "r", "nowhere", "c0"), ("met", "r", "c4", "c0"), ("short", "s", "a", "b")],
        "range_id string, repo string, base_sha string, head_sha string",
    )
    got = {}
    for r in first_parent_walk(commits, ranges).orderBy("range_id", "seq").collect():
        got.setdefault(r.range_id, []).append(r.sha or r.error)
    assert got == {"lost": ["base_not_an_ancestor"], "met": ["c3", "c2", "c1", "c0"], "short": ["b"]}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_trees_are_compared_without_their_content(spark, make_tree, one_range, tmp_path):
    body = "".join(f"line {i}\n" for i in range(9))
    tree = make_tree(
        {"same": body, "edit": body, "old": body + "x\n", "bin": "\x00"}, {"same": body, "edit": body + "y", "new": "z", "bin": "\x00\x00"}
    )
    write_tree(tree, str(tmp_path / "trees"))
    landed = spark.read.parquet(str(tmp_path / "trees"))
    plan = _plan(diff_trees(landed, one_range))
    assert "lines" in plan and "content" not in plan
    want = {tuple(r) for r in diff_trees(tree, one_range).collect()}
    assert {tuple(r) for r in diff_trees(landed, one_range).collect()} == want and len(want) == 4
    # unwanted content leaves before duplicates are removed
    found = _plan(blobs(landed, landed.filter("path = 'edit'").select("blob_id")))
    assert "LeftSemi" in found and found.index("Aggregate") < found.index("LeftSemi")


def test_scan_directory(spark, tmp_path):
    tmp_path = tmp_path / "a+b (1).c"
    (tmp_path / "src").mkdir(parents=True)
    (tmp_path / "src" / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        tree = scan_tree(spark, root, "r", "head")
        assert {(r.path, r.content) for r in tree.collect()} == {("src/a.rs", "fn a() {}\n"), ("bad.bin", None)}
    wanted = spark.createDataFrame(
        [("r", "head", p) for p in ("src/a.rs", "bad.bin", "nope")], "repo string, ref string, path string"
    )
    errors = {r.path: r.error for r in read_file_at_ref(tree, wanted).collect()}
    assert errors == {"src/a.rs": None, "bad.bin": "not_utf8", "nope": "file_not_found"}


def test_write_tree_keeps_other_repositories(spark, make_tree, tmp_path):
    first = make_tree({"a": "1"}, {"a": "2"})
    second = first.withColumn("repo", F.lit("other"))
    for tree in (first, second, second.filter("ref = 'base'")):
        write_tree(tree, str(tmp_path / "trees"))
    rows = spark.read.parquet(str(tmp_path / "trees")).select("repo", "ref").collect()
    assert sorted(map(tuple, rows)) == [("other", "base"), ("r", "base"), ("r", "head")]


def test_content_is_whole_unless_a_cut_is_asked_for(spark):
    text = spark.createDataFrame([("é" * 200_000,)], "t string")
    whole, cut = text.select(file_content(F.col("t")), file_content(F.col("t"), 101)).first()
    assert (len(whole.content), whole.truncated) == (200_000, False)
    assert (len(cut.content), cut.truncated, cut.size_bytes) == (50, True, 400_000)


def test_walk_from_an_unknown_head_or_to_itself(spark):
    commits = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b")], "repo string, sha string, parent_sha string")
    ranges = [(1, "r", "a", "c"), (2, "r", "zz", "c"), (3, "r", "a", "zz"), (4, "r", "c", "c"), (5, "r", "b", "c"), (6, "s", "a", "c")]
    df = spark.createDataFrame(ranges, "range_id long, repo string, base_sha string, head_sha string")
    got = sorted(tuple(map(str, r)) for r in first_parent_walk(commits, df).select("range_id", "seq", "sha", "error").collect())
    lost = "base_not_an_ancestor"  # a base that is only named as a parent is found
    assert got == [
        ("1", "0", "b", "None"), ("1", "1", "c", "None"), ("2", "None", "None", lost), ("3", "None", "None", lost),
        ("5", "0", "c", "None"), ("6", "None", "None", lost),
    ]


def test_copies_of_equal_and_similar_files(make_tree, one_range):
    body = "".join(f"line {i}\n" for i in range(20))
    other = "".join(f"other {i}\n" for i in range(20))
    base = {"a.txt": body, "z/a.txt": body, "m.txt": other, "still.txt": "".join(f"s {i}\n" for i in range(20)), "n": ""}
    head = base | {
        "copy.txt": body, "m.txt": other + "more\n", "like.txt": other.replace("other 3", "changed"), "empty": "",
        "unlike.txt": "".join(f"s {i}\n" for i in range(19)), "new.txt": "new\n",
    }
    tree = make_tree(base, head)
    found = with_line_churn(file_copies(diff_trees(tree, one_range), tree, one_range), tree)
    rows = {r.path: (r.change_type, r.old_path, r.lines_added, r.lines_removed) for r in found.collect()}
    assert rows == {
        "copy.txt": ("copied", "a.txt", 0, 0), "like.txt": ("copied", "m.txt", 1, 1), "m.txt": ("modified", None, 1, 0),
        "empty": ("added", None, 0, 0), "unlike.txt": ("added", None, 19, 0), "new.txt": ("added", None, 1, 0),
    }
    exact = file_copies(diff_trees(tree, one_range), tree, one_range, None)
    assert {r.path for r in exact.filter("change_type = 'copied'").collect()} == {"copy.txt"}


def test_staged_renames(make_tree, spark):
    body = "".join(f"line {i}\n" for i in range(20))
    tree = make_tree({"a.txt": body, "b.txt": "b\n"}, {}, INDEX={"moved.txt": body, "b.txt": "b\n"}, WORKTREE={"moved.txt": body + "x\n"})
    ranges = spark.createDataFrame([("x", "r", "base", "WORKTREE")], "range_id string, repo string, base_ref string, head_ref string")
    manifest = worktree_manifest(tree, ranges)
    rows = {(r.path, r.change_scope): (r.change_type, r.old_path, r.lines_added) for r in manifest.files.collect()}
    assert rows == {
        ("moved.txt", "staged"): ("renamed", "a.txt", 0), ("moved.txt", "unstaged"): ("modified", None, 1),
        ("b.txt", "unstaged"): ("deleted", None, 0),
    }
    assert manifest.summary.first().files_renamed == 1


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_stay_where_they_are(spark, no_broadcast, tmp_path):
    store = ContentStore(spark, "contents_test", str(tmp_path / "c"), 8)
    spark.sql("DROP TABLE IF EXISTS contents_test")
    rows = [(str(i), f"text {i}") for i in range(200)]
    store.write_blobs(spark.createDataFrame(rows[:150], "blob_id string, content string"))
    store.write_blobs(spark.createDataFrame(rows[100:], "blob_id string, content string"))
    assert sorted((r.blob_id, r.content) for r in store.table().collect()) == sorted(rows)
    wanted = spark.createDataFrame([("3",), ("180",), ("none",), ("3",)], "blob_id string")
    found = store.lookup(wanted)
    assert {(r.blob_id, r.content) for r in found.collect()} == {("3", "text 3"), ("180", "text 180")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # every exchange is below the ids; the scan of the contents has none above it
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "content" in line)
    above = plan.splitlines()[: plan.splitlines().index(scan)]
    depth = lambda line: len(line) - len(line.lstrip(" +-:*()0123456789"))
    chain, limit = [], depth(scan)
    for line in reversed(above):
        if depth(line) < limit:
            chain.append(line)
            limit = depth(line)
    assert "SortMergeJoin" in "".join(chain) and "Exchange" not in "".join(chain)
    compact = store.compact("contents_test_2", str(tmp_path / "c2"))
    assert compact.table().count() == 200 and compact.files_per_bucket() <= 1 < store.files_per_bucket()
    spark.sql("DROP TABLE contents_test")
    spark.sql("DROP TABLE contents_test_2")


def test_symbols_are_extracted_once(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS symbols_test")
    store = SymbolStore(spark, "symbols_test", str(tmp_path / "s"), 4)
    blobs = spark.createDataFrame(
        [(str(i), "rust", f"fn f{i}() {{ g() }}\n") for i in range(6)], "blob_id string, language string, content string"
    )
    asked = []

    def content_of(ids):
        asked.append({r.blob_id for r in ids.collect()})
        return blobs.join(ids, "blob_id")

    assert store.update(blobs.filter("blob_id < 4"), content_of) == 4
    assert store.update(blobs, content_of) == 2
    assert store.update(blobs, content_of) == 0
    assert asked == [{"0", "1", "2", "3"}, {"4", "5"}]
    names = {r.blob_id: [f.name for f in r.functions] for r in store.lookup(blobs).collect()}
    assert names == {str(i): [f"f{i}"] for i in range(6)}
    spark.sql("DROP TABLE symbols_test")


def test_only_moved_ranges_are_computed_again(spark, tmp_path):
    ranges = spark.createDataFrame(
        [(i, "r", "main", f"b{i}") for i in range(20)], "range_id long, repo string, base_ref string, head_ref string"
    )
    computed = []

    def refs(**moved):
        heads = {"main": "0"} | {f"b{i}": f"s{i}" for i in range(20)} | moved
        return spark.createDataFrame([("r", k, v) for k, v in heads.items()], "repo string, ref string, sha string")

    def run(these, at):
        def compute(some):
            computed.append(sorted(r.range_id for r in some.collect()))
            shas = at.select("repo", F.col("ref").alias("head_ref"), "sha")
            return some.join(shas, ["repo", "head_ref"]).select("range_id", F.col("sha").alias("fact"))

        return refresh_ranges(spark, str(tmp_path / "f"), these, at, compute, slots=4).count()

    def facts():
        return {r.range_id: r.fact for r in facts_of(spark, str(tmp_path / "f")).collect()}

    assert run(ranges.filter("range_id < 18"), refs()) == 18
    assert run(ranges.filter("range_id < 18"), refs()) == 0
    assert run(ranges, refs(b3="new", b7="newer")) == 4
    assert computed == [list(range(18)), [3, 7, 18, 19]]
    assert facts() == {i: f"s{i}" for i in range(20)} | {3: "new", 7: "newer"}


def test_diff_reads_both_ends_in_one_scan(spark, make_tree, one_range, tmp_path):
    tree = make_tree({"same": "1\n", "edit": "1\n2\n", "old": "x", None: "a"}, {"same": "1\n", "edit": "1\n3\n", "new": "y", None: "b"})
    found = with_line_churn(diff_trees(tree, one_range), tree)
    assert {(r.path, r.change_type, r.lines_added, r.lines_removed) for r in found.collect()} == {
        ("edit", "modified", 1, 1), ("old", "deleted", 0, 1), ("new", "added", 1, 0), (None, "deleted", 0, 1), (None, "added", 1, 0)
    }
    write_tree(tree, str(tmp_path / "trees"))
    landed = spark.read.parquet(str(tmp_path / "trees"))
    changes = diff_trees(landed, one_range)
    assert sum("FileScan" in line and "blob_id" in line for line in _plan(changes).splitlines()) == 1
    # the comparison is not repeated for the line counts
    assert "Window" in _plan(changes) and "Window" not in _plan(with_line_churn(changes, landed))


def test_packed_names_come_back(spark):
    names = ["", "a", "ab", "AB", "abc", "0f" * 32, "0f" * 32 + "0", "main", "é", "\x00", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("p", packed(F.col("name")))
    rows = df.select("name", "p", unpacked(F.col("p")).alias("back")).collect()
    assert [r.back for r in rows] == names
    assert len({bytes(r.p) for r in rows if r.p is not None}) == len(names) - 1
    assert max(len(r.p) for r in rows if r.name == "0f" * 32) == 33


def test_files_per_history_counts_no_lines(spark, monkeypatch):
    log = spark.createDataFrame(
        [("r", f"s{i}", f"s{i - 1}" if i else None, "m", "a", "2024-01-01") for i in range(4)],
        "repo string, sha string, parent_sha string, message string, author string, authored_at string",
    )
    tree = spark.createDataFrame(
        [("r", f"s{i}", path, f"fn f() {{\n    {i // step}\n}}\n") for i in range(4) for path, step in [("a.rs", 1), ("b.rs", 2)]],
        "repo string, ref string, path string, content string",
    )
    ranges = spark.createDataFrame([("x", "r", "s0", "s3")], "range_id string, repo string, base_sha string, head_sha string")
    counts = []
    real = line_churn.line_churn
    monkeypatch.setattr(line_churn, "line_churn", lambda *a: counts.append(1) or real(*a))
    found = history.commit_history(tree, log, ranges)
    assert [(r.range_id, r.files) for r in history.files_per_history(found).collect()] == [("x", 4)]
    assert found.manifest.function_changes.count() == 4 and counts == []
    assert {(r.range_id, r.total_files_changed, r.total_lines_added) for r in found.manifest.summary.collect()} == {
        ("x@s1", 1, 1), ("x@s2", 2, 2), ("x@s3", 1, 1),
    }
    assert counts == [1]


def test_lists_and_arrays_trim_alike():
    draw = random.Random(3)
    for _ in range(500):
        base, head = ([draw.randrange(5) for _ in range(draw.randrange(9))] for _ in range(2))
        base, head = ([1, 2] * draw.randrange(2) + side + [3] * draw.randrange(3) for side in (base, head))
        assert _trimmed(np.array(base, dtype="int64"), np.array(head, dtype="int64")) == _trimmed_short(base, head)


def test_lines_of_one_side_make_no_candidates(make_tree, spark, one_range):
    """Files are told apart by range, and rows of lines hold numbers of files, not ranges and paths."""
    base = {"a.txt": "k 1\nk 2\nk 3\nonly base\n", "b.txt": "z\n" * 4 + "y\n"}
    head = {"c.txt": "k 1\nk 2\nk 3\nonly head\n", "d.txt": "z\n" * 4 + "x\n"}
    tree = make_tree(base, head)
    ranges = one_range.unionByName(one_range.withColumn("range_id", F.lit("x2")))
    pairs = similar_pairs(diff_trees(tree, ranges), tree)
    found = sorted((r.range_id, r.old_path, r.path) for r in pairs.collect())
    assert found == [(r, a, b) for r in ("x", "x2") for a, b in (("a.txt", "c.txt"), ("b.txt", "d.txt"))]
    assert "hashpartitioning(range_id" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_working_trees_are_read_once(make_tree, one_range, monkeypatch):
    """Staged and unstaged changes come from one comparison."""
    from treeshift.operators import file_diff

    tree = make_tree({"a": "1\n", "b": "1\n"}, {}, INDEX={"a": "2\n", "c": "1\n"}, WORKTREE={"a": "3\n", "d": "1\n"})
    reads = []
    real = file_diff.file_index
    monkeypatch.setattr(file_diff, "file_index", lambda t: reads.append(t) or real(t))
    found = diff_worktree(tree, one_range)
    assert {(r.path, r.change_scope, r.change_type) for r in found.collect()} == {
        ("a", "staged", "modified"), ("b", "staged", "deleted"), ("c", "staged", "added"),
        ("a", "unstaged", "modified"), ("c", "unstaged", "deleted"),
    }
    assert len(reads) == 1


def test_counts_of_lines_are_not_broadcast(spark, make_tree, one_range):
    tree = make_tree({"a.txt": "1\n2\n", "b.txt": "x\n"}, {"a.txt": "1\n3\n4\n", "b.txt": "y\n"})
    found = with_line_churn(diff_trees(tree, one_range), tree)
    assert {(r.path, r.lines_added, r.lines_removed) for r in found.collect()} == {("a.txt", 2, 1), ("b.txt", 1, 1)}
    assert "BroadcastExchange" not in found._jdf.queryExecution().toString()


def test_folders_of_small_files_are_plain_files(spark, tmp_path):
    """A file for each value with the lines of its rows, without a process or checksum file for each."""
    rows = [("f1", "a"), ("f2", None), ("f1", "a"), (None, "ä"), ("f3", "")]
    df = spark.createDataFrame(rows, "at string, line string").repartition(3, "at")
    for folder in (f"{tmp_path}/x", f"file:{tmp_path}/y"):
        write_folders(df, folder)
        write_folders(df, folder)  # another attempt
        found = scan_tree(spark, folder, "r", "head")
        got = {(r.path.split("/")[0], r.content) for r in found.collect()}
        assert got == {("at=f1", "a\na\n"), ("at=f2", "\n"), ("at=f3", "\n"), ("at=__HIVE_DEFAULT_PARTITION__", "ä\n")}
        assert found.count() == 4
    assert len([f for f in tmp_path.rglob("*") if f.is_file()]) == 8
