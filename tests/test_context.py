import random

import pytest
from pyspark.sql import functions as F

from treeshift.operators import call_graph as K, paging as G
from treeshift.operators.file_diff import diff_trees
from treeshift.operators.function_diff import changed_symbols, function_changes
from treeshift.operators.greedy_pages import greedy_pages
from treeshift.operators.modules import import_targets, module_keys, references
from treeshift.operators.symbols import extract_symbols
from treeshift.plans.context import budgeted_context, function_context
from treeshift.plans.manifest import budgeted_files, change_manifest
from treeshift.plans.review import review_change, shares


@pytest.fixture(scope="session")
def context_of(make_tree, one_range):
    def run(base, head):
        tree = make_tree(base, head)
        changes = diff_trees(tree, one_range)
        changed = function_changes(changes, changed_symbols(tree, changes))
        found = function_context(tree, one_range, changed)
        entries = {r.name: r for r in found.functions.collect()}
        callers = {}
        for r in found.callers.collect():
            callers.setdefault(r.name, set()).add((r.file, r.line, r.caller, r.is_test))
        callees = {}
        for r in found.callees.orderBy("line", "ordinal").collect():
            callees.setdefault(r.name, []).append(r.callee)
        return entries, callers, callees

    return run


def test_callers_of_a_rust_module(context_of):
    """An importer, a function of the same file and a test call; a file without the import does not count."""
    area = "pub fn area(w: u64, h: u64) -> u64 {\n    w * h\n}\n"
    wider = "pub fn area(w: u64, h: u64) -> u64 {\n    clip(w) * h\n}\n"
    clip, lower = "\nfn clip(w: u64) -> u64 {\n    w.min(99)\n}\n", "\nfn clip(w: u64) -> u64 {\n    w.min(50)\n}\n"
    fence = "\npub fn fence(w: u64) -> u64 {\n    let inner = area(w, w);\n    clip(inner)\n}\n"
    lonely = "\npub fn lonely() -> u64 {\n    %d\n}\n"
    around = {
        "src/garden.rs": "use crate::shapes::area;\n\nstruct Bed;\n\nimpl Bed {\n    fn soil(&self) -> u64 {\n        area(4, 5)\n    }\n}\n",
        "src/stray.rs": "fn guess() -> u64 {\n    area(1, 1)\n}\n",
        "tests/shapes_test.rs": "use crate::shapes::area;\n\n#[test]\nfn squares() {\n    let nine = area(3, 3);\n    assert_eq!(nine, 9);\n}\n",
    }
    entries, callers, callees = context_of(
        {"src/shapes.rs": area + clip + lonely % 1, **around},
        {"src/shapes.rs": wider + lower + fence + lonely % 2, **around},
    )
    places = {(path, is_test) for path, _, _, is_test in callers["area"]}
    assert places == {("src/shapes.rs", False), ("src/garden.rs", False), ("tests/shapes_test.rs", True)}
    assert entries["area"].scoping_mode == "scoped"
    assert entries["lonely"].risk == "none" and "lonely" not in callers
    assert entries["area"].risk == "low" and entries["clip"].risk == "medium"
    assert callees["fence"] == ["area", "clip"]


def test_scoping_by_language(context_of):
    py, py2 = "def compute(x):\n    return x\n", "def compute(x):\n    return x + 1\n"
    rest = {
        "app.py": "from lib import compute\n\ndef main():\n    compute(1)\n", "un.py": "def other():\n    compute(2)\n"
    }
    _, callers, _ = context_of({"lib.py": py, **rest}, {"lib.py": py2, **rest})
    assert {c[0] for c in callers["compute"]} == {"app.py"}
    go, go2 = "package lib\n\nfunc Compute() int {\n\treturn 1\n}\n", "package lib\n\nfunc Compute() int {\n\treturn 2\n}\n"
    rest = {
        "go.mod": "module example.com/m\n", "lib/caller.go": "package lib\n\nfunc Use() {\n\tCompute()\n}\n",
        "far/far.go": "package far\n\nfunc F() {\n\tCompute()\n}\n",
        "cmd/main.go": 'package main\n\nimport "example.com/m/lib"\n\nfunc main() {\n\tlib.Compute()\n}\n',
    }
    _, callers, _ = context_of({"lib/lib.go": go, **rest}, {"lib/lib.go": go2, **rest})
    assert {c[0] for c in callers["Compute"]} == {"lib/caller.go", "cmd/main.go"}
    ts, ts2 = "export function compute() {\n  return 1;\n}\n", "export function compute() {\n  return 2;\n}\n"
    rest = {"app/x.ts": "import { compute } from '../lib';\nfunction x() {\n  compute();\n}\n", "y.ts": "function y() {\n  compute();\n}\n"}
    _, callers, _ = context_of({"lib.ts": ts, **rest}, {"lib.ts": ts2, **rest})
    assert {c[0] for c in callers["compute"]} == {"app/x.ts"}


def test_fallback_scans_everything(context_of):
    rest = {"b.rb": "def run\n  compute(1)\nend\n", "c.py": "def c():\n    compute(1)\n"}
    entries, callers, _ = context_of(
        {"a.rb": "def compute(x)\n  1\nend\n", **rest}, {"a.rb": "def compute(x)\n  2\nend\n", **rest}
    )
    assert entries["compute"].scoping_mode == "fallback"
    assert {c[0] for c in callers["compute"]} == {"b.rb", "c.py"}


def test_class_is_the_caller_of_its_methods(context_of):
    rest = {"app.py": "from lib import f\n\nclass A:\n    def m(self):\n        f()\n"}
    _, callers, _ = context_of({"lib.py": "def f():\n    return 1\n", **rest}, {"lib.py": "def f():\n    return 2\n", **rest})
    assert callers["f"] == {("app.py", 5, "A", False)}


def test_counts_equal_the_edges(spark):
    rng = random.Random(1)
    functions = spark.createDataFrame(
        [("x", 0, f"T{i}::new" if i % 2 else f"f{i}", f"a{i}.rs") for i in range(20)],
        "range_id string, page long, name string, file string",
    )
    calls = spark.createDataFrame(
        [("x", 0, rng.choice(["new", "f2", "f4"]), f"c{i % 7}.rs", i, 0, "", i % 3 == 0) for i in range(500)],
        "range_id string, page long, leaf string, file string, line long, ordinal long, caller string, is_test boolean",
    )
    counts = {(r.name, r.file): (r.production_callers, r.test_callers) for r in K.caller_counts(functions, calls).collect()}
    edges = {}
    for r in K.callers(functions, calls).collect():
        p, t = edges.get((r.name, r.function_file), (0, 0))
        edges[(r.name, r.function_file)] = (p + (not r.is_test), t + r.is_test)
    assert {k: v for k, v in counts.items() if v != (0, 0)} == edges


def test_risk_grid(spark):
    grid = [(0, 0, "none"), (0, 3, "none"), (2, 1, "low"), (1, 0, "medium"), (5, 2, "medium"), (10, 0, "high"), (3, 1, "medium")]
    df = spark.createDataFrame(grid, "production_callers long, test_callers long, want string")
    assert K.blast_radius(df).filter("risk <> want").isEmpty()


def test_budget_shares(spark):
    assert shares(4096) == (1638, 2458) and shares(16384) == (6553, 9830) and shares(0) == (0, 0)
    got = spark.range(1).select(G.split_budget(F.lit(4096)).alias("s")).select("s.*").first()
    assert tuple(got) == (1638, 2458)


def _greedy(costs, room, size, whole):
    """(page, offset, tier, over budget, next offset) of each row, page after page."""
    out, start, page = [], 0, 0
    while start < len(costs):
        last = min(start + size, len(costs))
        part, left, tiers = costs[start:last], room, []
        for tier in whole:
            if not tiers and sum(c[tier] for c in part) <= room:
                tiers = [tier] * len(part)
        for c in part if not tiers else []:
            tier = next((t for t in (2, 3) if c[t] is not None and c[t] <= left), None)
            if tier is None:
                break
            left -= c[tier]
            tiers.append(tier)
        over = not tiers
        end = start + max(len(tiers), 1)
        out += [(page, k, t, over, end if end < len(costs) else None) for k, t in enumerate(tiers or [3])]
        start, page = end, page + 1
    return out


@pytest.mark.parametrize("chunk, size", [(8, 8), (16, 5), (7, 3), (1, 40), (8192, 25), (64, 1)])
def test_pages_of_long_ranges(spark, chunk, size):
    """Chunks are entered where the page before them was cut, however many there are."""
    rng = random.Random(chunk)
    rows, want = [], {}
    for range_id, count, room in (("a", 300, 100), ("b", 1, 60), ("c", 37, 9), ("d", 64, 2000)):
        costs = [(f, max(f - rng.randrange(9), 1), rng.choice([None, max(f - 5, 1)]), max(f - rng.randrange(9, 30), 1))
                 for f in (rng.choice([rng.randrange(10, 60), 500]) if k % 23 == 0 else rng.randrange(10, 60) for k in range(count))]
        rows += [(range_id, k, room, *c) for k, c in enumerate(costs)]
        want |= {(range_id, k): row for k, row in enumerate(_greedy(costs, room, size, (0, 1)))}
    df = spark.createDataFrame(rows, "range_id string, position long, room long, f long, s long, a long, b long").repartition(5)
    pages = greedy_pages(
        df, ["range_id"], F.col("room"), size,
        [("0", F.col("f")), ("1", F.col("s"))], [("2", F.col("a")), ("3", F.col("b"))], chunk,
    )
    got = {
        (r.range_id, r.position): (r.page, r.offset, int(r.tier), r.over_budget, min(filter(None, [r.budget_cutoff, r.page_cutoff]), default=None))
        for r in pages.collect()
    }
    assert got == want


def test_no_rows_have_no_pages(spark):
    df = spark.createDataFrame([], "range_id string, position long, c long")
    assert greedy_pages(df, ["range_id"], F.lit(9), 5, [], [("x", F.col("c"))]).collect() == []


def test_manifest_budget_follows_the_greedy_walk(spark, make_tree, one_range):
    def text(i, v):
        return f"use crate::v{v}_{i};\n" + "".join(f"fn f{i}_{k}() {{ {v} }}\n" for k in range(1 + i % 4))

    base = {f"src/f{i:02}.rs": text(i, 1) for i in range(20)}
    head = {f"src/f{i:02}.rs": text(i, 2) for i in range(20)}
    manifest = change_manifest(make_tree(base, head), one_range, detect_renames=False)
    files = G.page_files(manifest.files, 100)
    tokens = lambda *drop: F.floor(
        F.octet_length(
            F.to_json(
                F.struct(*[F.lit(None).cast(files.schema[c].dataType).alias(c) if c in drop else F.col(c) for c in G.FILE_ENTRY]),
                {"ignoreNullFields": "false"},
            )
        ) / 4
    )
    costs = [
        tuple(r)
        for r in files.orderBy("offset")
        .select(tokens(), tokens("imports_changed"), tokens("imports_changed", "functions_changed"))
        .collect()
    ]
    for budget in (100, 1200, 2600, 9000):
        room = max(max(budget - 50, 0) - max(budget // 20, 16), 0)
        for size in (7, 100):
            kept = G.manifest_budget(files, budget, 50, size).orderBy("position").collect()
            got = [(r.page, r.offset, r.tier, r.over_budget, r.next_offset) for r in kept]
            priced = [(full, some, some, bare) for full, some, bare in costs]
            tiers = ("full", "functions", "functions", "bare")
            assert got == [(p, o, tiers[t], over, n) for p, o, t, over, n in _greedy(priced, room, size, (0, 1))], budget
            assert all((r.functions_changed is None) == (r.tier == "bare") for r in kept)
            assert all((r.imports_changed is None) == (r.tier != "full") for r in kept)


def test_context_budget_follows_the_greedy_walk(spark):
    rng = random.Random(2)
    costs = [(rng.randrange(20, 200), rng.randrange(10, 60)) for _ in range(40)]
    entries = spark.createDataFrame(
        [("x", 0, i, f, min(f, c)) for i, (f, c) in enumerate(costs)],
        "range_id string, page long, position long, full_tokens long, clamped_tokens long",
    )
    for budget in (200, 700, 20_000):
        room = max(max(budget - 30, 0) - max(budget // 4, 128), 0)
        priced = [(f, f, f, min(f, c)) for f, c in costs]
        tiers = ("full", "full", "full", "clamped")
        want = [(p, o, tiers[t], over, n) for p, o, t, over, n in _greedy(priced, room, 25, (0,))]
        kept = G.context_budget(entries, budget, 30).orderBy("position").collect()
        assert [(r.page, r.offset, r.tier, r.over_budget, r.next_offset) for r in kept] == want, budget
        assert G.trimmed_entries(G.context_budget(entries, budget, 30), "position").count() == sum(w[2] == "clamped" for w in want)


def test_large_change_stays_below_the_ceiling(spark, make_tree, one_range):
    def text(i, v):
        return "".join(f"def function_{i * 5 + k:04}():\n    return {v}\n\n" for k in range(5))

    base = {f"src/module_{i:04}.py": text(i, 1) for i in range(40)}
    head = {f"src/module_{i:04}.py": text(i, 2) for i in range(40)}
    tree = make_tree(base, head)
    manifest = change_manifest(tree, one_range, detect_renames=False)
    kept = budgeted_files(manifest, one_range, 8192, 500)
    size = F.sum(F.octet_length(F.to_json(F.struct(*G.FILE_ENTRY), {"ignoreNullFields": "false"})) / 4)
    sizes = [r[1] for r in kept.groupBy("page").agg(size).collect()]
    assert max(sizes) <= 8192 and kept.select("path").distinct().count() == kept.count() == 40
    context = function_context(tree, one_range, manifest.function_changes, 25)
    entries = budgeted_context(context, one_range, 512)
    first = entries.filter("page = 0").orderBy("offset").collect()
    assert first and first[-1].truncated and first[-1].next_offset == len(first)
    assert entries.select("name", "file").distinct().count() == entries.count() == 200


def test_review_halves(make_tree, one_range):
    tree = make_tree({"a.rs": "fn a() { 1 }\n"}, {"a.rs": "fn a() { 2 }\n"})
    review = review_change(tree, one_range, 16384, detect_renames=False)
    assert [r.tier for r in review.files.collect()] == ["full"]
    assert [r.name for r in review.functions.collect()] == ["a"]
    whole = review_change(tree, one_range, 0, detect_renames=False)
    assert whole.functions.count() == 1


def test_nested_use_trees(spark):
    text = "pub use crate::{a::{b, c as d, self}, e, f::{g::{h, i::*}},\n    j::k};"
    imports = spark.createDataFrame(
        [("x", "src/lib.rs", text, None, None), ("y", "src/lib.rs", "use crate::{a::{b", None, None)],
        "range_id string, path string, import_text string, rust_crate_name string, go_module string",
    )
    targets = {}
    for r in import_targets(imports).collect():
        targets.setdefault(r.range_id, set()).add(r.target)
    assert {"crate::a::b", "crate::a::c", "crate::e", "crate::f::g::h", "crate::f::g::i", "crate::j::k"} <= targets["x"]
    assert "crate::a::h" not in targets["x"] and "crate::g" not in targets["x"]


def scoped_by_hand(files, modules, importers, page):
    """Files that a page of changed modules scans, by definition."""
    own = [m for m in modules if m[1] == page]
    if any(not supports for _, _, _, supports in own):
        return {p for p in files}
    names = {p.removeprefix("src/").removesuffix(".rs") for _, _, p, _ in own}
    return {p for p in files if not p.endswith((".rs", ".go"))} | {p for _, _, p, _ in own} | {
        p for p, uses in importers.items() if names & uses
    }


def test_scope_of_many_pages(spark):
    """Calls of every page from the files that the page scans, and from no others."""
    rng = random.Random(6)
    files = [f"src/m{i}.rs" for i in range(12)] + [f"t{i}.rb" for i in range(3)]
    importers = {f"src/m{i}.rs": {f"m{rng.randrange(12)}" for _ in range(2)} for i in range(12)}
    blobs = [
        (path, "rust" if path.endswith(".rs") else "ruby",
         "".join(f"use crate::{u}::x;\n" for u in sorted(importers.get(path, ()))) + "fn w() {\n    make();\n    other();\n}\n"
         if path.endswith(".rs") else "def w\n  make(1)\nend\n")
        for path in files
    ]
    symbols = extract_symbols(spark.createDataFrame(blobs, "blob_id string, language string, content string"))
    tree = spark.createDataFrame([("x", p, p) for p in files], "range_id string, path string, blob_id string")
    functions = [("x", page, f"T{k}::make", f"src/m{rng.randrange(12)}.rs") for page in range(6) for k in range(3)]
    functions += [("x", 6, "make", "t0.rb"), ("x", 7, "nothing", "src/m0.rs")]
    changed = spark.createDataFrame(functions, "range_id string, page long, name string, file string")
    context = spark.createDataFrame([("x", None, None)], "range_id string, rust_crate_name string, go_module string")
    modules = K.changed_modules(changed, context)
    rows = [(r.range_id, r.page, r.path, r.supports) for r in modules.collect()]
    scope = K.scan_scope(tree, symbols, modules, context)
    want = {page: scoped_by_hand(files, rows, importers, page) for page in range(8)}
    found = {}
    for r in K.scanned_calls(tree, symbols, changed, scope).collect():
        found.setdefault(r.page, []).append(r.file)
    assert {p: sorted(f) for p, f in found.items()} == {p: sorted(want[p]) for p in range(7)}
    counts = {r.page: r.files_scanned for r in K.scanned_files(tree, symbols, scope).collect()}
    assert counts == {p: len(f) for p, f in want.items()}
    assert {r.path for r in K.scan_set(tree, scope).collect()} == set().union(*want.values())


def test_hot_leaf_names_are_dealt_out(spark):
    calls = spark.range(20_000).select(
        F.lit("x").alias("range_id"), F.when(F.col("id") % 4 < 3, "new").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("leaf"),
        F.col("id").alias("line"),
    )
    facts = spark.createDataFrame([("x", n, i) for i, n in enumerate(["new", "new", "f3", "f7", "gone"])], "range_id string, leaf string, fact int")
    joined = K.salted_join(calls, facts, ["range_id", "leaf"], ["line"], share=100)
    assert joined.columns == ["range_id", "leaf", "line", "fact"]
    plain = calls.join(facts, ["range_id", "leaf"])
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_references_hold_neither_side_in_memory(spark):
    """Estimates from the one narrow column would broadcast all names; the join is a merge."""
    parts = spark.range(1000).withColumn("name", F.concat(F.lit("lib/m_"), F.col("id").cast("string")))
    none = F.lit(None).cast("string")
    imports = parts.select(
        F.col("id").alias("range_id"), F.lit("cmd/main.go").alias("path"), F.col("name").alias("import_text"),
        none.alias("rust_crate_name"), none.alias("go_module"),
    )
    modules = parts.select(F.col("id").alias("range_id"), F.lit(0).alias("page"), F.lit("").alias("path"), F.col("name").alias("module"))
    found = references(import_targets(imports), module_keys(modules))
    assert found.select("range_id").distinct().count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "REPARTITION_BY_NUM" in plan


def test_places_are_listed_by_the_shorter_list(spark):
    """Many pages of few modules and files of many imports make no product, and a wide page is none either."""
    n = 40
    paths = [f"f{i}" for i in range(n)]
    imports = [("x", p, "exact", f"m{j}") for i, p in enumerate(paths) for j in range(i, i + 300)] + [("x", "one", "exact", "m7")]
    modules = [("x", page, "exact", f"m{page}") for page in range(n)] + [("x", n, "exact", f"m{j}") for j in range(500)]
    places = [("x", page, p) for page in range(n + 1) for p in [*paths, "one", "none"]]
    page = "range_id string, page long, "
    scope = K.Scope(
        pages=None, changed=None, folders=None,
        modules=spark.createDataFrame(modules, page + "kind string, target string"),
        imports=spark.createDataFrame(imports, "range_id string, path string, kind string, target string"),
    )
    at = spark.createDataFrame(places, page + "path string")
    names = {}
    for _, p, _, target in imports:
        names.setdefault(p, set()).add(target)
    wanted = {(pg, p) for _, pg, p in places if any(m in names.get(p, ()) for _, q, _, m in modules if q == pg)}
    got = [(r.page, r.path) for r in K._importers(at, scope).distinct().collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert sum(df.count() for df in K._listed(at, scope)) < n * n + n * 300 + 100  # 492,000 if all imports were listed
