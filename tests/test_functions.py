import pytest
from pyspark.sql import functions as F

from treeshift.catalog import changes
from treeshift.operators import symbols as symbols_module
from treeshift.operators.call_graph import call_symbols, callees
from treeshift.operators.dependencies import dependency_diff, nested_dependency_changes
from treeshift.operators.file_diff import diff_trees
from treeshift.operators.function_diff import changed_symbols, function_changes
from treeshift.operators.symbols import extract_symbols
from treeshift.plans.manifest import change_manifest
from treeshift.session import cut


@pytest.fixture(scope="session")
def changes_of(make_tree, one_range):
    def run(base: dict, head: dict):
        tree = make_tree(base, head)
        changes = diff_trees(tree, one_range)
        found = function_changes(changes, changed_symbols(tree, changes))
        return {(r.path, r.name, r.change_type, r.old_name) for r in found.collect()}

    return run


def test_content_aware_changes(changes_of):
    greet, bye = "fn greet() {\n    hi()\n}\n", "fn bye() {\n    ciao()\n}\n"
    got = changes_of(
        {
            "reorder.rs": greet + bye,
            "above.rs": greet,
            "body.rs": "fn f(x: i32) -> i32 {\n    x + 1\n}\n",
            "rename.rs": "fn old_name() {\n    1\n}\n",
            "both.rs": "fn old() {\n    1\n}\n",
            "sig.rs": "fn s() {\n}\n",
            "twice.py": "def f():\n    return 1\ndef f():\n    return 2\n",
        },
        {
            "reorder.rs": bye + greet,
            "above.rs": "fn new() {}\n" + greet,
            "body.rs": "fn f(x: i32) -> i32 {\n    x * 2\n}\n",
            "rename.rs": "fn new_name() {\n    1\n}\n",
            "both.rs": "fn new() {\n    2\n}\n",
            "sig.rs": "fn s(a: u8) {\n}\n",
            "twice.py": "def f():\n    return 3\ndef f():\n    return 2\n",
        },
    )
    assert got == {
        ("above.rs", "new", "added", None),
        ("body.rs", "f", "modified", None),
        ("rename.rs", "new_name", "renamed", "old_name"),
        ("both.rs", "new", "added", None),
        ("both.rs", "old", "deleted", None),
        ("sig.rs", "s", "signature_changed", None),
    }


CASES = {
    "rust": (
        "struct A;\nimpl A {\n  fn one(&self) { let c = '}'; }\n}\ntrait T { fn two(&self); }\nmod m {\n  fn three() {}\n}\n"
        "pub(crate) async fn four<'a>(x: &'a str) -> u8 {\n  fn five() {}\n  0\n}\n",
        ["A::one", "four"],
    ),
    "python": (
        "class A:\n    class B:\n        def b(self): pass\n    def a(self):\n        def inner():\n            pass\n"
        "if x:\n    def hidden():\n        pass\nasync def top(): return 1\n",
        ["A", "B", "B.b", "A.a", "top"],
    ),
    "go": ("func A[T any](x T) interface{} {\n\treturn x\n}\nfunc (l List[T]) B() {}\n", ["A", "List[T].B"]),
    "java": (
        "interface I { void no(); }\nabstract class A {\n  A(int x) { }\n  abstract void m();\n  int f = call(1);\n"
        "  class In { void no2() {} }\n  <T> T g(T t) { return t; }\n}\n",
        ["A.A", "A.m", "A.g"],
    ),
    "typescript": (
        "export default class A {\n  constructor(private x: number) {}\n  get y(): number { return 1; }\n  over(a: string): void;\n"
        "  over(a: any) { if (a) { b(); } }\n  field = () => { c(); };\n}\nexport function f<T>(x: T): T {\n  return x;\n}\n"
        "const g = async (x: number): Promise<void> => {\n  await h();\n};\nnamespace N { export function no() {} }\n",
        ["A.constructor", "A.y", "A.over", "f", "g"],
    ),
    "c": (
        "int proto(int a);\nstatic inline int f(void) {\n  if (x) { g(); }\n  return 0;\n}\nchar *name(int x) {\n  return 0;\n}\n"
        "struct s { int a; };\n#ifdef A\nvoid cond(void) {}\n#endif\n",
        ["proto", "f", "name(int x)", "cond"],
    ),
    "cpp": (
        'namespace a {\nnamespace b {\nclass C {\n public:\n  C(int x) { }\n  int m() const { return 1; }\n  void decl();\n};\n}\n'
        'int f(int x) { return x; }\n}\nextern "C" {\nvoid g() {}\n}\nvoid A::h() {\n}\n',
        ["a::b::C::C", "a::b::C::m", "a::f", "g", "A::h"],
    ),
    "csharp": (
        "namespace A.B {\n  public class C {\n    public C() : base(1) { }\n    [Test]\n    public async Task<int> M(int x)\n    {\n"
        "      return 1;\n    }\n    public int P { get; set; }\n    class In { void No() {} }\n  }\n  struct S {\n    void T() {}\n  }\n}\n",
        ["C.C", "C.M", "S.T"],
    ),
    "kotlin": (
        "fun String.ext(x: Int): Int = x\nclass A(val x: Int) {\n    constructor() : this(1) {\n    }\n    fun m() {\n    }\n"
        "    companion object {\n        fun make(): A = A(1)\n    }\n}\nobject O {\n    fun o() { }\n}\n",
        ["String.ext", "A.constructor", "A.m", "A.Companion.make", "O.o"],
    ),
    "php": (
        "<?php\nfunction f($a) { return 1; }\nabstract class A {\n  abstract public function m();\n  private static function n(): int {\n"
        "    return 2;\n  }\n}\ninterface I { public function no(); }\n",
        ["f", "A.m", "A.n"],
    ),
    "ruby": (
        "class A\n  class B\n    def b\n    end\n  end\n  def a?(x)\n    x.each do |y|\n      y\n    end\n  end\nend\n"
        "module M\n  def no\n  end\nend\ndef self.top\n  1\nend\n",
        ["A", "B", "B.b", "A.a?", "self.top"],
    ),
    "swift": (
        "func f(_ x: Int) -> Int { return x }\nstruct S {\n  init(x: Int) {\n  }\n  func m() { g() }\n  struct In { func no() {} }\n}\n"
        "extension S {\n  static func n() {}\n}\nprotocol P { func no2() }\n",
        ["f", "S.init", "S.m", "S.n"],
    ),
}


def test_function_names(spark):
    rows = [(lang, lang, text) for lang, (text, _) in CASES.items()]
    blobs = spark.createDataFrame(rows, "blob_id string, language string, content string")
    got = {r.language: [f.name for f in r.functions] for r in extract_symbols(blobs).collect()}
    assert got == {lang: names for lang, (_, names) in CASES.items()}


# text, (function, first line, last line, signature), (callee, line, caller)
ODD = {
    "rust": (
        "impl A { fn one(&self) { a(); } fn two(&self) -> u8 { b(\"}\") } }\nfn x() { p(); } fn y() { q('}'); } // fn z() {}\n"
        "fn t(s: &str) {\n    let n = s.parse::<u32>();\n    Vec::<Vec<u8>>::new();\n    let c = '\\''; let u = '\\u{10_FF_FF}'; d(b'{');\n}\n"
        "fn last() {}\n",
        [("A::one", 1, 1, "fn one(&self)"), ("A::two", 1, 1, "fn two(&self) -> u8"), ("x", 2, 2, "fn x()"), ("y", 2, 2, "fn y()"),
         ("t", 3, 7, "fn t(s: &str)"), ("last", 8, 8, "fn last()")],
        [("a", 1, "A::one"), ("b", 1, "A::two"), ("p", 2, "x"), ("q", 2, "y"), ("s.parse::<u32>", 4, "t"), ("Vec::<Vec<u8>>::new", 5, "t"),
         ("d", 6, "t")],
    ),
    "typescript": (
        "const r = /[{\"'`]\\/x/g;\nfunction f(a: number) { return a / b(a) / c; }\nconst t = `x ${`y ${z({a: '}'})}` + \"`\"} {`;\n"
        "class A { m() { x(); } n(): void { y(/}/); } }\nfunction g() { h(); } function i() { j(); }\n",
        [("f", 2, 2, "function f(a: number)"), ("A.m", 4, 4, "m()"), ("A.n", 4, 4, "n(): void"), ("g", 5, 5, "function g()"),
         ("i", 5, 5, "function i()")],
        [("b", 2, "f"), ("x", 4, "A.m"), ("y", 4, "A.n"), ("h", 5, "g"), ("j", 5, "i")],
    ),
    "go": (
        "type I interface {\n\tFoo(x int) error\n\tBar() (int, error)\n}\ntype J interface { Baz(); Qux() }\nfunc A() { Foo(1) }\n"
        "func B() { c() }; func D() { e() }\n",
        [("A", 6, 6, "func A()"), ("B", 7, 7, "func B()"), ("D", 7, 7, "func D()")],
        [("Foo", 6, "A"), ("c", 7, "B"), ("e", 7, "D")],
    ),
    "c": (
        "static int\nadd(int a)\n{\n    return sum(a);\n}\n\nstruct point *\nmake(void) {\n    return 0;\n}\n"
        "int f(void) { g(); } int h(void) { i('}'); }\n",
        [("add", 1, 5, "static int\nadd(int a)"), ("make", 7, 10, "struct point *\nmake(void)"), ("f", 11, 11, "int f(void)"),
         ("h", 11, 11, "int h(void)")],
        [("sum", 4, "add"), ("g", 11, "f"), ("i", 11, "h")],
    ),
    "java": (
        "class A { void m() { x(); } int n() { return y(1); } }\n",
        [("A.m", 1, 1, "void m()"), ("A.n", 1, 1, "int n()")],
        [("x", 1, "A.m"), ("y", 1, "A.n")],
    ),
}


@pytest.mark.parametrize("language", sorted(ODD))
def test_headers_and_literals_anywhere(spark, language):
    """Several headers in a line, names below their types, literals that hold braces and slashes."""
    text, functions, calls = ODD[language]
    blobs = spark.createDataFrame([("1", language, text)], "blob_id string, language string, content string")
    row = extract_symbols(blobs, [language]).first()
    assert [(f.name, f.start_line, f.end_line, f.signature) for f in row.functions] == functions
    assert [(c.callee, c.line, c.caller) for c in row.calls] == calls


def test_functions_of_one_line_change_alone(changes_of):
    got = changes_of({"a.rs": "fn a() { 1 } fn b() { 2 }\n"}, {"a.rs": "fn a() { 1 } fn b() { \"}\" } fn c() { 3 }\n"})
    assert got == {("a.rs", "b", "modified", None), ("a.rs", "c", "added", None)}


def test_callees_of_functions_of_one_line(spark):
    text = "fn a() { x(); } fn b() { y::<u8>(); }\n"
    blobs = spark.createDataFrame([("1", "rust", text)], "blob_id string, language string, content string")
    symbols = extract_symbols(blobs, ["rust"])
    files = spark.createDataFrame([("r", "f.rs", "1")], "range_id string, path string, blob_id string")
    wanted = spark.createDataFrame([("r", 0, n, "f.rs") for n in "ab"], "range_id string, page long, name string, file string")
    assert {(r.name, r.callee) for r in callees(wanted, files, symbols).collect()} == {("a", "x"), ("b", "y::<u8>")}
    assert [c.leaf for c in symbols.first().calls] == ["x", "y"]


def test_python_headers_over_several_lines(spark):
    text = "class A(\n    B,\n    C,\n):\n    def m(\n        self,\n    ):\n        f()\n\n    def n(self):\n        g()\n\ndef top(\n    x,\n):\n    h()\n"
    blobs = spark.createDataFrame([("1", "python", text)], "blob_id string, language string, content string")
    row = extract_symbols(blobs, ["python"]).first()
    assert [(f.name, f.start_line, f.end_line) for f in row.functions] == [
        ("A", 1, 11), ("A.m", 5, 8), ("A.n", 10, 11), ("top", 13, 16)
    ]
    assert [(c.callee, c.caller) for c in row.calls] == [("f", "A"), ("g", "A"), ("h", "top")]


def test_unbalanced_and_odd_text(spark):
    texts = ["", "\n", "}}}}\n", "fn f() {\n", '"' * 1001, "/* never closed", "fn a() {}\r\nfn b() {\r\n}\r\n"]
    blobs = spark.createDataFrame(
        [(str(i), "rust", t) for i, t in enumerate(texts)], "blob_id string, language string, content string"
    )
    got = {r.blob_id: [(f.name, f.end_line) for f in r.functions] for r in extract_symbols(blobs, ["rust"]).collect()}
    assert len(got) == len(texts)
    assert got["3"] == [("f", 1)]
    assert got["6"] == [("a", 1), ("b", 3)]


def test_long_literal_does_not_overflow(spark):
    text = 'fn a() { let s = "' + '\\" }' * 60_000 + '"; }\nfn b() { g(' + "(x) " * 20_000 + ") }\n"
    blobs = spark.createDataFrame([("1", "rust", text)], "blob_id string, language string, content string")
    assert [f.name for f in extract_symbols(blobs, ["rust"]).first().functions] == ["a", "b"]


def test_null_is_not_empty(make_tree, one_range):
    tree = make_tree({"a.txt": "1\n", "b.rs": "// 1\n"}, {"a.txt": "2\n", "b.rs": "// 2\n"})
    rows = {r.path: r for r in change_manifest(tree, one_range).files.collect()}
    assert rows["a.txt"].functions_changed is None and rows["a.txt"].imports_changed is None
    assert rows["b.rs"].functions_changed == [] and rows["b.rs"].imports_changed.added == []


def test_dependency_formats(make_tree, one_range):
    tree = make_tree(
        {
            "Cargo.toml": '[package]\nname = "x"\nversion = "1"\n[dependencies]\na = "1"\nb = { version = "2", features = ["z"] }\n# c = "9"\n',
            "package.json": '{"dependencies": {"a": "1", "o": {"v": 1}}, "devDependencies": {"a": "2"}}',
            "go.mod": "module m\nrequire x/y v1.0.0\nrequire (\n\t// note here\n\tp/q v2 // indirect\n)\n",
            "pyproject.toml": '[project]\ndependencies = ["Foo>=1"]\nother = ["no"]\n',
            "bad/package.json": "{",
        },
        {
            "Cargo.toml": '[dependencies]\na = "2"\nd = { git = "u" }\n[dev-dependencies]\nb = { version = "2" }\n',
            "package.json": '{"devDependencies": {"a": "3"}}',
            "go.mod": "module m\nrequire (\n\tp/q v3\n)\n",
            "pyproject.toml": '[project]\ndependencies = [\n  "Foo>=2",\n  "bar",\n]\n',
            "bad/package.json": '{"dependencies": {"n": "1"}}',
        },
    )
    diff = dependency_diff(diff_trees(tree, one_range), tree)
    got = {(r.path, r.kind, r.name, r.old_version, r.new_version) for r in diff.collect()}
    assert got == {
        ("Cargo.toml", "changed", "a", "1", "2"), ("Cargo.toml", "added", "d", None, ""),
        ("package.json", "changed", "a", "2", "3"),
        ("go.mod", "removed", "x/y", "v1.0.0", None), ("go.mod", "changed", "p/q", "v2", "v3"),
        ("pyproject.toml", "changed", "foo", ">=1", ">=2"), ("pyproject.toml", "added", "bar", None, ""),
        ("bad/package.json", "added", "n", None, "1"),
    }
    nested = {r.file: len(r.added) for r in nested_dependency_changes(diff).collect()}
    assert nested["Cargo.toml"] == 1


def test_summary_does_not_depend_on_pages(make_tree, one_range):
    base = {f"f{i}.rs": f"fn f{i}() {{ 1 }}\n" for i in range(30)}
    head = {f"f{i}.rs": f"fn f{i}() {{ 2 }}\n" for i in range(30)}
    tree = make_tree(base, head)
    whole = change_manifest(tree, one_range, page_size=500, detect_renames=False).summary.first()
    paged = change_manifest(tree, one_range, page_size=10, detect_renames=False).summary.first()
    assert whole.total_functions_changed == paged.total_functions_changed == 30
    assert not whole.needs_more_pages and paged.needs_more_pages
    assert whole.total_files_changed == paged.total_files_changed == 30
    assert whole.languages_affected == ["rust"]


def test_signature_and_lines(spark):
    text = "@Deco\nclass A {\n  @Override\n  public int m(\n      int a) {\n    return 1;\n  }\n}\n"
    blobs = spark.createDataFrame([("1", "java", text)], "blob_id string, language string, content string")
    f = extract_symbols(blobs, ["java"]).select(F.col("functions")[0].alias("f")).first().f
    assert (f.start_line, f.end_line) == (3, 7)
    assert f.signature == "@Override\n  public int m(\n      int a)"


def test_only_languages_of_the_blobs_are_planned(spark):
    schema = "blob_id string, language string, content string"
    texts = ['fn a() { b("}"); }\n', "fn a\x01() {}\n\x02fn c() { d() }\n", "fn e() {}", "plain prose\n"]
    blobs = spark.createDataFrame([(str(i), "rust", t) for i, t in enumerate(texts)], schema)
    assert symbols_module._work(blobs, sorted(symbols_module.RULES))[1] == ["rust"]
    rows = extract_symbols(blobs).orderBy("blob_id").collect()
    assert rows == extract_symbols(blobs, ["rust"]).orderBy("blob_id").collect()
    assert [[f.name for f in r.functions] for r in rows] == [["a"], ["a", "c"], ["e"], []]
    assert extract_symbols(blobs.limit(0)).count() == 0
    assert extract_symbols(blobs, ["go"]).count() == 0


def test_the_crate_and_its_changes_are_written_once(spark):
    first, again = (changes.code_changes(spark, "/root/testdata/sf0.001") for _ in range(2))
    assert first[0] is again[0] and first[1] is again[1]
    assert {"size", "binary", "lines"} <= set(first[0].columns)


def test_calls_and_functions_meet_in_their_blob(spark):
    """Of functions with the same name the first is looked into, a call is in all functions around it, and rows move once."""
    text = "fn a() { x(); }\nfn out() {\n    fn a() { y(); }\n    z();\n}\nfn b() { a(); a(); }\nv();\n"
    blobs = spark.createDataFrame([("1", "rust", text), ("2", "rust", "fn a() { w(); }\n")], "blob_id string, language string, content string")
    symbols = cut(call_symbols(extract_symbols(blobs, ["rust"])))
    files = cut(spark.createDataFrame([("r", "f.rs", "1"), ("r", "g.rs", "2"), ("r", "h.rs", "1")], "range_id string, path string, blob_id string"))
    wanted = cut(spark.createDataFrame(
        [("r", 0, n, f) for f, n in [("f.rs", "a"), ("f.rs", "out"), ("f.rs", "b"), ("g.rs", "a"), ("h.rs", "none")]],
        "range_id string, page long, name string, file string",
    ))
    found = callees(wanted, files, symbols)
    got = sorted((r.file, r.name, r.callee, r.line) for r in found.collect())
    assert got == [("f.rs", "a", "x", 1), ("f.rs", "b", "a", 6), ("f.rs", "b", "a", 6), ("f.rs", "out", "y", 3), ("f.rs", "out", "z", 4), ("g.rs", "a", "w", 1)]
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Window" not in plan and plan.count("Exchange") <= 4
