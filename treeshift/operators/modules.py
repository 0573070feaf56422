"""Module names of files, and which modules a file's imports refer to.

Imports are turned into the module names they could mean, so that "does this
file import a changed module" is an equality join. Where the rule is "equal or
a prefix", all prefixes are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeshift.functions import paths as P
from treeshift.functions.text import strip

TS = ["ts", "tsx", "js", "jsx"]


def module_rust(path: Column) -> Column:
    """``crate`` for the crate root, else ``crate::a::b``."""
    inner = F.regexp_replace(F.regexp_replace(path, r"\.rs$", ""), "^src/", "")
    dotted = F.replace(F.regexp_replace(inner, "/mod$", ""), F.lit("/"), F.lit("::"))
    return F.when(inner.isin("lib", "main"), "crate").otherwise(F.concat(F.lit("crate::"), dotted))


def module_python(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def module_go(path: Column, go_module: Column) -> Column:
    folder = P.parent_dir(path)
    return (
        F.when(go_module.isNotNull() & (folder == ""), go_module)
        .when(go_module.isNotNull(), F.concat(go_module, F.lit("/"), folder))
        .when(folder == "", ".")
        .otherwise(folder)
    )


def module_ts(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.(?:tsx?|jsx?)$", ""), "/index$", "")


def module_path(path: Column, go_module: Column) -> Column:
    """The module a file is imported as; NULL where imports cannot be scoped."""
    ext = P.extension_from_path(path)
    return (
        F.when(ext == "rs", module_rust(path))
        .when(ext == "py", module_python(path))
        .when(ext == "go", module_go(path, go_module))
        .when(ext.isin(TS), module_ts(path))
    )


def _prefixes(name: Column, glue: str) -> Column:
    """``a``, ``a.b``, ``a.b.c`` for ``a.b.c``."""
    parts = F.split(name, F.lit("\\Q" + glue + "\\E"))
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), glue)
    )


def _opened(tree: Column) -> Column:
    """The paths that a use tree such as ``a::{b, c::{d, e}}`` stands for, braces in braces included."""
    text = "array<string>"
    start = F.struct(
        F.array(F.lit("")).alias("fronts"), F.lit("").alias("part"), F.array().cast(text).alias("paths")
    )

    def path(s: Column) -> Column:
        whole = F.array(F.concat(F.element_at(s["fronts"], -1), s["part"]))
        return F.when(s["part"] != "", F.concat(s["paths"], whole)).otherwise(s["paths"])

    def state(fronts: Column, part: Column, paths: Column) -> Column:
        return F.struct(fronts.alias("fronts"), part.alias("part"), paths.alias("paths"))

    def step(s: Column, token: Column) -> Column:
        fronts, none = s["fronts"], F.lit("")
        deeper = F.concat(fronts, F.array(F.concat(F.element_at(fronts, -1), s["part"])))
        outer = F.when(F.size(fronts) > 1, F.slice(fronts, F.lit(1), F.size(fronts) - 1)).otherwise(fronts)
        return (
            F.when(token == "{", state(deeper, none, s["paths"]))
            .when(token == "}", state(outer, none, path(s)))
            .when(token == ",", state(fronts, none, path(s)))
            .otherwise(state(fronts, strip(token), s["paths"]))
        )

    tokens = F.regexp_extract_all(tree, F.lit(r"[{},]|[^{},]+"), F.lit(0))
    return F.aggregate(tokens, start, step, path)


def _targets_rust(text: Column, path: Column, crate: Column) -> Column:
    raw = strip(F.regexp_replace(F.regexp_replace(strip(text), "^(?:pub )?use ", ""), ";+$", ""))
    own = module_rust(path)
    parent = F.regexp_extract(own, "^(.*)::[^:]*$", 1)
    external = F.concat(crate, F.lit("::"))
    absolute = (
        F.when(raw.startswith("crate::"), raw)
        .when(raw == crate, F.lit("crate"))
        .when(F.startswith(raw, external), F.concat(F.lit("crate::"), F.substr(raw, F.length(external) + 1)))
        .when(raw.startswith("super::") & (parent != ""), F.concat(parent, F.lit("::"), F.substr(raw, F.lit(8))))
        .when(raw.startswith("self::"), F.concat(own, F.lit("::"), F.substr(raw, F.lit(7))))
    )
    opened = F.when(absolute.contains("{"), _opened(absolute)).otherwise(F.array(absolute))
    named = F.transform(opened, lambda p: F.regexp_replace(p, r"\s+as\s+\w+$", ""))
    return F.array_distinct(F.flatten(F.transform(named, lambda p: _prefixes(p, "::"))))


def _targets_python(text: Column, path: Column) -> tuple[Column, Column]:
    """Names a module may equal, and names of which it may be a descendant."""
    imp = strip(text)
    is_from, is_import = imp.startswith("from "), imp.startswith("import ")
    source = strip(F.regexp_extract(imp, r"^from\s+((?s:.*?))(?: import |$)", 1))
    listed = F.regexp_replace(F.regexp_extract(imp, r"^from (?s:.*?) import ((?s:.*))$", 1), "[()]", "")
    names = F.filter(
        F.transform(F.split(listed, ","), lambda n: F.split(strip(n), r"\s+")[0]),
        lambda n: (n != "") & (n != "*"),
    )
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    own = F.split(module_python(path), r"\.")
    up = F.array_join(F.slice(own, F.lit(1), F.greatest(F.size(own) - dots, F.lit(0))), ".")
    rest = F.substr(source, dots + 1)
    anchor = F.when(
        dots > 0,
        F.when(
            dots < F.size(own), F.when(rest == "", up).otherwise(F.concat(up, F.lit("."), rest))
        ),
    ).otherwise(source)
    from_targets = F.concat(
        _prefixes(anchor, "."), F.transform(names, lambda n: F.concat(anchor, F.lit("."), n))
    )
    modules = F.filter(
        F.transform(
            F.split(F.regexp_replace(imp, "^import ", ""), ","), lambda m: F.split(strip(m), r"\s+")[0]
        ),
        lambda m: m != "",
    )
    equal = F.when(is_from, F.when(anchor.isNotNull(), from_targets)).when(
        is_import, F.flatten(F.transform(modules, lambda m: _prefixes(m, ".")))
    )
    return F.array_distinct(equal), F.when(is_import, modules)


def _targets_go(text: Column, go_module: Column) -> Column:
    parts = F.split(text, "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/")
    )
    return F.when(go_module.isNotNull(), F.array(text)).otherwise(suffixes)


def _targets_ts(text: Column, path: Column) -> Column:
    after = F.regexp_extract(text, r"^(?s:.*?)from((?s:.*))$", 1)
    single = F.regexp_extract(after, r"'([^']*)'", 1)
    spec = F.when(F.contains(after, F.lit("'")), single).otherwise(F.regexp_extract(after, '"([^"]*)"', 1))
    folder = P.parent_dir(path)
    start = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    resolved = F.aggregate(
        F.split(spec, "/"),
        start,
        lambda at, s: F.when(s == ".", at)
        .when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))
        .otherwise(F.array_append(at, s)),
    )
    return F.when(spec.startswith("."), F.array(F.array_join(resolved, "/")))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key before lists of names grow out of them; such small rows would
    otherwise share a few tasks, by the size of files or of compressed shuffles."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def import_targets(imports: DataFrame) -> DataFrame:
    """``imports(range_id, path, import_text, rust_crate_name, go_module)`` gives
    ``(range_id, path, kind, target)``: kind ``is`` for the module itself, ``under``
    for a package of which the module may be part."""
    text, path, go = F.col("import_text"), F.col("path"), F.col("go_module")
    ext = P.extension_from_path(path)
    py_is, py_under = _targets_python(text, path)
    equal = (
        F.when(ext == "rs", _targets_rust(text, path, F.col("rust_crate_name")))
        .when(ext == "py", py_is)
        .when(ext == "go", _targets_go(text, go))
        .when(ext.isin(TS), _targets_ts(text, path))
    )
    under = F.when(ext == "py", py_under)

    def tagged(names: Column, kind: str) -> Column:
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("target")),
        )

    # a file whose imports name one module a thousand times is one row; a file is in one
    # task before its targets are listed, so no task lists those of a whole scan split
    return (
        _spread(imports, "range_id", "path").select("range_id", "path", F.explode(F.concat(tagged(equal, "is"), tagged(under, "under"))).alias("t"))
        .select("range_id", "path", "t.*")
        .filter("target IS NOT NULL")
        .distinct()
    )


def module_keys(modules: DataFrame) -> DataFrame:
    """The other side of the join: every name by which a module can be referred to."""
    parts = _prefixes(F.col("module"), ".")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    keys = F.concat(
        F.array(F.struct(F.lit("is").alias("kind"), F.col("module").alias("target"))),
        F.transform(parents, lambda p: F.struct(F.lit("under").alias("kind"), p.alias("target"))),
    )
    others = [c for c in modules.columns if c not in ("path", "module")]
    named = _spread(modules.filter("module IS NOT NULL"), *others, "module")
    return named.select(*others, F.explode(keys).alias("k")).select(*others, "k.*").distinct()


def references(targets: DataFrame, keys: DataFrame) -> DataFrame:
    """Import targets with the modules they refer to.

    Merged, as neither side is of proven size: names are made from narrow columns, so
    that sizes estimated from files are far too small, and a broadcast would hold them all.
    """
    return targets.join(keys.hint("merge"), ["range_id", "kind", "target"])
