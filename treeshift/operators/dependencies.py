"""Declared dependencies: four manifest formats and their diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from treeshift.functions import paths as P
from treeshift.functions.text import strip
from treeshift.session import cut
from treeshift.sources.trees import with_blob_id

# fixed values
CARGO_SECTIONS = [
    "[dependencies]",
    "[dev-dependencies]",
    "[build-dependencies]",
    "[workspace.dependencies]",
]
VERSION_OPERATORS = [">=", "<=", "==", "!=", "~=", ">", "<"]  # tried in this order

def _file_window(last: int) -> WindowSpec:
    """The lines of one manifest up to an offset from the current one."""
    return Window.partitionBy("blob_id").orderBy("line").rowsBetween(Window.unboundedPreceding, last)


OUT = ["blob_id", "name", "version"]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("blob_id", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).select(
        "blob_id", "line", strip(F.col("text")).alias("text")
    )


def _last(found: DataFrame) -> DataFrame:
    """Of several lines for one name the last one counts."""
    return found.groupBy("blob_id", "name").agg(F.max_by("version", "at").alias("version"))


def parse_package_json(files: DataFrame) -> DataFrame:
    """``dependencies``, then ``devDependencies``; only string versions."""
    json = F.try_parse_json("content")

    def section(name: str, rank: int) -> Column:
        entries = F.map_entries(F.try_variant_get(json, f"$.{name}", "map<string,variant>"))
        return F.transform(
            F.coalesce(entries, F.array()),
            lambda e: F.struct(
                e["key"].alias("name"),
                F.when(F.schema_of_variant(e["value"]) == "STRING", e["value"].cast("string")).alias("version"),
                F.lit(rank).alias("at"),
            ),
        )

    both = F.concat(section("dependencies", 0), section("devDependencies", 1))
    found = files.select("blob_id", F.explode(both).alias("d")).select("blob_id", "d.*")
    return _last(found.filter("version IS NOT NULL"))


def parse_cargo_toml(files: DataFrame) -> DataFrame:
    text = F.col("text")
    section = F.last_value(F.when(F.startswith(text, F.lit("[")), text), True).over(_file_window(0))
    rest = strip(F.regexp_extract(text, r"^[^=]*=(.*)$", 1))
    version = F.when(
        F.startswith(rest, F.lit('"')), F.regexp_extract(rest, r'^"([^"]*)', 1)
    ).otherwise(F.regexp_extract(rest, r'(?:^|[{,])\s*version\s*=\s*"?([^",}]*)', 1))
    found = (
        _lines(files)
        .withColumn("section", section)
        .filter(
            F.col("section").isin(CARGO_SECTIONS)
            & F.contains(text, F.lit("="))
            & ~text.rlike(r"^[\[#]")
        )
        .select(
            "blob_id",
            strip(F.regexp_extract(text, "^([^=]*)=", 1)).alias("name"),
            strip(version).alias("version"),
            F.col("line").alias("at"),
        )
    )
    return _last(found.filter("name <> ''"))


def parse_go_mod(files: DataFrame) -> DataFrame:
    text = F.col("text")
    mark = F.when(F.startswith(text, F.lit("require (")), True).when(text == ")", False)
    inside = F.coalesce(F.last_value(mark, True).over(_file_window(-1)), F.lit(False))
    single = text.rlike(r"^require [^(]*$")
    item = F.when(single, F.regexp_replace(text, "^require ", "")).when(
        F.col("inside") & mark.isNull(), text
    )
    parts = F.split(strip(F.col("item")), r"\s+")
    found = (
        _lines(files)
        .withColumn("inside", inside)
        .withColumn("item", item)
        .filter(F.col("item").isNotNull() & ~F.startswith("item", F.lit("//")) & (F.size(parts) >= 2))
        .select(
            "blob_id", parts[0].alias("name"), parts[1].alias("version"), F.col("line").alias("at")
        )
    )
    return _last(found)


def split_requirement(spec: Column) -> Column:
    """``struct(name, version)``: lower-cased name, operator and version."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("version")))
    for op in VERSION_OPERATORS:
        at = F.instr(spec, op)
        chain = chain.when(
            at > 0,
            F.struct(
                F.lower(strip(F.substring(spec, F.lit(1), at - 1))).alias("name"),
                F.concat(
                    F.lit(op), strip(F.substring(spec, at + len(op), F.length(spec)))
                ).alias("version"),
            ),
        )
    return chain.otherwise(F.struct(F.lower(strip(spec)).alias("name"), F.lit("").alias("version")))


def parse_pyproject(files: DataFrame) -> DataFrame:
    text = F.col("text")
    opens = text.rlike(r"^dependencies[^=\[]*=[^\[]*\[")
    in_line = opens & F.contains(text, F.lit("]"))
    mark = F.when(in_line | (text == "]"), False).when(opens, True)
    inside = F.coalesce(F.last_value(mark, True).over(_file_window(-1)), F.lit(False))
    quoted = F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.regexp_replace(text, "^[\"',]+|[\"',]+$", "")
    items = F.when(opens, quoted).when(
        F.col("inside") & mark.isNull() & (bare != "") & ~F.startswith(text, F.lit("#")), F.array(bare)
    )
    found = (
        _lines(files)
        .withColumn("inside", inside)
        .select("blob_id", F.col("line").alias("at"), F.explode(items).alias("item"))
        .select("blob_id", "at", split_requirement(F.col("item")).alias("r"))
        .select("blob_id", "at", "r.*")
    )
    return _last(found)


PARSERS = {
    "Cargo.toml": parse_cargo_toml,
    "package.json": parse_package_json,
    "go.mod": parse_go_mod,
    "pyproject.toml": parse_pyproject,
}


def dependency_files(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(blob_id, kind, content)`` of the wanted manifests, once each."""
    kind = P.basename(F.col("path"))
    return (
        with_blob_id(tree)
        .filter(P.is_dependency_file(F.col("path")))
        .select(F.concat("blob_id", F.lit(":"), kind).alias("blob_id"), kind.alias("kind"), "content")
        .join(wanted, "blob_id", "left_semi")
        .dropDuplicates(["blob_id"])
    )


def declared(files: DataFrame) -> DataFrame:
    """``(blob_id, name, version)`` of manifests of all four formats."""
    out = None
    for kind, parse in PARSERS.items():
        part = parse(files.filter(F.col("kind") == kind)).select(*OUT)
        out = part if out is None else out.unionByName(part)
    return out


def dependency_diff(changes: DataFrame, tree: DataFrame) -> DataFrame:
    """``(range_id, path, kind, name, old_version, new_version)``.

    Each distinct manifest is parsed once, whatever the number of ranges.
    """
    kind = P.basename(F.col("path"))

    def key(blob: str) -> Column:
        return F.concat(blob, F.lit(":"), kind)

    files = changes.filter(P.is_dependency_file(F.col("path"))).select(
        "range_id",
        "path",
        # a renamed manifest has no base under its new path
        F.when(F.col("old_path").isNull(), key("base_blob")).alias("base_key"),
        key("head_blob").alias("head_key"),
    )
    sides = files.select(
        "range_id",
        "path",
        F.explode(
            F.array(
                F.struct(F.lit("old").alias("side"), F.col("base_key").alias("blob_id")),
                F.struct(F.lit("new").alias("side"), F.col("head_key").alias("blob_id")),
            )
        ).alias("s"),
    ).select("range_id", "path", "s.*").filter("blob_id IS NOT NULL")
    # written once, as each of the four formats reads it
    found = declared(cut(dependency_files(tree, sides.select("blob_id").distinct())))

    def version(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("version"))).alias(f"{side}_version")

    kind_of = (
        F.when(F.col("old_version").isNull(), "added")
        .when(F.col("new_version").isNull(), "removed")
        .otherwise("changed")
    )
    return (
        sides.join(found, "blob_id")
        .groupBy("range_id", "path", "name")
        .agg(version("old"), version("new"))
        .filter(~F.col("old_version").eqNullSafe(F.col("new_version")))
        .select("range_id", "path", kind_of.alias("kind"), "name", "old_version", "new_version")
    )


def nested_dependency_changes(diff: DataFrame) -> DataFrame:
    """One row per manifest file with its added, removed and changed lists."""
    entry = F.struct("name", "old_version", "new_version")

    def listed(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind)

    return diff.groupBy("range_id", F.col("path").alias("file")).agg(
        listed("added"), listed("removed"), listed("changed")
    )
