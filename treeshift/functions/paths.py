"""Column expressions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from treeshift.functions.languages import (
    EXTENSIONS,
    SCOPED_EXTENSIONS,
    UNKNOWN,
    extension_to_language,
)

# --- fixed values -----------------------------------------------------------
VENDOR_DIRS = ["vendor/", "node_modules/"]
LOCK_FILES = [
    "Cargo.lock",
    "package-lock.json",
    "poetry.lock",
    "go.sum",
    "yarn.lock",
    "pnpm-lock.yaml",
    "Gemfile.lock",
    "composer.lock",
]
GENERATED_SUFFIXES = [".min.js", ".min.css", ".pb.go", "_generated.go"]
GENERATED_MARKERS = ["do not edit", "generated by", "auto-generated"]
DEPENDENCY_FILES = ["Cargo.toml", "package.json", "go.mod", "pyproject.toml"]
TEST_DIRS = ["/test/", "/tests/", "/__tests__/", "/spec/"]
TEST_SUFFIXES = [
    "_test.go",
    "_test.rs",
    ".test.ts",
    ".test.js",
    ".test.tsx",
    ".test.jsx",
    "_spec.rb",
    "test.java",
    "tests.cs",
]
# -----------------------------------------------------------------------------


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part without the trailing slash; ``''`` at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def last_dot_part(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def extension_from_path(path: Column) -> Column:
    ext = last_dot_part(path)
    return F.when(F.length(path) > F.length(ext) + 1, ext).otherwise(F.lit(""))


def detect_language(path: Column) -> Column:
    ext = last_dot_part(path)
    chain = None
    for language, extensions in EXTENSIONS.items():
        hit = ext.isin(extensions)
        chain = F.when(hit, language) if chain is None else chain.when(hit, language)
    return chain.otherwise(UNKNOWN)


def has_analyzer(path: Column) -> Column:
    return extension_from_path(path).isin(sorted(extension_to_language()))


def supports_scoping(path: Column) -> Column:
    return extension_from_path(path).isin(SCOPED_EXTENSIONS)


def is_generated_path(path: Column) -> Column:
    in_vendor = path.rlike(f"(^|/)({_any_of(VENDOR_DIRS)})")
    return (
        in_vendor
        | basename(path).isin(LOCK_FILES)
        | path.rlike(f"({_any_of(GENERATED_SUFFIXES)})$")
    )


def is_generated_content(content: Column, head_bytes: int = 1024) -> Column:
    """Does a marker of generated code stand in the first bytes?"""
    head = F.lower(F.substring(F.encode(content, "UTF-8"), 1, head_bytes).cast("string"))
    return F.coalesce(head.rlike(_any_of(GENERATED_MARKERS)), F.lit(False))


def is_test_path(path: Column) -> Column:
    lowered = F.lower(path)
    return lowered.rlike(
        f"({_any_of(TEST_DIRS)})|({_any_of(TEST_SUFFIXES)})$|(^|/)test_[^/]*$"
    )


def is_dependency_file(path: Column) -> Column:
    return basename(path).isin(DEPENDENCY_FILES)


def same_directory(a: Column, b: Column) -> Column:
    return parent_dir(a) == parent_dir(b)


def glob_to_regex(pattern: str) -> str | None:
    """Translate a shell glob; ``None`` for an invalid one, which matches nothing.

    ``*`` and ``?`` cross ``/``, a leading dot is nothing special, matching is
    case-sensitive. ``**`` is only valid as a whole path component, where
    ``**/`` matches any number of directories.
    """
    out = ["^"]
    i, n = 0, len(pattern)
    while i < n:
        char = pattern[i]
        if char == "*":
            run = len(pattern) - len(pattern[i:].lstrip("*")) - i
            end = i + run
            if run > 2:
                return None
            if run == 2:
                starts = i == 0 or pattern[i - 1] == "/"
                if not starts or (end < n and pattern[end] != "/"):
                    return None
                if end < n:
                    out.append("(?:.*/)?")
                    end += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = end
        elif char == "?":
            out.append(".")
            i += 1
        elif char == "[":
            start = i + 1
            negated = start < n and pattern[start] == "!"
            first = start + 1 if negated else start
            close = pattern.find("]", first + 1)
            if close < 0:
                return None
            body = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[first:close])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close + 1
        else:
            out.append(re.escape(char))
            i += 1
    out.append("$")
    return "(?s)" + "".join(out)


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    """One alternation for the whole list, so the plan does not grow with it."""
    regexes = [r for r in map(glob_to_regex, patterns) if r is not None]
    if not regexes:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{r})" for r in regexes))


def glob_include(path: Column, patterns: list[str] | None) -> Column:
    return matches_any_glob(path, patterns) if patterns else F.lit(True)


def glob_exclude(path: Column, patterns: list[str] | None) -> Column:
    """True for the rows to keep."""
    return ~matches_any_glob(path, patterns) if patterns else F.lit(True)
