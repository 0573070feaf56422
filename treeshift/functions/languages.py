"""Languages, file extensions and what can be done with each.

Fixed values: they must equal the published behaviour being matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# extensions by language (22 extensions, 13 languages)
EXTENSIONS: dict[str, list[str]] = {
    "c": ["c", "h"],
    "cpp": ["cpp", "hpp", "cc", "cxx", "hh", "hxx"],
    "csharp": ["cs"],
    "go": ["go"],
    "java": ["java"],
    "javascript": ["js", "jsx"],
    "kotlin": ["kt", "kts"],
    "php": ["php"],
    "python": ["py"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "swift": ["swift"],
    "typescript": ["ts", "tsx"],
}

# extensions whose imports can be resolved to a module of the repository
SCOPED_EXTENSIONS = ["rs", "py", "go", "ts", "tsx", "js", "jsx"]

UNKNOWN = "unknown"


def extension_to_language() -> dict[str, str]:
    return {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts}


def language_table(spark: SparkSession) -> DataFrame:
    """``(extension, language, analysable, scoping)``; one row per extension."""
    rows = [
        (ext, lang, True, ext in SCOPED_EXTENSIONS)
        for ext, lang in sorted(extension_to_language().items())
    ]
    return spark.createDataFrame(
        rows, "extension string, language string, analysable boolean, scoping boolean"
    )
