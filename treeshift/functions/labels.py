"""Bounded labels for telemetry, so that no raw path, ref or message leaves."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values
TRUNCATION_REASONS = ["paginated", "max_files", "max_file_size", "token_budget"]
ERROR_WORDS = [
    ("ref_not_found", "resolve|ref not found|invalid ref"),
    ("repo_not_found", "repository|repo not found|not a git|open repo"),
    ("diff_failed", "diff"),
    ("parse_failed", "parse|tree-sitter"),
    ("io_error", "i/o|io error|permission"),
]


def ref_pattern(ref: Column) -> Column:
    return (
        F.when(F.contains(ref, F.lit("...")), "range_triple_dot")
        .when(F.contains(ref, F.lit("..")), "range_double_dot")
        .when(ref.rlike("^[0-9a-fA-F]{12,}$"), "sha")
        .when(ref.rlike("[~^]") | (ref == "HEAD"), "single_commit")
        .otherwise("branch")
    )


def ref_mode(base_ref: Column, head_ref: Column) -> Column:
    return F.when(head_ref.isNull(), "worktree").otherwise(ref_pattern(base_ref))


def truncation_reason(reason: Column) -> Column:
    return F.when(reason.isin(TRUNCATION_REASONS), reason).otherwise("unknown")


def error_kind(message: Column) -> Column:
    lowered = F.lower(message)
    chain = F.when(F.lit(False), "unknown")
    for label, words in ERROR_WORDS:
        chain = chain.when(lowered.rlike(words), label)
    return chain.otherwise("unknown")


def hash_repo_path(path: Column) -> Column:
    return F.sha2(path, 256)
