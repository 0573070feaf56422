"""Manifest and function context of a change under one size budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from treeshift.plans.context import Context, budgeted_context, function_context
from treeshift.plans.manifest import Manifest, budgeted_files, change_manifest, worktree_manifest

MANIFEST_SHARE, CONTEXT_SHARE = 0.4, 0.6


@dataclass(frozen=True)
class Review:
    manifest: Manifest
    files: DataFrame  # trimmed to the manifest's share
    context: Context | None  # none for a working tree
    functions: DataFrame | None  # trimmed to the context's share


def shares(budget: int) -> tuple[int, int]:
    """Rounded down for the smaller share, to the nearest for the larger."""
    return int(budget * MANIFEST_SHARE), int(budget * CONTEXT_SHARE + 0.5)


def review_change(
    tree: DataFrame,
    ranges: DataFrame,
    budget: int = 0,
    page_size: int = 25,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    names: DataFrame | None = None,
    worktree: bool = False,
    **options,
) -> Review:
    """Both halves from one set of changes; a budget of 0 trims nothing."""
    for_files, for_functions = shares(budget)
    build = worktree_manifest if worktree else change_manifest
    manifest = build(tree, ranges, include, exclude, page_size=page_size, **options)
    files = manifest.files if budget == 0 else budgeted_files(manifest, ranges, for_files, page_size)
    if worktree:
        return Review(manifest, files, None, None)
    context = function_context(tree, ranges, manifest.function_changes, page_size, names)
    functions = (
        context.functions if budget == 0 else budgeted_context(context, ranges, for_functions, page_size)
    )
    return Review(manifest, files, context, functions)
