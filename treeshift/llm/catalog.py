"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeshift.llm import (
    exact_dedup,
    language_id,
    lattice_lm,
    mixing,
    near_dedup,
    packing,
    quality,
    secret_scan,
    spelling,
    substring_dedup,
    tool_calls,
    vector_search,
    whitening,
)


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents = table("documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, sf_dir: language_id.languages(documents(spark, sf_dir)),
    "op2_secret_scan": lambda spark, sf_dir: secret_scan.secrets(documents(spark, sf_dir)),
    "op3_lm_score": lambda spark, sf_dir: lattice_lm.lm_scores(documents(spark, sf_dir)),
    "op4_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op5_mixing": lambda spark, sf_dir: mixing.mixture(documents(spark, sf_dir)),
    "op6_tool_calls": lambda spark, sf_dir: tool_calls.linked_conversations(table("conversations")(spark, sf_dir)),
    "op7_substring_dedup": lambda spark, sf_dir: substring_dedup.repeated_spans(documents(spark, sf_dir)),
    "op8_vector_search": lambda spark, sf_dir: vector_search.nearest_neighbours(table("embeddings")(spark, sf_dir)),
    "op9_near_dedup": lambda spark, sf_dir: near_dedup.near_groups(documents(spark, sf_dir)),
    "op10_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_groups(documents(spark, sf_dir)),
    "op11_whitening": lambda spark, sf_dir: whitening.whitened(table("embeddings")(spark, sf_dir)),
    "op12_quality": lambda spark, sf_dir: quality.qualities(documents(spark, sf_dir), table("labels")(spark, sf_dir)),
    "op13_spelling": lambda spark, sf_dir: spelling.variants(documents(spark, sf_dir)),
}

ORACLES = {"op5_mixing": mixing.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
