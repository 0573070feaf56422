"""Usage metrics over a table of requests.

Every function is an aggregation with map-side partials and runs unchanged on a
batch or, where it is keyed by a time window, on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.functions import labels as L
from treeshift.functions.languages import UNKNOWN

# fixed values: upper bounds of the histogram buckets
DURATION_BUCKETS = [
    1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 30000.0,
]
SIZE_BUCKETS = [
    100.0, 500.0, 1000.0, 5000.0, 10000.0, 50000.0, 100000.0, 500000.0, 1000000.0,
]
COUNT_BUCKETS = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0]
INFINITY = float("inf")


def requests_total(requests: DataFrame) -> DataFrame:
    return requests.groupBy("tool", "status").agg(F.count("*").alias("requests"))


def sessions_started(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count_distinct("session_id").alias("sessions"))


def errors_total(requests: DataFrame) -> DataFrame:
    return (
        requests.filter("error IS NOT NULL")
        .groupBy("tool", L.error_kind(F.col("error")).alias("error_kind"))
        .agg(F.count("*").alias("errors"))
    )


def ref_pattern_counts(requests: DataFrame) -> DataFrame:
    mode = L.ref_mode(F.col("base_ref"), F.col("head_ref"))
    return requests.groupBy(mode.alias("ref_pattern")).agg(F.count("*").alias("requests"))


def change_scope_counts(requests: DataFrame) -> DataFrame:
    return (
        requests.filter("change_scope IS NOT NULL")
        .groupBy("change_scope")
        .agg(F.count("*").alias("requests"))
    )


def languages_analyzed(requests: DataFrame) -> DataFrame:
    return (
        requests.filter(F.col("language").isNotNull() & (F.col("language") != UNKNOWN))
        .groupBy("language")
        .agg(F.count("*").alias("requests"))
    )


def truncated_counts(requests: DataFrame) -> DataFrame:
    return (
        requests.filter("truncation_reason IS NOT NULL")
        .groupBy("tool", L.truncation_reason(F.col("truncation_reason")).alias("reason"))
        .agg(F.count("*").alias("responses"))
    )


def response_truncated(
    manifest_pages: DataFrame, context_pages: DataFrame, snapshot_files: DataFrame | None = None
) -> DataFrame:
    """``(range_id, truncated, reasons)`` from both halves of a review, and from snapshots.

    Each half is ``(range_id, has_next, trimmed)``: is there a further page, and
    was a list or an analysis trimmed. ``snapshot_files`` is ``(range_id, truncated)``,
    a row per file whose content may have been cut at the largest size.
    """
    both = manifest_pages.unionByName(context_pages).withColumn("cut", F.lit(False))
    if snapshot_files is not None:
        none = F.lit(False)
        both = both.unionByName(
            snapshot_files.select("range_id", none.alias("has_next"), none.alias("trimmed"), F.col("truncated").alias("cut"))
        )
    more, trimmed, shortened = F.bool_or("has_next"), F.bool_or("trimmed"), F.bool_or("cut")
    reasons = F.array_compact(
        F.array(F.when(more, "paginated"), F.when(trimmed, "token_budget"), F.when(shortened, "max_file_size"))
    )
    return both.groupBy("range_id").agg((more | trimmed | shortened).alias("truncated"), reasons.alias("reasons"))


def files_touched(functions: DataFrame) -> DataFrame:
    """Distinct files of the changed functions of each response."""
    return functions.groupBy("range_id").agg(F.count_distinct("file").alias("files"))


def pages_requested(requests: DataFrame) -> DataFrame:
    return requests.filter("has_cursor").groupBy("tool").agg(F.count("*").alias("pages"))


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Upper bound of the bucket a value is in; infinity above the last."""
    chain = None
    for bound in bounds:
        hit = value <= bound
        chain = F.when(hit, bound) if chain is None else chain.when(hit, bound)
    return chain.otherwise(INFINITY)


def histogram(requests: DataFrame, value: str, bounds: list[float], label: str = "tool") -> DataFrame:
    """Count per bucket and, as ``cumulative``, up to its bound.

    The running sum is over the few buckets of a label, not over requests.
    """
    counted = (
        requests.filter(F.col(value).isNotNull())
        .groupBy(label, bucket_of(F.col(value).cast("double"), bounds).alias("le"))
        .agg(F.count("*").alias("n"))
    )
    below = Window.partitionBy(label).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("cumulative", F.sum("n").over(below))


def duration_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "duration_ms", DURATION_BUCKETS)


def bytes_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "bytes", SIZE_BUCKETS)


def tokens_histogram(requests: DataFrame) -> DataFrame:
    return histogram(
        requests.withColumn("tokens", F.floor(F.col("bytes") / 4)), "tokens", SIZE_BUCKETS
    )


def files_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "files", COUNT_BUCKETS)


def functions_histogram(requests: DataFrame) -> DataFrame:
    return histogram(requests, "functions", COUNT_BUCKETS)


def timing_histogram(timings: DataFrame, label: str) -> DataFrame:
    """Duration buckets by another label, such as operation or language."""
    return histogram(timings.filter(F.col(label).isNotNull()), "duration_ms", DURATION_BUCKETS, label)


def requests_24h_by_tool(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.window("ts", "24 hours").start.alias("day"), "tool").agg(
        F.count("*").alias("requests")
    )


def exact_quantile(requests: DataFrame, value: str, width: str, q: float, name: str) -> DataFrame:
    """Quantile by tool and window, interpolated between neighbouring values."""
    return requests.groupBy(F.window("ts", width).start.alias("window_start"), "tool").agg(
        F.percentile(F.col(value).cast("double"), q).alias(name)
    )


def quantile_from_buckets(
    requests: DataFrame, value: str, bounds: list[float], width: str, q: float, name: str
) -> DataFrame:
    """Quantile as read off cumulative buckets: linear inside the bucket that
    holds it, the last bound if that is the open one.

    Buckets are counted first, so the state of a window is a few numbers.
    """
    keys = ["window_start", "tool"]
    counted = requests.groupBy(
        F.window("ts", width).start.alias("window_start"),
        "tool",
        bucket_of(F.col(value).cast("double"), bounds).alias("le"),
    ).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*keys).orderBy("le")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.withColumn("upto", F.sum("n").over(upto))
        .withColumn("rank", F.lit(q) * F.sum("n").over(Window.partitionBy(*keys)))
        .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    )
    lower = F.when(F.lit(False), 0.0)
    for low, high in zip([0.0, *bounds], bounds):
        lower = lower.when(F.col("le") == high, low)
    inside = lower + (F.col("le") - lower) * (F.col("rank") - (F.col("upto") - F.col("n"))) / F.col("n")
    value_at = F.when(F.col("le") == INFINITY, bounds[-1]).otherwise(inside)
    return ranked.select(*keys, value_at.alias(name))


def p95_duration_5m(requests: DataFrame) -> DataFrame:
    return quantile_from_buckets(requests, "duration_ms", DURATION_BUCKETS, "5 minutes", 0.95, "p95")


def median_tokens_1h(requests: DataFrame) -> DataFrame:
    tokens = requests.withColumn("tokens", F.floor(F.col("bytes") / 4))
    return quantile_from_buckets(tokens, "tokens", SIZE_BUCKETS, "1 hour", 0.5, "median_tokens")


def redact_requests(requests: DataFrame) -> DataFrame:
    """What may leave: hashes and bounded labels instead of paths, refs and messages."""
    return requests.select(
        "ts",
        "tool",
        "status",
        L.hash_repo_path(F.col("repo_path")).alias("repo_hash"),
        L.ref_mode(F.col("base_ref"), F.col("head_ref")).alias("ref_pattern"),
        F.when(F.col("error").isNotNull(), L.error_kind(F.col("error"))).alias("error_kind"),
        F.when(
            F.col("truncation_reason").isNotNull(), L.truncation_reason(F.col("truncation_reason"))
        ).alias("truncation_reason"),
        "duration_ms",
        "bytes",
    )
