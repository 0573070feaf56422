"""The usage metrics as running jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from treeshift.functions import labels as L
from treeshift.operators.telemetry import DURATION_BUCKETS, bucket_of

LATENESS = "10 minutes"


def read_requests(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Requests that arrive as Parquet files in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def request_rates(requests: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests, errors and duration buckets by window, tool and status.

    Rows later than the watermark are dropped; the state is one row per open
    window and label.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        requests.withWatermark("ts", LATENESS)
        .groupBy(
            window.alias("w"),
            "tool",
            "status",
            bucket_of(F.col("duration_ms"), DURATION_BUCKETS).alias("le"),
        )
        .agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        .select(F.col("w.start").alias("window_start"), "tool", "status", "le", "n", "bytes")
    )


def requests_by_day(requests: DataFrame) -> DataFrame:
    """Requests of the last 24 hours by tool, updated every hour."""
    return (
        requests.withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), "tool")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "tool", "n")
    )


def error_rates(requests: DataFrame, width: str = "5 minutes") -> DataFrame:
    return (
        requests.filter("error IS NOT NULL")
        .withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", width).alias("w"), "tool", L.error_kind(F.col("error")).alias("error_kind"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "tool", "error_kind", "n")
    )


def write_metrics(metrics: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append closed windows as Parquet; the checkpoint makes restarts exactly-once."""
    writer = (
        metrics.writeStream.outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_metrics(
    metrics: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the windows of ``metrics`` up to date, open ones included.

    Every micro-batch writes the rows that it changed to a folder of its own, named
    by its number, so a batch that is run again after a failure replaces itself.
    ``latest_metrics`` reads the result.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch:012d}")

    writer = metrics.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_metrics(spark: SparkSession, folder: str, values: tuple[str, ...] = ("n", "bytes")) -> DataFrame:
    """The newest row of each window and label that ``upsert_metrics`` has written."""
    written = spark.read.option("basePath", folder).parquet(folder)
    keys = [c for c in written.columns if c not in (*values, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return written.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def compact_metrics(spark: SparkSession, folder: str, target: str, values: tuple[str, ...] = ("n", "bytes")) -> None:
    """One file set for all batches so far; run it while no stream writes to ``folder``."""
    latest_metrics(spark, folder, values).write.mode("overwrite").parquet(f"{target}/batch={0:012d}")
