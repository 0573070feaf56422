"""Facts of ranges kept on disk and brought up to date range by range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeshift.operators.paging import stale_ranges
from treeshift.session import cut

SLOTS = 1024


def slot_of(range_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(range_id.cast("string")), F.lit(slots)).cast("int")


def refresh_ranges(
    spark: SparkSession,
    folder: str,
    ranges: DataFrame,
    refs: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    slots: int = SLOTS,
) -> DataFrame:
    """Bring the facts below ``folder`` up to date; the ranges that were computed again.

    ``ranges(range_id, repo, base_ref, head_ref)`` are all ranges to keep facts of,
    and ``compute`` gives facts with a ``range_id`` for some of them. Recomputed are
    ranges that are new and those whose base or head has moved since. Facts lie in
    ``slots`` folders by a hash of the range; only folders with such a range are
    written, together with what else they hold, so a failed run leaves every folder
    either old or new and the next run makes up for it.
    """
    facts_at, recorded_at = f"{folder}/facts", f"{folder}/recorded"
    now = _shas(ranges, refs)
    known = _read(spark, recorded_at)
    if known is None:
        wanted = now
    else:
        moved = stale_ranges(known.join(ranges.select("range_id"), "range_id", "left_semi"), refs).select("range_id")
        fresh = now.join(known.select("range_id"), "range_id", "left_anti").select("range_id")
        wanted = now.join(moved.unionByName(fresh).distinct(), "range_id", "left_semi")
    wanted = cut(wanted)
    if wanted.isEmpty():
        return wanted
    facts = compute(ranges.join(wanted.select("range_id"), "range_id", "left_semi"))
    for rows, path in ((facts, facts_at), (wanted, recorded_at)):
        _replace(spark, rows, wanted.select("range_id"), path, slots)
    return wanted


def facts_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/facts").drop("slot")


def _shas(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return refs.select("repo", F.col("ref").alias(f"{name}_ref"), F.col("sha").alias(f"{name}_sha"))

    return ranges.join(side("base"), ["repo", "base_ref"], "left").join(side("head"), ["repo", "head_ref"], "left").select(
        "range_id", "repo", "base_ref", "head_ref", "base_sha", "head_sha"
    )


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def _replace(spark: SparkSession, rows: DataFrame, gone: DataFrame, path: str, slots: int) -> None:
    """Put ``rows`` in the place of those of the ``gone`` ranges."""
    slot = slot_of(F.col("range_id"), slots)
    rows = rows.withColumn("slot", slot)
    old = _read(spark, path)
    if old is not None:
        touched = gone.select(slot.alias("slot")).distinct()
        rest = old.join(touched, "slot", "left_semi").join(gone, "range_id", "left_anti")
        rows = rest.select(rows.columns).unionByName(rows)
    # the folders that are written are also read
    cut(rows).repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)
