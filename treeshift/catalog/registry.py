"""Queries over the test tables, each with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeshift import fixtures as fx
from treeshift.session import cut

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

T = TypeVar("T")

_kept: dict[tuple[str, str, str], Any] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], T]) -> T:
    """What several queries use, made on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries use, written on first use in a session.

    Extraction is meant to be done once and kept (see ``new_blobs``); this is
    the same for the test tables.
    """
    return once(spark, sf_dir, name, lambda: cut(build()))


def one_range(spark: SparkSession, repo: str, base: str = "base", head: str = "head") -> DataFrame:
    return spark.range(1).select(
        F.lit("x").alias("range_id"),
        F.lit(repo).alias("repo"),
        F.lit(base).alias("base_ref"),
        F.lit(head).alias("head_ref"),
    )


def joined(column: str | Column) -> Column:
    """A list as text, so that both engines print it the same way."""
    return F.array_join(column, "|")


def sql(names: list[str], select: str) -> str:
    return fx.cte(*names) + "\n" + select


def greedy_sql(costs: str, size: int) -> str:
    """CTEs that cut the rows of ``costs`` into greedy pages, row by row.

    ``costs(i, room, all_1, all_2, one, two)`` holds for row ``i`` what a page has,
    the row's cost in two tiers for whole pages and in two tiers for single rows;
    null costs never fit. ``pages`` has i, page, page_start, tier (1, 2 of a whole
    page, 3, 4 of a row) and over_budget.
    """
    return f"""costs AS ({costs}),
    summed AS (SELECT *, sum(all_1) OVER w AS sum_1, sum(all_2) OVER w AS sum_2, count(*) OVER () AS n FROM costs
      WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)),
    walk(i, page, page_start, whole, room_left, tier, over_budget) AS (
      SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-{size} AS BIGINT), 0, CAST(0 AS BIGINT), 0, false
      UNION ALL
      SELECT i, page, page_start, whole, CASE tier WHEN 3 THEN have - one WHEN 4 THEN have - two ELSE have END, tier,
        tier = 4 AND two > have
      FROM (SELECT *, CASE WHEN whole > 0 THEN whole WHEN coalesce(one <= have, false) THEN 3 ELSE 4 END AS tier
        FROM (SELECT i, one, two, CASE WHEN same THEN page ELSE page + 1 END AS page,
            CASE WHEN same THEN page_start ELSE i END AS page_start,
            CASE WHEN same THEN whole WHEN sum_1 <= room THEN 1 WHEN sum_2 <= room THEN 2 ELSE 0 END AS whole,
            CASE WHEN same THEN room_left ELSE room END AS have
          FROM (SELECT s.*, w.page, w.page_start, w.whole, w.room_left,
              s.i - w.page_start < {size} AND (w.whole > 0 OR coalesce(s.one <= w.room_left, false)
                OR coalesce(s.two <= w.room_left, false)) AS same
            FROM walk w JOIN summed s ON s.i = w.i + 1) a) b) c),
    pages AS (SELECT i, page, page_start, i - page_start AS "offset", tier, over_budget,
      CASE WHEN max(i) OVER (PARTITION BY page) + 1 < (SELECT count(*) FROM costs) THEN max(i) OVER (PARTITION BY page) + 1 END
        AS next_offset FROM walk WHERE i >= 0)
    """


def recursive(query_sql: str) -> str:
    return query_sql.replace("WITH ", "WITH RECURSIVE ", 1)
