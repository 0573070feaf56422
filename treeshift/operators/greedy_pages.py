"""Greedy pages of ordered ranges of any length.

A page takes rows in order until one does not fit its budget, and the next page
starts there, so where a page starts depends on all pages before it. To cut a
range without folding it in one task, the rows are dealt out in chunks, each with
the rows behind it that a page may reach into. For every row of a chunk it is
computed where a page that started there would end; following these pointers
turns a chunk into a small table: from the place where the first page starts in it
to the place where the first page of the next chunk starts. These tables are
composed by doubling, which gives the true entry of every chunk in as many rounds
as a range's chunk count has binary digits, and then each chunk walks its pages.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.session import cut

#: Rows of a chunk, unless a page may hold more.
CHUNK = 8192
#: A cost that never fits.
NEVER = 1 << 40

Costs = list[np.ndarray]


def page_ends(room: np.ndarray, whole: Costs, choices: Costs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: where a page that starts there ends, and the whole tier it has (-1: row by row).

    ``end == start`` if not even the first row fits.
    """
    n = len(room)
    starts = np.arange(n)
    last = np.minimum(starts + size, n)
    ends, mode = starts.copy(), np.full(n, -1)
    for k, costs in enumerate(whole):
        before = np.concatenate([[0], np.cumsum(costs)])
        fits = (mode < 0) & (before[last] - before[starts] <= room)
        mode[fits] = k
    ends[mode >= 0] = last[mode >= 0]
    left = room.copy()
    live = starts[mode < 0]
    for step in range(size):
        live = live[live + step < n]
        if not len(live):
            break
        at = live + step
        cost = np.full(len(live), NEVER)
        for costs in reversed(choices):
            cost = np.where(costs[at] <= left[live], costs[at], cost)
        fits = cost < NEVER
        live = live[fits]
        left[live] -= cost[fits]
        ends[live] += 1
    return ends, mode


def _exits(ends: np.ndarray, size: int, chunk: int) -> list[int]:
    """For the first ``size`` rows: where in the next chunk the pages from there arrive."""
    after = np.maximum(ends, np.arange(len(ends)) + 1).tolist()  # a row that does not fit has a page of its own
    arrival = list(range(-chunk, size))
    for p in range(min(chunk, len(after)) - 1, -1, -1):
        arrival[p] = after[p] - chunk if after[p] >= chunk else arrival[after[p]]
    return [max(a, 0) for a in arrival[:size]]


def _walk(entry: int, room: np.ndarray, whole: Costs, choices: Costs, size: int, chunk: int) -> dict[str, list]:
    """The rows of all pages that start in a chunk, which is entered at ``entry``."""
    ends, mode = page_ends(room, whole, choices, size)
    n, start = len(room), entry
    out: dict[str, list] = {c: [] for c in ("row", "start", "tier", "over", "budget", "page")}
    while start < min(chunk, n):
        end = max(int(ends[start]), start + 1)
        held = end - start
        left = int(room[start])
        for row in range(start, end):
            if mode[start] >= 0:
                tier = int(mode[start])
            else:
                fitting = [k for k, costs in enumerate(choices) if costs[row] <= left]
                k = fitting[0] if fitting else len(choices) - 1
                left -= int(choices[k][row])
                tier = len(whole) + k
            out["tier"].append(tier)
        out["row"] += range(start, end)
        out["start"] += [start] * held
        out["over"] += [bool(ends[start] == start)] * held
        out["budget"] += [end if end < min(start + size, n) else None] * held
        out["page"] += [start + size if start + size < n else None] * held
        start = end
    return out


def _entries(maps: DataFrame, by: list[str], chunks: int) -> DataFrame:
    """(by, chunk, entry): where in each chunk the first page starts."""
    keys = [*by, "chunk"]
    known = maps.filter("chunk = 0").select(*keys, F.lit(0).alias("entry"))
    step = 1
    while step < chunks:
        onward = known.join(maps, keys).select(
            *by, (F.col("chunk") + step).alias("chunk"), F.get("exits", F.col("entry")).alias("entry")
        )
        known = cut(known.unionByName(onward))
        if step * 2 < chunks:
            later = maps.select(*by, (F.col("chunk") - step).alias("chunk"), F.col("exits").alias("then"))
            then = F.col("then")
            maps = cut(
                maps.join(later, keys).select(*keys, F.transform("exits", lambda e: F.get(then, e)).alias("exits"))
            )
        step *= 2
    return known


def greedy_pages(
    rows: DataFrame,
    by: list[str],
    room: Column,
    page_size: int,
    whole: Sequence[tuple[str, Column]],
    choices: Sequence[tuple[str, Column]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Cut ranges into pages of at most ``page_size`` rows that cost at most ``room``.

    ``rows`` has a ``position`` from 0 in each ``by`` range, and ``room`` is one value
    for a range. If all rows that a page could hold fit at the cost of a ``whole``
    tier, they have the first such tier; else each row takes the first of the
    ``choices`` that fits what is left, and the page ends where none does. A cost of
    null is never taken. Each row is on exactly one page; one that fits on no page
    has its own, and is ``over_budget``.

    Gives (by, position, page, page_start, offset, tier, over_budget, budget_cutoff,
    page_cutoff): the cutoffs are the positions at which budget and page size end
    the page, if rows follow.
    """
    size = max(1, page_size)
    chunk = max(chunk, size)
    names = [name for name, _ in [*whole, *choices]]
    costs = [f"c{k}" for k in range(len(names))]
    priced = [F.coalesce(c.cast("long"), F.lit(NEVER)).alias(n) for n, (_, c) in zip(costs, [*whole, *choices])]
    lean = cut(rows.select(*by, F.col("position").cast("long").alias("position"), room.cast("long").alias("room"), *priced))
    own = F.floor(F.col("position") / chunk).cast("int")
    reached = (F.col("position") % chunk < size) & (own > 0)
    dealt = lean.withColumn("chunk", F.explode(F.when(reached, F.array(own, own - 1)).otherwise(F.array(own))))
    keys = [*by, "chunk"]
    key_type = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in by) + ", chunk int"
    split = len(whole)

    def numbers(group: pa.Table) -> tuple[np.ndarray, Costs, Costs]:
        columns = [group.column(c).to_numpy() for c in costs]
        return group.column("room").to_numpy(), columns[:split], columns[split:]

    def mapped(key: tuple, group: pa.Table) -> pa.Table:
        left, all_of, each = numbers(group.sort_by("position"))
        exits = _exits(page_ends(left, all_of, each, size)[0], size, chunk)
        named = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}
        return pa.table(named | {"exits": pa.array([exits], pa.list_(pa.int32()))})

    chunks = (lean.agg(F.max(own)).first()[0] or 0) + 1
    if chunks > 1:
        maps = cut(dealt.groupBy(*keys).applyInArrow(mapped, f"{key_type}, exits array<int>"))
        entered = dealt.join(_entries(maps, by, chunks), keys)
    else:
        entered = dealt.withColumn("entry", F.lit(0))

    def walked(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        first = group.column("position")[0].as_py()
        out = _walk(group.column("entry")[0].as_py(), *numbers(group), size, chunk)
        at = {c: pa.array([None if v is None else v + first for v in out[c]], pa.int64()) for c in ("row", "start", "budget", "page")}
        named = {k: pa.array([v.as_py()] * len(out["row"]), v.type) for k, v in zip(keys, key)}
        return pa.table(
            named
            | {
                "position": at["row"],
                "page_start": at["start"],
                "tier": pa.array([names[k] for k in out["tier"]], pa.string()),
                "over": pa.array(out["over"], pa.bool_()),
                "budget_cutoff": at["budget"],
                "page_cutoff": at["page"],
            }
        )

    schema = f"{key_type}, position long, page_start long, tier string, over boolean, budget_cutoff long, page_cutoff long"
    placed = cut(entered.groupBy(*keys).applyInArrow(walked, schema))
    begun = F.col("position") == F.col("page_start")
    # one row for each chunk of a range
    counted = placed.groupBy(*keys).agg(F.count_if(begun).alias("starts"))
    earlier = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*keys, F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*keys).orderBy("position")  # rows of one chunk
    return (
        placed.withColumn("rank", F.sum(begun.cast("long")).over(upto))
        .join(before, keys)
        .select(
            *by,
            "position",
            (F.col("before") + F.col("rank") - 1).alias("page"),
            "page_start",
            (F.col("position") - F.col("page_start")).alias("offset"),
            "tier",
            F.col("over").alias("over_budget"),
            "budget_cutoff",
            "page_cutoff",
        )
    )


