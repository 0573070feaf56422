"""Approximate nearest neighbours by an adaptive dimension scan.

Nearness is the inner product. Every vector gets one more dimension that brings
all to the same norm, so the largest inner product is the smallest distance.
Vectors are dealt to lists around centroids and turned by a random rotation.
Inside a probed list they lie in blocks of columns; after each block a hypothesis
test compares the distance so far, scaled to all dimensions, with the distance of
the query's k-th neighbour, and abandons candidates that will hardly get below
it. The few that remain are scored exactly on the original vectors.

A query scans its own list first; the distance reached there holds for all
other lists. How many lists are probed is found from the data: some queries are
answered by brute force against all rows, and the probes must cover
``COVERAGE`` of their neighbours. Only centroids are fitted on a sample; every
row is indexed.

Equal vectors are one vector with its smallest ids: as ties go to smaller ids, no
other of them can be among the nearest. Lists and the queries that probe them are
dealt out in cells of bounded size.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without id. A shorter vector counts as padded with
zeros. An id is a key: rows that repeat an id with other vectors are candidates
for every other id. Other columns are not looked at. With fewer candidates than k
all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.llm.common import lists, staged

#: Rows the centroids are fitted on, by hash of the id.
SAMPLE = 20_000
#: Queries answered by brute force to set the number of probes.
MEASURED = 100
COVERAGE = 0.97
#: Columns between two tests, and the confidence of a test.
COLUMNS = 16
CONFIDENCE = 2.1
#: Vectors and queries of one cell.
CELL_VECTORS = 2048
CELL_QUERIES = 1024


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, in double precision."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    )


class Index:
    """Centroids, rotation and the norm that all vectors are brought to."""

    def __init__(self, sample: np.ndarray, norm: float, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm, self.dimensions = norm, sample.shape[1]
        size = self.dimensions + 1
        self.rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        points = self.turned(sample)
        self.centroids = points[rng.permutation(len(points))[:count]].copy()
        for _ in range(8):
            near = self.nearest(points, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, points)
            held = np.bincount(near, minlength=len(self.centroids))
            some = held > 0
            self.centroids[some] = sums[some] / held[some, None]

    def turned(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            last = np.zeros(len(vectors))
        else:
            last = np.sqrt(np.maximum(0, self.norm**2 - (vectors * vectors).sum(axis=1)))
        return np.column_stack([vectors, last]) @ self.rotation

    def nearest(self, points: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each turned point, nearest first."""
        out = []
        for i in range(0, len(points), 4096):
            part = points[i : i + 4096]
            distance = (self.centroids**2).sum(axis=1) - 2 * part @ self.centroids.T
            out.append(np.argsort(distance, axis=1, kind="stable")[:, :count])
        return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; each row is summed in the same way wherever it stands."""
    return (vectors * query).sum(axis=1)


def scan(index: Index, points: np.ndarray, vectors: np.ndarray, point: np.ndarray, query: np.ndarray, limit: float, k: int):
    """Candidates that pass all tests: their places and scores.

    ``limit`` is the squared distance of the k-th neighbour known so far.
    """
    size = points.shape[1]
    alive, distance = np.arange(len(points)), np.zeros(len(points))
    for start in range(0, size, COLUMNS):
        end = min(size, start + COLUMNS)
        part = points[alive, start:end] - point[start:end]
        distance = distance + (part * part).sum(axis=1)
        if np.isfinite(limit) and end < size:
            slack = (1 + CONFIDENCE / np.sqrt(end)) ** 2
            stay = distance * (size / end) <= slack * limit
            alive, distance = alive[stay], distance[stay]
            if not len(alive):
                break
    found = scores(vectors[alive], query)
    # exact comparison, so that ties at the limit stay
    enough = found >= (index.norm**2 + (query * query).sum() - limit) / 2 - 1e-9 * index.norm**2
    alive, found = alive[enough], found[enough]
    if len(alive) > k:
        edge = np.partition(found, len(found) - k)[len(found) - k]
        alive, found = alive[found >= edge], found[found >= edge]
    return alive, found


def _matrix(column, dimensions: int) -> np.ndarray:
    values, offsets = lists(column, "float64")
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dimensions))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def _assign(shared, probes: int):
    """The nearest list of every vector, and for queries the ``probes`` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"), index.dimensions)
            near = index.nearest(index.turned(vectors, query=probes > 0), max(1, probes))
            lists_of = pa.array(near.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of], [*batch.schema.names, "lists"])

    return run


def _brute(shared, queries: np.ndarray, k: int):
    """Of each batch the k nearest of each query, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), queries.shape[1])
            products = queries @ vectors.T
            best = np.argsort(-products, axis=1, kind="stable")[:, :k]
            owner = np.repeat(np.arange(len(queries)), best.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner),
                    pa.array(products[owner, best.ravel()]),
                    batch.column("list").take(pa.array(best.ravel())),
                ],
                ["query", "score", "list"],
            )

    return run


def _search(shared, k: int):
    def run(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        index: Index = shared.value
        names = ["query", "group", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.float64())], names)
        vectors, queries = _matrix(left.column("vector"), index.dimensions), _matrix(right.column("vector"), index.dimensions)
        points = np.asfortranarray(index.turned(vectors))  # columns lie together
        turned = index.turned(queries, query=True)
        limits = right.column("limit").to_numpy()
        owner, place, found = [], [], []
        for i in range(len(queries)):
            alive, score = scan(index, points, vectors, turned[i], queries[i], limits[i], k)
            owner.append(np.full(len(alive), i))
            place.append(alive)
            found.append(score)
        owner, place = np.concatenate(owner), np.concatenate(place)
        return pa.table(
            [
                right.column("query").combine_chunks().take(pa.array(owner)),
                left.column("group").combine_chunks().take(pa.array(place)),
                pa.array(np.concatenate(found)),
            ],
            names,
        )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query").orderBy(F.col("score").desc(), "first_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def nearest_neighbours(rows: DataFrame, every: int = 20, k: int = 20, probes: int | None = None) -> DataFrame:
    """For ids divisible by ``every`` their ``k`` nearest rows: query_id, rank, vec_id, score."""
    context = rows.sparkSession.sparkContext
    vectors = staged(usable(rows), "vectors")
    about = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("vector")).alias("dimensions"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"),
    ).first()
    if not about["n"]:
        return vectors.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    # one row for equal vectors, with as many of the smallest ids as can ever be needed
    groups = _distinct(vectors, k + 1)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    index = Index(
        _matrix(drawn.column("vector"), about["dimensions"]),
        about["norm"],
        max(1, min(round(about["n"] ** 0.5), drawn.num_rows // 8)),
    )
    shared = context.broadcast(index)  # at most SAMPLE / 8 centroids
    held = staged(
        groups.mapInArrow(_assign(shared, 0), "group binary, vector array<double>, ids array<long>, lists array<int>")
        .withColumn("list", F.element_at("lists", 1))
        .withColumn("first_id", F.element_at("ids", 1))
        .drop("lists"),
        "indexed",
    )
    asked = staged(
        vectors.filter(F.col("vec_id") % every == 0).select("vec_id", _identity().alias("query"), "vector"), "asked"
    )
    queries = asked.dropDuplicates(["query"]).select("query", "vector")
    if probes is None:
        probes = _probes(index, shared, held, queries, k)
    probed = staged(
        queries.mapInArrow(_assign(shared, probes), "query binary, vector array<double>, lists array<int>"), "probed"
    )

    def search(part: DataFrame) -> DataFrame:
        """part: query, vector, limit, list."""
        found = _cells(held, part, shared, k)
        return found.join(held.select("group", "first_id"), "group")

    home = probed.select("query", "vector", F.lit(float("inf")).alias("limit"), F.element_at("lists", 1).alias("list"))
    first = staged(_best(search(home), k + 1).drop("rank"), "first-list")
    reached = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) + F.lit(about["norm"] ** 2)
    others = (
        probed.join(reached, "query", "left")
        .withColumn("limit", F.when(F.col("n") > k, square - 2 * F.col("least")).otherwise(F.lit(float("inf"))))
        .select("query", "vector", "limit", F.explode(F.slice("lists", 2, max(1, probes))).alias("list"))
    )
    found = staged(_best(first.unionByName(search(others)), k + 1).drop("rank"), "found")
    # back to rows: every id of an equal vector, without the query's own
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    named = found.join(held.select("group", "ids"), "group").select("query", "score", F.explode("ids").alias("vec_id"))
    each = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    named = named.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= k + 1)
    return (
        asked.select("query", F.col("vec_id").alias("query_id"))
        .distinct()
        .join(named, "query")
        .filter("query_id != vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _identity() -> Column:
    return F.unhex(F.sha2(F.to_json("vector").cast("binary"), 256))


def _distinct(vectors: DataFrame, ids: int) -> DataFrame:
    """group, vector, ids (the smallest, sorted) of each distinct vector."""
    smallest = Window.partitionBy("group").orderBy("vec_id")
    keyed = vectors.withColumn("group", _identity()).dropDuplicates(["group", "vec_id"])
    return (
        keyed.withColumn("place", F.row_number().over(smallest))
        .filter(F.col("place") <= ids)
        .groupBy("group")
        .agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )


def _probes(index: Index, shared, held: DataFrame, queries: DataFrame, k: int) -> int:
    """Lists a query must probe so that the measured queries find ``COVERAGE`` of their neighbours."""
    drawn = queries.orderBy("query").limit(MEASURED).select("vector").toArrow()
    if not drawn.num_rows:
        return 1
    asked = _matrix(drawn.column("vector"), index.dimensions)
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    true = (
        held.select("vector", "list")
        .mapInArrow(_brute(shared, asked, k), "query long, score double, list int")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .collect()  # MEASURED * k rows
    )
    order = np.argsort(index.nearest(index.turned(asked, query=True), len(index.centroids)), axis=1)
    needed = np.sort([order[row["query"], row["list"]] for row in true])
    return int(needed[int(np.ceil(COVERAGE * len(needed))) - 1]) + 1


def _cells(held: DataFrame, part: DataFrame, shared, k: int) -> DataFrame:
    """Search each list's vectors with the queries that probe it, in cells of bounded size."""

    def pieces(counts: DataFrame, size: int) -> Column:
        # at most SAMPLE / 8 lists
        many = {row["list"]: -(-row["count"] // size) for row in counts.collect() if row["count"] > size}
        if not many:
            return F.lit(1)
        return F.coalesce(F.create_map(*[F.lit(x) for pair in many.items() for x in pair])[F.col("list")], F.lit(1))

    blocks = pieces(held.groupBy("list").count(), CELL_VECTORS)
    part = staged(part, "probes")
    turns = pieces(part.groupBy("list").count(), CELL_QUERIES)

    def dealt(df: DataFrame, key: str, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), own).cast("int")
        return df.withColumn(names[0], mine).withColumn(names[1], F.explode(F.sequence(F.lit(0), other - 1)))

    vectors = dealt(held.select("group", "vector", "list"), "group", blocks, turns, ("block", "turn"))
    asked = dealt(part, "query", turns, blocks, ("turn", "block"))
    cell = ["list", "block", "turn"]
    schema = "query binary, group binary, score double"
    return vectors.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_search(shared, k + 1), schema)
