"""Embedding whitening by Jacobi-Davidson on a covariance that is never formed.

Vectors are coded as integers, so counts and sums are exact. The fit list holds
each distinct code vector once. Its covariance V is only ever applied: one Spark
job centres every row, multiplies it with a small block of directions and sums
the products, so tasks return one block each, whatever the number of rows.

The leading eigenpairs come from a block Jacobi-Davidson iteration on the driver,
which holds nothing but blocks of directions: Rayleigh-Ritz in the search space,
locking of the pairs whose residual has come down to the rounding of the product,
and for all others a correction equation, projected off the locked and the
current directions and solved by some steps of MINRES. All equations of a round
advance in step, so a MINRES step of the whole block is one job.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do vectors of another length than the most frequent one
(the longer on a tie), nor entries so large that their code has 40 bits or more.
Repeated rows are all returned, ids may be null. There are at most as many
components as V has eigenvalues above rounding: none, and so no rows, for a
single distinct vector. A deviation beyond a long is null. Other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treeshift.llm.common import lists, staged

SCALE, SHIFT = 64, 1_000_000
#: Codes stay below this, so that a batch of them is summed in 64 bits.
LARGEST = float(1 << 40)
#: A pair is locked when its residual is below this share of the largest eigenvalue.
PRECISION = 1e-13
#: Below this share of the largest eigenvalue a direction has no variance.
FLAT = 1e-11


def coded(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, ``x`` as array of long."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: c * SCALE)
    usable = F.forall("scaled", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    full = rows.select("vec_id", scaled.alias("scaled")).filter(
        F.col("scaled").isNotNull() & (F.size("scaled") > 0) & usable
    )
    return full.select("vec_id", F.transform("scaled", lambda c: F.floor(c) + SHIFT).alias("x"))


@dataclass(frozen=True)
class Centre:
    """Row count and exact sums of a fit list."""

    count: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; whole parts are subtracted as integers, so nothing cancels."""
        whole = np.array([s // self.count for s in self.sums], dtype=np.int64)
        part = np.array([s % self.count / self.count for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of each row, exact; None beyond 63 bits."""
        most = max((abs(s) for s in self.sums), default=0) + self.count * int(np.abs(x).max(initial=0))
        if most >= 1 << 62:
            gaps = x.astype(object) * self.count - np.array(self.sums, dtype=object)
        else:
            gaps = x * self.count - np.array(self.sums, dtype=np.int64)
        largest = max(int(gaps.max(initial=0)), -int(gaps.min(initial=0)))
        if largest**2 * max(1, x.shape[1]) < 1 << 63:
            return (gaps.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (gaps.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values, offsets = lists(batch.column("x"), "int64")
    return values.reshape(len(offsets) - 1, -1)


def centre(fit: DataFrame) -> Centre:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch).sum(axis=0).astype(object)
                total = own if total is None else total + own
                count += batch.num_rows
        if total is not None:
            exact = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), exact, pa.array([count] * len(total), pa.int64())],
                ["position", "total", "held"],
            )

    parts = fit.select("x").mapInArrow(sums, "position int, total decimal(38,0), held long")
    # one row for each dimension
    found = parts.groupBy("position").agg(F.sum("total").alias("total"), F.sum("held").alias("held")).collect()
    found.sort(key=lambda r: r["position"])
    return Centre(found[0]["held"] if found else 0, tuple(int(r["total"]) for r in found))


def summed(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``work`` over all rows: a matrix of a fixed shape, added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += work(matrix(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["position", "value"]
        )

    parts = fit.select("x").mapInArrow(partial, "position int, value double")
    cells = parts.groupBy("position").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["position"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(shape)


def covariance(fit: DataFrame, middle: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """V as a function of a block of directions."""

    def apply(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            rows = middle.centred(x)
            return rows.T @ (rows @ block)

        return summed(fit, work, block.shape) / middle.count

    return apply


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The part of ``block`` that ``against`` does not span, as unit directions."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):  # once more for the rounding of the first
        block = block - against @ (against.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    kept = left[:, sizes > 1e-10]
    kept = kept - against @ (against.T @ kept)
    return np.linalg.qr(kept)[0] if kept.shape[1] else kept


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """One MINRES solution for each column, all columns in step.

    Stops when every residual is below ``enough`` of its start.
    """
    first = np.linalg.norm(right, axis=0)
    safe = lambda v: np.where(v > 0, v, 1.0)  # noqa: E731  a finished column stays as it is
    found = np.zeros_like(right)
    basis, basis_old = right / safe(first), np.zeros_like(right)
    step, step_old = np.zeros_like(right), np.zeros_like(right)
    cosine = cosine_old = np.ones(right.shape[1])
    sine = sine_old = beta = np.zeros(right.shape[1])
    rest = first.copy()
    for _ in range(steps):
        image = apply(basis)
        alpha = (basis * image).sum(axis=0)
        image = image - alpha * basis - beta * basis_old
        after = np.linalg.norm(image, axis=0)
        after = np.where(after > 1e-14 * (np.abs(alpha) + beta), after, 0.0)
        delta = cosine * alpha - cosine_old * sine * beta
        second, third = sine * alpha + cosine_old * cosine * beta, sine_old * beta
        size = np.hypot(delta, after)
        alive = (size > 0) & (rest != 0)
        size = safe(size)
        fresh = (basis - third * step_old - second * step) / size
        cosine_old, cosine = cosine, delta / size
        sine_old, sine = sine, after / size
        found = found + np.where(alive, cosine * rest, 0.0) * fresh
        rest = np.where(alive, -sine * rest, 0.0)
        step_old, step = step, fresh
        basis_old, basis, beta = basis, image / safe(after), after
        if (np.abs(rest) <= enough * first).all():
            break
    return found


def leading_pairs(
    apply: Callable[[np.ndarray], np.ndarray],
    dimensions: int,
    wanted: int,
    inner: int = 4,
    enough: float = 0.02,
    rounds: int = 200,
    seed: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``apply``, falling, with their eigenvectors.

    The search space has up to four directions for each wanted pair; a full one
    is replaced by its best Ritz vectors.
    """
    wanted = min(wanted, dimensions)
    keep, most = min(dimensions, 2 * wanted), min(dimensions, 4 * wanted)
    start = np.random.default_rng(seed).normal(size=(dimensions, min(dimensions, wanted + 8)))
    locked, values = np.zeros((dimensions, 0)), np.zeros(0)
    space = np.linalg.qr(start)[0]
    images = apply(space)
    for _ in range(rounds):
        ritz, turn = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        order = np.argsort(-ritz)
        ritz, turn = ritz[order], turn[:, order]
        space, images = space @ turn, images @ turn
        missing = wanted - len(values)
        lowest = np.sort(values)[-wanted] if missing <= 0 else -np.inf
        active = max(missing, int((ritz > lowest).sum()) if missing <= 0 else missing)
        active = min(active, len(ritz))
        if missing <= 0 and not active:
            break
        rest = images[:, :active] - space[:, :active] * ritz[:active]
        limit = PRECISION * max(np.abs(values).max(initial=0), np.abs(ritz).max(initial=0))
        whole = len(values) + space.shape[1] == dimensions  # Rayleigh-Ritz in all directions is exact
        done = np.linalg.norm(rest, axis=0) <= limit
        done |= whole
        if done.any():
            at = np.flatnonzero(done)
            locked = np.hstack([locked, space[:, at]])
            values = np.concatenate([values, ritz[at]])
            others = np.setdiff1d(np.arange(len(ritz)), at)
            space, images, ritz = space[:, others], images[:, others], ritz[others]
            rest = rest[:, ~done]
            active = rest.shape[1]
            if not active:
                if not space.shape[1]:
                    break
                continue
        if space.shape[1] + active > most - len(values):
            few = max(active, min(keep, most - len(values) - active))
            space, images = space[:, :few], images[:, :few]
        fixed = np.hstack([locked, space[:, :active]])
        project = lambda block: block - fixed @ (fixed.T @ block)
        shifts = ritz[:active]

        def corrected(block: np.ndarray) -> np.ndarray:
            block = project(block)
            return project(apply(block) - block * shifts)

        steps = minres(corrected, -project(rest), inner, enough)
        fresh = orthonormal(project(steps), np.hstack([locked, space]))
        if not fresh.shape[1]:  # residuals are pure rounding: a random direction tells if anything is missed
            random = np.random.default_rng(seed + len(values)).normal(size=(dimensions, active))
            fresh = orthonormal(random, np.hstack([locked, space]))
        space, images = np.hstack([space, fresh]), np.hstack([images, apply(fresh)])
    else:
        raise RuntimeError("the residuals did not reach double precision")
    order = np.argsort(-values)[:wanted]
    return values[order], locked[:, order]


@dataclass(frozen=True)
class Whitening:
    middle: Centre
    values: np.ndarray  # eigenvalues, falling
    directions: np.ndarray  # one column for each component
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.middle.centred(x) @ (self.directions / np.sqrt(self.values))


def fit_whitening(x: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors ``x`` of equal length; None without variance."""
    fit = staged(x.select("x").distinct(), "whitening-fit")
    middle = centre(fit)
    dimensions = len(middle.sums)
    if middle.count < 2:
        return None
    trace = float(summed(fit, lambda rows: np.array([[(middle.centred(rows) ** 2).sum()]]), (1, 1))[0, 0]) / middle.count
    values, directions = leading_pairs(covariance(fit, middle), dimensions, min(components, middle.count - 1))
    real = values > FLAT * values.max(initial=0)
    values, directions = values[real], directions[:, real]
    found = Whitening(middle, values, directions, trace, 0.0)
    size = len(values)

    def squares(rows: np.ndarray) -> np.ndarray:
        turned = found.whitened(rows)
        return np.vstack([turned.T @ turned, turned.sum(axis=0)[None]])

    sums = summed(fit, squares, (size + 1, size)) / middle.count
    off = sums[:size] - np.outer(sums[size], sums[size]) - np.eye(size)
    return Whitening(middle, values, directions, trace, float(np.abs(off).max()))


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = 16) -> DataFrame:
    """One row for each vector that takes part and each component.

    vec_id, component, n, deviation, whitened, explained, identity_error.
    """
    every = coded(rows)
    lengths = every.groupBy(F.size("x").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    every = every.filter(F.size("x") == (usual["length"] if usual else 0))
    id_type = every.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {OUTPUT}"
    model = fit_whitening(every, components) if usual else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    size = len(model.values)
    shares = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch) if batch.num_rows else np.zeros((0, len(model.middle.sums)), np.int64)
            each = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.middle.count)),
                    pa.array(model.middle.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                ["vec_id", *(field.split()[0] for field in OUTPUT.split(", "))],
            )

    return every.mapInArrow(project, schema)
