"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of its features; the chance that one
document is preferred to another is the logistic function of the difference of
their strengths. Preference pairs join a labelled document of quality 1 with one
of quality 0. The weights are learned by logistic loss on feature differences. A
threshold is the quantile of the strengths at which as large a share of labelled
documents lies below as has quality 0; a slope that makes the distance to it a
probability comes from rows that the weights have not seen.

Features of a whole text are its byte 1- to 3-grams, hashed into a fixed number of
buckets and scaled to unit length, and a few shares: of capitals, digits,
punctuation, white space, letters beyond ASCII, repeated bytes, distinct words
and distinct lines, with the length of words, lines and text on a log scale.

Defined cases: a null text counts as empty, and an empty text has a score like any
other. A document with several labels counts with each; a null label or a label
without document teaches nothing. Without labels of both kinds there are no
pairs: the score is the share of quality 1, or 0.5 without any label. Rows may
repeat and ids may be null (a null id has no label); other columns are not looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from treeshift.llm.common import chunks, doc_hash, text_bytes
from treeshift.session import cut

BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
SHARES = 12
#: Bytes whose n-grams are counted at a time, and texts whose features are held at a time.
PIECE = 1 << 20
ROWS = 64
#: Weights and strengths are whole numbers of parts while they are added up.
UNIT = 1 << 32
#: Rows of the rarer label that a shard has at least, bins of one round, and partitions for shards.
LEAST, BINS, MOST_PARTS = 64, 4096, 4096

_KIND = np.zeros(256, dtype=np.uint8)  # 0 control, 1 white space, 2 punctuation, 3 digit, 4 capital, 5 small, 6 beyond ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[33:127] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[ord("a") : ord("z") + 1] = 5
_KIND[128:] = 6


def _distinct(text: bytes, separator: bytes | None) -> tuple[int, int]:
    parts = [p for p in text.split(separator) if p]
    return len(set(parts)), len(parts)


def shares(texts: list[bytes]) -> np.ndarray:
    """The plain features, one row for each text; all zero for an empty one."""
    out = np.zeros((len(texts), SHARES), dtype=np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(text, dtype=np.uint8)
        size = len(data)
        out[row, :6] = np.bincount(_KIND[data], minlength=7)[1:] / size
        words, all_words = _distinct(text, None)
        lines, all_lines = _distinct(text, b"\n")
        out[row, 6:] = (
            (data[1:] == data[:-1]).sum() / size,
            words / max(1, all_words),
            lines / max(1, all_lines),
            np.log1p(size / max(1, all_words)) / 4,
            np.log1p(size / max(1, all_lines)) / 8,
            np.log1p(size) / 16,
        )
    return out


def _add_grams(out: np.ndarray, parts: list[tuple[int, bytes]], n: int) -> None:
    """Count the n-grams of each part in its row of ``out``."""
    joined = np.frombuffer(b"".join(p for _, p in parts), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(p) for _, p in parts])
    width = len(joined) - n + 1
    hashed = np.full(width, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        hashed = (hashed ^ joined[k : k + width]) * np.uint32(0x01000193)
    hashed ^= hashed >> np.uint32(15)
    left = np.repeat(np.cumsum(sizes), sizes)[:width] - np.arange(width)  # bytes from here to the part's end
    row = np.repeat([r for r, _ in parts], sizes)[:width]
    at = np.flatnonzero(left >= n)
    cells = row[at] * BUCKETS + (hashed[at] & np.uint32(BUCKETS - 1))
    out += np.bincount(cells, minlength=out.size).reshape(out.shape)


def features(texts: list[bytes]) -> np.ndarray:
    """One dense row for each text: roots of the share of each bucket, then the plain features.

    Long texts are read in pieces that overlap by less than an n-gram.
    """
    out = np.zeros((len(texts), BUCKETS))
    for n in ORDERS:
        parts = [
            (row, text[i : i + PIECE + n - 1])
            for row, text in enumerate(texts)
            for i in range(0, len(text) - n + 1, PIECE)
        ]
        for start, end in chunks([p for _, p in parts], PIECE):
            _add_grams(out, parts[start:end], n)
    shared = np.sqrt(out / np.maximum(out.sum(axis=1), 1)[:, None])
    return np.hstack([shared.astype(np.float32), shares(texts)])


@dataclass
class Ranking:
    weights: np.ndarray | None  # None if there were no pairs
    threshold: float
    slope: float
    prior: float  # share of quality 1

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        strength = np.concatenate([features(texts[i : i + ROWS]) @ self.weights for i in range(0, len(texts), ROWS)])
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.threshold), -30, 30)))


def _pairs(good: int, bad: int, rivals: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Each document of either kind against ``rivals`` of the other."""
    left = np.concatenate([np.repeat(np.arange(good), rivals), rng.integers(0, good, bad * rivals)])
    right = np.concatenate([rng.integers(0, bad, good * rivals), np.repeat(np.arange(bad), rivals)])
    order = rng.permutation(len(left))
    return left[order], right[order]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_weights(
    good: np.ndarray, bad: np.ndarray, rivals: int, epochs: int, rate: float, decay: float, rng: np.random.Generator
) -> np.ndarray:
    """Bradley-Terry weights by AdaGrad over batches of pairs."""
    weights = np.zeros(good.shape[1], dtype=np.float64)
    seen = np.full(good.shape[1], 1e-8)
    for _ in range(epochs):
        left, right = _pairs(len(good), len(bad), rivals, rng)
        for i in range(0, len(left), 256):
            gap = (good[left[i : i + 256]] - bad[right[i : i + 256]]).astype(np.float64)
            wrong = _logistic(gap @ weights) - 1  # of the preferred winning
            slope = gap.T @ wrong / len(gap) + decay * weights
            seen += slope**2
            weights -= rate * slope / np.sqrt(seen)
    return weights


def _fitted(rivals: int, epochs: int, rate: float, decay: float, seed: int):
    """The weights of each shard of rows (shard, quality, text) sorted by shard, as (index, weight) in parts of ``UNIT``."""

    def weights(shard: int, rows: list[np.ndarray], answers: list[int]) -> pa.RecordBatch:
        table, kinds = np.concatenate(rows), np.array(answers)
        rng = np.random.default_rng([seed, shard])
        found = fit_weights(table[kinds == 1], table[kinds == 0], rivals, epochs, rate, decay, rng)
        whole = np.rint(found * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole)], ["index", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, answers = None, [], []
        for batch in batches:
            texts, shards, kinds = text_bytes(batch.column("text")), batch.column("shard").to_pylist(), batch.column("quality").to_pylist()
            start = 0
            while start < len(texts):
                end = start + 1
                while end < len(texts) and end - start < ROWS and shards[end] == shards[start]:
                    end += 1
                if shards[start] != at and rows:
                    yield weights(at, rows, answers)
                    rows, answers = [], []
                at = shards[start]
                rows.append(features(texts[start:end]))
                answers += kinds[start:end]
                start = end
        if rows:
            yield weights(at, rows, answers)

    return run


def _strengths(weights: np.ndarray):
    """(quality, strength) of rows (quality, text), strengths in parts of ``UNIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i in range(0, len(texts), ROWS):
                found = np.rint(features(texts[i : i + ROWS]) @ weights * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, ROWS), pa.array(found)], ["quality", "strength"])

    return run


def _threshold(judged: DataFrame, weight: dict[int, float], share: float) -> float:
    """Midway from the first strength at which ``share`` of the weight is reached to the next one.

    Counts of all rows in ever finer bins; no round collects more than two counts a bin.
    """
    low, high = judged.agg(F.min("strength"), F.max("strength")).first()
    below = 0.0
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bin_of = F.floor((F.col("strength") - low) / F.lit(width)) if width > 1 else F.col("strength") - low
        counted = judged.filter(F.col("strength").between(low, high)).groupBy(bin_of.alias("bin"), "quality").count().collect()
        held = [0.0] * BINS
        for r in counted:
            held[r["bin"]] += r["count"] * weight[r["quality"]]
        last = max(r["bin"] for r in counted)
        at = 0
        while at < last and below + held[at] < share - 1e-12:
            below += held[at]
            at += 1
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    after = judged.filter(F.col("strength") > low).agg(F.min("strength")).first()[0]
    return (low + (low if after is None else after)) / 2 / UNIT


def _slope(judged: DataFrame, weight: dict[int, float], threshold: float) -> float:
    """The slope under which the answers of all rows are likeliest, about the threshold."""
    grid = np.geomspace(0.05, 50, 121)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for batch in batches:
            answers = batch.column("quality").to_numpy()
            gap = batch.column("strength").to_numpy() / UNIT - threshold
            own = np.where(answers == 1, weight[1], weight[0])
            for i, g in enumerate(grid):
                p = _logistic(gap * g)
                total[i] -= (own * np.log(np.where(answers == 1, p, 1 - p) + 1e-9)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], ["index", "loss"])

    found = judged.mapInArrow(losses, "index int, loss double").groupBy("index").agg(F.sum("loss").alias("loss")).collect()
    return float(grid[min(found, key=lambda r: (round(r["loss"], 9), r["index"]))["index"]]) if found else 1.0


def train(
    docs: DataFrame,
    known: DataFrame,
    shard_rows: int = 1500,
    rivals: int = 8,
    epochs: int = 6,
    rate: float = 0.1,
    decay: float = 1e-4,
    seed: int = 3,
) -> Ranking:
    """Fit on documents (doc_id, text) and their distinct labels (doc_id, quality 0 or 1).

    All labelled rows take part; equal ones (id, text and label) count once. Three in
    four are dealt by hash to shards of about ``shard_rows`` rows of the more frequent
    label; the weights are the mean of the shards' weights. Rows of the rarer label are
    dealt to several shards where needed, so that each has ``LEAST`` of them or all.
    The others give the threshold and the slope.
    """
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return Ranking(None, 0.0, 1.0, 0.5)
    prior = counts.get(1, 0) / sum(counts.values())
    if len(counts) < 2:
        return Ranking(None, 0.0, 1.0, prior)
    # the same plan at every size; texts move once to their labels, and the labelled ones once to their shard
    rows = cut(
        docs.join(known.hint("merge"), "doc_id")
        .dropDuplicates(["doc_id", "quality", "text"])
        .select(
            "quality",
            "text",
            (F.pmod(F.xxhash64("doc_id", F.lit("quality held")), F.lit(4)) == 0).alias("held"),
            F.xxhash64("doc_id", "text", F.lit("quality shard")).alias("drawn"),
        )
    )
    found = {(r["quality"], r["held"]): r["count"] for r in rows.groupBy("quality", "held").count().collect()}
    if len({q for q, _ in found}) < 2:
        return Ranking(None, 0.0, 1.0, prior)
    apart = len(found) == 4  # else all rows are for both
    fit, judged = (rows.filter("NOT held"), rows.filter("held")) if apart else (rows, rows)
    sizes = {q: found[q, False] if apart else found.get((q, False), 0) + found.get((q, True), 0) for q in (0, 1)}
    shards = -(-max(sizes.values()) // shard_rows)
    copies = {q: min(shards, -(-LEAST * shards // n)) for q, n in sizes.items()}
    dealt = F.when(F.col("quality") == 1, F.lit(copies[1])).otherwise(copies[0])
    first = F.pmod("drawn", F.lit(shards))
    shard = F.transform(
        F.sequence(F.lit(0), dealt - 1), lambda k: F.pmod(first + k * F.floor(F.lit(shards) / dealt), F.lit(shards)).cast("int")
    )
    sharded = (
        fit.select(F.explode(shard).alias("shard"), "quality", "drawn", "text")
        .repartition(min(shards, MOST_PARTS), "shard")
        .sortWithinPartitions("shard", "drawn", "quality", "text")
        .select("shard", "quality", "text")
    )
    # a row for each feature; whole numbers, so that sums do not depend on their order
    sums = (
        sharded.mapInArrow(_fitted(rivals, epochs, rate, decay, seed), "index int, weight bigint")
        .groupBy("index")
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
        .collect()
    )
    weights = np.zeros(BUCKETS + SHARES)
    for r in sums:
        weights[r["index"]] = r["weight"] / r["n"] / UNIT
    judged = cut(judged.select("quality", "text").mapInArrow(_strengths(weights), "quality int, strength bigint"))
    each = {q: found[q, True] if apart else sizes[q] for q in (0, 1)}
    # the shares of the labels are those of the table
    weight = {1: prior / each[1], 0: (1 - prior) / each[0]}
    threshold = _threshold(judged, weight, 1 - prior)
    return Ranking(weights, threshold, _slope(judged, weight, threshold), prior)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            scores = [shared.value.scores(texts[a:b]) for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(rank, f"doc_id {kind}, score double")


def held_out() -> Column:
    return doc_hash("doc_id", 3) == 1


def learn(docs: DataFrame, labels: DataFrame, **options) -> Ranking:
    """The model of a table: from its labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~held_out())
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL").distinct()
    return train(docs.select("doc_id", "text").filter(~held_out()), known, **options)


def qualities(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels, **options)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
