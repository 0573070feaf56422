"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where the hash is larger
than at all ``AROUND`` places to either side. A cut so depends on the bytes near
it and on no other cut, and an insertion only moves the cuts next to it. Chunks
are deduplicated by digest. The first copy, in order of doc_id and
position, stays; of every other copy the text is to go. Neighbouring repeated
chunks of a document form one span. It is extended to either side as far as the
text equals that around the copy that stays (the first copy: around the last one),
as whole chunks do not reach the edges of a passage. Spans that are shorter than
``SPAN`` characters then are left alone: passages of fifty words are longer by
far, common phrases are not.

Defined cases: a null text counts as empty and has no chunk. The last chunk of a
text may be short. Rows without id are ordered first and are never linked to
other rows without id by that id. Rows that repeat an id are copies like any
others. Extra columns are carried by ``drop_repeated_spans``. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from treeshift.llm.common import chunks, join_unique, staged, text_bytes

#: Bytes to either side of a cut without another; chunks have twice as many on average.
AROUND = 24
#: Bytes after which a chunk is cut where the content gives no place.
MOST = 256
#: Characters a repeated span must have.
SPAN = 128
#: Characters compared in the first round of extending spans; where all are equal, the next round takes eight times as many.
REACH = 128

_GEAR = np.random.default_rng(99).integers(0, 1 << 32, 256, dtype=np.uint32)


def _largest(values: np.ndarray, width: int) -> np.ndarray:
    """The largest of each value and the ``width`` - 1 before it."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        out[step:] = np.maximum(out[step:], out[:-step])
        reach += step
    return out


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Places after which the content makes a cut.

    The gear hash h = 16 * h + gear[byte] modulo 2^32 depends on the last 8 bytes;
    it is built here for all places at once by doubling the window.
    """
    hashed = _GEAR[data]
    for width in (1, 2, 4):
        hashed[width:] += hashed[:-width] << np.uint32(4 * width)
    highest = _largest(np.concatenate([hashed, np.zeros(AROUND, np.uint32)]), AROUND)
    before = np.concatenate([[np.uint32(0)], highest[: len(hashed) - 1]])
    after = highest[AROUND:]
    return np.flatnonzero((hashed > before) & (hashed >= after)) + 1


def chunk_bounds(text: bytes) -> list[int]:
    """Byte offsets 0, ..., len(text) of the chunks; a cut inside a character moves behind it."""
    size = len(text)
    if not size:
        return [0]
    data = np.frombuffer(text, dtype=np.uint8)
    places = cut_candidates(data)
    for _ in range(3):
        places = places[places < size]
        places = places + ((data[places] & 0xC0) == 0x80)
    bounds, last = [0], 0
    for place in [*places[places < size].tolist(), size]:
        while place - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            bounds.append(last)
        if place > last:
            bounds.append(place)
            last = place
    return bounds


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = text_bytes(batch.column("text")), batch.column("row").to_numpy()
        ids = batch.column("doc_id")
        for first, last in chunks(texts):
            owner, start, length, digest = [], [], [], bytearray()
            for i in range(first, last):
                text, bounds = texts[i], chunk_bounds(texts[i])
                if len(bounds) < 2:
                    continue
                data = np.frombuffer(text, dtype=np.uint8)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                owner += [i] * (len(bounds) - 1)
                start.append(points[:-1])
                length.append(np.diff(points))
                for a, b in zip(bounds, bounds[1:]):
                    digest += hashlib.blake2b(text[a:b], digest_size=12).digest()
            at = np.array(owner, dtype=np.int64)
            marks = np.frombuffer(bytes(digest), dtype=[("digest", "<i8"), ("check", "<i4")])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[at]),
                    ids.take(pa.array(at)),
                    pa.array(np.concatenate(start or [at]), pa.int64()),
                    pa.array(np.concatenate(length or [at]), pa.int32()),
                    pa.array(np.ascontiguousarray(marks["digest"])),
                    pa.array(np.ascontiguousarray(marks["check"])),
                ],
                ["row", "doc_id", "start", "length", "digest", "check"],
            )


CHUNK = "row long, doc_id long, start long, length int, digest long, check int"


def repeated_chunks(numbered: DataFrame) -> DataFrame:
    """Chunks that occur again: row, doc_id, start, length, keep_id, first (is it the copy that stays) and other (place of the copy to compare with).

    ``numbered`` has row (unique), doc_id and text.
    """
    cut = staged(numbered.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(_chunk, CHUNK), "chunks")
    # a digest has 96 bits; rows meet by 64 of them, and the rest decides
    counts = cut.groupBy("digest", "check").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = staged(counts.withColumnRenamed("check", "same"), "repeated")
    rows = staged(join_unique(cut, again, "digest", "copies").filter("check = same").drop("same", "copies"), "repeated-rows")
    place = F.struct("doc_id", "row", "start")
    ends = rows.groupBy("digest", "check").agg(
        F.min(place).alias("kept"), F.max(place).alias("last"), F.count(F.lit(1)).alias("copies")
    )
    first = (F.col("row") == F.col("kept.row")) & (F.col("start") == F.col("kept.start"))
    placed = join_unique(rows, staged(ends.withColumnRenamed("check", "same"), "repeated-ends"), "digest", "copies")
    return placed.filter("check = same").select(
        "row",
        "doc_id",
        "start",
        "length",
        F.col("kept.doc_id").alias("keep_id"),
        first.alias("first"),
        F.when(first, F.col("last")).otherwise(F.col("kept")).alias("other"),
    )


def _gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters that the two texts of each row have in common at their beginning."""
    for batch in batches:
        gained = []
        for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
            least = min(len(one), len(two))
            gained.append(next((i for i in range(least) if one[i] != two[i]), least))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("row", "start", "left")), pa.array(gained, pa.int64())], ["row", "start", "left", "gained"]
        )


def _extended(spans: DataFrame, numbered: DataFrame) -> DataFrame:
    """``spans`` made longer on either side as far as the texts around both copies are equal."""

    def side(left: bool, own: str, other: str):
        return spans.select("row", "start", F.lit(left).alias("left"), F.col(own).alias("at"), F.col(f"{other}.row").alias("other"), F.col(f"{other}.at").alias("there"))

    asked = staged(side(True, "start", "head").unionByName(side(False, "end", "tail")), "asked")
    gains, reach = [], REACH
    while not asked.isEmpty():
        key = F.struct("row", "start", "left").alias("key")
        ends = asked.select(key, F.lit(True).alias("own"), F.col("row").alias("of"), "at").unionByName(
            asked.select(key, F.lit(False).alias("own"), F.col("other").alias("of"), F.col("there").alias("at"))
        )
        texts = numbered.select(F.col("row").alias("of"), F.coalesce("text", F.lit("")).alias("text"))
        from_ = F.when(F.col("key.left"), F.greatest(F.col("at") - reach, F.lit(0))).otherwise(F.col("at"))
        to = F.when(F.col("key.left"), F.col("at")).otherwise(F.col("at") + reach)
        near = F.substring("text", (from_ + 1).cast("int"), (to - from_).cast("int"))
        seen = ends.join(texts, "of").select("key", "own", F.when(F.col("key.left"), F.reverse(near)).otherwise(near).alias("near"))
        pairs = seen.groupBy("key").agg(F.max(F.when(F.col("own"), F.col("near"))).alias("one"), F.max(F.when(~F.col("own"), F.col("near"))).alias("two"))
        gained = staged(pairs.select("key.*", "one", "two").mapInArrow(_gained, "row long, start long, left boolean, gained long"), "gained")
        gains.append(gained)
        step = F.when(F.col("left"), -reach).otherwise(reach)
        again = asked.join(gained.filter(F.col("gained") == reach).drop("gained"), ["row", "start", "left"])
        asked = staged(again.withColumns({"at": F.col("at") + step, "there": F.col("there") + step}), "asked")
        reach = min(8 * reach, 1 << 28)
    if not gains:
        return spans
    every = functools.reduce(DataFrame.unionByName, gains).groupBy("row", "start").agg(
        F.sum(F.when(F.col("left"), F.col("gained"))).alias("before"), F.sum(F.when(~F.col("left"), F.col("gained"))).alias("after")
    )
    return spans.join(every, ["row", "start"]).withColumns({"start": F.col("start") - F.col("before"), "end": F.col("end") + F.col("after")}).drop("before", "after")


def _spans(repeated: DataFrame, numbered: DataFrame, least: int) -> DataFrame:
    """Neighbouring repeated chunks of a row as one span, extended; spans that meet then are one."""
    order = Window.partitionBy("row").orderBy("start")
    gap = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order) != F.col("start"), F.lit(True))
    found = (
        repeated.withColumn("_new", gap.cast("int"))
        .withColumn("_span", F.sum("_new").over(order))
        .groupBy("row", "_span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max(F.col("start") + F.col("length")).alias("end"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.count(F.when(~F.col("first"), 1)).alias("n_copies"),
            F.collect_set("keep_id").alias("keep_ids"),
            F.min_by(F.struct(F.col("other.row").alias("row"), F.col("other.start").alias("at")), "start").alias("head"),
            F.max_by(F.struct(F.col("other.row").alias("row"), (F.col("other.start") + F.col("length")).alias("at")), "start").alias("tail"),
        )
        .drop("_span")
    )
    longer = _extended(staged(found, "spans"), numbered)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True))
    return (
        longer.withColumn("_new", apart.cast("int"))
        .withColumn("_span", F.sum("_new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "_span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n_chunks").alias("n_chunks"),
            F.sum("n_copies").alias("n_copies"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("keep_ids")))).alias("keep_ids"),
        )
        .filter(F.col("end") - F.col("start") >= least)
        .drop("_span")
    )


def repeated_spans(docs: DataFrame, least: int = SPAN) -> DataFrame:
    """One row for each repeated span of a document, in code points.

    Returns doc_id, start, end, n_chunks, n_copies (chunks of which an earlier copy
    stays; 0 if the span is the first) and keep_ids (documents with the first copies).
    """
    numbered = staged(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _spans(repeated_chunks(numbered), numbered, least).drop("row")


def drop_repeated_spans(docs: DataFrame, least: int = SPAN) -> DataFrame:
    """``docs`` with every copy but the first of a repeated passage cut out of the texts."""
    numbered = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col("__row").alias("row"), "doc_id", "text")
    spans = _spans(repeated_chunks(texts).filter("NOT first"), texts, least)
    cuts = spans.groupBy(F.col("row").alias("__row")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    merged = F.aggregate(
        "__cuts",
        start,
        lambda a, s: F.struct(
            s["end"].alias("at"),
            F.concat(a["text"], F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))).alias("text"),
        ),
    )
    rest = F.concat(merged["text"], F.substring(F.col("text"), merged["at"].cast("int") + 1, F.char_length("text")))
    return (
        numbered.join(cuts, "__row", "left")
        .withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(rest))
        .select(docs.columns)
    )
