"""Shared by the operators of this folder: written stages, skew-proof joins, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeshift.session import scratch

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts lineage like ``checkpoint()``, but columnar and compressed, so later
    readers load only the columns they use. It outlives lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unique(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each ``key``.

    ``facts.weight`` is the number of rows of the key. Fewer than ``share`` keys
    can hold more than 1/``share`` of all rows each, so those are broadcast and
    their rows stay where they are; all other keys are too small to be hot and
    meet by a shuffle. Both inputs are read twice: stage them if they are costly.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    limit = total // share
    hot = facts.filter(F.col(weight) > limit)
    cold = facts.filter(F.col(weight) <= limit)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def in_keys(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """The rows whose key is in ``facts``, which has one row for each key and its number of rows.

    As in ``join_unique``, the fewer than ``share`` keys that can be hot become a
    list, and rows of all others meet by a shuffle.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    limit = total // share
    hot = [r[key] for r in facts.filter(F.col(weight) > limit).select(key).collect()]
    near = rows.filter(F.col(key).isin(hot)) if hot else rows.limit(0)
    far = rows.filter(~F.col(key).isin(hot)) if hot else rows
    return near.unionByName(far.join(facts.filter(F.col(weight) <= limit).select(key), key, "left_semi"))


def spare_name(df: DataFrame, start: str = "__new") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{start}{k or ''}" for k in range(len(taken) + 1)) if n.lower() not in taken)


def doc_hash(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of successive texts with about ``size`` bytes together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of rows with equal ``key`` of an input sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        plain = keys.cast(pa.binary()).to_pylist() if pa.types.is_string(keys.type) else keys.to_pylist()
        edges = [i for i in range(1, len(plain)) if plain[i] != plain[i - 1]]
        start = 0
        if held and held[-1].column(key)[-1].as_py() != keys[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for edge in edges:
            held.append(batch.slice(start, edge - start))
            yield pa.Table.from_batches(held)
            held, start = [], edge
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def lists(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]
