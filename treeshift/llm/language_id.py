"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: byte 2- to 4-grams of
each word with a mark at either end, hashed into a fixed number of buckets.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on a sample of labelled rows that is bounded for each language. A second
part of the sample sets the temperature of the softmax, which makes its output a
probability, and bounds the share of rightly predicted rows that are rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
is rejected. A text whose words are all shorter than two bytes has no subword
and gets the bias of the model. Without any labelled row nothing can be learned:
all rows are ``und``; more than ``MAX_LANGUAGES`` labels are an error. Rows may
repeat and ids may be null; other columns are not looked at, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from treeshift.llm.common import chunks, doc_hash, text_bytes

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
#: A classifier has few classes; a column with more labels is not a language.
MAX_LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")

# letters in lower case stay, as do all bytes beyond ASCII; the rest ends a word
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def subwords(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket of every subword, and where each text's subwords begin."""
    joined = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inside = (joined != 32).astype(np.uint8)
    codes = joined.astype(np.uint32)
    for n in ORDERS:
        width = len(joined) - n + 1
        if width <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
            continue
        hashed = np.full(width, n, dtype=np.uint32)
        for k in range(n):
            hashed = (hashed ^ codes[k : k + width]) * np.uint32(0x01000193)
        hashed ^= hashed >> np.uint32(15)
        # marks may stand at either end only, and a subword is more than marks
        ok = inside[1 : 1 + width].copy() if n > 2 else (inside[:width] | inside[1 : 1 + width])
        for k in range(2, n - 1):
            ok &= inside[k : k + width]
        at = np.flatnonzero(ok)
        yield hashed[at] & np.uint32(BUCKETS - 1), np.searchsorted(at, starts)


@dataclass
class Model:
    """``weights``: for each bucket its embedding times the softmax matrix."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for buckets, bounds in subwords(texts):
            held = np.diff(bounds)
            some = held > 0
            if some.any():
                total[some] += np.add.reduceat(self.weights[buckets], bounds[:-1][some], axis=0, dtype=np.float64)
                count += held
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text with their share of its subwords."""
    for batch in batches:
        texts, buckets, shares = text_bytes(batch.column("text")), [], []
        for text in texts:
            found = np.concatenate([b for b, _ in subwords([text])])
            held, counts = np.unique(found, return_counts=True)
            buckets.append(held.astype(np.int32))
            shares.append((counts / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("rank"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            ["lang", "rank", "buckets", "shares"],
        )


def _sample(labelled: DataFrame, languages: dict[str, int], per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, by hash of their id."""
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    rate = F.create_map(*[F.lit(x) for lang, n in languages.items() for x in (lang, min(1.0, 1.5 * per_language / n))])
    first = Window.partitionBy("lang").orderBy("drawn", "doc_id")
    return (
        labelled.withColumn("drawn", drawn)
        .filter(F.col("drawn") < rate[F.col("lang")] * (1 << 30))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= per_language)
        .select("lang", "rank", "text")
    )


def train(
    labelled: DataFrame,
    per_language: int = 400,
    dimensions: int = 16,
    epochs: int = 6,
    rate: float = 0.5,
    spared: float = 0.01,
    floor: float = 0.5,
    seed: int = 7,
) -> Model | None:
    """Fit on rows (doc_id, text, lang); None if no row has a label.

    The fit sees at most ``per_language`` rows of a language. Every fourth row
    of the sample is kept for calibration. A text is rejected below ``floor``,
    a calibrated probability, but never so that more than ``spared`` of the
    calibration rows that are predicted right would go: wrong labels lower all
    probabilities, and must not cost the rows that are fine.
    """
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: lang is not a language")
    if not counts:
        return None
    languages = {row["lang"]: row["count"] for row in sorted(counts, key=lambda r: r["lang"].encode())}
    names = list(languages)
    schema = "lang string, rank int, buckets array<int>, shares array<float>"
    # bounded: per_language rows a language, at most BUCKETS entries a row
    rows = _sample(labelled, languages, per_language).mapInArrow(_bags, schema).collect()
    rows.sort(key=lambda r: (r["rank"], r["lang"].encode()))
    examples = [(names.index(r["lang"]), np.array(r["buckets"], np.int64), np.array(r["shares"], np.float32)) for r in rows]
    # by rank within the language, so that both parts have all languages
    fit = [e for r, e in zip(rows, examples) if r["rank"] % 4]
    held = [e for r, e in zip(rows, examples) if r["rank"] % 4 == 0] or fit
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, dimensions)).astype(np.float32) / dimensions
    matrix = rng.normal(0, 0.1, (dimensions, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            answer, buckets, shares = fit[i]
            speed, step = rate * (1 - step / steps), step + 1
            mean = shares @ table[buckets]
            wrong = softmax(mean @ matrix + bias)
            wrong[answer] -= 1
            back = matrix @ wrong
            matrix -= speed * np.outer(mean, wrong)
            bias -= speed * wrong
            # a text's buckets are distinct, so this adds each gradient once; the
            # root keeps steps alike for short and long texts
            table[buckets] -= (speed * np.sqrt(len(buckets)) * shares)[:, None] * back
    weights = table @ matrix
    logits = np.array([s @ weights[b] + bias for _, b, s in held])
    answers = np.array([a for a, _, _ in held])
    temperature = _temperature(logits, answers)
    threshold = _threshold(softmax(logits / temperature), answers, floor, spared)
    return Model(names, weights, bias, temperature, threshold)


def _temperature(logits: np.ndarray, answers: np.ndarray) -> float:
    """The temperature under which the calibration rows are likeliest."""
    grid = np.geomspace(0.05, 20, 121)
    pick = np.arange(len(answers))
    loss = [-np.log(softmax(logits / t)[pick, answers] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _threshold(p: np.ndarray, answers: np.ndarray, floor: float, spared: float) -> float:
    """``floor``, or less where it would reject more than ``spared`` of the rows that are right."""
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == answers])
    return min(floor, float(right[int(spared * len(right))])) if len(right) else floor


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (with text) plus __lang, __score and __accepted."""
    if model is None:
        nothing = {"__lang": F.lit("und"), "__score": F.lit(0.0), "__accepted": F.lit(False)}
        return docs.withColumns(nothing)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS times languages
    names = np.array([*model.languages, "und"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            best = np.full(len(texts), len(names) - 1)
            score = np.zeros(len(texts))
            for start, end in chunks(texts):
                p = own.probabilities(texts[start:end])
                best[start:end], score[start:end] = p.argmax(axis=1), p.max(axis=1)
            empty = np.array([_LETTER.search(t.decode("utf-8", "replace")) is None for t in texts], dtype=bool)
            best[empty], score[empty] = len(names) - 1, 0.0
            accepted = ~empty & (score >= own.threshold)
            added = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, "__lang", "__score", "__accepted"]
            )

    plain = docs.drop("__lang", "__score", "__accepted")
    added = (("__lang", T.StringType()), ("__score", T.DoubleType()), ("__accepted", T.BooleanType()))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(*f) for f in added)])
    return plain.mapInArrow(classify, schema)


def held_out() -> Column:
    return doc_hash("doc_id", 4) == 2


def learn(docs: DataFrame, **options) -> Model | None:
    """The model of a table: from its labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())
    return train(rows, **options)


def languages(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, accepted."""
    scored = predict(docs.select("doc_id", "text"), learn(docs, **options))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__accepted").alias("accepted"),
    )


def accepted_only(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose language the model rejects; all columns stay as they are."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return predict(packed, learn(docs, **options)).filter("__accepted").select("row.*")
