"""Language-model scores from a subword lattice, next to a smoothed word model.

The pieces of an existing public vocabulary are the unigrams. Each piece's score
is its smoothed share in that vocabulary's own segmentation of the training
words, counted over the whole corpus. A word's probability is the sum over all
its segmentations into pieces, by a forward recursion in log space; no piece
crosses white space, so the marginal probability of a document is the product
over its words and one end token, and every distinct word is worked out once.

The ``HOT_WORDS`` most frequent words, a fixed number, are broadcast and looked
up while a document is read. The rest, each of them rare, are joined by word.

Defined cases: a null text counts as empty: one token, the end. Words are UTF-8
between ASCII white space, A-Z in lower case. Characters outside the vocabulary
are spelled by its byte pieces. Rows may repeat and ids may be null; other
columns are not looked at. Without training documents all counts are 0: base
scores then are log10(0.1 / 0.1) = 0 for V = 0. An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from treeshift.llm.common import doc_hash, staged, text_bytes

#: At most this many words with their scores are sent to every executor (a few MB).
HOT_WORDS = 200_000
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 150_000
ADDED = 0.1
START = "▁"


def words_of(text: bytes) -> list[bytes]:
    """Bytes split at ASCII white space, and only A-Z are put in lower case."""
    return text.lower().split()


def held_out() -> Column:
    return doc_hash("doc_id", 10) == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each word, in training documents and in all."""
    trained, every = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        found = list(every)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.binary()).cast(pa.string()),
                pa.array([trained[w] for w in found], pa.int64()),
                pa.array(list(every.values()), pa.int64()),
            ],
            ["word", "trained", "found"],
        )
        trained.clear()
        every.clear()
        return out

    for batch in batches:
        for text, held in zip(text_bytes(batch.column("text")), batch.column("held_out").to_pylist()):
            words = words_of(text)
            every.update(words)
            if not held:
                trained.update(words)
            if len(every) > HELD_WORDS:
                yield flush()
    if every:
        yield flush()


class Vocabulary:
    """Pieces of a public vocabulary and its own segmentation of a word."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        self.special = {i for i in range(size) if self.processor.is_control(i) or self.processor.is_unknown(i)}
        self.pieces = [self.processor.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.processor.is_byte(i)}
        self.plain = {
            p: i for i, p in enumerate(self.pieces) if i not in self.special and not self.processor.is_byte(i)
        }

    def segment(self, words: list[str]) -> list[list[int]]:
        return self.processor.encode(words, num_threads=1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        counts = np.zeros(len(own.pieces), np.int64)
        for batch in batches:
            weights = np.array(batch.column("trained").to_pylist(), np.int64)
            found = own.segment(batch.column("word").to_pylist())
            flat = np.fromiter((i for ids in found for i in ids), np.int64)
            each = np.repeat(weights, [len(ids) for ids in found])
            np.add.at(counts, flat, each)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "count"])

    return run


class Lattice:
    """log10 probability of words, summed over all segmentations.

    ``scores`` are natural logarithms by piece id; they and the end token's sum
    up to probability 1.
    """

    def __init__(self, own: Vocabulary, scores: np.ndarray):
        # a prefix that is no piece itself is kept as None: beyond it nothing follows
        self.score: dict[str, float | None] = {}
        for piece, i in own.plain.items():
            self.score[piece] = float(scores[i])
        for piece in list(self.score):
            for end in range(1, len(piece)):
                self.score.setdefault(piece[:end], None)
        self.byte = {b: float(scores[i]) for b, i in own.bytes.items()}

    def log10(self, word: str) -> float:
        text, score = START + word, self.score
        size = len(text)
        arriving: list[list[float]] = [[] for _ in range(size + 1)]
        arriving[0].append(0.0)
        for i in range(size):
            # log-space forward step: all ways to reach i, then each piece from there
            ways = arriving[i]
            if not ways:
                continue
            if len(ways) == 1:
                here = ways[0]
            else:
                most = max(ways)
                here = most + math.log(sum([math.exp(w - most) for w in ways]))
            arriving[i] = []
            for j in range(i + 1, size + 1):
                piece = text[i:j]
                if piece not in score:
                    break
                value = score[piece]
                if value is not None:
                    arriving[j].append(here + value)
            if score.get(text[i]) is None:
                spelled = sum(self.byte[b] for b in text[i].encode())
                arriving[i + 1].append(here + spelled)
        ways = arriving[size]
        most = max(ways)
        return (most + math.log(sum(math.exp(w - most) for w in ways))) / math.log(10)


def _score_words(path: str, scores, tokens: int, distinct: int):
    low = tokens + ADDED * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), scores.value)
        for batch in batches:
            counts = batch.column("trained").to_numpy(zero_copy_only=False)
            marginal = [lattice.log10(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    batch.column("found"),
                    pa.array(counts > 0),
                    pa.array(np.log10((counts + ADDED) / low)),
                    pa.array(marginal, pa.float64()),
                ],
                ["word", "found", "known", "base", "marginal"],
            )

    return run


def _score_documents(hot, end_known: bool, end_base: float, end_score: float):
    """Sums over the hot words of a document, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column("text")):
                words = words_of(text)
                known, base, score, rare, times = int(end_known), end_base, end_score, [], []
                for word, n in Counter(words).items():
                    entry = table.get(word)
                    if entry is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        known += n * entry[0]
                        base += n * entry[1]
                        score += n * entry[2]
                rows.append((len(words) + 1, known, base, score, rare, times))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    *(pa.array(c, t) for c, t in zip(columns[:4], [pa.int64()] * 2 + [pa.float64()] * 2)),
                    pa.array(columns[4], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array(columns[5], pa.list_(pa.int32())),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

    return run


def _hot_from(table: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, to about one part in eight.

    From a histogram of counts with a few hundred classes, so no task sees more
    than its own words.
    """
    step = F.floor(F.log2("found") * 8).cast("int")
    classes = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("least")).collect()
    reached, least = 0, 1 << 62
    for row in sorted(classes, key=lambda r: -r["step"]):
        reached += row["n"]
        if reached > most:
            break
        least = row["least"]
    return least


def lm_scores(docs: DataFrame, vocabulary_file: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    path = vocabulary_file or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(_count_words, "word string, trained long, found long")
    words = staged(counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("found").alias("found")), "words")
    ends = rows.filter(~F.col("held_out")).count()
    totals = words.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    tokens, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)

    pieces = words.filter("trained > 0").select("word", "trained").mapInArrow(_count_pieces(path), "piece long, count long")
    counts = np.full(len(vocabulary(path).pieces), ADDED)
    counts[list(vocabulary(path).special)] = 0
    for row in pieces.groupBy("piece").agg(F.sum("count").alias("count")).collect():  # one row a piece at most
        if row["piece"] not in vocabulary(path).special:
            counts[row["piece"]] += row["count"]
    total = counts.sum() + ends + ADDED
    with np.errstate(divide="ignore"):
        scores = context.broadcast(np.log(counts / total))

    schema = "word string, found long, known boolean, base double, marginal double"
    # lattices cost far more than their bytes suggest, so they are dealt out evenly
    spread = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = staged(spread.mapInArrow(_score_words(path, scores, tokens, distinct), schema), "word-scores")
    hot = table.filter(F.col("found") >= _hot_from(table, hot_words)).drop("found").toArrow()
    looked_up = dict(
        zip(
            hot["word"].cast(pa.binary()).to_pylist(),
            zip(hot["known"].to_pylist(), hot["base"].to_pylist(), hot["marginal"].to_pylist()),
        )
    )
    low = tokens + ADDED * (distinct + 1)
    step = _score_documents(
        context.broadcast(looked_up), ends > 0, math.log10((ends + ADDED) / low), math.log10((ends + ADDED) / total)
    )
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<string>, times array<int>"
    )
    scored = staged(
        rows.mapInArrow(step, schema).withColumn("row", F.monotonically_increasing_id()), "document-scores"
    )
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
        .join(table, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.col("base")).alias("rare_base"),
            F.sum(F.col("times") * F.col("marginal")).alias("rare_score"),
        )
    )

    def with_rare(own: str, other: str) -> Column:
        return (F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own)

    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        with_rare("n_known", "rare_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        with_rare("base_score", "rare_base"),
        with_rare("score", "rare_score"),
    )
