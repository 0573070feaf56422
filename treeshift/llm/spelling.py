"""Spelling variants of words by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced code point have letter
counts at a squared distance of one or two, and lengths that differ by at most
one. So words are dealt to blocks by their length and by how many of their letters
fall into each of a few groups of letters; one edit moves a word to the same block
or to one whose group counts differ by a single letter, and only such blocks meet.
Within two blocks all squared distances come from one NumPy product of the letter
counts, and pairs at most two apart are verified code point by code point.

A word is sent once to its own block and as a guest to the neighbours that it can
reach, so each pair of blocks meets in one place. Blocks of many words are cut
into parts of ``PART`` words that meet part by part. A task holds one part and
one batch of guests.

A word's form is its near word of largest count, if that is at least twice its
own; counts double along a chain of forms, so roots are found by a few rounds of
pointer doubling.

Defined cases: a null text has no words, a null id counts as empty text in the
hash, repeated rows count each. Other columns are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from treeshift.llm.common import chunks, staged, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by how even they divide among groups: dealt out in this order.
DEALT = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
LETTERS = len(DEALT)
#: Words of one part of a block.
PART = 2048
#: Bits of one group's letter count in a block's key. Longer counts wrap round;
#: words that share a key so are far apart, and the length is part of the block.
BITS = 10
MOST_GROUPS = 6
#: Bytes of words that are compared at a time.
CELLS = 1 << 22
#: Bytes of texts whose words are counted together.
TEXT_BYTES = 1 << 23

_COLUMN = np.full(256, -1, dtype=np.int64)
_COLUMN[[ord(c) for c in DEALT]] = np.arange(LETTERS)

OWN, EQUAL, LONGER = 0, 1, 2  # a block's own words, guests of the same length, guests one longer


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()

# lower-case Latin-1 code of every ASCII letter, 0 for what ends a run
_FOLD = np.zeros(256, dtype=np.uint8)
for _upper, _lower in zip(UPPER, LOWER):
    _FOLD[[ord(_upper), ord(_lower)]] = ord(_lower)


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point of UTF-8 that a run can hold, A-Z in lower case, and 0 for
    each other byte; and which bytes of ``data`` they stand for.

    The letters beyond ASCII are the two-byte characters that begin with 0xC3.
    """
    codes = _FOLD[data]
    pair = (data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80)
    codes[1:][pair] = data[1:][pair] + 0x40
    kept = np.append(~pair, True)
    return codes[kept], kept


def run_hashes(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of a seed's text followed by each run, all runs letter by letter in step."""
    order = np.argsort(-sizes, kind="stable")
    at, left = begins[order], sizes[order]
    state = ~seeds[order]
    step = lambda now, byte: _CRC[(now ^ byte) & 255] ^ (now >> 8)
    for k in range(int(left[0]) if len(left) else 0):
        alive = int(np.searchsorted(-left, -k, side="left"))  # runs of more than k letters
        letter = codes[at[:alive] + k].astype(np.uint32)
        now = state[:alive]
        wide = letter >= 0xC0
        if wide.any():
            now = np.where(wide, step(now, np.uint32(0xC3)), now)
            letter = np.where(wide, letter - 0x40, letter)
        state[:alive] = step(now, letter)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _counted(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Distinct runs with their counts, by length: those of up to 16 letters as one or two numbers."""
    for size in np.unique(sizes):
        at = begins[sizes == size]
        if size > 16:
            held = Counter(codes[i : i + size].tobytes() for i in at.tolist())
            yield [w.decode("latin-1") for w in held], np.fromiter(held.values(), np.int64, len(held))
            continue
        letters = np.zeros((len(at), 8 if size <= 8 else 16), dtype=np.uint8)
        letters[:, :size] = codes[at[:, None] + np.arange(size)]
        packed = letters.view(">u8").astype(np.uint64)
        if packed.shape[1] == 1:
            order = np.argsort(packed[:, 0])
        else:
            order = np.lexsort((packed[:, 1], packed[:, 0]))
        packed = packed[order]
        first = np.flatnonzero(np.append(True, (packed[1:] != packed[:-1]).any(axis=1)))
        joined = letters[order[first], :size].tobytes().decode("latin-1")
        yield [joined[i : i + size] for i in range(0, len(joined), size)], np.diff(np.append(first, len(at)))


def count_runs(ids: list[str], texts: list[bytes], shortest: int) -> Counter[str]:
    """Words of at least ``shortest`` letters in some texts, one in 97 with a letter left out."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    codes, kept = folded(data)
    starts = np.append(0, np.cumsum(kept))[starts]
    inside = np.concatenate([[False], codes != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    long = sizes >= shortest
    begins, sizes = begins[long], sizes[long]
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    hashes = run_hashes(codes, begins, sizes, seeds[np.searchsorted(starts, begins, side="right") - 1])
    cut = hashes % 97 == 0
    found: Counter[str] = Counter()
    for words, counts in _counted(codes, begins[~cut], sizes[~cut]):
        for word, count in zip(words, counts.tolist()):
            found[word] += count
    for begin, size, h in zip(begins[cut].tolist(), sizes[cut].tolist(), hashes[cut].tolist()):
        if size > shortest:
            word = codes[begin : begin + size].tobytes().decode("latin-1")
            found[word[: h % size] + word[h % size + 1 :]] += 1
    return found


def spoken(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """Words (word, n) of all texts with at least ``shortest`` letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("id").to_pylist()
            for start, end in chunks(texts, TEXT_BYTES):
                found = count_runs(ids[start:end], texts[start:end], shortest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "held"]
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(count, "word string, held long")
    return counted.groupBy("word").agg(F.sum("held").alias("n"))


def group_count(words: int) -> int:
    """More words, more groups: the blocks stay about as large."""
    return max(2, min(MOST_GROUPS, round(2 * math.log10(max(words, 1)) - 6)))


def blocked(vocabulary: DataFrame, groups: int) -> DataFrame:
    """(block, size, role, word, n): every word in its own block and as a guest in its neighbours."""
    held = [F.length("word") - F.length(F.translate("word", DEALT[g::groups], "")) for g in range(groups)]
    unit = [1 << (BITS * g) for g in range(groups)]
    space = (1 << (BITS * groups)) - 1

    def place(role: int, shift: int, reachable: Column, size: Column) -> Column:
        block = (F.col("own") + F.lit(shift)).bitwiseAND(F.lit(space))
        return F.when(reachable, F.struct(block.alias("block"), size.cast("int").alias("size"), F.lit(role).alias("role")))

    def has(g: int) -> Column:
        return F.col("held")[g] > 0

    size = F.length("word")
    places = [place(OWN, 0, F.lit(True), size)]
    # one letter less: the shorter word's block
    places += [place(LONGER, -unit[g], has(g), size - 1) for g in range(groups)]
    # a letter of one group for a letter of a later one
    places += [
        place(EQUAL, unit[i] - unit[j], has(j), size) for i in range(groups) for j in range(i + 1, groups)
    ]
    own = sum((F.pmod(h, F.lit(1 << BITS)).cast("long") * u for h, u in zip(held[1:], unit[1:])), F.pmod(held[0], F.lit(1 << BITS)).cast("long"))
    placed = vocabulary.select("word", "n", F.array(*held).alias("held"), own.alias("own"))
    return placed.select(F.explode(F.array_compact(F.array(*places))).alias("at"), "word", "n").select("at.*", "word", "n")


def in_parts(rows: DataFrame) -> DataFrame:
    """Adds ``part``: blocks above ``PART`` words are cut, their guests go to every part.

    A word of part p is a guest of the same block in all parts before p.
    """
    parts = (
        rows.filter(F.col("role") == OWN)
        .groupBy("block", "size")
        .agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    )
    # a block without words of its own has nothing to compare, so guests of it go
    dealt = rows.join(parts, ["block", "size"])
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    to = F.when(F.col("role") == OWN, F.sequence(F.lit(0), mine)).otherwise(all_parts)
    spread = dealt.select("block", "size", "role", "word", "n", mine.alias("mine"), F.explode(to).alias("part"))
    role = F.when((F.col("role") == OWN) & (F.col("part") < F.col("mine")), EQUAL).otherwise(F.col("role"))
    return spread.select("block", "size", "part", role.cast("int").alias("role"), "word", "n")


class Words:
    """Some words of one length as bytes, with their letter counts.

    All letters are Latin-1, so a code point is a byte.
    """

    def __init__(self, letters: np.ndarray, counts: np.ndarray, index: np.ndarray):
        self.letters, self.counts, self.index = letters, counts, index

    def __len__(self) -> int:
        return len(self.index)

    @staticmethod
    def of(data: np.ndarray, begins: np.ndarray, length: int, index: np.ndarray) -> "Words":
        letters = data[begins[:, None] + np.arange(length)]
        flat = _COLUMN[letters] + np.arange(len(letters))[:, None] * LETTERS
        counts = np.bincount(flat.ravel(), minlength=len(letters) * LETTERS)
        return Words(letters, counts.reshape(len(letters), LETTERS).astype(np.float32), index)

    def with_more(self, other: "Words") -> "Words":
        return Words(
            np.vstack([self.letters, other.letters]),
            np.vstack([self.counts, other.counts]),
            np.concatenate([self.index, other.index]),
        )


def candidates(left: Words, right: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose letter counts are at a squared distance of two at most."""
    gram = left.counts @ right.counts.T
    # counts are small whole numbers, exact in float32 for words below thousands of letters
    gram *= -2
    gram += (left.counts**2).sum(axis=1)[:, None]
    gram += (right.counts**2).sum(axis=1)
    slack = max(2.0, 1e-6 * float(left.letters.shape[1]) ** 2)  # rounding of very long words only adds candidates
    return np.nonzero(gram <= slack)


def verified(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; ``right`` is as long as ``left`` or one longer."""
    out = np.zeros(len(i), dtype=bool)
    size = left.letters.shape[1]
    step = max(1, CELLS // size)
    for start in range(0, len(i), step):
        a, b = left.letters[i[start : start + step]], right.letters[j[start : start + step]]
        if b.shape[1] == size:
            out[start : start + step] = (a != b).sum(axis=1) == 1
        else:
            front = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
            back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[start : start + step] = front + back >= size
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each near pair of sorted (block, size, part, role, word, n)."""
    key, own = None, None
    texts: list[pa.Array] = []  # of the part in hand
    counts: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        held_n = batch.column("n").to_numpy()
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        _, bounds, content = words.buffers()
        bounds = np.frombuffer(bounds, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        data, _ = folded(np.frombuffer(content, dtype=np.uint8)[bounds[0] : bounds[-1]])
        columns = [batch.column(c).to_numpy() for c in ("block", "size", "part", "role")]
        role = columns[3]
        moved = np.ones(batch.num_rows + 1, dtype=bool)
        moved[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
        moved[-1] = False  # the next batch may go on with the last part
        last = moved[1:]  # of its part
        change = moved[:-1] | np.append(True, role[1:] != role[:-1])
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        found: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []

        def pairs(left: Words, right: Words, inside: bool) -> None:
            for first in range(0, len(right), PART):
                piece = Words(*(x[first : first + PART] for x in (right.letters, right.counts, right.index)))
                i, j = candidates(left, piece)
                if inside:
                    later = left.index[i] < piece.index[j]
                    i, j = i[later], j[later]
                if len(i):
                    near = verified(left, piece, i, j)
                    if near.any():
                        hits.append((left.index[i[near]], piece.index[j[near]]))

        for start, end in zip(edges, edges[1:]):
            now = tuple(int(c[start]) for c in columns[:3])
            if now != key:
                key, own, texts, counts = now, None, [], []
            if role[start] != OWN and own is None:
                continue
            if end - start == 1 and own is None and last[start]:
                continue
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            rows = Words.of(data, begins[start:end], int(lengths[start]), np.arange(end - start))
            if role[start] == OWN:
                base = sum(map(len, texts))
                rows.index = rows.index + base
                texts.append(words.slice(start, end - start))
                counts.append(held_n[start:end])
                if own is not None:
                    pairs(own, rows, False)
                pairs(rows, rows, True)
                own = rows if own is None else own.with_more(rows)
                other_texts, other_n, shift = None, None, 0
            else:
                pairs(own, rows, False)
                other_texts, other_n = words.slice(start, end - start), held_n[start:end]
            if hits:
                a, b = (np.concatenate(x) for x in zip(*hits))
                own_texts, own_n = pa.concat_arrays(texts), np.concatenate(counts)
                if other_texts is None:
                    other_texts, other_n = own_texts, own_n
                found.append((own_texts.take(pa.array(a)), other_texts.take(pa.array(b)), own_n[a], other_n[b]))
        if found:
            left, right = (pa.concat_arrays([f[k] for f in found]) for k in (0, 1))
            left_n, right_n = (np.concatenate([f[k] for f in found]) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.array(np.concatenate([right_n, left_n]))],
                ["word", "near", "near_n"],
            )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs one edit apart; ``vocabulary`` has distinct words."""
    rows = in_parts(blocked(vocabulary, group_count(vocabulary.count())))
    dealt = rows.repartition("block", "size", "part").sortWithinPartitions("block", "size", "part", "role")
    return dealt.mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by pointer doubling.

    Counts at least double from a word to its form, so chains are short and end.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = staged(
            links.join(onward, "root", "left").select(
                "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """One row for each word of ``shortest`` code points that occurs ``least`` times.

    word, form, root, n, n_near, form_n.
    """
    kept = spoken(docs, shortest).filter(F.col("n") >= least)
    vocabulary = staged(kept, "spelling-words")
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))
    facts = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    joined = vocabulary.join(facts, "word", "left")
    strong = -F.col("best.less") >= 2 * F.col("n")
    formed = staged(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, F.col("best.word")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
