"""Harmonic packing of token pieces into sequences of fixed capacity.

Documents are cut into pieces. A piece belongs to the class of the largest k of
which k pieces of its length fit, and a sequence of class k holds exactly k
pieces, so each worker fills its sequences alone while it reads. A piece whose
class would leave more than ``WASTE`` of a sequence unused gives up its largest
part of length capacity // k and goes on with the rest, so padding stays small
for every mix of lengths.

What does not fill a sequence at a worker, fewer than k pieces of each class, is
handed on: ``FAN_IN`` workers' rests are packed by one worker in the same way,
again and again, until one is left. That one has fewer than k pieces of each
class and packs them largest first into whatever room there is.

Defined cases: a null or empty text is one token, the end token. Rows may repeat
or lack an id: each is packed by itself. Other columns are not looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from treeshift.llm.common import runs, staged

CAPACITY = 2048
END = 1
WASTE = 0.02
FAN_IN = 64
#: Parts of words whose ids a worker remembers, about 200 bytes each; when so many are
#: new, those that were not used meanwhile are forgotten.
REMEMBERED = 250_000
#: Bytes of text that are encoded together, or one text.
SLICE = 4 << 20

LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The tokenizer's own first split, for text that is all Latin-1, with a zero after each word.
LATIN_SPLIT = re.compile(
    f"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LETTERS}{NUMBERS}{BLANKS}\0]+"
    f"|[{BLANKS}]+(?![^{BLANKS}\0])|[{BLANKS}]+"
)
#: Words that only the tokenizer can split, as patterns of Arrow: beyond Latin-1, zeros, special tokens.
UNSPLIT = r"[^\x01-\x{ff}]|<\|"
#: Texts whose words do not begin at each space: white space before a space, zeros.
UNEVEN = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace()) + r"] |\x00"


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "class int, worker long"
)


class Memory:
    """Ids of texts by ``work``, of which the last used are remembered."""

    def __init__(self, work: Callable[[list[str]], list[bytes]]):
        self.work = work
        # plain dictionaries, which the garbage collector does not walk through
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, texts))
        missing = [at for at, ids in enumerate(found) if ids is None]
        for at in missing:
            found[at] = self.before.get(texts[at])
        new = [at for at in missing if found[at] is None]
        for at, ids in zip(new, self.work([texts[at] for at in new])):
            found[at] = ids
        self.known.update((texts[at], found[at]) for at in missing)
        return found


class Encoder:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    Byte-level BPE never merges across a space that follows other text, so texts
    are cut in words with their leading spaces. Each distinct word of a slice is
    split once, a Latin one into the parts that are merged for themselves, and
    the tokenizer's model merges each part that is not remembered. A piece
    between spaces that is empty or ends in white space stays with what follows
    it, as white space there is split by what follows.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the letters that the model has for the bytes of Latin-1 characters, zero for the separator
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = np.zeros(256, "<u4")
        for character in map(chr, range(1, 256)):
            ((mapped, _),) = level.pre_tokenize_str(character)
            self.letters[list(character.encode())] = list(map(ord, mapped))
        self.parts, self.words = Memory(self.merge), Memory(self.learn)

    @staticmethod
    def units(text: str) -> list[str]:
        pieces = text.split(" ")
        units, held = [], ""
        for piece in [pieces[0], *(" " + p for p in pieces[1:])]:
            held += piece
            if held and not held[-1].isspace():
                units.append(held)
                held = ""
        return [*units, held] if held else units

    def merge(self, parts: list[str]) -> list[bytes]:
        """Ids of Latin parts, as the tokenizer's model merges them."""
        mapped = self.letters[np.frombuffer("\0".join(parts).encode(), "u1")].tobytes().decode("utf-32-le")
        bounds, tokenize, token_id = [0], self.model.tokenize, operator.attrgetter("id")

        def ids() -> Iterator[int]:
            for part in mapped.split("\0"):
                tokens = tokenize(part)
                bounds.append(bounds[-1] + 4 * len(tokens))
                yield from map(token_id, tokens)

        data = np.fromiter(ids(), "<u4").tobytes()
        return [data[a:b] for a, b in itertools.pairwise(bounds)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer has to split."""
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(found.ids, dtype="<u4").tobytes() for found in encoded]

    def word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of each of some words, at least one."""
        unsplit = pc.match_substring_regex(words, UNSPLIT)
        latin = pc.if_else(unsplit, "", words)
        _, ends, data = pc.binary_join_element_wise(latin, *pa.array(["", "\0"], latin.type)).buffers()
        joined = str(memoryview(data)[: np.frombuffer(ends, "<i8")[len(latin)]], "utf-8")
        parts = pa.array(LATIN_SPLIT.findall(joined), pa.large_string()).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        separator = distinct.index("\0")
        distinct[separator] = ""
        ids = pa.array(self.parts.ids(distinct), pa.large_binary()).take(parts.indices)
        ends = np.flatnonzero(parts.indices.to_numpy() == separator)
        bounds = np.append(0, np.frombuffer(ids.buffers()[1], "<i8")[ends + 1])
        found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), ids.buffers()[2]])
        if not pc.any(unsplit).as_py():
            return found
        learnt = self.words.ids(words.filter(unsplit).to_pylist())
        return pc.replace_with_mask(found, unsplit, pa.array(learnt, pa.large_binary()))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        uneven = pc.match_substring_regex(texts, UNEVEN)
        even = texts.filter(pc.invert(uneven))
        units = [self.units(text) for text in texts.filter(uneven).to_pylist()]
        lists = pa.concat_arrays(
            [
                pc.split_pattern(pc.replace_substring(even, " ", "\0 "), "\0"),
                pa.array(units, pa.list_(pa.large_string())),
            ]
        )
        words = lists.flatten().dictionary_encode()
        ids = self.word_ids(words.dictionary).take(words.indices)
        data = memoryview(ids.buffers()[2] or b"")
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        bounds = np.frombuffer(ids.buffers()[1], "<i8")[ends].tolist()
        order = np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable").tolist()
        found = [b""] * len(texts)
        for at, a, b in zip(order, bounds, bounds[1:]):
            found[at] = bytes(data[a:b])
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=None)
def cuts(length: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a stretch of at most ``capacity`` tokens."""
    pieces: list[int] = []
    while length:
        fit = capacity // length
        if capacity - fit * length <= WASTE * capacity:
            pieces.append(length)
            break
        part = capacity // (fit + 1)
        pieces.append(part)
        length -= part
    return tuple(pieces)


class Filler:
    """Sequences of each class with exactly k pieces; ``rest`` tells what is in an unfilled one."""

    def __init__(self, first_id: int):
        self.next_id, self.open = first_id, {}

    def place(self, kind: int, row: int) -> list[int] | None:
        held = self.open.setdefault(kind, [])
        held.append(row)
        if len(held) < kind:
            return None
        self.open[kind] = []
        return held

    def rest(self) -> list[tuple[int, int]]:
        return [(kind, row) for kind, rows in self.open.items() for row in rows]


def _table(columns: list, kinds: list[int], worker: list[int]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", "worker"]
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, kinds, worker], types)], names)


def _emit(filler: Filler, pieces: list[tuple], kinds: list[int], last: bool, worker: int) -> pa.RecordBatch:
    """Place the pieces (doc_id, start, length, crc, doc_tokens); with ``last`` also hand on the rest."""
    rows: list[tuple] = []
    for piece, kind in zip(pieces, kinds):
        full = filler.place(kind, piece)
        if full:
            at = 0
            for held in full:
                rows.append((*held, filler.next_id, at, kind, worker))
                at += held[2]
            filler.next_id += 1
    if last:
        rows += [(*held, None, None, kind, worker) for kind, held in filler.rest()]
    columns = list(zip(*rows)) if rows else [[]] * 9
    return _table([list(c) for c in columns[:7]], list(columns[7]), list(columns[8]))


#: Sequence ids of one worker begin at a multiple of this.
BLOCK = 1 << 32


def _cut_and_fill(path: str, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        filler, codec = Filler(worker * BLOCK), encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            slices = np.cumsum(pc.binary_length(texts).to_numpy(), dtype="i8") // SLICE
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(ids)]
            for first, last in itertools.pairwise(edges):
                pieces, kinds = [], []
                for doc_id, data in zip(ids[first:last], codec.encode(texts[first:last])):
                    data += tail
                    total, start = len(data) // 4, 0
                    lengths = [CAPACITY] * (total // CAPACITY) + list(cuts(total % CAPACITY))
                    for length in lengths:
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        pieces.append((doc_id, start, length, crc, total))
                        kinds.append(CAPACITY // length)
                        start += length
                yield _emit(filler, pieces, kinds, False, worker)
        yield _emit(filler, [], [], True, worker)

    return run


def _fill_again(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "worker"):
            worker = group.column("worker")[0].as_py()
            filler = Filler((level << 56) + worker * BLOCK)
            columns = [group.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield _emit(filler, list(zip(*columns)), group.column("class").to_pylist(), True, worker)

    return run


def _fill_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fit, largest first, of fewer than k pieces of each class k."""
    for group in runs(batches, "worker"):
        rows = sorted(
            zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))),
            key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]),
        )
        used: list[int] = []
        placed: list[tuple] = []
        for row in rows:
            at = next((i for i, n in enumerate(used) if n + row[2] <= CAPACITY), len(used))
            if at == len(used):
                used.append(0)
            placed.append((*row, (127 << 56) + at, used[at]))
            used[at] += row[2]
        columns = [list(c) for c in zip(*placed)]
        yield _table(columns, [0] * len(rows), [0] * len(rows))


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    filled = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut_and_fill(path, end), PIECE), "packed")
    done, level = [filled.filter("sequence_id IS NOT NULL")], 0
    rest = filled.filter("sequence_id IS NULL")
    while True:
        highest = rest.agg(F.max("worker")).first()[0]
        if highest is None:
            break
        order = ["worker", "class", "doc_id", "start", "length", "ids_crc32"]
        level += 1
        if level > 1 and highest == 0:
            done.append(rest.repartition(1).sortWithinPartitions(*order).mapInArrow(_fill_last, PIECE))
            break
        groups = highest // FAN_IN + 1
        regrouped = rest.withColumn("worker", F.floor(F.col("worker") / FAN_IN))
        again = regrouped.repartition(min(groups, 10_000), "worker").sortWithinPartitions(*order)
        filled = staged(again.mapInArrow(_fill_again(level), PIECE), "packed-rest")
        done.append(filled.filter("sequence_id IS NOT NULL"))
        rest = filled.filter("sequence_id IS NULL")
    return functools.reduce(DataFrame.unionByName, done).drop("class", "worker")
