"""Secret scans: patterns of known forms, and character Markov models for the rest.

Two Markov models over the characters of keys are trained from labelled samples:
random strings (the values that the patterns find) and ordinary identifiers (other
runs of such characters that are too short to be in question themselves). A long
run that no pattern covers is reported when the likelihood ratio of the two models
speaks for a secret strongly enough to outweigh its rarity.

Spans are kind:start:end in code points, the end exclusive. Kinds: ``assign``,
``access``, ``hex`` by pattern, ``random`` by the models.

Defined cases: a null text counts as empty. A pattern match that is too short is
dropped, but the text it covers is not matched again by that pattern. Rows may
repeat and ids may be null; other columns are not looked at. Without any sample
both models are uniform and nothing is added. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treeshift.llm.common import chunks, text_bytes

ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_VALUE = 8
# a run this long that starts with AKIA, or of hex digits, is the run the plain pattern finds
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")

#: Runs of these characters are candidates of the models from this length on.
KEY_CHARACTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = 20
SAMPLE_RUN = 4
#: Natural log of the odds against a run being a secret, which the ratio must exceed.
PRIOR = 8.0
#: Documents the models are trained from; a sample by hash of the id.
TRAINING_DOCUMENTS = 20_000

_KEY = np.full(256, 255, dtype=np.uint8)
_KEY[list(KEY_CHARACTERS)] = np.arange(len(KEY_CHARACTERS))
STATES = len(KEY_CHARACTERS) + 1  # the last one is the start
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true; the array begins and ends with false."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return edges[::2], edges[1::2]


class Scanned:
    """Some texts as one buffer with a line feed around each, and what the patterns find there.

    No pattern matches a line feed, so nothing crosses from one text into another.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n" + b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = 1 + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        assigned = [m for m in ASSIGN.finditer(self.buffer) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
        self.assign, self.values = [m.span() for m in assigned], [m.span(2) for m in assigned]
        self.access = [m.span() for m in ACCESS.finditer(self.buffer)]
        starts, ends = _runs(_HEX[self.data])
        long = ends - starts >= 32
        self.hex = list(zip(starts[long].tolist(), ends[long].tolist()))
        starts, ends = _runs(_KEY[self.data] != 255)
        covered = np.zeros(len(self.data) + 1, dtype=np.int32)
        for a, b in [*self.assign, *self.access, *self.hex]:
            covered[a] += 1
            covered[b] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
        free = (inside[ends] - inside[starts] == 0) & (ends - starts >= SAMPLE_RUN)
        self.starts, self.ends = starts[free], ends[free]


def _steps(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition codes of all runs one after another, and where each run begins."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(starts, sizes)
    # a dot, which values may hold, starts anew
    state = np.minimum(_KEY[data[at]].astype(np.int64), STATES - 1)
    before = np.empty_like(state)
    before[1:] = state[:-1]
    before[bounds[:-1]] = STATES - 1
    return before * STATES + state, bounds[:-1]


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, STATES * STATES), np.int64)
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for start, end in chunks(texts):
            found = Scanned(texts[start:end])
            secret = np.array([*found.values, *found.access, *found.hex], np.int64).reshape(-1, 2)
            short = found.ends - found.starts < CANDIDATE  # the others have no label yet
            ordinary = (found.starts[short], found.ends[short])
            for label, (a, b) in enumerate([ordinary, (secret[:, 0], secret[:, 1])]):
                if len(a):
                    steps, _ = _steps(found.data, a, b)
                    steps = steps[steps % STATES < STATES - 1]
                    counts[label] += np.bincount(steps, minlength=STATES * STATES)
    label, step = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label), pa.array(step), pa.array(counts[label, step])], ["label", "step", "count"]
    )


def train(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> np.ndarray:
    """Log likelihood ratio, random against ordinary, of each transition of characters."""
    rate = min(1.0, documents / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("secret sample")), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    counted = docs.filter(drawn).select("text").mapInArrow(_count_steps, "label long, step long, count long")
    counts = np.ones((2, STATES, STATES))
    for row in counted.groupBy("label", "step").agg(F.sum("count").alias("count")).collect():  # 2 * STATES^2 at most
        counts[row["label"], row["step"] // STATES, row["step"] % STATES] += row["count"]
    chance = counts / counts.sum(axis=2, keepdims=True)
    return np.log(chance[1] / chance[0]).ravel()


def _joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_texts(texts: list[bytes], ratio: np.ndarray) -> list[tuple[int, int, int, str, str]]:
    """For each text: n_assign, n_access, n_hex, digest of base spans, all spans."""
    kinds = ("assign", "access", "hex", "random")
    found = Scanned(texts)
    long = found.ends - found.starts >= CANDIDATE
    starts, ends = found.starts[long], found.ends[long]
    if len(starts):
        steps, bounds = _steps(found.data, starts, ends)
        # each transition counts once in a run, so a repeated pattern does not add up
        run = np.repeat(np.arange(len(starts)), np.diff([*bounds, len(steps)]))
        distinct = np.unique(run * STATES**2 + steps)
        chosen = np.bincount(distinct // STATES**2, ratio[distinct % STATES**2], len(starts)) > PRIOR
        starts, ends = starts[chosen], ends[chosen]
    by_kind = [found.assign, found.access, found.hex, list(zip(starts.tolist(), ends.tolist()))]
    spans = [(a, kind, b) for kind, own in enumerate(by_kind) for a, b in own]
    owner = np.searchsorted(found.first, [a for a, _, _ in spans], side="right") - 1
    points = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
    held: dict[int, list[tuple[int, int, int]]] = {}
    for text, (a, kind, b) in zip(owner.tolist(), spans):
        origin = points[found.first[text]]
        held.setdefault(text, []).append((int(points[a] - origin), kind, int(points[b] - origin)))
    rows = []
    for i in range(len(texts)):
        own = held.get(i, [])
        base = [s for s in own if s[1] < 3]
        counts = [sum(s[1] == kind for s in base) for kind in range(3)]
        digest = hashlib.sha256(_joined(base, kinds).encode()).hexdigest()
        rows.append((*counts, digest, _joined(own, kinds)))
    return rows


def secrets(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ratio = train(docs, documents)  # STATES^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            rows = [row for start, end in chunks(texts) for row in scan_texts(texts[start:end], ratio)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
