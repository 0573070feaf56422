"""Vector search and tool calls against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeshift.llm import tool_calls, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    size = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, size - len(v)))) for i, v in good]
    out = {}
    for q, vector in good:
        if q % every == 0:
            near = sorted((-float((v * vector).sum()), i) for i, v in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def searched(df, **options):
    out = {}
    for row in vector_search.nearest_neighbours(df, **options).collect():
        out.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    return {q: [(i, s) for _, i, s in sorted(found)] for q, found in out.items()}


def clustered(count, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    points = centres[rng.integers(0, 12, count)] + 0.4 * rng.normal(size=(count, 24))
    return [(i, [float(x) for x in np.float32(p)], 0, 0.0) for i, p in enumerate(points)]


def test_recall_on_clusters(spark):
    rows = clustered(3000)
    hot = rows[40][1]
    rows += [(3000 + i, hot, 0, 0.0) for i in range(900)]  # equal vectors
    found, want = searched(spark.createDataFrame(rows, VECTORS)), brute(rows)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {r[0]: np.array(r[1]) for r in rows}
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(np.isclose(s, (vectors[q] * vectors[i]).sum(), rtol=1e-12, atol=1e-12) for i, s in near)
    # ties of equal vectors go to the smallest ids
    equal = [40, *range(3000, 3900)]
    for q, near in found.items():
        ties = [i for i, _ in near if i in equal]
        assert ties == [i for i in equal if i != q][: len(ties)]


@pytest.mark.parametrize("count", [1, 15, 60])
def test_few_rows_are_all_found(spark, count):
    rows = clustered(count)
    rows += [(None, rows[0][1], 0, 0.0), (500, None, 0, 0.0), (520, [0.0] * 24, 0, 0.0), (540, [float("nan")] * 24, 0, 0.0)]
    rows += [(560, [1.0, None], 0, 0.0), (580, [float("inf")] + [0.0] * 23, 0, 0.0), (600, [2.0], 0, 0.0)]
    found, want = searched(spark.createDataFrame(rows, VECTORS), probes=100), brute(rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}


def test_no_vectors(spark):
    assert searched(spark.createDataFrame([], VECTORS)) == {}
    assert searched(spark.createDataFrame([(20, [0.0], 0, 0.0)], VECTORS)) == {}


def test_scan_abandons_but_keeps_the_near():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2000, 63))
    index = vector_search.Index(vectors, float(np.sqrt((vectors**2).sum(axis=1)).max()), 10)
    points, query = index.turned(vectors), vectors[0]
    true = np.argsort(-(vectors @ query))[:20]
    limit = index.norm**2 + (query**2).sum() - 2 * (vectors[true] @ query).min()
    found, _ = vector_search.scan(index, points, vectors, index.turned(query[None], query=True)[0], query, limit, 20)
    assert len(set(found) & set(true)) >= 19


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depth int"
RESULTS = "conv_id long, turn long, call_id string, result string"
TOOLS = {
    "add": {
        "type": "object",
        "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]}},
        "required": ["a"],
        "additionalProperties": False,
    }
}


def test_links(spark):
    ref = lambda i: {"$result": i}
    calls = [
        (1, 0, "c", "add", json.dumps({"b": ref("b"), "a": ref("a")}), 9),
        (1, 1, "b", "add", json.dumps({"a": ref("a")}), 9),
        (1, 2, "a", "add", '{"b": null,  "a": 1.0}', 9),
        (1, 3, "a", "add", '{"a": 2}', 9),
        (1, 4, "x", "add", json.dumps({"a": ref("y")}), 9),
        (1, 5, "y", "add", json.dumps({"a": ref("x")}), 9),
        (1, 6, "bad", "add", '{"a": -1, "z": true}', 9),
        (1, 7, "text", "add", "{not json", 9),
        (1, 8, "tool", "unknown", "{}", 9),
        (1, 9, "lost", "add", json.dumps({"a": ref("nowhere")}), 9),
        (2, 0, "a", "add", None, 9),
        (None, 0, "a", "add", "{}", 9),
        (2, 0, None, "add", "{}", 9),
    ]
    results = [(1, 5, "a", "three é"), (1, 6, "a", "later"), (2, 1, "orphan", ""), (2, 1, None, "none")]
    linked = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS)
    rows = {(r.conv_id, r.call_id): r for r in linked.collect()}
    assert len(rows) == 11
    first = rows[1, "a"]
    assert (first.status, first.depth, first.repeats, first.valid) == ("linked", 0, 2, True)
    assert first.json == '{"arguments":{"a":1.0,"b":null},"id":"a","name":"add","result":"three é","status":"linked"}'
    assert (rows[1, "b"].depth, rows[1, "c"].depth) == (1, 2)
    assert rows[1, "a"].position < rows[1, "b"].position < rows[1, "c"].position
    assert {rows[1, "x"].status, rows[1, "y"].status} == {"cyclic"}
    assert rows[1, "bad"].errors == "$.a: range; $.z: not allowed"
    assert rows[1, "text"].errors == "$: not JSON" and rows[1, "tool"].errors == "$: unknown tool"
    assert rows[1, "lost"].errors == "$result: no call nowhere"
    assert (rows[2, "a"].status, rows[2, "a"].errors) == ("open", "$: not object")
    assert (rows[2, "orphan"].status, rows[2, "orphan"].json) == ("orphan", '{"id":"orphan","result":"","status":"orphan"}')
    assert sorted(r.position for (c, _), r in rows.items() if c == 1) == list(range(9))
    empty = tool_calls.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOLS)
    assert empty.count() == 0


@pytest.mark.parametrize(
    "text", ['{"a": "\\ud800"}', "[" * 100_000, '{"a": NaN}', '{"a": -Infinity}', '{"a": 1e999}', '{"a": ' + "9" * 5000 + "}", '{"a": ' + "[" * 101 + "]" * 101 + "}"]
)
def test_arguments_that_are_no_json(spark, text):
    calls = spark.createDataFrame([(1, 0, "a", "add", text, 0), (1, 1, "b", "add", '{"a": 3}', 0)], CALLS)
    rows = {r.call_id: r for r in tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), TOOLS).collect()}
    assert rows["a"].errors == "$: not JSON" and not rows["a"].valid and rows["b"].valid
    for row in rows.values():
        json.loads(row.json)


def test_deep_arguments_and_brackets_in_strings():
    deep = "[" * 100 + "]" * 100
    assert tool_calls.canonical(tool_calls.parsed(deep)) == deep
    assert tool_calls.parsed('"' + "[" * 500 + '\\""') == "[" * 500 + '"'


def test_conversations(spark):
    messages = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", ""), (2, 0, "system", "s"), (2, 1, "assistant", "t")]
    messages += [(None, 0, "user", "x"), (3, None, "user", None), (3, 2, None, "y")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1))
    rows = {(r.conv_id, r.call_id): r for r in tool_calls.linked_conversations(df).collect()}
    assert {k: v.status for k, v in rows.items() if k[0] != 3} == {
        (1, "call-0"): "linked", (1, "call-2"): "open", (2, "call-0"): "orphan"
    }
    assert (rows[1, "call-2"].depth, rows[1, "call-2"].errors) == (1, "$.prompt: length")
    assert rows[1, "call-0"].json == '{"arguments":{"prompt":"a","turn":0},"id":"call-0","name":"reply","result":"b","status":"linked"}'


def depths_by_hand(uses: dict[str, list[str]]) -> dict[str, int]:
    """Longest chain below each call, rounds of calls all of whose references are known."""
    known: dict[str, int] = {}
    while True:
        ready = {
            c: 1 + max((known[r] for r in refs if r in uses), default=-1)
            for c, refs in uses.items()
            if c not in known and all(r in known for r in refs if r in uses)
        }
        if not ready:
            return known
        known |= ready


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_of_chains_forks_and_circles(spark, seed):
    rng = np.random.default_rng(seed)
    graphs = {
        1: {str(i): [str(i - 1)] if i else [] for i in range(70)},  # one long chain
        2: {str(i): ["0"] if i else [] for i in range(40)},  # all refer to one call
        3: {str(i): [str(j) for j in {*rng.integers(0, 40, int(rng.integers(0, 3))).tolist()}] for i in range(40)},
        4: {str(i): [str(j) for j in {*rng.integers(0, max(i, 1), int(rng.integers(1, 4))).tolist()} if j < i] for i in range(40)},
        5: {"a": ["a"], "b": ["a"], "c": ["b", "d"], "d": [], "e": ["d", "gone"], "f": ["e"], "g": ["f", "d"], "h": ["g"]},
        6: {"a": ["c"], "b": ["a"], "c": ["b"], "d": ["c"]},
    }
    calls = [
        (conv, turn, call, "add", json.dumps({"a": [{"$result": r} for r in refs]}), 0)
        for conv, uses in graphs.items()
        for turn, (call, refs) in enumerate(uses.items())
    ]
    found = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), TOOLS).collect()
    got = {conv: {r.call_id: r.depth for r in found if r.conv_id == conv and r.depth is not None} for conv in graphs}
    assert got == {conv: depths_by_hand(uses) for conv, uses in graphs.items()}
    assert all((r.status == "cyclic") == (r.depth is None) for r in found)
