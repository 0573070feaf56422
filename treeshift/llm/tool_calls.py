"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join on conversation and call identifier. Calls
whose arguments refer to another call's result ({"$result": id}, at any depth)
come after it: a call's depth is the longest chain below it. Chains of single
references are followed by pointers that double their reach in every round; calls
with several references settle once all of these have. Arguments are checked against
the schema of the tool, and each linked call is serialised as canonical JSON:
keys sorted, no blanks, UTF-8.

Defined cases: rows without conversation or identifier belong to nothing and are
left out of the links. If an identifier is repeated in a conversation, the row
with the smallest turn counts (then name and arguments), and ``repeats`` tells how
many there are. A call without a result is ``open``, a result without a call is
``orphan``, a call in a cycle of references is ``cyclic``, and all others are
``linked``. References to calls that do not exist are errors, but do not hold a
call back. Null arguments count as absent; unparsable ones are an error, and so
are NaN, infinities, numbers beyond double precision, lone surrogates and more
than ``DEEPEST`` levels of brackets. An
unknown tool is an error. Extra columns are not looked at. Empty tables give an
empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treeshift.llm.common import staged
from treeshift.operators.numbering import number_rows

TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "number": (int, float),
    "integer": int,
    "null": type(None),
}


#: Levels of nested brackets that arguments may have.
DEEPEST = 100


def canonical(value) -> str:
    """Sorted keys, no blanks; a number beyond double precision's range is a ValueError."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None):
    """The value of a JSON text; ValueError for NaN, infinities, lone surrogates, and nesting beyond ``DEEPEST``."""

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    if text is None:
        return None
    depth = deepest = 0
    for bracket in re.findall(r'"(?:[^"\\]|\\.)*+"|[\[{]|[\]}]', text, re.DOTALL):
        if bracket[0] != '"':
            depth += 1 if bracket in "[{" else -1
            deepest = max(deepest, depth)
    if deepest > DEEPEST:
        raise ValueError("too deep")
    value = json.loads(text, parse_constant=refuse)
    canonical(value).encode()  # a lone surrogate has no encoding: UnicodeEncodeError is a ValueError
    return value


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, bounds, required, properties, items.

    A reference to a result stands for any value.
    """
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    whole = isinstance(value, float) and value.is_integer() and "integer" in kinds
    fits = [isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds]
    if kinds and not any(fits) and not whole:
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: range")
    elif isinstance(value, list):
        for i, item in enumerate(value):
            found += violations(item, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                found += violations(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{name}: not allowed")
    return found


def references(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return {str(value["$result"])}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _check(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, uses, plain = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
                try:
                    value = parsed(text)
                except ValueError:
                    errors.append(["$: not JSON"])
                    uses.append([])
                    plain.append(None)
                    continue
                schema = schemas.get(name)
                errors.append(["$: unknown tool"] if schema is None else violations(value, schema))
                uses.append(sorted(references(value)))
                plain.append(canonical(value))
            added = [pa.array(errors, pa.list_(pa.string())), pa.array(uses, pa.list_(pa.string())), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "errors", "uses", "plain"])

    return run


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for row in batch.to_pylist():
            record = {"id": row["call_id"], "status": row["status"]}
            if row["status"] != "orphan":
                record |= {"name": row["name"], "arguments": json.loads(row["plain"]) if row["plain"] else None}
            if row["result"] is not None:
                record["result"] = row["result"]
            text.append(canonical(record))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "json"])


KEY = ["conv_id", "call_id"]


def _chain_ends(single: DataFrame, longest: int) -> DataFrame:
    """(conv_id, call_id, end, steps): where the chain of a call with one reference (use) ends, and how far off.

    Each round doubles the reach of every pointer, so a chain of n calls takes
    log2(n) rounds. No chain is longer than ``longest``, the calls of the largest
    conversation; what has not ended by then leads into a circle and is left out.
    """
    hops = staged(single.select(*KEY, F.col("use").alias("end"), F.lit(1).cast("long").alias("steps")), "call-chains")
    reach = 1
    while reach < longest:
        further = hops.select(
            "conv_id", F.col("call_id").alias("end"), F.col("end").alias("beyond"), F.col("steps").alias("more")
        )
        moved = staged(
            hops.join(further, ["conv_id", "end"], "left").select(
                *KEY,
                F.coalesce("beyond", "end").alias("end"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("beyond").isNotNull().alias("moved"),
            ),
            "call-chains",
        )
        hops = moved.drop("moved")
        reach *= 2
        if moved.filter("moved").isEmpty():
            break
    return hops.join(single.select("conv_id", F.col("call_id").alias("end")), ["conv_id", "end"], "left_anti")


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of all calls that are in no cycle nor behind one.

    Chains of calls with one reference each are followed first, by doubling. Then
    only calls with several references are left, which take a round a level.
    """
    edges = staged(
        calls.select(*KEY, F.explode("uses").alias("use"))
        .join(calls.select("conv_id", F.col("call_id").alias("use")), ["conv_id", "use"])
        .distinct(),
        "call-uses",
    )
    fan = staged(edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("use").alias("use")), "call-fans")
    longest = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls")).agg(F.max("calls")).first()[0] or 0
    ends = staged(_chain_ends(fan.filter("refs = 1").drop("refs"), longest), "call-ends")
    settled = staged(
        calls.select(KEY).join(fan.select(KEY), KEY, "left_anti").withColumn("depth", F.lit(0).cast("long")), "call-depths"
    )
    # a reference to a chain is one to its end; one to a circle has no end and stays open
    single = fan.filter("refs = 1").select("conv_id", F.col("call_id").alias("use"), F.lit(True).alias("chained"))
    chain = ends.select("conv_id", F.col("call_id").alias("use"), "end", "steps")
    waiting = staged(
        edges.join(fan.filter("refs > 1").select(KEY), KEY, "left_semi")
        .join(single, ["conv_id", "use"], "left")
        .join(chain, ["conv_id", "use"], "left")
        .select(
            *KEY,
            F.when(F.col("chained"), F.col("end")).otherwise(F.col("use")).alias("use"),
            (F.coalesce("steps", F.lit(0)) + 1).alias("steps"),
        ),
        "call-uses",
    )
    while not waiting.isEmpty():
        done = settled.select("conv_id", F.col("call_id").alias("use"), F.col("depth").alias("below"))
        ready = (
            waiting.join(done, ["conv_id", "use"], "left")
            .groupBy(KEY)
            .agg(
                F.max(F.col("below") + F.col("steps")).alias("depth"),
                F.count(F.when(F.col("below").isNull(), 1)).alias("open"),
            )
            .filter("open = 0")
        )
        new = staged(ready.select(*KEY, "depth"), "call-depths")
        if new.isEmpty():
            break
        settled = staged(settled.unionByName(new), "call-depths")
        waiting = staged(waiting.join(new.select(KEY), KEY, "left_anti"), "call-uses")
    below = settled.select("conv_id", F.col("call_id").alias("end"), "depth")
    chained = ends.join(below, ["conv_id", "end"]).select(*KEY, (F.col("depth") + F.col("steps")).alias("depth"))
    return settled.unionByName(chained).select(*KEY, F.col("depth").cast("int"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link calls (conv_id, turn, call_id, name, arguments) with results (conv_id, turn, call_id, result).

    Returns conv_id, call_id, turn, status, depth, position (order in the conversation
    that respects references), repeats, valid, errors and json.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "name", "arguments"))
    unique = (
        calls.filter(named).groupBy(KEY).agg(first.alias("call"), F.count(F.lit(1)).alias("repeats"))
        .select(*KEY, "call.turn", "call.name", "call.arguments", "repeats")
    )
    fields = {"conv_id": calls.schema["conv_id"], "turn": calls.schema["turn"]}
    kinds = {n: f.dataType.simpleString() for n, f in fields.items()}
    schema = (
        f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, name string, arguments string, "
        "repeats long, errors array<string>, uses array<string>, plain string"
    )
    checked = staged(unique.mapInArrow(_check(schemas), schema), "calls")
    exists = checked.select("conv_id", F.col("call_id").alias("use"), F.lit(True).alias("there"))
    missing = (
        checked.select(*KEY, F.explode("uses").alias("use"))
        .join(exists, ["conv_id", "use"], "left_anti")
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("$result: no call "), "use"))).alias("missing"))
    )
    answers = results.filter(named).groupBy(KEY).agg(F.min(F.struct("turn", "result")).alias("answer"))
    status = (
        F.when(F.col("repeats").isNull(), "orphan")
        .when(F.col("depth").isNull(), "cyclic")
        .when(F.col("answer").isNull(), "open")
        .otherwise("linked")
    )
    linked = (
        checked.join(_depths(checked), KEY, "left")
        .join(missing, KEY, "left")
        .join(answers, KEY, "full")
        .select(
            *KEY,
            F.coalesce("turn", "answer.turn").alias("turn"),
            status.alias("status"),
            "depth",
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
            F.concat(F.coalesce("errors", F.array()), F.coalesce("missing", F.array())).alias("errors"),
            "name",
            "plain",
            F.col("answer.result").alias("result"),
        )
        .withColumn("last", F.coalesce("depth", F.lit(2**31 - 1)))
    )
    kinds_out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema)
    written = linked.mapInArrow(_serialise, kinds_out + ", json string")
    return number_rows(written.drop("name", "plain", "result"), ["conv_id"], ["last", "turn", "call_id"]).select(
        *KEY, "turn", "status", "depth", "position", "repeats", (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"), "json",
    )


#: The tool that the test conversations are read as calls of.
REPLY = {
    "type": "object",
    "properties": {
        "prompt": {"type": "string", "minLength": 1, "maxLength": 2000},
        "turn": {"type": "integer", "minimum": 0},
        "context": {"type": "object"},
    },
    "required": ["prompt", "turn"],
    "additionalProperties": False,
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages read as tool calls: a user's turn calls ``reply``, the next turn, the assistant's, is its result.

    A call refers to the result of the user's turn two before, as its context.
    Messages of other roles, such as ``system``, are no calls and no results: they
    take no part.
    """

    def call_id(turn):
        return F.concat_ws("-", F.lit("call"), turn.cast("string"))

    turn = F.col("turn").cast("long")
    asked = messages.filter("role = 'user'").select("conv_id", turn.alias("turn"), "text")
    context = F.when(F.col("turn") >= 2, F.struct(call_id(F.col("turn") - 2).alias("$result")))
    calls = asked.select(
        "conv_id",
        "turn",
        call_id(F.col("turn")).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(context.alias("context"), F.col("text").alias("prompt"), "turn")).alias("arguments"),
    )
    results = messages.filter("role = 'assistant'").select(
        "conv_id", turn.alias("turn"), call_id(turn - 1).alias("call_id"), F.col("text").alias("result")
    )
    return calls, results


def linked_conversations(messages: DataFrame) -> DataFrame:
    """The conversations' calls and results, one row for each identifier."""
    return link_calls(*conversation_calls(messages), {"reply": REPLY})
