"""Operator 8: chat formatting by tool-call linking.

Calls and results are hash-joined by the call's identifier. A call may name another call that it comes ``after``;
its depth is the number of calls that must come before it, so (depth, turn, call_id) is a topological order. Depths
come from pointer doubling: each round joins every call with the call that it points to and takes over its pointer,
so a chain of n calls takes log2(n) joins, whichever conversation it is in, and no conversation is held by one task.
Arguments are checked against the tool's schema, and each link is written as canonical JSON: sorted keys, no spaces,
whole numbers without a fraction, everything but quotes, backslashes, control characters and halves of surrogate
pairs as it is.

``status`` is linked, unanswered (no result), orphan (a result without a call), cyclic (its chain never ends) or
unidentified (no identifier). Turns that are neither call nor result (system, other and null roles) each keep a row
with status message and a canonical record of role, content and turn. Calls of one identifier are one call: that of the least turn, name and arguments, and
``n_calls`` counts them; results likewise. ``valid`` is null for orphans.

Cases: null texts are JSON null, which a schema of strings rejects; empty and very long texts are kept whole;
arguments that are no JSON (NaN and infinities too), hold numbers beyond a double, or are nested deeper than ``DEEPEST``
are an error and stay in the record as the text that they are;
repeated rows are counted; a null identifier links to nothing and keeps its row; a call after one that does not
exist is a first call; other columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, discard, map_arrow, table

#: Levels of arrays and objects in arguments.
DEEPEST = 200
_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    def plain(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _whole(json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't express, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(text: str) -> float:
    if math.isinf(value := float(text)):
        raise ValueError("beyond a double")
    return value


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parsed(text: str) -> Any:
    """The value of a JSON text; what is no JSON or too deep is a ValueError."""
    deep = most = 0
    for bracket in re.findall(r"[\[{}\]]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text)):
        deep += 1 if bracket in "[{" else -1
        most = max(most, deep)
    if most > DEEPEST:
        raise ValueError("nested too deeply")
    return json.loads(text, parse_float=_number, parse_constant=_no_constant)


def _of_kind(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _KINDS[kind])


def first_error(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first breach of a JSON schema's type, enum, bounds, required, properties, additionalProperties or items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_of_kind(value, kind) for kind in kinds):
        return f"{at}: not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: length out of bounds"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{at}: value out of bounds"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}: lacks {name}"
        for name in sorted(value):
            below = schema.get("properties", {}).get(name, schema.get("additionalProperties", True))
            if below is False:
                return f"{at}: unknown {name}"
            if isinstance(below, dict) and (error := first_error(value[name], below, f"{at}.{name}")):
                return error
    if isinstance(value, list):
        for k, item in enumerate(value):
            if error := first_error(item, schema.get("items", {}), f"{at}[{k}]"):
                return error
    return None


def depths(calls: DataFrame) -> DataFrame:
    """``call_id`` and ``depth`` (null in a cycle) of calls with a unique ``call_id`` and an ``after``."""
    known = calls.select(F.col("call_id").alias("after"))
    first = F.when(F.col("there") == 1, F.col("after"))
    state = calls.select("call_id", "after").join(known.withColumn("there", F.lit(1)), "after", "left").select("call_id", first.alias("at"), F.coalesce("there", F.lit(0)).cast("long").alias("depth"))
    state = cut(state, "pointers")
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        active = state.where("at is not null")
        if active.isEmpty():
            break
        onward = state.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = active.join(onward, "at").select("call_id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        # A pointer that has arrived stays; the others find it under its own identifier in the next round.
        before, state = state, cut(moved.unionByName(state.where("at is null")), "pointers")
        discard(before)
    return state.select("call_id", F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``conv_id, turn, call_id, status, n_calls, n_results, depth, valid, error, record`` for each call and orphan.

    ``calls`` has conv_id, turn, call_id, after, name and arguments (JSON), ``results`` conv_id, turn, call_id and
    content. ``schemas`` are those of the tools, by name: a constant of the job."""
    one = ["conv_id", "turn", "after", "name", "arguments"]
    named = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "name", "arguments", "conv_id", "after")).alias("call"), F.count("*").alias("n_calls"))
    named = cut(named.select("call_id", "n_calls", *(F.col(f"call.{c}").alias(c) for c in one)), "calls")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("answer"), F.count("*").alias("n_results"))
    linked = named.join(answers, "call_id", "full").join(depths(named).withColumn("placed", F.lit(True)), "call_id", "left")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("depth").isNull(), "cyclic").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    columns = ["conv_id", "turn", "call_id", "status", "n_calls", "n_results", "depth", "name", "arguments", "content"]
    linked = linked.withColumns({"status": status, "content": F.col("answer.content"), "conv_id": F.coalesce("conv_id", "answer.conv_id"), "turn": F.coalesce("turn", "answer.turn"), "n_calls": F.coalesce("n_calls", F.lit(0)), "n_results": F.coalesce("n_results", F.lit(0))})
    lone = calls.where("call_id is null").select("conv_id", "turn", "call_id", F.lit("unidentified").alias("status"), F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("long").alias("depth"), "name", "arguments", F.lit(None).cast("string").alias("content"))
    lost = results.where("call_id is null").select("conv_id", "turn", "call_id", F.lit("unidentified").alias("status"), F.lit(0).cast("long").alias("n_calls"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content")
    rows = linked.select(*columns).unionByName(lone).unionByName(lost)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        valid, errors, records = [], [], []
        for row in batch.to_pylist():
            arguments, error = None, None
            if row["n_calls"]:
                try:
                    arguments = parsed(row["arguments"] or "null")
                    error = first_error(arguments, schemas[row["name"]]) if row["name"] in schemas else "unknown tool"
                except ValueError:
                    arguments, error = row["arguments"], "not JSON"
            valid.append(error is None if row["n_calls"] else None)
            errors.append(error and _whole(error))
            records.append(canonical({"arguments": arguments, "depth": row["depth"], "id": row["call_id"], "name": row["name"], "result": row["content"], "status": row["status"]}))
        kept = ["conv_id", "turn", "call_id", "status", "n_calls", "n_results", "depth"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(records, pa.string())], [*kept, "valid", "error", "record"])

    return map_arrow(rows, "conv_id long, turn long, call_id string, status string, n_calls long, n_results long, depth long, valid boolean, error string, record string", work)


#: The one tool of plain conversations: a user's turn calls it and the turn that follows is its result.
REPLY = {
    "reply": {
        "type": "object", "required": ["question", "turn"], "additionalProperties": False,
        "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations: a user's turn is a call, an assistant's the result of the turn before."""
    identifier = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(F.col("text").alias("question"), turn.alias("turn")), {"ignoreNullFields": "false"})
    calls = conversations.where(F.col("role") == "user").select("conv_id", "turn", identifier(turn).alias("call_id"), identifier(turn - 2).alias("after"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    return calls, conversations.where(F.col("role") == "assistant").select("conv_id", "turn", identifier(turn - 1).alias("call_id"), F.col("text").alias("content"))


def messages(conversations: DataFrame) -> DataFrame:
    """Rows like those of link() for the turns that turns() leaves: neither a user's nor an assistant's."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [canonical({"content": r["text"], "role": r["role"], "status": "message", "turn": r["turn"]}) for r in batch.to_pylist()]
        none, zero = (lambda kind: pa.nulls(batch.num_rows, kind)), pa.array([0] * batch.num_rows, pa.int64())
        columns = [batch.column(0), batch.column(1), none(pa.string()), pa.array(["message"] * batch.num_rows), zero, zero, none(pa.int64()), none(pa.bool_()), none(pa.string()), pa.array(said, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "call_id", "status", "n_calls", "n_results", "depth", "valid", "error", "record"])

    others = conversations.where(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"))
    return map_arrow(others.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), "conv_id long, turn long, call_id string, status string, n_calls long, n_results long, depth long, valid boolean, error string, record string", work)


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations: calls with their results, and messages of other roles."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(*turns(conversations), REPLY).unionByName(messages(conversations))


_SAID = "coalesce(to_json({})::VARCHAR, 'null')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text, count(text) AS said, count(*) AS n_calls FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM g),
j AS (SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.turn, r.turn + 1) AS turn, 'call_' || coalesce(d.conv_id, r.conv_id) || '_' || coalesce(d.turn, r.turn) AS call_id,
             CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
             coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, depth, text, said, content, d.turn AS called
      FROM d FULL JOIN r ON d.conv_id = r.conv_id AND d.turn = r.turn)
SELECT conv_id, turn, call_id, status, n_calls, n_results, depth::BIGINT AS depth, CASE WHEN n_calls > 0 THEN said > 0 AND text <> '' END AS valid,
       CASE WHEN n_calls = 0 THEN NULL WHEN said = 0 THEN '$.question: not of type string' WHEN text = '' THEN '$.question: length out of bounds' END AS error,
       '{{"arguments":' || CASE WHEN n_calls = 0 THEN 'null' ELSE '{{"question":' || CASE WHEN said = 0 THEN 'null' ELSE to_json(text)::VARCHAR END || ',"turn":' || called || '}}' END
         || ',"depth":' || coalesce(depth::VARCHAR, 'null') || ',"id":"' || call_id || '","name":' || CASE WHEN n_calls = 0 THEN 'null' ELSE '"reply"' END
         || ',"result":' || {_SAID.format("content")} || ',"status":"' || status || '"}}' AS record
FROM j
UNION ALL SELECT conv_id, turn, NULL, 'message', 0, 0, NULL, NULL, NULL,
       '{{"content":' || {_SAID.format("text")} || ',"role":' || {_SAID.format("role")} || ',"status":"message","turn":' || coalesce(turn::VARCHAR, 'null') || '}}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
