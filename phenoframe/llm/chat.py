"""Tool calls of conversations: linking, ordering, validation and canonical JSON.

Calls and results meet in a hash join on conversation and identifier; results are reduced to one for
each identifier before. A call may name calls it comes after. Where all of those stand earlier in the
conversation, the order of turns is already topological; only conversations with a reference forward are
peeled level by level. No conversation is ever gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.session import arrow_batches, cut

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks; whole floats are written as integers, lone surrogates as escapes.

    Raises ValueError for numbers that JSON does not have.
    """
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema (types, properties, required, enum, limits, pattern, items) a value breaks."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        whole = isinstance(value, float) and value.is_integer()
        if not any(
            (isinstance(value, _TYPES[k]) or k == "integer" and whole) and (k == "boolean" or not isinstance(value, bool)) for k in kinds
        ):
            return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{at}: wrong number of items")
        for i, v in enumerate(value):
            found += violations(v, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            found.append(f"{at}: out of range")
    return found


def _serialise(schemas: dict[str, dict]):
    def one(name: str | None, arguments: str | None, row: dict) -> tuple[list[str], str]:
        try:
            value = json.loads(arguments) if arguments is not None else {}
            errors = violations(value, schemas[name]) if name in schemas else ["unknown tool"]
            return errors, canonical({"arguments": value, "name": name} | row)
        except RecursionError:
            errors = ["$: nested too deeply"]
        except ValueError:  # no JSON, or a number beyond it
            errors = ["$: not JSON"]
        return errors, canonical({"arguments": arguments, "name": name} | row)

    def line(r: dict) -> tuple[list[str], str]:
        if r["status"] == "other":
            return [], canonical({"id": r["call_id"], "role": r["name"], "text": r["result"]})
        if r["status"] == "orphan":
            return [], canonical({"id": r["call_id"], "result": r["result"]})
        return one(r["name"], r["arguments"], {"id": r["call_id"], "result": r["result"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["name", "arguments", "call_id", "result", "status"]).to_pylist()
            done = [line(r) for r in rows]
            keep = [n for n in batch.schema.names if n not in ("arguments", "result")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array([not e for e, _ in done]), pa.array([e for e, _ in done], pa.list_(pa.string())),
                 pa.array([j for _, j in done], pa.string())], [*keep, "valid", "errors", "json"])

    return run


def parse_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages whose text is JSON: assistants' ``tool_calls`` (id, name, arguments as
    text, after) and tools' ``tool_call_id`` with ``content``. Other messages have neither."""
    call = F.from_json(text, "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>")
    calls = messages.where(F.col(role) == "assistant").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.posexplode(call["tool_calls"]).alias("index", "c"))
    calls = calls.select("conv", "turn", "index", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    result = F.from_json(text, "tool_call_id string, content string")
    results = messages.where(F.col(role) == "tool").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), result["tool_call_id"].alias("call_id"), result["content"].alias("content"))
    return calls, results.where("call_id is not null")


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls in conversations with a reference forward; the level is null on cycles.

    A call's level is one more than the highest among those it comes after. One round for each level.
    """
    node = calls.select("conv", "call_id", "turn", "index")
    place = node.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "index")).alias("place"))
    edge = calls.select("conv", "call_id", F.explode("after").alias("before")).distinct().join(
        place.select("conv", F.col("call_id").alias("before"), F.col("place").alias("other")), ["conv", "before"]).join(place, ["conv", "call_id"])
    knotted = edge.where("other >= place").select("conv").distinct()
    edge = cut(edge.join(knotted, "conv", "left_semi").select("conv", "call_id", "before"), "edges")
    open_ = cut(place.select("conv", "call_id").join(knotted, "conv", "left_semi"), "calls")
    found, level = open_.select("conv", "call_id").limit(0).withColumn("level", F.lit(0)), 0
    while not open_.isEmpty():
        waiting = edge.select("conv", "call_id").distinct()
        free = cut(open_.join(waiting, ["conv", "call_id"], "left_anti"), "free")
        if free.isEmpty():
            return found.unionByName(open_.withColumn("level", F.lit(None).cast("int")))
        found = found.unionByName(free.withColumn("level", F.lit(level)))
        open_ = cut(open_.join(free, ["conv", "call_id"], "left_anti"), "calls")
        edge = cut(edge.join(free.select("conv", F.col("call_id").alias("before")), ["conv", "before"], "left_anti"), "edges")
        level += 1
    return found


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], others: DataFrame | None = None) -> DataFrame:
    """One row for each call, for each result without a call, and for each of the ``others`` (conv, turn, role, text).

    ``calls``: conv, turn, index, call_id, name, arguments (JSON text), after (array of ids); ``results``: conv,
    turn, call_id, content. Rows: ``conv``, ``call_id``, ``name``, ``level``, ``turn``, ``index`` (ordered by these
    three, calls come after what they name), ``status`` (linked, unanswered, orphan, other), ``valid``, ``errors``, ``json``.
    The earliest result of an identifier counts, the smaller text on a tie; repeated calls stay, each
    linked. The level is the turn where turns are in order, else from ``levels``; null on cycles. Null identifiers
    link with nothing, null arguments are an empty object, names of unknown calls in ``after`` are ignored.
    Arguments that are no JSON, hold numbers that JSON does not have or are nested too deeply stay text and are not
    valid; lone surrogates are kept as escapes.
    """
    arrow_batches(calls.sparkSession)
    answer = results.where("conv is not null and call_id is not null").groupBy("conv", "call_id").agg(
        F.min(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("a"))
    joined = calls.drop("after").join(answer, ["conv", "call_id"], "left").select(
        "conv", "call_id", "name", "arguments", "turn", "index", F.col("a.content").alias("result"),
        F.when(F.col("a").isNull(), "unanswered").otherwise("linked").alias("status"))
    known = calls.select("conv", "call_id").distinct()
    stray = answer.join(known, ["conv", "call_id"], "left_anti").select(
        "conv", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("a.turn").alias("turn"),
        F.lit(0).alias("index"), F.col("a.content").alias("result"), F.lit("orphan").alias("status"))
    if others is not None:
        none = F.lit(None).cast("string")
        stray = stray.unionByName(others.select(
            "conv", F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string")).alias("call_id"), F.col("role").alias("name"),
            none.alias("arguments"), "turn", F.lit(0).alias("index"), F.col("text").alias("result"), F.lit("other").alias("status")))
    depth = levels(calls).withColumn("_knotted", F.lit(True))
    ordered = joined.unionByName(stray).join(depth, ["conv", "call_id"], "left").withColumn(
        "level", F.when(F.col("_knotted"), F.col("level")).otherwise(F.col("turn").cast("int"))).drop("_knotted")
    kind = lambda c: ordered.schema[c].dataType.simpleString()
    keep = ["conv", "call_id", "name", "turn", "index", "status", "level"]
    schema = ", ".join(f"`{c}` {kind(c)}" for c in keep) + ", valid boolean, errors array<string>, json string"
    return ordered.select("conv", "call_id", "name", "arguments", "turn", "index", "result", "status", "level").mapInArrow(_serialise(schemas), schema)


def turns_as_calls(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain conversations read as calls: a user turn asks for a reply and comes after the one before; an
    assistant turn is the result of the turn before it."""
    name = lambda back: F.concat_ws(":", F.col(conv).cast("string"), (F.col(turn) - back).cast("string"))
    calls = messages.where(F.col(role) == "user").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.lit(0).alias("index"), name(0).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col(turn).alias("turn"), F.col(text).alias("prompt"))).alias("arguments"), F.array(name(2)).alias("after"))
    results = messages.where(F.col(role) == "assistant").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(1).alias("call_id"), F.col(text).alias("content"))
    return calls, results


def other_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns that neither ask nor answer: system turns, other roles and rows without a role."""
    return messages.where(~F.coalesce(F.col(role).isin("user", "assistant"), F.lit(False))).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


REPLY = {"reply": {
    "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}
