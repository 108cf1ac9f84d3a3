"""Tool-call linking for chat data: calls joined to results, put in topological order, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written

#: JSON types of a schema's properties; an integer is a number too, a boolean neither.
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: The keywords that are judged, and those that say nothing of a value.
_KEYWORDS = {"type", "properties", "required", "additionalProperties", "items", "enum"} | {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
#: Waits of a conversation up to which one task orders its calls; those of a larger one are settled level by level.
GATHER = 100_000
_SURROGATE = re.compile("[\ud800-\udfff]")


class Refused(ValueError):
    """JSON that can't be written canonically; says why."""


def _integer(digits: str) -> int:
    if len(digits) > 4000:
        raise Refused("number too long")
    return int(digits)


def _constant(name: str):
    raise Refused("not JSON")


def parsed(text: str):
    """The value of a JSON text; of repeated keys the last counts.  Raises Refused."""
    try:
        return json.loads(text, parse_int=_integer, parse_constant=_constant)
    except Refused:
        raise
    except RecursionError:
        raise Refused("nested too deeply") from None
    except ValueError:
        raise Refused("not JSON") from None


def canonical(value) -> str:
    """JSON with keys in code-point order, no spaces, no escapes but the needed ones.  Numbers keep their kind, so that 1 and
    1.0 differ; half of a surrogate pair is escaped; infinite numbers and too deep values raise Refused."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        raise Refused("nested too deeply") from None
    except ValueError:
        raise Refused("number out of range") from None
    return _escaped(text)


def _escaped(text: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def checked(schema: dict, at: str = "$") -> dict:
    """The schema, if violation can judge all of it: known keywords and types alone; a ValueError says what is not."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    if strange := sorted(set(schema) - _KEYWORDS):
        raise ValueError(f"{at}: unknown keyword {', '.join(strange)}")
    kinds = schema.get("type", [])
    for k in kinds if isinstance(kinds, list) else [kinds]:
        if k not in _TYPES:
            raise ValueError(f"{at}: unknown type {k}")
    for name, part in schema.get("properties", {}).items():
        checked(part, f"{at}.{name}")
    if "items" in schema:
        checked(schema["items"], f"{at}[]")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    return schema


def violation(value, schema: dict, at: str = "$") -> str | None:
    """The first place where a value breaks a schema (type, properties, required, additionalProperties, items, enum), or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        fits = any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds)
        if not fits or isinstance(value, float) and not math.isfinite(value):
            return f"{at}: not {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := violation(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := violation(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def levels(calls: DataFrame, gather: int = GATHER) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after: ids that a call waits for): 0 without any, else one more
    than the highest of them.  Ids that name no call are not waited for; calls in or behind a cycle get no row.

    Calls that wait for one other form chains, whose ends are found by doubling pointers, in as many rounds as the longest
    has binary digits.  What remains, the calls that wait for several, is ordered by one task for each conversation, or level
    by level where it has more than gather waits.
    """
    key = ["conv_id", "call_id"]
    waits = calls.select(*key, F.explode("after").alias("on")).where("`on` is not null").distinct()
    waits = written(waits.join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi"), "waits", True)
    one = written(waits.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("to")).where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("far")), "chains", True)
    chains = one
    longest = one.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    for _ in range(longest.bit_length() + 1):
        ahead = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        step = chains.join(ahead, ["conv_id", "to"], "left")
        chains = written(step.select(*key, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")), "chains", True)
        if chains.where("moved").isEmpty():
            break
    chains = chains.select(*key, "to", "far").join(one.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti")  # else it goes round

    several = waits.join(one.select(*key), key, "left_anti")
    total = written(calls.select(*key).join(waits.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0).cast("long")), "level", True)
    ends = chains.select("conv_id", F.col("call_id").alias("on"), F.col("to").alias("end"), "far")
    several = several.join(ends, ["conv_id", "on"], "left").select(*key, F.coalesce("end", "on").alias("on"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    several = several.join(total.select("conv_id", F.col("call_id").alias("on"), "level"), ["conv_id", "on"], "left").select(*key, "on", "far", "level")
    several = written(several, "waits", True)
    size = written(several.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes", True)
    small = several.join(size.where(F.col("n") <= gather).select("conv_id"), "conv_id").repartition("conv_id").sortWithinPartitions("conv_id")
    kinds = {f.name: f.dataType.simpleString() for f in several.schema}
    found = [total, small.select(*key, "on", "far", "level").mapInArrow(_ordered, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, level long")]
    several = written(several.join(size.where(F.col("n") > gather).select("conv_id"), "conv_id").select(*key, "on", "far", "level"), "waits", True)
    while not several.isEmpty():
        state = several.groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("met"), F.max(F.col("level") + F.col("far")).alias("level"))
        fresh = written(state.where("n = met").select(*key, "level"), "level", True)
        if fresh.isEmpty():
            break
        found.append(fresh)
        rest = several.join(fresh.select(*key), key, "left_anti").join(fresh.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("got")), ["conv_id", "on"], "left")
        several = written(rest.select(*key, "on", "far", F.coalesce("level", "got").alias("level")), "waits", True)
        if len(found) > 50:
            found = [written(reduce(DataFrame.union, found), "level", True)]
    total = written(reduce(DataFrame.union, found), "level", True)
    ends = total.select("conv_id", F.col("call_id").alias("to"), "level")
    return total.union(chains.join(ends, ["conv_id", "to"]).select(*key, F.col("level") + F.col("far")))


def _ordered(batches):
    """Levels of the calls (conv_id, call_id, on, far, level of on if known) of whole conversations, sorted by conversation."""
    conv, rows = None, []

    def settled():
        waits, behind, level = {}, {}, {}
        for call, on, far, known in rows:
            level.setdefault(call, 0)
            waits.setdefault(call, 0)
            if known is not None:
                level[call] = max(level[call], known + far)
            else:
                waits[call] += 1
                behind.setdefault(on, []).append((call, far))
        ready = [c for c, n in waits.items() if not n]
        for c in ready:  # grows as calls become ready
            for call, far in behind.get(c, ()):
                level[call] = max(level[call], level[c] + far)
                waits[call] -= 1
                if not waits[call]:
                    ready.append(call)
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(ready), kind[0]), pa.array(ready, kind[1]), pa.array([level[c] for c in ready], pa.int64())], names=["conv_id", "call_id", "level"])

    for batch in batches:
        kind = batch.schema.types
        for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv and rows:
                yield settled()
                rows = []
            conv = c
            rows.append(row)
    if rows:
        yield settled()


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and result: conv_id, turn, kind, call_id, status, problem, place, json.

    calls: conv_id, turn, call_id, name, arguments (JSON), after (array of call ids).  results: conv_id, turn, call_id,
    content.  status of a call: `repeated` if its conversation has its id more than once, `unanswered` without a result,
    `cycle` if it waits for itself, `invalid` if its arguments aren't JSON or break its function's schema (problem says
    where; an unknown function is a problem too; so are numbers of over 4,000 digits or beyond a double, and
    too deep nesting, whose arguments are then written as the string they came as), else `ok`.  status of a result: `orphan` without a call, `repeated` if
    call or result is there more than once, else `ok`.  place is twice the call's level, and one more for its result, so
    that sorting a conversation by (place, turn) is a topological order; null where there is none.  Null ids link with
    nothing: such calls are unanswered, such results orphans.  A null content is the JSON null.  Columns beyond these aren't
    looked at.  A schema with a type or keyword that can't be judged is a ValueError before any work.
    """
    for name, schema in schemas.items():
        checked(schema, name)
    key = ["conv_id", "call_id"]
    n_calls = written(calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.count("*").alias("n_calls")), "calls", True)
    n_results = written(results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.count("*").alias("n_results")), "results", True)
    both = written(n_calls.join(n_results, key, "full").na.fill(0, ["n_calls", "n_results"]), "links", True)
    single = calls.join(both.where("n_calls = 1").select(*key), key, "left_semi").select(*key, F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    level = written(levels(written(single, "single")), "levels", True)

    rows = calls.join(both, key, "left").join(level, key, "left")
    called = rows.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "n_calls", "n_results", "level", "name", F.col("arguments").alias("body"))
    rows = results.join(both, key, "left").join(level, key, "left")
    answered = rows.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "n_calls", "n_results", "level", F.lit(None).cast("string").alias("name"), F.col("content").alias("body"))

    def write(batches):
        for batch in batches:
            status, problems, places, texts = [], [], [], []
            for _, _, kind, call_id, n_calls, n_results, level, name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                problem = None
                if kind == "call":
                    try:
                        value = parsed(body) if body is not None else None
                        text = canonical(value)
                        problem = violation(value, schemas[name]) if name in schemas else "unknown function"
                    except Refused as e:
                        problem, text = str(e), canonical(body)
                    except RecursionError:
                        problem, text = "nested too deeply", canonical(body)
                    state = "repeated" if (n_calls or 0) > 1 else "unanswered" if not n_results else "cycle" if level is None else "invalid" if problem else "ok"
                    texts.append(f'{{"arguments":{text},"id":{canonical(call_id)},"name":{canonical(name)},"type":"call"}}')
                else:
                    state = "orphan" if not n_calls else "repeated" if n_calls > 1 or n_results > 1 else "ok"
                    texts.append(f'{{"content":{canonical(body)},"id":{canonical(call_id)},"type":"result"}}')
                status.append(state)
                problems.append(problem and _escaped(problem))
                places.append(None if level is None or state in ("repeated", "orphan") else 2 * level + (kind == "result"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(status, pa.string()), pa.array(problems, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["conv_id", "turn", "kind", "call_id", "status", "problem", "place", "json"])

    flow = called.union(answered)
    kinds = {f.name: f.dataType.simpleString() for f in flow.schema}
    return flow.mapInArrow(write, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, kind string, call_id string, status string, problem string, place long, json string")


#: What a user's turn asks of the assistant, as a function.
REPLY = {"reply": {"type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"], "additionalProperties": False}}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool calls: a user's turn calls `reply`, waiting for the call two turns earlier; the assistant's turn
    after it is its result."""
    named = lambda back: F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    ident = lambda back: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), named(back))
    user = messages.where("role = 'user'")
    body = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = user.select("conv_id", "turn", ident(0).alias("call_id"), F.lit("reply").alias("name"), body.alias("arguments"), F.array(ident(2)).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*turns_as_calls(read(spark, sf_dir, "conversations")), REPLY)


OP2_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || '.' || turn AS id, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '.' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
nc AS (SELECT id, count(*) AS n FROM c GROUP BY 1), nr AS (SELECT id, count(*) AS n FROM r GROUP BY 1),
one AS (SELECT c.conv_id, c.turn, c.id FROM c JOIN nc USING (id) WHERE n = 1),
lv AS (SELECT conv_id, turn, id, 0 AS level FROM one WHERE conv_id || '.' || (turn - 2) NOT IN (SELECT id FROM one)
  UNION ALL SELECT o.conv_id, o.turn, o.id, lv.level + 1 FROM lv JOIN one o ON o.conv_id = lv.conv_id AND o.turn = lv.turn + 2)
SELECT c.conv_id, c.turn, 'call' AS kind, c.id AS call_id, CASE WHEN nc.n > 1 THEN 'repeated' WHEN nr.n IS NULL THEN 'unanswered' WHEN c.text IS NULL THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN c.text IS NULL THEN '$.text: not string' END AS problem, CASE WHEN nc.n = 1 THEN 2 * lv.level END::BIGINT AS place,
  '{"arguments":{"text":' || coalesce(to_json(c.text)::VARCHAR, 'null') || ',"turn":' || c.turn || '},"id":"' || c.id || '","name":"reply","type":"call"}' AS json
FROM c JOIN nc USING (id) LEFT JOIN nr USING (id) LEFT JOIN lv USING (id)
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.id, CASE WHEN nc.n IS NULL THEN 'orphan' WHEN nc.n > 1 OR nr.n > 1 THEN 'repeated' ELSE 'ok' END, NULL,
  CASE WHEN nc.n = 1 AND nr.n = 1 THEN 2 * lv.level + 1 END::BIGINT, '{"content":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"id":"' || r.id || '","type":"result"}'
FROM r LEFT JOIN nc USING (id) JOIN nr USING (id) LEFT JOIN lv USING (id)
"""
