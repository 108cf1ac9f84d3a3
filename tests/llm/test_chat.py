import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from starloom.llm import chat as C

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@given(JSON)
def test_canonical_json_round_trips_and_is_fixed(value):
    text = C.canonical(value)
    assert json.loads(text) == value and C.canonical(json.loads(text)) == text


def test_schemas():
    s = {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "k": {"enum": ["a", 1]}}, "required": ["n"], "additionalProperties": False}
    for value, want in [({"n": 1}, None), ({}, "$.n: missing"), ({"n": True}, "$.n: not integer"), ({"n": 1.5}, "$.n: not integer"), ({"n": 1, "x": 0}, "$.x: unknown"), ({"n": 1, "tags": ["a", 2]}, "$.tags[1]: not string"), ({"n": 1, "k": "b"}, "$.k: not in enum"), ([], "$: not object"), (None, "$: not object")]:
        assert C.violation(value, s) == want
    assert C.violation(2, {"type": ["number", "null"]}) is None and C.violation("x", {"type": ["number", "null"]}) == "$: not number/null"


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMA = {"f": {"type": "object", "required": ["x"]}}


def run(spark, calls, results):
    out = C.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA).collect()
    return {(r.conv_id, r.turn, r.kind): r for r in out}, len(out)


def test_linking_order_and_problems(spark):
    calls = [
        (1, 1, "a", "f", '{"x": 1, "b": [1.0, "é"]}', None), (1, 2, "b", "f", '{"x":2}', ["a"]), (1, 3, "c", "f", '{"x":2}', ["b", "a", "none"]), (1, 4, "d", "f", "{}", ["c"]), (1, 5, "e", "g", "{}", []), (1, 6, "h", "f", "oops", []),
        (2, 1, "a", "f", '{"x":1}', ["b"]), (2, 2, "b", "f", '{"x":1}', ["a"]), (2, 3, "c", "f", '{"x":1}', ["a"]), (3, 1, "a", "f", '{"x":1}', []), (3, 2, "a", "f", '{"x":1}', []), (4, 1, None, "f", '{"x":1}', []), (None, 1, "a", "f", None, None),
    ]
    results = [(1, k, i, None if k == 20 else "r") for k, i in enumerate("abcdeh", 20)] + [(2, 30, "a", "r"), (2, 31, "b", "r"), (2, 32, "c", "r"), (3, 30, "a", "r"), (1, 40, "zz", "r"), (2, 41, None, "r"), (None, 1, "a", "r")]
    got, n = run(spark, calls, results)
    assert n == len(calls) + len(results)
    status = {k: r.status for k, r in got.items()}
    assert [status[1, t, "call"] for t in range(1, 7)] == ["ok", "ok", "ok", "invalid", "invalid", "invalid"]
    assert [got[1, t, "call"].problem for t in (4, 5, 6)] == ["$.x: missing", "unknown function", "not JSON"]
    assert [got[1, t, "call"].place for t in range(1, 5)] == [0, 2, 4, 6] and got[1, 21, "result"].place == 3
    assert got[1, 1, "call"].json == '{"arguments":{"b":[1.0,"é"],"x":1},"id":"a","name":"f","type":"call"}' and got[1, 20, "result"].json == '{"content":null,"id":"a","type":"result"}'
    assert {status[2, t, "call"] for t in (1, 2, 3)} == {"cycle"} and {status[3, t, "call"] for t in (1, 2)} == {"repeated"}
    assert status[3, 30, "result"] == "repeated" and status[1, 40, "result"] == status[2, 41, "result"] == status[None, 1, "result"] == "orphan"
    assert status[4, 1, "call"] == status[None, 1, "call"] == "unanswered"
    for (conv, _, kind), r in got.items():
        json.loads(r.json)
        assert r.place is None or kind == "call" or r.place % 2 == 1, conv


def test_json_that_is_hard_to_write(spark):
    bodies = ['{"x":"\\ud800"}', "[" * 20_000 + "]" * 20_000, '{"x":' + "9" * 5000 + "}", '{"x":1e999}', '{"x":NaN}', '{"x":1,"x":2}', '{"x":1.0}', '{"\\udfff":1}', "x" * 3_000_000]
    got, _ = run(spark, [(1, k, str(k), "f", b, []) for k, b in enumerate(bodies)], [(1, 100 + k, str(k), "r") for k in range(len(bodies))])
    assert [got[1, k, "call"].problem for k in range(len(bodies))] == [None, "nested too deeply", "number too long", "number out of range", "not JSON", None, None, "$.x: missing", "not JSON"]
    assert got[1, 0, "call"].json.startswith('{"arguments":{"x":"\\ud800"}') and got[1, 5, "call"].json.startswith('{"arguments":{"x":2}') and got[1, 6, "call"].json.startswith('{"arguments":{"x":1.0}')
    for k in range(len(bodies)):
        assert json.loads(got[1, k, "call"].json)["id"] == str(k)


def test_empty_tables_and_conversations(spark):
    assert run(spark, [], [])[1] == 0
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 3, "user", None), (2, 0, "assistant", "x"), (None, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    calls, results = C.turns_as_calls(m)
    got = sorted((str(r.conv_id), r.turn, r.kind, r.status) for r in C.link(calls, results, C.REPLY).collect())
    assert got == [("1", 1, "call", "ok"), ("1", 2, "result", "ok"), ("1", 3, "call", "repeated"), ("1", 3, "call", "repeated"), ("2", 0, "result", "orphan"), ("None", 1, "call", "unanswered")]


@pytest.mark.parametrize("depth", [3, 12])
def test_long_chains(spark, depth):
    calls = [(1, k, str(k), "f", '{"x":1}', [str(k - 1)]) for k in range(depth)]
    got, _ = run(spark, calls, [(1, 100 + k, str(k), "r") for k in range(depth)])
    assert [got[1, k, "call"].place for k in range(depth)] == [2 * k for k in range(depth)]


def test_a_deep_graph_in_one_task(spark):
    after = {k: [str(x) for x in (k - 1, k - 2) if x >= 0] for k in range(300)}
    df = spark.createDataFrame([(c, str(k), v) for c in (1, 2) for k, v in after.items()], "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in C.levels(df).collect()}
    assert got == {(c, str(k)): k for c in (1, 2) for k in range(300)}


@pytest.mark.parametrize("gather", [0, 10**6])
def test_levels_of_a_random_graph(spark, gather):
    import random

    rng = random.Random(4)
    after = {k: sorted({rng.randrange(k) for _ in range(rng.choice([1, 1, 1, 1, 2, 3]))}) if k else [] for k in range(60)}
    after = after if gather else {k: v for k, v in after.items() if k < 25}
    after |= {70: [71], 71: [72], 72: [70], 73: [72], 74: [73, 1], 75: [74]}
    df = spark.createDataFrame([(1, str(k), [str(x) for x in v]) for k, v in after.items()], "conv_id long, call_id string, after array<string>")
    want: dict = {}
    for k in range(60 if gather else 25):
        want[str(k)] = 1 + max((want[str(x)] for x in after[k]), default=-1)
    assert {r.call_id: r.level for r in C.levels(df, gather).collect()} == want


@pytest.mark.parametrize("schema, place", [({"type": "text"}, "f: unknown type text"), ({"properties": {"x": {"type": ["string", "date"]}}}, "f.x: unknown type date"), ({"items": {"pattern": "a"}}, r"f\[\]: unknown keyword pattern"), ({"additionalProperties": {"type": "string"}}, "f: additionalProperties must be"), ([], "f: a schema must be")])
def test_schemas_are_checked_before_any_work(spark, schema, place):
    with pytest.raises(ValueError, match=place):
        C.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {"f": schema})
    assert C.checked({"title": "t", **SCHEMA["f"]})


def test_very_long_texts_and_columns_of_result_names(spark):
    long = "é" * 3_000_000
    calls = spark.createDataFrame([(1, 1, "a", "f", json.dumps({"x": long}), [], "s")], CALLS + ", status string")
    results = spark.createDataFrame([(1, 2, "a", long, 7)], RESULTS + ", place int")
    got = {r.kind: r for r in C.link(calls, results, SCHEMA).collect()}
    assert got["call"].status == got["result"].status == "ok" and got["result"].place == 1
    assert json.loads(got["call"].json)["arguments"]["x"] == long == json.loads(got["result"].json)["content"]
