import json

import pytest

from cartospark.llm.tool_calls import SCHEMA_DDL, link_tool_calls

CALLS = "conv_id long, pos long, call_id string, tool string, arguments string, after string, kind string"
RESULTS = "conv_id long, pos long, call_id string, content string"
SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("find", "q", "string", True), ("find", "tags", "array", False), ("find", "opt", "object", False), ("find", "on", "boolean", False), ("find", "no", "null", False)]


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    r = spark.createDataFrame(results, RESULTS)
    return link_tool_calls(c, r, spark.createDataFrame(SCHEMAS, SCHEMA_DDL)).collect()


def test_linking(spark):
    rows = run(
        spark,
        [(1, 0, "x", "add", '{"b": 2.50, "a": 1}', None), (1, 2, "y", "add", '{"a":1}', None), (1, 3, None, "add", '{"a":1,"b":2}', None), (1, 4, "x", "add", "{}", None), (2, 0, "x", "other", '{"z":[1,{"b":1,"a":2}]}', None), (None, 0, "x", "add", None, None)],
        [(1, 1, "x", "three"), (1, 5, "x", "late"), (1, 6, "q", 'a "quoted"\ntext é'), (1, 7, None, "n"), (None, 1, "x", "for null")],
    )
    got = {(r.conv_id, r.kind, r.pos): (r.status, r.errors) for r in rows}
    assert got == {
        (1, "call", 0): ("linked", []), (1, "call", 2): ("no result", ["missing:b"]), (1, "call", 3): ("no id", []), (1, "call", 4): ("duplicate", ["missing:a", "missing:b"]), (2, "call", 0): ("no result", []),
        (None, "call", 0): ("linked", ["not an object"]), (1, "result", 1): ("linked", []), (1, "result", 5): ("duplicate", []), (1, "result", 6): ("no call", []), (1, "result", 7): ("no id", []), (None, "result", 1): ("linked", []),
    }
    text = {(r.conv_id, r.kind, r.pos): r.json for r in rows}
    assert text[1, "call", 0] == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","type":"call"}'
    assert text[2, "call", 0] == '{"arguments":{"z":[1,{"a":2,"b":1}]},"id":"x","name":"other","type":"call"}'
    assert json.loads(text[1, "result", 6]) == {"content": 'a "quoted"\ntext é', "id": "q", "type": "result"}
    for t in text.values():
        o = json.loads(t)
        assert list(o) == sorted(o)


def plain_errors(tool, text):
    spec = {k: (t, r) for n, k, t, r in SCHEMAS if n == tool}
    try:
        o = json.loads(text)
    except (ValueError, TypeError):
        return ["not an object"]
    if not isinstance(o, dict):
        return ["not an object"]
    if not spec:
        return []
    is_kind = {"integer": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float), "string": lambda v: type(v) is str, "array": lambda v: type(v) is list, "object": lambda v: type(v) is dict, "boolean": lambda v: type(v) is bool, "null": lambda v: v is None}
    wrong = [f"unknown:{k}" if k not in spec else f"type:{k}" for k, v in o.items() if k not in spec or not is_kind[spec[k][0]](v)]
    return sorted(wrong + [f"missing:{k}" for k, (_, r) in spec.items() if r and k not in o])


def test_validation(spark):
    texts = ['{"a":1,"b":2}', '{"a":"1","b":2}', '{"a":1.5,"b":1}', '{"a":1,"b":2.25,"note":"n"}', '{"a":1,"b":2,"c":3}', "[1]", "{", '"s"', "{}", '{"q":"x","tags":[1],"opt":{"k":1},"on":true,"no":null}', '{"q":1,"tags":{},"opt":[],"on":"t","no":0}', '{"q":null}', None, "", '{"a":' + "9" * 30 + ',"b":1}']
    calls = [(i, k, f"c{k}", tool, t, None) for i, tool in enumerate(("add", "find", "free")) for k, t in enumerate(texts)]
    for r in run(spark, calls, []):
        tool, text = ("add", "find", "free")[r.conv_id], texts[r.pos]
        assert r.errors == plain_errors(tool, text), (tool, text)


def test_schemas_with_objects_values_and_bounds(spark):
    from cartospark.llm.tool_calls import SCHEMA_MORE, validate

    schema = [
        ("t", "n", "integer", True, None, None, 1.0, 10.0, None), ("t", "unit", "string", False, None, ['"km"', '"m"'], None, None, None), ("t", "at", "object", True, None, None, None, None, None),
        ("t", "x", "number", True, ["at"], None, None, 90.0, None), ("t", "deep", "object", False, ["at"], None, None, None, None), ("t", "k", None, True, ["at", "deep"], None, None, None, None),
        ("open", "a", "string", False, None, None, None, None, True), ("none", None, None, None, None, None, None, None, None),
    ]
    cases = [
        ("t", '{"n":5,"at":{"x":1.5}}', []), ("t", '{"n":11,"unit":"mile","at":{"x":91}}', ["allowed:unit", "range:at.x", "range:n"]), ("t", '{"n":5,"at":{}}', ["missing:at.x"]), ("t", '{"n":5,"at":3}', ["type:at"]),
        ("t", '{"n":5,"at":{"x":1,"y":2,"deep":{}}}', ["missing:at.deep.k", "unknown:at.y"]), ("t", '{"n":5,"at":{"x":1,"deep":{"k":null,"l":1}}}', ["unknown:at.deep.l"]), ("t", '{"n":20000000000000000000,"at":{"x":1}}', ["range:n"]),
        ("open", '{"b":1,"a":"x"}', []), ("none", "{}", []), ("none", '{"a":1}', ["unknown:a"]), ("t", '{"n":1,"n":2}', ["not an object"]), (None, "{}", []),
    ]
    calls = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i long, tool string, arguments string")
    rows = validate(calls, spark.createDataFrame(schema, f"{SCHEMA_DDL}, {SCHEMA_MORE}")).collect()
    assert {r.i: r.errors for r in rows} == {i: e for i, (_, _, e) in enumerate(cases)}


def test_canonical_json_of_bad_and_null_values(spark):
    rows = run(spark, [(1, 0, "x", "add", '{"b": 1, "a": "2"}', None), (1, 1, None, None, None, None), (1, 2, "y", "add", '{"a": ', None)], [(1, 3, "z", None)])
    assert {r.pos: r.json for r in rows} == {
        0: '{"arguments":{"a":"2","b":1},"id":"x","name":"add","type":"call"}', 1: '{"arguments":null,"id":null,"name":null,"type":"call"}',
        2: '{"arguments":"{\\"a\\": ","id":"y","name":"add","type":"call"}', 3: '{"content":null,"id":"z","type":"result"}',
    }


def test_order(spark):
    """b needs a's result, which the log shows later; c needs b's; d and e need each other's."""
    rows = run(
        spark,
        [(1, 0, "b", "t", "{}", "a"), (1, 1, "c", "t", "{}", "b"), (1, 5, "a", "t", "{}", None), (1, 9, "z", "t", "{}", None), (2, 0, "d", "t", "{}", "e"), (2, 1, "e", "t", "{}", "d"), (3, 0, "p", "t", "{}", None), (3, 2, "q", "t", "{}", "p")],
        [(1, 2, "b", ""), (1, 3, "c", ""), (1, 6, "a", ""), (1, 10, "z", ""), (2, 2, "d", ""), (2, 3, "e", ""), (3, 1, "p", ""), (3, 3, "q", "")],
    )
    order = sorted(rows, key=lambda r: (r.conv_id, r.order_pos, r.depth, r.pos, r.kind, r.call_id))
    assert [(r.call_id, r.kind) for r in order if r.conv_id == 1] == [("a", "call"), ("a", "result"), ("b", "call"), ("b", "result"), ("c", "call"), ("c", "result"), ("z", "call"), ("z", "result")]
    assert {r.status for r in rows if r.conv_id == 2} == {"cycle"}
    assert [(r.call_id, r.kind, r.order_pos) for r in order if r.conv_id == 3] == [("p", "call", 0), ("p", "result", 1), ("q", "call", 2), ("q", "result", 3)]


def test_long_chain_and_repeats(spark):
    n = 40
    calls = [(1, n - i, f"k{i}", "t", "{}", f"k{i - 1}" if i else None) for i in range(n)]
    results = [(1, n - i, f"k{i}", "r") for i in range(n)]
    order = sorted(run(spark, calls * 2, results), key=lambda r: (r.order_pos, r.depth, r.pos, r.kind, r.call_id))
    assert len(order) == 3 * n
    seen = []
    for r in order:
        if r.call_id not in seen:
            seen.append(r.call_id)
    assert seen == [f"k{i}" for i in range(n)]


def test_no_python_in_the_plan(spark):
    from cartospark.llm.queries import op3_sharding, op10_tool_calls

    for query in (op10_tool_calls, op3_sharding):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert run(spark, [], []) == []


@pytest.mark.parametrize("turns", [200])
def test_conversations(spark, tiny, turns):
    from cartospark.llm.queries import op10_tool_calls

    table = spark.read.parquet(f"{tiny}/conversations.parquet")
    rows = op10_tool_calls(spark, tiny).collect()
    assert len(rows) == table.count() and all(json.loads(r.json) for r in rows)
    texts = {(r.conv_id, r.turn * 37 % 101): r for r in table.collect()}
    order = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.order_pos, r.depth, r.pos)):
        o, turn = json.loads(r.json), texts[r.conv_id, r.pos]
        assert (o["content"] if r.kind == "result" else o["arguments"]["text"]) == turn.text and r.errors == []
        order.setdefault(r.conv_id, []).append(turn)
    for own in order.values():  # every answer after its question, every question after the answer that it needs
        place = {t.turn: i for i, t in enumerate(own)}
        assert all(place[t.turn - 1] < place[t.turn] for t in own if t.role == "assistant" and t.turn - 1 in place)
        assert all(place[t.turn - 1] < place[t.turn] for t in own if t.role == "user" and own[place.get(t.turn - 1, 0)].role == "assistant" and t.turn - 1 in place)
    assert any([t.turn for t in own] != sorted((t.turn for t in own), key=lambda t: t * 37 % 101) for own in order.values())
