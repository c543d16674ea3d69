import json
import random

from relrank.llm.queries import ORACLE, QUERIES
from relrank.llm.tool_calls import levels, link_tool_calls

CALLS = "conv_id long, call_id string, parent_id string, seq long, name string, arguments string"
RESULTS = "conv_id long, call_id string, seq long, content string"
SCHEMAS = "name string, field string, kind string, required boolean"
TOOL = [("t", "a", "integer", True), ("t", "b", "number", False), ("t", "c", "array", None), (None, "x", "string", True), ("u", None, "string", True)]


def linked(spark, calls, results, schemas=TOOL):
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((calls, CALLS), (results, RESULTS), (schemas, SCHEMAS)))
    return link_tool_calls(*frames)


def test_levels_of_random_forests(spark):
    draw, rows, want = random.Random(3), [], {}
    for conv in range(30):
        ids = [f"{conv}.{i}" for i in range(draw.randrange(1, 60))]
        draw.shuffle(ids)
        for i, own in enumerate(ids):
            chain = conv % 3 == 0
            parent = None if i == 0 or draw.random() < 0.1 else ids[i - 1] if chain else draw.choice([*ids[:i], "elsewhere"])
            rows.append((conv, own, parent))
            want[own] = want[parent] + 1 if parent in want else 0
    rows += [(99, "x", "y"), (99, "y", "z"), (99, "z", "x"), (99, "w", "x"), (99, "s", "s"), (99, "ok", None), (98, "q", "ok")]
    want |= {"x": None, "y": None, "z": None, "w": None, "s": None, "ok": 0, "q": 0}
    found = levels(spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string"))
    assert {r.call_id: r.level for r in found.collect()} == want


def test_arguments_are_checked(spark):
    cases = {
        '{"a": 1}': "", '{"b": 1.5, "a": 2}': "", '{"a": 1, "b": 2}': "", '{"a": 1, "c": [1]}': "", '{"b": 1}': "missing a",
        '{"a": 1.5}': "wrong a", '{"a": null}': "wrong a", '{"a": 1, "z": 2, "c": {}}': "unknown z; wrong c", "{}": "missing a",
        "[1]": "no object", '{"a": 1': "no object", '{"a":1,"a":2}': "no object", "": "no object", None: "no object",
    }
    calls = [(1, str(i), None, i, "t", a) for i, a in enumerate(cases)] + [(1, "n", None, 99, "other", "{}"), (1, "m", None, 99, None, "{}")]
    rows = linked(spark, calls, []).collect()
    found = {r.call_id: r.problems for r in rows}
    assert found == {**{str(i): p for i, p in enumerate(cases.values())}, "n": "no schema", "m": "no schema"}
    for r in rows:
        assert r.status == ("invalid" if r.problems else "no result")
        parsed = json.loads(r.json)
        assert r.json == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        given = dict((c[1], c[5]) for c in calls)[r.call_id]
        try:
            assert given.count('"a"') > 1 or parsed["arguments"] == json.loads(given)
        except (AttributeError, ValueError):
            assert parsed["arguments"] == given


def test_hard_cases(spark):
    long = 'é "quoted" \\ \n\t' * 20_000
    calls = [(1, "a", None, 1, "t", '{"a":1}'), (1, "a", None, 0, "t", '{"a":2}'), (1, "a", None, 0, "t", '{"a":2}'), (None, "a", None, 1, "t", '{"a":1}'),
             (1, None, "a", 1, "t", '{"a":1}'), (1, None, "a", 1, "t", '{"a":1}'), (2, "a", "a", 1, "t", '{"a":1}'), (1, "b", "a", None, "t", '{"a":1}')]
    results = [(1, "a", 5, "late"), (1, "a", 3, long), (1, "zz", 4, None), (None, None, 4, ""), (2, "a", 9, "x")]
    rows = linked(spark, calls, results).collect()
    state = sorted((str(r.conv_id), str(r.call_id), str(r.seq), str(r.level), r.status) for r in rows)
    assert state == sorted([
        ("1", "a", "0", "0", "linked"), ("None", "a", "1", "0", "no result"), ("1", "None", "1", "0", "no result"), ("1", "None", "1", "0", "no result"),
        ("2", "a", "1", "None", "cycle"), ("1", "b", "None", "1", "no result"), ("1", "zz", "4", "None", "no call"), ("None", "None", "4", "None", "no call"),
    ])
    first = next(r for r in rows if (r.conv_id, r.call_id) == (1, "a"))
    assert json.loads(first.json)["content"] == long and json.loads(first.json)["arguments"] == {"a": 2}
    assert linked(spark, [], []).count() == 0
    extra = spark.createDataFrame(calls, CALLS).selectExpr("*", "1 as level", "2 as status", "3 as asked", "4 as up", "5 as content")
    assert link_tool_calls(extra, spark.createDataFrame(results, RESULTS), spark.createDataFrame(TOOL, SCHEMAS)).count() == len(rows)


def test_query(spark):
    import verify

    con = verify.oracle("/root/testdata/sf0.01")
    mine = QUERIES["op5_tool_calls"](spark, "/root/testdata/sf0.01")
    theirs = con.sql(ORACLE["op5_tool_calls"])
    assert verify._sorted(mine.columns, [tuple(r) for r in mine.collect()]) == verify._sorted(theirs.columns, theirs.fetchall())
    assert "Python" not in mine._jdf.queryExecution().executedPlan().toString()
