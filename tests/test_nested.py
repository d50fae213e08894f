"""Structural comparison of nested values against a plain version."""

import json
import random

from granary.operators import nested as N


def plain(text):
    """{path: (kind, value)} of a JSON text."""
    out, todo = {}, [("", json.loads(text))]
    while todo:
        path, x = todo.pop()
        if isinstance(x, (dict, list)):
            out[path] = ("object" if isinstance(x, dict) else "array", None)
            todo += [(f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))]
        elif x is None or isinstance(x, bool):
            out[path] = ("null", None) if x is None else ("boolean", str(x).lower())
        elif isinstance(x, str):
            out[path] = ("string", x)
        else:
            out[path] = ("integer", str(x)) if isinstance(x, int) else ("double", x + 0.0)
    return out


def value(r, depth):
    if depth and r.random() < 0.7:
        n = r.randrange(4)
        return {r.choice(["a", "b", "c/d", "e~f", "", "0", "é"]): value(r, depth - 1) for _ in range(n)} if r.random() < 0.6 else [value(r, depth - 1) for _ in range(n)]
    return r.choice([None, True, False, 0, 1, -7, 1.0, 0.5, 1e300, -0.25, "", "1", "x y", 'q"\\', 2**70, -(2**63)])


def test_against_a_plain_version(spark):
    r = random.Random(11)
    texts = [(i, json.dumps(value(r, 5)), json.dumps(value(r, 5))) for i in range(150)]
    deep = '{"k":[' * 12 + "%s" + "]}" * 12
    texts += [(200, deep % 1, deep % 1), (201, deep % 1, deep % "1.0"), (202, '{"b":1.50,"a":[1e0]}', '{"a":[1.0],"b":1.5}'), (203, "[]", "{}"), (204, '{"a":[]}', '{"a":[[]]}')]
    made = spark.createDataFrame(texts, "k int, a string, b string")
    found = {}
    for x in N.differences(made, "k", "a", "b").collect():
        found[(x.k, x.path)] = (x.change, x.left_kind, float(x.left_value) if x.left_kind == "double" else x.left_value, x.right_kind, float(x.right_value) if x.right_kind == "double" else x.right_value)
    want = {}
    for k, a, b in texts:
        left, right = plain(a), plain(b)
        for path in left.keys() | right.keys():
            one, two = left.get(path), right.get(path)
            if one != two:
                change = "added" if one is None else "removed" if two is None else "retyped" if one[0] != two[0] else "changed"
                want[(k, path)] = (change, *(one or (None, None)), *(two or (None, None)))
    assert found == want
    equal = {x.k: x.equal for x in N.strictly_equal(made, "k", "a", "b").collect()}
    assert equal == {k: plain(a) == plain(b) for k, a, b in texts} and equal[200] and equal[202] and not equal[201]


def test_texts_that_are_no_value(spark):
    """Null, malformed text, text after the value, repeated keys; and differences that are allowed."""
    texts = [(1, None, "1"), (2, None, None), (3, "{", "{"), (4, '{"a":1,"a":1}', '{"a":1}'), (5, "[1] x", "[1]"), (6, "1]", "1"), (7, "1,2", "1"), (8, "", "1"), (9, '{"a":[1,2],"b":1}', '{"a":[1,3],"b":"1"}'), (10, " [1]\n", "[1]")]
    made = spark.createDataFrame(texts, "k int, a string, b string")
    assert {x.k: x.equal for x in N.strictly_equal(made, "k", "a", "b").collect()} == {1: None, 2: None, 10: True} | dict.fromkeys(range(3, 10), False)
    allowed = spark.createDataFrame([("/a/*", "changed")], "shape string, change string")
    found = {(x.k, x.path): x.change for x in N.differences(made, "k", "a", "b", allowed).collect()}
    assert found == {(1, ""): "added", (9, "/b"): "retyped"} | {(k, ""): "malformed" for k in range(3, 9)} | {(4, "/a"): "added", (5, "/0"): "added"}
    assert N.differences(made.where("false"), "k", "a", "b").count() == 0
    plan = N.strictly_equal(made, "k", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    """Rows in one file are compared by many tasks."""
    monkeypatch.setattr(N, "TASK_ROWS", 100)
    made = spark.range(0, 5000, 1, 1).selectExpr("id AS k", """concat('{"a":[', id, ']}') AS a""", """concat('{"a":[', id % 10, ']}') AS b""")
    found = N.differences(made, "k", "a", "b")
    assert found.rdd.getNumPartitions() == 50 and found.count() == 4990
