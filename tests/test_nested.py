from __future__ import annotations

import json

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators.nested import SEP, child_objects, indices, read_json, rebuild_fields, rebuild_nodes, shred, shred_value



KEYS = st.sampled_from(["a", "b.c", "d[0]", "%s", "", "#attributes"])
VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text("xyz{[", max_size=4)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(KEYS, inner, max_size=4), st.dictionaries(KEYS, inner, min_size=1, max_size=3).map(json.dumps)),
    max_leaves=14,
)


def held(v):
    if isinstance(v, str) and len(v.strip()) >= 2 and v.strip()[0] + v.strip()[-1] in ("{}", "[]"):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def walk(v, path, parent, out):
    """Brute force: (node, parent) of all objects in arrays."""
    v = held(v)
    if isinstance(v, dict):
        for k, x in v.items():
            walk(x, f"{path}.{k}", parent, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            p = f"{path}[{i}]"
            if isinstance(held(x), dict):
                out.append((p, parent))
                walk(x, p, p, out)
            else:
                walk(x, p, parent, out)


def by_levels(v):
    """The same from the level sequences of the shredded value."""
    out = []
    for path, most, nodes, rep, de, _ in shred_value(v, "P"):
        steps = path.split(SEP)
        arrays = [i for i, s in enumerate(steps) if s == "[]"]
        at = indices(np.array(rep), len(arrays)).tolist()

        def name(n, idx):
            idx = iter(idx)
            return "".join(f"[{next(idx)}]" if s == "[]" else s for s in steps[:n])

        for level, need in enumerate(nodes, 1):
            if need:
                i = arrays[level - 1]
                up = max((a for a in arrays if a < i and steps[a + 1] != "[]"), default=0)
                out += [(name(i + 1, x), name(up + 1, x)) for x, r, d in zip(at, rep, de) if r <= level and d >= need]
    return out


def leaves(v, path, out):
    """Brute force: (path, text) of all scalars."""
    v = held(v)
    if isinstance(v, dict):
        for k, x in v.items():
            leaves(x, f"{path}.{k}", out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            leaves(x, f"{path}[{i}]", out)
    elif v is not None:
        out.append((path, v if isinstance(v, str) else json.dumps(v)))


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_levels_give_back_the_nodes(v):
    expected: list = []
    walk(v, "P", "P", expected)
    if isinstance(held(v), (dict, list)):
        assert sorted(by_levels(held(v))) == sorted(expected)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_levels_give_back_the_values(v):
    if not isinstance(held(v), (dict, list)):
        return
    expected: list = []
    leaves(v, "P", expected)
    got = []
    for path, most, _, rep, de, values in shred_value(held(v), "P"):
        if values is None:
            continue
        steps = [s for s in path.split(SEP) if s != "$"]
        for i, d, text in zip(indices(np.array(rep), steps.count("[]")).tolist(), de, values):
            if d == most:
                idx = iter(i)
                got.append(("".join(f"[{next(idx)}]" if s == "[]" else s for s in steps), text))
    assert sorted(got) == sorted(expected)


def test_levels_of_a_known_record():
    v = {"a": [{"b": [1, 2]}, {}, {"b": []}, None, {"b": [3]}]}
    got = {p.replace(SEP, ""): (most, nodes, rep, de, val) for p, most, nodes, rep, de, val in shred_value(v, "P")}
    # The values' column stands for the objects above it as well: 3 from where an element is an object.
    assert got == {"P.a[].b[]$": (6, [3, 0], [0, 2, 1, 1, 1, 1], [6, 6, 3, 4, 2, 6], ["1", "2", None, None, None, "3"])}
    got = {p.replace(SEP, ""): (most, nodes, rep, de, val) for p, most, nodes, rep, de, val in shred_value({"a": [{}, 5, {"b": None}]}, "P")}
    assert got == {"P.a[]{}": (3, [3], [0, 1, 1], [3, 2, 3], None), "P.a[]$": (3, [0], [0, 1, 1], [2, 3, 2], [None, "5", None])}


PAYLOADS = [
    ("1", '{"a": [{"x": 1}, null, {"y": [{"z": 2}]}]}', None),
    ("1", '{"a": [{"x": 1}, null, {"y": [{"z": 2}]}]}', None),
    ("2", '[[{"k": 1}], {"k": 2}]', '"{\\"s\\": [{\\"t\\": \\"u\\"}]}"'),
    ("3", '{"a": [{"x": 1}', "plain [text]"),
    ("4", "", None),
    (None, '{"a": [{}]}', None),
    ("5", '{"a": "\\u005b{\\"q\\": 1}]"}', "[NaN]"),
]


def test_operator(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in PAYLOADS], "RecordID string, E string, U string, path string, rep int")
    got = sorted(map(tuple, child_objects(df, "RecordID", ["E", "U"]).collect()), key=str)
    expected = [("1", "E.a[0]", "E"), ("1", "E.a[2]", "E"), ("1", "E.a[2].y[0]", "E.a[2]"), ("2", "E[0][0]", "E"), ("2", "E[1]", "E"), ("2", "U.s[0]", "U"), (None, "E.a[0]", "E"), ("5", "E.a[0]", "E")]
    assert got == sorted(expected, key=str)
    assert child_objects(df.limit(0), "RecordID", ["E", "U"]).count() == 0


def test_fields_know_their_table(spark):
    df = spark.createDataFrame([("1", '{"a": [{"x": 1, "o": {"y": true}}, 7], "t": "u"}')], "id string, P string")
    levels = shred(df, "id", ["P"])
    assert sorted(map(tuple, rebuild_fields(levels).collect())) == sorted([("1", "P.a[0]", "x", "1"), ("1", "P.a[0]", "o.y", "true"), ("1", "P.a[1]", "", "7"), ("1", "P", "t", "u")])
    assert [tuple(r) for r in rebuild_nodes(levels).collect()] == [("1", "P.a[0]", "P")]


def test_long_and_deep_payloads(spark):
    wide = json.dumps({"a": [{"i": i} for i in range(20_000)]})
    deep = "[" * 300 + '{"x":1}' + "]" * 300
    df = spark.createDataFrame([("w", wide), ("d", deep), ("t", "[" * 100_000)], "id string, P string")
    n = {r["record_id"]: r["count"] for r in child_objects(df, "id", ["P"]).groupBy("record_id").count().collect()}
    assert n == {"w": 20_000, "d": 1}


def test_read_json_rules():
    assert read_json('"\\"{}\\""') == {}
    assert read_json("12") is None and read_json("nan") is None and read_json(None) is None


def test_five_thousand_nested_pairs(spark):
    n = 5_000
    text = '{"a":[' * n + "1" + "]}" * n
    # So deep a value only: the paths of all of its objects together are long.
    v = read_json(text)
    nodes = [x for _, _, nodes, *_ in shred_value(v, "P") for x in nodes]
    assert sum(x > 0 for x in nodes) == n - 1
    df = spark.createDataFrame([("d", '{"a":[' * 2_000 + "1" + "]}" * 2_000), ("e", '[{"x": 1}]')], "id string, P string")
    got = {r["record_id"]: r["count"] for r in child_objects(df, "id", ["P"]).groupBy("record_id").count().collect()}
    assert got == {"d": 1_999, "e": 1}
