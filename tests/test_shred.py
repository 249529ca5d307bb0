import json

import numpy as np

from skein.operators import shred
from tests.conftest import rows


def walk(value, path, parent):
    """Brute force: every object that is an element of an array."""
    out = []
    if isinstance(value, list):
        for i, x in enumerate(value):
            here = f"{path}[{i}]"
            if isinstance(x, dict):
                out.append((here, parent))
                for k, v in x.items():
                    out += walk(v, f"{here}.{k}", here)
            else:
                out += walk(x, here, parent)
    elif isinstance(value, dict):
        for k, v in value.items():
            out += walk(v, f"{path}.{k}", parent)
    return out


RECORDS = [
    {"result": [{"to": {"tags": [1, {"a": []}, None, {"b": [{"c": 1}]}]}}, None, [[{"x": 1}], {"y": [[], [{"z": 2}]]}]]},
    {"params": {"items": [{"n": 1}, {"items": [{"n": 2}]}], "other": {"items": [{}]}}},
    {"params": [], "result": None},
    {"params": {"a": {"b": {"c": [{"d": [{"e": [{}]}]}]}}}},
    {"result": "[{\"deep\": [{}, {}]}]", "params": "no json"},
    {"result": "3"},
    {"result": [{"mixed": [{"p": 1}, 2, "s", [], {}]}, {"mixed": None}, {"mixed": {"q": [{}]}}]},
]


def expected(record):
    out = []
    for root in ("params", "result"):
        value = record.get(root)
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                continue
        out += walk(value, root, root)
    return out


def test_objects_match_a_plain_walk(spark):
    data = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(50, None), (51, "{broken"), (52, "[1]"), (53, ""), (0, json.dumps(RECORDS[0]))]
    df = spark.createDataFrame(data, "msg bigint, body string").selectExpr("*", "1 AS record_id", "'x' AS obj_path")
    got = rows(shred.json_objects(df, "msg", "body", ("params", "result")))
    assert got == sorted([(i, o, p) for i, r in enumerate(RECORDS) for o, p in expected(r)], key=repr)


def test_no_records(spark):
    df = spark.createDataFrame([], "msg bigint, body string")
    assert shred.json_objects(df, "msg", "body", ("params",)).count() == 0


def test_nan_is_no_json():
    assert shred.parse_json('{"a": NaN}') is shred.parse_json("{")


def test_very_deep_record(spark):
    deep = '{"result": ' + '[{"c": ' * 150 + "[]" + "}]" * 150 + "}"
    df = spark.createDataFrame([(1, deep)], "msg bigint, body string")
    assert shred.json_objects(df, "msg", "body", ("result",)).count() == 150


def test_positions_restart_below_their_level():
    reps = np.array([0, 2, 1, 2, 2, 0, 1])
    got = shred.positions(reps, np.full(7, 2), 2)
    assert got.tolist() == [[0, 0], [0, 1], [1, 0], [1, 1], [1, 2], [0, 0], [1, 0]]


def test_missing_arrays_keep_their_place():
    reps, defs, kinds = shred.shred("r", [{}, {"b": [{}]}], leaves=False)[("r", None, "b", None)]
    assert (reps, defs, kinds) == ([0, 1], [2, 4], [shred.MISSING, shred.OBJECT])


def test_struct_column(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, array(named_struct('kind', 'a'), NULL, named_struct('kind', NULL))), (2, NULL), (3, array()), (1, array(named_struct('kind', 'z'))) AS t(id, evidence)"
    )
    assert rows(shred.list_objects(df, "id", "evidence")) == [(1, "evidence[0]", "evidence"), (1, "evidence[2]", "evidence")]


def test_leaves_come_back(spark):
    record = {"result": [{"v": 1, "w": [2, None, {"u": "x"}]}, {"v": True}], "params": {"k": None}}
    df = spark.createDataFrame([(7, json.dumps(record))], "msg bigint, body string")
    got = rows(shred.rebuild_leaves(shred.shredded_columns(df, "msg", "body", ("params", "result"))))
    assert got == sorted(
        [
            (7, "params", "k", None),
            (7, "result[0]", "v", "1"),
            (7, "result[1]", "v", "true"),
            (7, "result[0]", "w[0]", "2"),
            (7, "result[0]", "w[1]", None),
            (7, "result[0].w[2]", "u", "x"),
        ],
        key=repr,
    )


def test_any_depth_and_any_number(spark):
    assert shred.parse_json("[" * 20_000 + '{"a": -1.5e3}' + "]" * 20_000) is not shred._ABSENT
    deep = "[" * 300 + '{"a": -1.5e3}' + "]" * 300
    df = spark.createDataFrame([(1, '{"result": ' + deep + "}"), (2, '{"params": [{"n": ' + "9" * 5000 + "}]}")], "id bigint, message string")
    got = {(r.record_id, r.obj_path[:9], r.parent_path) for r in shred.json_objects(df, "id", "message", ("params", "result")).collect()}
    assert got == {(1, "result[0]", "result"), (2, "params[0]", "params")}


def test_own_parser_agrees_with_the_library():
    texts = ['{"a":[1,2.5,{"b":null}],"c":"\\u00e9\\n","d":{},"e":[],"a":true}', " [ ] ", "{}", "1", '"x"', '[{"a":[[],[{}]]}, -0.1e-2]', "[1,]", "{,}", '{"a"}', "[1 2]", "", "[", '{"a":1', "01", "nul", "[1]]"]
    for text in texts:
        try:
            want = json.loads(text)
        except ValueError:
            want = None
        try:
            assert shred._parse_deep(text) == want, text
        except ValueError:
            assert want is None, text
