import json
from datetime import datetime

from pyspark.sql import functions as F

from skein.operators import drift
from tests.conftest import rows

TARGET = {"fact_id": "string", "n": "bigint", "ok": "boolean", "tags": "array<string>", "path": "string"}
E1, E2, E3 = (datetime(2026, m, 1) for m in (1, 2, 3))


def exports(spark, data):
    lines = [(e, f, t, i, r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, (e, f, t, r) in enumerate(data)]
    return spark.createDataFrame(lines, "export_id bigint, feed string, exported_at timestamp_ntz, line_no int, raw string, field string")


def changes(spark, data):
    df = exports(spark, data)
    typed = drift.ingest(df, "raw", TARGET, ["export_id"])
    fields = drift.profile(typed.withColumn("record_key", F.col("fact_id")), TARGET, ["export_id", "record_key"])
    return rows(drift.field_changes(df.select("export_id", "feed", "exported_at"), fields))


def test_all_kinds_of_change(spark):
    data = [
        (7, "f", E1, {"fact_id": "a", "n": 1, "path": "p", "gone": 1, "t": "x"}),
        (7, "f", E1, {"fact_id": "b", "n": 2, "path": "q", "gone": None, "t": "x"}),
        (3, "f", E2, {"fact_id": "a", "n": "1", "file": "p", "new": None, "t": None}),
        (3, "f", E2, {"fact_id": "c", "file": "r", "t": None}),
        (3, "f", E2, "{broken"), (3, "f", E2, None), (3, "f", E2, "[1]"), (3, "f", E2, ""),
        (9, "g", E1, {"fact_id": "a"}), (5, "f", E3, {"fact_id": "a", "n": "1", "file": "p", "t": 5}),
    ]
    assert changes(spark, data) == sorted(
        [(3, "renamed", "path", "file"), (3, "removed", "gone", ""), (3, "added", "", "new"), (3, "type_changed", "n", "n"), (5, "removed", "new", "")], key=repr
    )


def test_values_that_differ_are_no_rename(spark):
    data = [(1, "f", E1, {"fact_id": "a", "old": 1}), (1, "f", E1, {"fact_id": "b", "old": 2}), (2, "f", E2, {"fact_id": "a", "new": 1}), (2, "f", E2, {"fact_id": "b", "new": 3})]
    assert changes(spark, data) == [(2, "added", "", "new"), (2, "removed", "old", "")]


def test_repeated_records_and_order_by_time(spark):
    data = [(2, "f", E1, {"fact_id": "a", "old": 1}), (2, "f", E1, {"fact_id": "a", "old": 1}), (1, "f", E2, {"fact_id": "a", "new": 1.0}), (1, "f", E2, {"fact_id": "a", "new": 1})]
    assert changes(spark, data) == [(1, "renamed", "old", "new")]


def test_rescue_and_replay(spark):
    data = [
        (1, "f", E1, {"fact_id": "a", "n": "12", "ok": "true", "path": {"root": "r"}, "unknown": [1, {"x": None}], "tags": ["t", "u"]}),
        (1, "f", E1, {"fact_id": 5, "n": 2.5, "file": "p", "ok": None, "tags": "t,u"}),
        (1, "f", E1, {"n": 2**70, "file": 3, "path": "q"}),
    ]
    typed = drift.ingest(exports(spark, data), "raw", TARGET, ["line_no"])
    got = {r.line_no: r for r in typed.collect()}
    assert (got[0].fact_id, got[0].n, got[0].tags) == ("a", None, ["t", "u"])
    assert json.loads(got[0]._rescued) == {"n": "12", "ok": "true", "path": {"root": "r"}, "unknown": [1, {"x": None}]}
    assert json.loads(got[1]._rescued) == {"fact_id": 5, "n": 2.5, "file": "p", "ok": None, "tags": "t,u"}
    after = {r.line_no: r for r in drift.replay(typed, TARGET, ["line_no"], {"file": "path"}).collect()}
    assert (after[0].n, after[0].ok, after[0].path) == (12, True, None)
    assert json.loads(after[0]._rescued) == {"path": {"root": "r"}, "unknown": [1, {"x": None}]}
    assert (after[1].fact_id, after[1].n, after[1].path) == ("5", None, "p")
    assert json.loads(after[1]._rescued) == {"n": 2.5, "ok": None, "tags": "t,u"}
    assert after[2].path == "q" and json.loads(after[2]._rescued) == {"n": 2**70, "file": 3}


def test_names_that_lead_to_two_fields_are_not_approved(spark):
    found = spark.createDataFrame([(1, "renamed", "path", "file"), (2, "renamed", "file", "place"), (3, "renamed", "fact_id", "x"), (4, "renamed", "n", "x")], "export_id bigint, change_type string, old_field string, new_field string")
    assert drift.other_names(found, TARGET) == {"file": "path", "place": "path"}


def test_empty(spark):
    assert changes(spark, []) == []


def test_promoted_fields_get_columns_and_are_filled(spark):
    data = [(1, "f", E1, {"fact_id": "a", "score": 1.5, "team": "x"}), (1, "f", E1, {"fact_id": "b", "score": "2", "team": None}), (1, "f", E1, {"fact_id": "c", "score": "none"})]
    typed = drift.ingest(exports(spark, data), "raw", TARGET, ["line_no"])
    more = {"score": "double", "team": "string"}
    got = {r.fact_id: (r.score, r.team, r._rescued) for r in drift.replay(drift.promote(typed, more), {**TARGET, **more}, ["line_no"], {}).collect()}
    assert got == {"a": (1.5, "x", None), "b": (2.0, None, '{"team": null}'), "c": (None, None, '{"score": "none"}')}
