from datetime import datetime

from pyspark.sql import functions as F

from skein.functions.canonical import canonical_text, json_digest
from skein.operators.snapshots import snapshot_changes, validity_intervals
from tests.conftest import rows

T = lambda h: datetime(2026, 1, 1, h)


def frame(spark, data):
    df = spark.createDataFrame(data, "snapshot string, key string, payload string, delivered timestamp_ntz")
    return df.withColumn("version", json_digest("payload")).withColumn("idx", F.lit(1))


def test_spelling_does_not_matter():
    same = ['{"a":1,"b":[1,{"c":null}],"d":null}', '{ "b" : [1.0, {}], "a": 1e0 }', '{"b":[10e-1,{}],"a":1,"x":null}']
    assert len({canonical_text(t) for t in same}) == 1
    assert canonical_text('{"a":"1"}') != canonical_text('{"a":1}')
    assert canonical_text("[null]") != canonical_text("[]")
    assert canonical_text('{"a":"\\u00e9"}') == canonical_text('{"a":"é"}')
    assert canonical_text("12345678901234567890123") != canonical_text("12345678901234567890124")
    assert canonical_text("nope") is None


def test_changes(spark):
    data = [
        ("s1", "a", '{"v":1}', T(1)), ("s2", "a", '{"v":1.0}', T(1)), ("s3", "a", '{"v":2}', T(1)), ("s4", "a", '{"v":2}', T(1)),
        ("s1", "b", "{}", T(1)), ("s3", "b", "{}", T(1)),
        ("s2", "c", None, T(1)), ("s3", "c", "null", T(1)), ("s4", "c", "null", T(1)),
        ("s1", "d", '{"v":1}', T(1)), ("s1", "d", '{"v":9}', T(5)), ("s2", "d", '{"v":9}', None), ("s2", "d", '{"v":9}', T(2)), ("s2", "d", '{"v":9}', T(2)),
        ("s3", "d", '{"v":9}', T(1)), ("s4", "d", '{"v":9}', T(1)),
        (None, "e", "{}", T(1)), ("s1", None, "{}", T(1)), ("s4", "f", "broken", T(1)),
    ]
    got = rows(snapshot_changes(frame(spark, data), "snapshot", "key", "version", "delivered"))
    assert got == sorted(
        [("s3", "a", "changed"), ("s2", "b", "removed"), ("s3", "b", "added"), ("s4", "b", "removed"), ("s2", "c", "added"), ("s3", "c", "changed"), ("s4", "f", "added")],
        key=repr,
    )


def test_ties_are_decided_alike(spark):
    data = [("s1", "a", "1", T(1)), ("s1", "a", "2", T(1)), ("s2", "a", "1", T(1)), ("s2", "a", "2", T(1))]
    for part in (data, data[::-1]):
        assert snapshot_changes(frame(spark, part), "snapshot", "key", "version", "delivered").count() == 0


def test_intervals_and_empty(spark):
    data = [(f"s{i}", "a", str(i // 2), T(1)) for i in range(5)]
    got = validity_intervals(frame(spark, data), "snapshot", "key", "version", "delivered")
    assert sorted((r["first"], r["last"]) for r in got.collect()) == [(0, 1), (2, 3), (4, 4)]
    empty = frame(spark, [])
    assert snapshot_changes(empty, "snapshot", "key", "version", "delivered").count() == 0
    assert snapshot_changes(frame(spark, data[:1]), "snapshot", "key", "version", "delivered").count() == 0
