from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators.incremental import IncrementalTarget, run_slices
from tests.conftest import rows

D = lambda day: datetime(2026, 1, 1) + timedelta(days=day)
SCHEMA = "record_type string, record_key string, version string, at timestamp_ntz, arrived_at timestamp_ntz"


def found(target):
    return rows(target.rows().where("changed").select("run_no", "record_key"))


def test_late_repeated_and_changed_records(spark, tmp_path):
    data = [
        ("file", "a", "1", D(1), D(1)), ("file", "a", "1", D(1), D(1)), ("file", "b", "1", D(1), D(1)),
        ("file", "a", "2", D(11), D(12)), ("file", "b", "1", D(12), D(12)), ("fact", "b", "", None, D(12)),
        ("file", "b", "9", D(5), D(21)), ("file", "a", "1", D(22), D(22)), ("fact", "b", "", None, D(22)), ("file", None, "1", D(1), D(1)),
        ("file", "c", "1", D(1), D(99)), ("file", "c", "1", D(1), None),
    ]
    runs = [(1, D(10)), (4, D(20)), (6, D(30))]
    slices = run_slices(spark.createDataFrame(data, SCHEMA).withColumn("k", F.lit(0)), runs)
    target = IncrementalTarget(spark, str(tmp_path / "t"), 4)
    for i, (run, _) in enumerate(runs):
        assert target.process(run, slices.where(F.col("slice") == i))
    assert found(target) == [(1, "a"), (1, "b"), (4, "a"), (4, "b"), (6, "a")]
    assert target.manifest()["version"] == 3


def test_failed_run_leaves_no_trace_and_is_made_good(spark, tmp_path):
    first = spark.createDataFrame([("f", "a", "1", D(1), D(1))], SCHEMA)
    second = spark.createDataFrame([("f", "a", "2", D(2), D(2)), ("f", "b", "1", D(2), D(2))], SCHEMA)
    target = IncrementalTarget(spark, str(tmp_path / "t"), 4)
    target.process(1, first)
    with pytest.raises(RuntimeError):
        target.process(2, second, fail_before_publish=True)
    assert found(target) == [(1, "a")]
    again = IncrementalTarget(spark, str(tmp_path / "t"))
    assert again.process(2, second) and not again.process(2, second)
    assert found(again) == [(1, "a"), (2, "a"), (2, "b")]


def test_empty_runs(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    target = IncrementalTarget(spark, str(tmp_path / "t"), 4)
    assert target.rows().count() == 0
    target.process(1, none)
    target.process(2, none)
    assert target.rows().count() == 0 and target.manifest()["runs"] == [1, 2]
    assert run_slices(none, [(1, D(1))]).count() == 0


def test_given_all_again_each_run_takes_only_what_is_new(spark, tmp_path):
    data = [("f", str(i % 40), str(i % 3), D(i), D(i)) for i in range(200)] + [("f", "3", "x", D(2), D(150))]
    df = spark.createDataFrame(data, SCHEMA)
    runs = [(n, D(10 + 37 * n)) for n in range(6)]
    sliced, whole = (IncrementalTarget(spark, str(tmp_path / n), 2) for n in ("a", "b"))
    slices = run_slices(df, runs)
    for i, (run, cutoff) in enumerate(runs):
        sliced.process(run, slices.where(F.col("slice") == i).drop("slice"), slices.where(F.col("slice") == i).count())
        whole.process(run, df.where(F.col("arrived_at") <= F.lit(cutoff)))
    assert found(sliced) == found(whole) and len(found(whole)) > 100


def test_compacted_parts_hold_the_same_rows_and_orphans_go(spark, tmp_path):
    target = IncrementalTarget(spark, str(tmp_path / "t"), 2, compact_after=3, keep_s=0)
    one = lambda i: spark.createDataFrame([("f", str(i % 2), str(i), D(i), D(i))], SCHEMA)
    target.process(0, one(0))
    with pytest.raises(RuntimeError):
        target.process(1, one(1), fail_before_publish=True)
    for i in range(1, 5):
        target.process(i, one(i))
    assert found(target) == [(i, str(i % 2)) for i in range(5)]
    assert len(target.manifest()["parts"]) < 3 and target.manifest()["runs"] == list(range(5))
    assert len(list((tmp_path / "t" / "parts").iterdir())) <= 5  # the failed run's part is gone
    assert not target.process(3, one(9))
