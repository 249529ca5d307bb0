from datetime import datetime, timedelta

import pytest

from skein.operators import references
from skein.operators.references import lifetimes, orphan_counts, orphans
from tests.conftest import rows

D = lambda day: datetime(2026, 1, 1) + timedelta(days=day)
NODES = [("a", D(0), None), ("b", D(0), D(10)), ("b", D(20), None), ("c", D(5), None), ("n", None, None), ("a", D(0), None), (None, D(0), None)]


def refs(spark, data):
    return spark.createDataFrame(data, "referrer string, record_key string, ref_column string, fk string, at timestamp_ntz, k string")


def lives(spark, data=NODES):
    return lifetimes(spark.createDataFrame(data, "id string, since timestamp_ntz, until timestamp_ntz"), "id", "since", "until")


@pytest.mark.parametrize("few,hot", [(10**6, 10), (0, 4), (0, 10**9)])
def test_reasons(spark, monkeypatch, few, hot):
    monkeypatch.setattr(references, "FEW", few)
    monkeypatch.setattr(references, "HOT", hot)
    data = [
        ("e", "1", "s", "a", D(1), ""), ("e", "2", "s", "b", D(9), ""), ("e", "3", "s", "b", D(10), ""), ("e", "4", "s", "b", D(15), ""),
        ("e", "5", "s", "b", D(20), ""), ("e", "6", "s", "c", D(4), ""), ("e", "7", "s", "c", D(5), ""), ("e", "8", "s", "zz", D(5), ""),
        ("e", "8", "s", "zz", D(5), ""), ("e", "9", "s", None, D(5), ""), ("e", "10", "t", "A", D(5), ""), ("e", "11", "t", "n", D(5), ""),
        ("e", "12", "t", "zz", None, ""), ("e", "13", "t", "b", None, ""), ("e", None, "t", "zz", D(40), ""), ("e", "14", "t", "b", D(-5), ""),
    ]
    got = orphans(refs(spark, data), lives(spark))
    assert sorted([(r.record_key, r.reason) for r in got.collect()], key=repr) == sorted(
        [("3", "deleted"), ("4", "deleted"), ("6", "late"), ("8", "missing"), ("10", "missing"), ("11", "late"), ("12", "missing"), (None, "missing"), ("14", "late")], key=repr
    )
    counts = {(r.ref_column, r.reason, r.ref_month): r.n_refs for r in orphan_counts(got).collect()}
    assert counts["s", "deleted", "2026-01"] == 2 and counts["t", "missing", None] == 1


def test_empty_sides(spark):
    assert orphans(refs(spark, []), lives(spark)).count() == 0
    assert rows(orphans(refs(spark, [("e", "1", "s", "a", D(1), "")]), lives(spark, [])).select("record_key", "reason")) == [("1", "missing")]
