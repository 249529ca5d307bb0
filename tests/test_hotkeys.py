import random
from collections import defaultdict

from skein.operators.hotkeys import dense_key_counts, heavy_keys
from tests.conftest import rows


def test_counts_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = ("hot", "k") if rng.random() < 0.4 else (rng.choice([None, "a", "b", "c" * 300]), rng.choice(["x", None, "y"]))
        data += [(i, *key, 9)] * rng.choice([1, 1, 3])
    data += [(None, "hot", "k", 9), (5, "a", "x", 1)]
    df = spark.createDataFrame(data, "id bigint, target string, kind string, h1 int")
    ids = defaultdict(set)
    for i, t, k, _ in data:
        ids[t, k].update(() if i is None else (i,))
    got = rows(dense_key_counts(df, ["target", "kind"], "id", split_rows=40))
    assert got == sorted([(*k, len(v)) for k, v in ids.items()], key=repr)
    total = len(set().union(*ids.values()))
    assert rows(heavy_keys(df, ["target", "kind"], "id", 10).select("target", "kind")) == sorted(
        [k for k, v in ids.items() if k[0] is not None and v and len(v) * 10 >= total], key=repr
    )


def test_null_and_text_keys_differ(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "", "a")], "id bigint, target string, kind string")
    assert rows(dense_key_counts(df, ["target", "kind"], "id")) == [("", "a", 1), ("a", None, 1), (None, "a", 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, target string, kind string")
    assert dense_key_counts(df, ["target", "kind"], "id").count() == 0
    assert heavy_keys(df, ["target", "kind"], "id").count() == 0


def test_tree_of_sums_and_text_ids(spark, monkeypatch):
    from skein.operators import hotkeys

    monkeypatch.setattr(hotkeys, "FAN_IN", 3)
    data = [(f"i{i % 700}", "hot" if i % 3 else str(i % 7), "k") for i in range(2000)]
    ids = defaultdict(set)
    for i, t, k in data:
        ids[t, k].add(i)
    df = spark.createDataFrame(data, "id string, target string, kind string")
    assert rows(dense_key_counts(df, ["target", "kind"], "id", split_rows=50)) == sorted([(*k, len(v)) for k, v in ids.items()], key=repr)


def test_layout_splits_only_what_is_large():
    from skein.operators.hotkeys import layout

    assert layout({0: 3, 1: 4, 5: 25, 7: 2, 8: 9}, 10) == [(0, 0, 1), (1, 0, 1), (5, 1, 3), (7, 2, 1), (8, 3, 1)]
    assert layout({}, 10) == []
