from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12), st.sets(st.integers(40, 90), min_size=1, max_size=3))
def test_plans_hold_every_item_once_within_capacity(histogram, capacities):
    done = packing.plan_bins(histogram, sorted(capacities))
    held = Counter()
    for b in done:
        assert 0 < b.used <= b.capacity and b.capacity in capacities and b.repeat > 0
        assert not any(c < b.capacity and c >= b.used for c in capacities)  # downsized
        for size, copies in b.contents:
            held[size] += copies * b.repeat
    assert held == Counter(histogram)


def first_fit(histogram, capacity):
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [i for i, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= size
            else:
                rooms.append(capacity - size)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), min_size=1, max_size=10))
def test_one_capacity_is_best_fit_decreasing(histogram):
    assert sum(b.repeat for b in packing.plan_bins(histogram, [50])) == first_fit(histogram, 50)


def test_packed_items(spark):
    sizes = [(i, (i * 37) % 90) for i in range(500)] + [(1000, 263), (1001, 100), (1002, None), (1003, 0), (7, 5), (7, 5)]
    sizes += [(2000 + i, 33) for i in range(300)]  # a third share one size
    df = spark.createDataFrame(sizes, "doc_id bigint, n bigint").selectExpr("*", "'x' AS plan", "1 AS bucket")
    got = packing.pack(df, "doc_id", "n", {"small": [100], "any": [50, 100, 25], "none": []}).collect()
    for plan, capacities in (("small", [100]), ("any", [25, 50, 100])):
        mine = [r for r in got if r.plan == plan]
        bins = defaultdict(list)
        for r in mine:
            if r.container is None:
                assert r.piece_size == 0
            else:
                bins[r.container].append(r)
        for rs in bins.values():
            assert sum(r.piece_size for r in rs) <= rs[0].capacity and len({r.capacity for r in rs}) == 1 and rs[0].capacity in capacities
        total = Counter()
        for r in mine:
            total[r.doc_id] += r.piece_size
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v} and set(total) == {i for i, _ in sizes}
        big = sorted((r.piece_no, r.piece_start, r.piece_size) for r in mine if r.doc_id == 1000)
        assert big == [(0, 0, 100), (1, 100, 100), (2, 200, 63)]
        assert len([r for r in mine if r.doc_id == 1001]) == 1
    report = {(r.plan, r.capacity): r for r in packing.fill_report(packing.pack(df, "doc_id", "n", {"small": [100]})).collect()}
    assert report["small", 100].unused_share < 0.05


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n bigint")
    assert packing.pack(df, "doc_id", "n", {"p": [10]}).count() == 0
    assert packing.pack(df, "doc_id", "n", {}).count() == 0
