import random

import pytest

from skein.operators.hierarchy import descendants, hierarchy
from tests.conftest import rows


def brute(links):
    parent = {}
    ids = set()
    for c, p in links:
        ids |= {x for x in (c, p) if x is not None}
        if c is not None and p is not None:
            parent[c] = p
    out = []
    for n in ids:
        seen, at = {n: 0}, n
        order = [n]
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen[at] = len(order)
            order.append(at)
        if at not in parent:
            out.append((n, at, len(order) - 1, "tree"))
        else:
            ring = order[seen[parent[at]] :]
            steps = seen[parent[at]]
            out.append((n, min(ring), steps, "cycle" if n in ring else "below_cycle"))
    return sorted(out, key=repr)


CASES = {
    "chain": [(f"n{i + 1}", f"n{i}") for i in range(40)],
    "diamonds": [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("b", "a"), ("x", None), (None, "y"), (None, None)],
    "self": [("a", "a"), ("b", "a"), ("c", "b")],
    "ring": [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "a"), ("t2", "t1"), ("t3", "t2"), ("r1", "r0")],
    "hub": [(f"c{i}", "hub") for i in range(300)] + [("hub", "top")],
    "unicode": [("é", "ü"), ("z", "é"), ("𐍈", "ｚ"), ("ｚ", "𐍈")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("every", [1, 3, 10**9])
def test_cases(spark, name, every):
    """every=1 makes all nodes splitters, 10**9 none: cycles then have no splitter."""
    df = spark.createDataFrame([(c, p, 1, "z") for c, p in CASES[name]], "child string, parent string, k int, id string")
    assert rows(hierarchy(df, "child", "parent", every=every)) == brute(CASES[name])


def test_random_forest_with_cycles_and_paths(spark):
    rng = random.Random(5)
    links = [(f"n{i}", f"n{rng.randrange(max(0, i - 15), i)}") for i in range(1, 400)]
    links += [(f"c{i}", f"c{(i + 1) % 37}") for i in range(37)] + [(f"t{i}", f"t{i - 1}" if i else "c3") for i in range(50)]
    df = spark.createDataFrame(links, "child string, parent string")
    placed = hierarchy(df, "child", "parent", every=4, paths=True)
    got = placed.collect()
    assert sorted([(r.node, r.root, r.depth, r.node_state) for r in got], key=repr) == brute(links)
    parent = dict(links)
    for r in got:
        if r.node_state == "tree":
            path = [r.node]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            assert r.path == path[::-1]
        else:
            assert r.path is None
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(placed).collect()}
    assert pairs == {(a, r.node, r.depth - i) for r in got if r.path for i, a in enumerate(r.path[:-1])}


def test_no_links(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert hierarchy(df, "child", "parent").count() == 0


def test_paths_below_cycles(spark):
    links = [*CASES["ring"], ("s", "s"), ("u1", "s")]
    df = spark.createDataFrame(links, "child string, parent string")
    placed = hierarchy(df, "child", "parent", paths=True, rings=True)
    paths = {r.node: r.path for r in placed.collect()}
    assert paths["t3"] == ["a", "t1", "t2", "t3"] and paths["t1"] == ["a", "t1"] and paths["u1"] == ["s", "u1"]
    assert paths["b"] == ["b"] and paths["s"] == ["s"] and paths["r1"] == ["r0", "r1"]
    pairs = {tuple(r) for r in descendants(placed).collect()}
    below = {("a", "t1", 1), ("a", "t2", 2), ("t1", "t2", 1), ("a", "t3", 3), ("t1", "t3", 2), ("t2", "t3", 1)}
    assert pairs == below | {("s", "u1", 1), ("r0", "r1", 1)}
