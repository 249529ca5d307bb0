import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skein.functions import identity, vocabulary
from skein.operators import aggregate, deltas, filters, intervals, merge, resolve, similar, traverse, triage
from skein.plans import graphs
from tests.conftest import rows

EDGE = "id bigint, source string, target string, kind string, confidence string, semantic_role string, resolution_status string"


def edges(spark, links, kind="calls", confidence="confirmed"):
    return spark.createDataFrame([(i, s, t, kind, confidence, None, "resolved") for i, (s, t) in enumerate(links)], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


# merging


def test_node_dedupe_ranks_and_ties(spark):
    data = [("a", "unresolved", "n", "p"), ("a", "class", "n", None), ("a", "class", "m", "p"), ("a", "class", "n", "p"), ("b", None, None, None), ("b", None, None, None)]
    got = rows(merge.dedupe_nodes(spark.createDataFrame(data, "id string, kind string, name string, path string")))
    assert got == [("a", "class", "m", "p"), ("b", None, None, None)]


def test_edge_merge_first_wins_and_upgrade(spark):
    data = [
        (1, "a", "b", "calls", "heuristic", None, "partial", [("x", "p", 1)]), (2, "a", "b", "calls", "confirmed", None, "resolved", [("x", "p", 1), None, ("y", "p", 2)]),
        (3, "a", "b", "calls", None, None, "late", None), (4, "a", "b", "calls", "inferred", "write", "resolved", []), (5, None, "b", "calls", "unresolved", None, None, None),
    ]
    df = spark.createDataFrame(data, EDGE + ", evidence array<struct<kind string, path string, start_line int>>")
    got = {(r.source, r.semantic_role): (r.confidence, r.resolution_status, r.n_merged, r.first_seq, r.n_evidence) for r in merge.merge_edges(df).collect()}
    assert got == {("a", None): ("confirmed", "resolved", 3, 1, 2), ("a", "write"): ("inferred", "resolved", 1, 4, 0), (None, None): ("unresolved", None, 1, 5, 0)}
    for parts in (1, 5):
        assert rows(merge.merge_edges(df.repartition(parts))) == rows(merge.merge_edges(df))


def test_dangling_and_conflicts(spark):
    df = spark.createDataFrame(
        [(1, "a", "b", "calls", "confirmed", [("django", "p", 1)]), (2, "a", "z", "calls", "confirmed", [("django", "p", 1)]), (3, "a", None, "calls", "confirmed", None)],
        "id bigint, source string, target string, kind string, confidence string, evidence array<struct<kind string, path string, start_line int>>",
    )
    assert rows(merge.dangling(df, seeds(spark, "a", "b"), ("django",))) == [(2, "target", "z", "warning")]
    assert rows(merge.dangling(df, seeds(spark, "a", "b"))) == [(2, "target", "z", "error")]
    assert rows(merge.conflicts(df)) == [("a", "calls", "p", 1, 2, 1)]


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "id string, path string")
    new = spark.createDataFrame([("b2", "p2")], "id string, path string")
    assert rows(merge.incremental(old, new, spark.createDataFrame([("p2",)], "path string")).select("id")) == [("a",), ("b2",), ("c",)]


# traversal

CHAIN = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a"), ("d", None), (None, "q")]


def test_reach_depths_cycle_and_limits(spark):
    df = edges(spark, CHAIN)
    assert rows(traverse.reach(df, seeds(spark, "a"), 2)[0]) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(traverse.reach(df, seeds(spark, "d"), 1, reverse=True)[0]) == [("c", 1), ("d", 0)]
    assert rows(traverse.reach(df, seeds(spark, "nowhere"), 5)[0]) == [("nowhere", 0)]
    assert traverse.reach(df, seeds(spark, "a").limit(0), 3)[1].count() == 0


def test_hub_caps(spark):
    df = edges(spark, [(f"c{i:03}", "hub") for i in range(201)])
    found, walked = traverse.reach(df, seeds(spark, "hub"), 1, reverse=True, fan_cap=200)
    assert walked.count() == 200 and found.count() == 201 and "c200" not in {r.id for r in found.collect()}
    assert traverse.reach(df, seeds(spark, "hub"), 1, reverse=True, edge_cap=7)[1].count() == 7


def test_components_and_cycles_match_brute_force(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"l{i}", f"l{i + 1}") for i in range(30)]
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    assert rows(traverse.components(edges(spark, links))) == sorted([(x, top(x)) for x in group], key=repr)

    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def reachable(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {x: reachable(x) for x in group}
    want = sorted([(x, min([y for y in far[x] if x in far.get(y, ())] + [x])) for x in group if x in far[x]], key=repr)
    assert rows(traverse.strong_components(edges(spark, links))) == want


def test_ego_and_fan(spark):
    df = edges(spark, CHAIN)
    assert rows(traverse.ego(df, seeds(spark, "b"), 1).select("source", "target")) == [("a", "b"), ("b", "c")]
    assert rows(traverse.ego(df, seeds(spark, "b"), 1, "out").select("source", "target")) == [("b", "c")]
    assert rows(traverse.fan(df, "target", 1)) == [("c", "calls", 2)]


# resolution, filters, triage

NODES = "id string, kind string, name string, qualname string, path string, start_line int, end_line int, properties_json string"


def nodes(spark):
    return spark.createDataFrame(
        [
            ("fn:m.x", "function", "x", "m.x", "m.py", 1, 9, None), ("class:m.y.x", "class", "x", "m.y.x", "m/y.py", 2, 8, None), ("table:x", "table", "x", None, None, None, None, None),
            ("mod:m", "module", "m", "m", "m.py", 1, 90, '{"route_mounted": false}'), ("fn:solo", "function", "100%_o", "deep.pkg.solo", "tests/a.py", 3, None, "{}"),
        ],
        NODES,
    )


@pytest.mark.parametrize(
    "query,state,strategy,found",
    [
        ("fn:m.x", "resolved", "exact_id", "fn:m.x"), ("m.x", "resolved", "exact_qualname", "fn:m.x"), ("solo", "resolved", "normalized_id", "fn:solo"), ("m/y.py", "resolved", "exact_path", "class:m.y.x"),
        ("m.py", "ambiguous", "exact_path", None), ("x", "resolved", "resource_name", "table:x"), ("pkg.solo", "resolved", "qualname_suffix", "fn:solo"), ("nothing", "unresolved", None, None),
    ],
)
def test_resolution_order(spark, query, state, strategy, found):
    asked = spark.createDataFrame([(query,), (query,), (None,), ("",)], "query string")
    got = resolve.resolve(asked, nodes(spark)).collect()
    assert [(r.query, r.status, r.strategy, r.id) for r in got] == [(query, state, strategy, found)]


def test_search_takes_wildcards_literally(spark):
    assert [r.id for r in filters.search(nodes(spark), "100%_O").collect()] == ["fn:solo"]
    assert filters.search(nodes(spark), "1000").count() == 0 and filters.search(nodes(spark), "").count() == 0


def test_predicates(spark):
    df = nodes(spark)
    got = {r.id: (r.r, r.x) for r in df.select("id", filters.routable().alias("r"), filters.exclusion_reason(("module",)).alias("x")).collect()}
    assert got["mod:m"] == (False, "kind") and got["fn:solo"] == (True, "test") and got["table:x"] == (True, "external") and got["fn:m.x"][1] is None
    sites = spark.createDataFrame([(1, [("a", True), ("b", False)]), (2, [("a", True)]), (3, None), (4, [])], "id int, callsites array<struct<id string, guessed boolean>>")
    assert [(r.id, None if r.callsites is None else len(r.callsites)) for r in filters.without_guesses(sites).orderBy("id").collect()] == [(1, 1), (3, None), (4, 0)]
    assert filters.by_kind(edges(spark, CHAIN), exclude=("calls",)).count() == 0
    warn = spark.createDataFrame([("k", "m.py"), ("k", "z.py"), ("j", None)], "kind string, path string")
    inside, outside = filters.scope_warnings(warn, df)
    assert rows(inside.select("path")) == [("m.py",)] and rows(outside) == [("j", 1), ("k", 1)]


def test_triage_precedence(spark):
    cases = [
        ("mock.getattr", None, "", "{}", "mock_or_assertion"), ("click", None, "", "{}", "framework_magic"), ("on_click", None, "", "{}", "static_candidate"),
        ("router.get", None, "", "{}", "framework_magic"), ("cache.get", None, "", "{}", "static_candidate"), ("redis.execute", None, "", None, "external_service_boundary"), ("client.get", None, "", "{}", "framework_magic"),
        ("user_fixture", None, "", "{}", "framework_magic"), ("f", "receiver_type_unknown", "", "{}", "missing_type_context"),
        ("f", None, "", '{"receiver_type_status": "Missing"}', "missing_type_context"), ("f", None, "a\\Generated\\b.py", "{}", "generated_or_reflection"),
        ("setattr", None, None, "{}", "generated_or_reflection"), ("f", None, "", '{"callee_binding_kind": "parameter"}', "true_dynamic_call"),
        ("mock.x", "union_receiver", "", '{"semantic_reason": "ambiguous_union_receiver"}', "true_dynamic_call"), (None, None, None, None, "static_candidate"),
    ]
    df = spark.createDataFrame([c[:4] + (i,) for i, c in enumerate(cases)], "raw_expression string, failed_strategy string, path string, properties_json string, n int")
    got = {r.n: r.category for r in triage.annotate(df).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == [(c[0], c[4]) for c in cases]
    counts = {r.category: r.n_calls for r in triage.triage_counts(df.limit(0)).collect()}
    assert counts == dict.fromkeys(triage.CATEGORIES, 0)


# identities


def test_identity_functions(spark):
    import hashlib
    from urllib.parse import quote

    odd = "fn:a b/c.d-é*~+%"
    got = spark.createDataFrame([(odd, None)], "a string, b string").select(
        identity.content_id("fact", F.col("a"), F.col("b")), identity.canonical_identity("skein", F.lit("m"), F.lit("p"), F.lit("1"), F.col("a")), identity.typed_id("fn", F.col("a"), F.col("b"))
    ).first()
    assert got[0] == "fact:" + hashlib.sha256(f"{odd}\x1f".encode()).hexdigest()
    assert got[1] == "skein m p 1 " + quote(odd, safe=":._/-~") and got[2] is None
    names = spark.createDataFrame([("src/a/b.py", "src"), ("src/a/__init__.py", "src"), ("x.py", "")], "p string, r string").select(identity.module_name(F.col("p"), F.col("r"))).collect()
    assert [r[0] for r in names] == ["a.b", "a", "x"]
    urls = spark.createDataFrame([("//a//b/",), ("/",), (None,), ("",)], "u string").select(identity.canonical_url_path(F.col("u"))).collect()
    assert [r[0] for r in urls] == ["/a/b", "/", "/", "/"]
    secret = spark.createDataFrame([("api_key=abc123 at https://me:pw@host/x in /home/joe/y Bearer abc.def",), (None,)], "t string").select(identity.redact(F.col("t"))).collect()
    assert secret[0][0] == "[secret] at https://[secret]@host/x in ~/y Bearer abc.def" and secret[1][0] is None  # too short for a token


# intervals


def test_containment_and_narrowest(spark):
    ranges = spark.createDataFrame([("f", "outer", 1, 500), ("f", "in1", 100, 130), ("f", "twin1", 200, 210), ("f", "twin2", 200, 210), ("f", "point", 130, None), ("f", "bad", 9, 3), ("g", "none", None, 5)], "path string, id string, s int, e int")
    points = spark.createDataFrame([("f", 1), ("f", 130), ("f", 205), ("f", 501), ("g", 2), ("f", None)], "path string, line int")
    got = rows(intervals.narrowest(points, ranges, "path", "line", "s", "e", ["path", "line"], "id"))
    assert got == [("f", 1, "outer", "matched", 1), ("f", 130, "point", "matched", 1), ("f", 205, None, "ambiguous", 2)]


def test_longest_prefix_and_as_of(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("ab/c.py",), ("a/b",), (None,)], "path string")
    parents = spark.createDataFrame([("a",), ("a/b",), ("z",)], "folder string")
    assert rows(intervals.longest_prefix(paths, "path", parents, "folder")) == [("a/b", "a/b"), ("a/b/c.py", "a/b"), ("ab/c.py", None)]
    events = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "k", 10), (4, "j", 5), (5, None, 5)], "id int, k string, at int")
    states = spark.createDataFrame([("k", 5, "b"), ("k", 5, "a"), ("k", 8, "c"), (None, 1, "n")], "k string, since int, v string")
    assert rows(intervals.as_of(events, states, "k", "at", "since", "v").select("id", "v")) == [(1, "b"), (2, None), (3, "c"), (4, None), (5, None)]


# aggregates


@pytest.mark.parametrize("n", [1, 2, 20, 21])
def test_percentile_index(spark, n):
    values = sorted(random.Random(n).random() * 100 for _ in range(n))
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
    got = aggregate.nearest_rank(df, ["g"], "v").first()
    assert (got.n, got.p50, got.p95) == (n, round(values[min(n - 1, int(n * 0.5))], 3), round(values[min(n - 1, int(n * 0.95))], 3))


def test_retention_budget_and_bounds(spark):
    builds = spark.createDataFrame([("v1", True), ("v2", True), ("v3", False), ("v4", True), ("v5", True)], "version string, ok boolean")
    got = dict(rows(aggregate.retention(builds, "version", 3, pinned=("v1",), complete=F.col("ok"))))
    assert got == {"v1": "keep", "v2": "remove", "v3": "remove", "v4": "keep", "v5": "keep"}
    df = spark.createDataFrame([("g", i, "é" * 5) for i in range(10)], "g string, i int, t string")
    assert aggregate.byte_budget(df, "g", "i", "t", 35).count() == 3
    assert {r.n_omitted for r in aggregate.bounded(df, ["i"], 4).collect()} == {6}
    assert aggregate.resolution_rates(edges(spark, []), "kind").count() == 0
    limits = spark.createDataFrame([("g", 3)], "g string, budget int")
    assert rows(aggregate.budget_violations(spark.createDataFrame([("g", 5), ("h", 9)], "g string, m int"), limits, "g", "m")) == [("g", 5, 3)]


def test_module_graph(spark):
    data = [(1, "a", "b", "calls", "confirmed"), (2, "a", "b", "calls", None), (3, "a", "b", "imports", "heuristic"), (4, "a", "c", "calls", "confirmed"), (5, "a", "b", "covers", "confirmed")]
    df = spark.createDataFrame(data, "id bigint, source string, target string, kind string, confidence string")
    modules = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m1")], "id string, module string")
    got = aggregate.module_graph(df, modules).first()
    assert (got.from_module, got.to_module, got.n_edges, got.weight, got.dominant) == ("m1", "m2", 3, 10.525, "confirmed")
    assert aggregate.module_graph(df, modules, min_weight=11).count() == 0


# similarity


def test_near_sets_match_all_pairs(spark):
    rng = random.Random(4)
    data = []
    for i in range(120):
        base = [f"t{rng.randrange(30)}" for _ in range(rng.choice([0, 3, 8, 12]))] if i % 3 or not data else list(data[rng.randrange(len(data))][2] or [])
        if base and rng.random() < 0.5:
            base[rng.randrange(len(base))] = "x"
        data.append((i, rng.choice(["p", "q"]), sorted(set(base + ["common"] * bool(base))) if i % 17 else None))
    df = spark.createDataFrame(data, "id bigint, block string, members array<string>")
    classes, links = similar.near_sets(df, "id", "block", "members", 0.6)
    sets = {}
    for i, b, m in data:
        sets.setdefault((b, tuple(m or ())), i)
    want = set()
    for (b1, m1), i in sets.items():
        for (b2, m2), j in sets.items():
            if i < j and b1 == b2 and m1 and m2 and len(set(m1) & set(m2)) / len(set(m1) | set(m2)) >= 0.6:
                want.add((i, j))
    assert {(r.class_a, r.class_b) for r in links.collect()} == want and want
    assert {(r.id, r.class_id) for r in classes.collect()} == {(i, sets[b, tuple(m or ())]) for i, b, m in data}
    assert similar.families(classes, links, "id").count() == len(data)
    empty = similar.near_sets(df.limit(0), "id", "block", "members")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_scores(spark):
    row = spark.sql("SELECT array('a','b','c') a, array('b','c','d') b, cast(array() as array<string>) e").select(
        similar.jaccard(F.col("a"), F.col("b")), similar.jaccard(F.col("e"), F.col("e")), similar.jaccard(F.col("a"), F.col("e")),
        similar.combined_score(F.lit(0.5), F.lit(True), F.lit(1.0), F.lit(0.0)), similar.grams(F.lit("One two, three four")), similar.grams(F.lit("One two")), similar.grams(F.lit(None)),
    ).first()
    assert row[0] == 0.5 and row[1] == 1.0 and row[2] == 0.0 and row[3] == 0.9575
    assert row[4] == ["one two three", "two three four"] and row[5] == ["one", "two"] and row[6] == []
    a, b = (F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: i.cast("string")) for lo, hi in ((1, 400), (1, 300)))
    got = spark.range(1).select(similar.containment(similar.sketch(a), similar.sketch(b)), similar.containment(similar.sketch(F.array(F.lit("1"))), similar.sketch(b))).first()
    assert got[0] > 0.9 and got[1] == 0.0


# deltas


def test_diffs(spark):
    schema = "k string, v int, w int"
    a, b = spark.createDataFrame([("x", 1, 1), ("y", None, 1), ("z", 1, 1), (None, 1, 1)], schema), spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("n", 1, 1), (None, 1, 1)], schema)
    assert rows(deltas.outer_diff(a, b, ["k"], ["v", "w"])) == sorted([("x", "same"), ("y", "changed"), ("z", "removed"), ("n", "added"), (None, "same")], key=repr)
    got = rows(deltas.graph_delta(a.where("k IS NOT NULL"), b.where("k IS NOT NULL"), "k", {"semantic": F.col("v"), "location": F.col("w")}))
    assert got == [("n", "added"), ("y", "semantic"), ("z", "removed")]


def test_lifecycle_two_stages(spark):
    previous = spark.createDataFrame([("e1", "s1", "v0", 3), ("e2", "s2", "v1", 1), ("e3", "s3", "v1", 1), ("e4", "s3", "v1", 1)], "exact string, loose string, first_seen string, seen_count bigint")
    current = spark.createDataFrame([("e1", "s1"), ("e9", "s2"), ("e8", "s3"), ("e7", "s7"), ("e7", "s7"), (None, None)], "exact string, loose string")
    got = {r.exact: (r.first_seen, r.seen_count, r.lifecycle) for r in deltas.lifecycle(previous, current, "v2", ["exact"], ["loose"]).collect()}
    assert got == {"e1": ("v0", 4, "existing"), "e9": ("v1", 2, "moved"), "e8": ("v2", 1, "new"), "e7": ("v2", 1, "new"), None: ("v2", 1, "new")}


def test_stale_targets(spark):
    got = deltas.stale_targets(edges(spark, [("a", "gone"), ("b", "gone"), ("c", "a"), ("dead", "gone")]), seeds(spark, "a", "b", "c"), seeds(spark, "b"))
    assert rows(got.select("source", "target")) == [("a", "gone")]


def test_vocabulary_ranks(spark):
    df = spark.createDataFrame([("confirmed",), (None,), ("runtime-only",), ("odd",)], "c string").select(vocabulary.confidence_rank(F.col("c")), vocabulary.edge_weight(F.lit("calls"), F.col("c")))
    assert [tuple(r) for r in df.collect()] == [(4, 5.0), (4, 5.0), (2, 3.25), (1, 1.25)]


def test_windows(spark):
    from skein.streaming import windows

    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t + timedelta(minutes=m), "u", v) for i, (m, v) in enumerate([(0, 1.0), (20, None), (70, 2.0), (10, 4.0)])], "id bigint, ts timestamp_ntz, user string, value double")
    assert [r.n_events for r in windows.tumbling(df, "ts", "1 hour", [], "value").orderBy("window_start").collect()] == [3, 1]
    assert [(r.n_events, r.total) for r in windows.sessions(df, "ts", "30 minutes", ["user"], "value").orderBy("session_start").collect()] == [(3, 5.0), (1, 2.0)]
    assert rows(windows.late_events(df, "ts", "id", 1800).select("id")) == [(3,)]


def test_dependent_closure_goes_on_until_nothing_is_new(spark, monkeypatch):
    links = [(f"mod:m{i + 1}", f"mod:m{i}") for i in range(5)] + [("mod:m0", "mod:m3")]
    held = SimpleNamespace(deliveries=edges(spark, links, kind="imports"))
    monkeypatch.setattr(graphs, "load", lambda *_: held)
    monkeypatch.setattr(graphs, "table", lambda *_: spark.createDataFrame([("m0", 2), ("old", 1)], "module string, index_version int"))
    assert rows(graphs.dependent_closure(spark, "")) == [(f"mod:m{i}", i) for i in range(6)]


def test_walk_tells_what_it_leaves_out(spark):
    hub = edges(spark, [(f"s{i:03d}", "hub") for i in range(201)])
    nodes, walked, cuts = traverse.walk(hub, seeds(spark, "hub"), 1, reverse=True, fan_cap=200, edge_cap=5000)
    assert (nodes.count(), walked.count(), rows(cuts)) == (201, 200, [(1, "max_fan_in", 1)])
    full = edges(spark, [(f"s{i:03d}", "hub") for i in range(200)])
    assert rows(traverse.walk(full, seeds(spark, "hub"), 3, reverse=True, fan_cap=200, edge_cap=5000)[2]) == []  # exactly full is not cut
    assert rows(traverse.walk(full, seeds(spark, "hub"), 3, reverse=True, edge_cap=150)[2]) == [(1, "max_edges", 50)]
    chain = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert rows(traverse.walk(chain, seeds(spark, "a"), 2)[2]) == [(2, "max_depth", 1)]
    assert rows(traverse.walk(chain, seeds(spark, "a"), 3)[2]) == []
    assert rows(traverse.walk(chain, seeds(spark, "a"), 3, edge_cap=1)[2]) == [(2, "max_edges", 1)]


def test_one_row_of_an_id_whatever_columns_are_asked(spark):
    data = [("a", "x", "p", "m"), ("a", "x", "p", "n"), ("a", "unresolved", "a", "a"), ("b", None, None, None), ("b", None, None, None)]
    df = spark.createDataFrame(data, "id string, kind string, path string, name string")
    rank = (F.col("kind") == "unresolved").cast("int")
    pick = lambda *wanted: rows(merge.first_by_order(df, ["id"], ["kind", "path", "name"], list(wanted), F.coalesce(rank, F.lit(0))))
    assert pick("id", "name") == [("a", "m"), ("b", None)]
    assert pick("id", "kind") == [("a", "x"), ("b", None)]
    assert pick("id") == [("a",), ("b",)]
    shared = spark.createDataFrame([("config:env:HOME", "config", "f.py", "HOME", '{"key":"HOME"}')], "id string, kind string, path string, name string, properties_json string")
    assert rows(merge.canonical_config(shared)) == [("config:env:HOME", "config", None, "env:HOME", '{"config_kind":"env","key":"HOME"}')]
