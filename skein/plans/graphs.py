"""Queries of the graph operators over the tables' own graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import identity, vocabulary
from skein.graph import load
from skein.operators import aggregate, deltas, filters, intervals, merge, resolve, similar, traverse, triage
from skein.runtime import table
from skein.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, values: dict, other) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


GRAPH = """
e AS (SELECT DISTINCT id, source, target, kind, confidence, semantic_role, resolution_status, index_version, created_at FROM edges),
n AS (
  SELECT DISTINCT id, kind, name, qualname, path, start_line, end_line, repo_id, properties_json FROM nodes WHERE retired_at IS NULL
  UNION ALL
  SELECT DISTINCT id, kind, name, NULL, NULL, NULL, NULL, NULL, NULL FROM external_nodes
)"""


def query(sql: str | None = None, graph: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if not graph:
                SQL[f.__name__] = text
            elif text.startswith("RECURSIVE"):
                SQL[f.__name__] = f"WITH RECURSIVE {GRAPH}, " + text[len("RECURSIVE") :].lstrip()
            elif text.startswith(", "):
                SQL[f.__name__] = f"WITH {GRAPH}{text}"
            else:
                SQL[f.__name__] = f"WITH {GRAPH} {text}"
        return f

    return register


# Counting ---------------------------------------------------------------------


@query("""
SELECT 'node' AS entity, kind, count(*)::BIGINT AS n FROM n GROUP BY kind
UNION ALL SELECT 'node', '(all)', count(*)::BIGINT FROM n
UNION ALL SELECT 'edge', kind, count(*)::BIGINT FROM e GROUP BY kind
UNION ALL SELECT 'edge', '(all)', count(*)::BIGINT FROM e""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, edges="id kind")
    return aggregate.kind_counts(g.nodes, g.edges)


@query("""
SELECT kind, CASE WHEN coalesce(confidence, 'confirmed') IN ('confirmed', 'inferred', 'runtime-only', 'heuristic', 'unresolved')
  THEN coalesce(confidence, 'confirmed') ELSE 'heuristic' END AS bucket, count(*)::BIGINT AS n_edges FROM e GROUP BY ALL""")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.confidence_summary(load(spark, sf_dir, edges="id kind confidence").edges)


@query("""
SELECT resolution_status, confidence, count(*)::BIGINT AS n_edges, count(DISTINCT source)::BIGINT AS n_sources FROM e GROUP BY ALL""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, edges="id source confidence resolution_status").edges.groupBy("resolution_status", "confidence").agg(
        F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source").alias("n_sources")
    )


@query(f"""
SELECT kind, count(*)::BIGINT AS n_callsites, count(*) FILTER (resolution_status = 'resolved')::BIGINT AS n_resolved,
       round(count(*) FILTER (resolution_status = 'resolved') / count(*), 4) AS rate
FROM e WHERE kind IN ({_names(vocabulary.CALLSITE_KINDS)}) GROUP BY kind""")
def resolution_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.resolution_rates(load(spark, sf_dir, edges="id kind resolution_status").edges, "kind")


@query("""
, x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c
        FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS n, round(min(value), 3) AS min_value, round(max(value), 3) AS max_value, round(sum(value) / count(*), 3) AS avg_value,
       round(max(value) FILTER (i = least(c - 1, floor(c * 0.5))), 3) AS p50, round(max(value) FILTER (i = least(c - 1, floor(c * 0.95))), 3) AS p95
FROM x GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
SELECT index_version, count(*)::BIGINT AS n_facts, count(DISTINCT fact_id)::BIGINT AS n_distinct,
       count(*) FILTER (fact_kind = 'diagnostic')::BIGINT AS n_diagnostics, count(*) FILTER (confidence = 'unresolved')::BIGINT AS n_unresolved
FROM semantic_facts GROUP BY index_version""", graph=False)
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "semantic_facts").groupBy("index_version").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.countDistinct("fact_id").alias("n_distinct"),
        F.count_if(F.col("fact_kind") == "diagnostic").alias("n_diagnostics"),
        F.count_if(F.col("confidence") == "unresolved").alias("n_unresolved"),
    )


@query("""
SELECT coalesce(language, '(none)') AS language, max(CASE fact_kind WHEN 'edge' THEN 2 WHEN 'node' THEN 1 ELSE 0 END)::INT AS tier,
       arg_max(frontend_name, CASE fact_kind WHEN 'edge' THEN 2 WHEN 'node' THEN 1 ELSE 0 END || coalesce(frontend_name, '')) AS frontend
FROM semantic_facts GROUP BY ALL""", graph=False)
def language_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("fact_kind") == "edge", 2).when(F.col("fact_kind") == "node", 1).otherwise(0)
    best = table(spark, sf_dir, "semantic_facts").groupBy(F.coalesce("language", F.lit("(none)")).alias("language")).agg(
        F.max(F.struct(tier.alias("tier"), F.coalesce("frontend_name", F.lit("")).alias("frontend"))).alias("b")
    )
    return best.select("language", "b.tier", "b.frontend")


@query("""
SELECT source_root, index_version, sum(file_size)::BIGINT AS n_bytes, sum(line_count)::BIGINT AS n_lines, count(*)::BIGINT AS n_files
FROM (SELECT DISTINCT * FROM files) GROUP BY ALL""", graph=False)
def storage_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").distinct().groupBy("source_root", "index_version").agg(
        F.sum("file_size").alias("n_bytes"), F.sum(F.col("line_count").cast("bigint")).alias("n_lines"), F.count(F.lit(1)).alias("n_files")
    )


# Filters and lookups ----------------------------------------------------------


@query("".join(
    f"{'UNION ALL ' if i else ''}SELECT '{p}' AS profile, kind, count(*)::BIGINT AS n_edges FROM e "
    f"WHERE coalesce(confidence, 'confirmed') IN ({_names(levels)}) GROUP BY kind "
    for i, (p, (levels, _)) in enumerate(vocabulary.PROFILES.items())
))
def confidence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.filter(
        F.array(*[F.when(F.coalesce("confidence", F.lit("confirmed")).isin(*levels), F.lit(p)) for p, (levels, _) in vocabulary.PROFILES.items()]),
        lambda x: x.isNotNull(),
    )
    return load(spark, sf_dir, edges="id kind confidence").edges.select("kind", F.explode(allowed).alias("profile")).groupBy("profile", "kind").agg(F.count(F.lit(1)).alias("n_edges"))


_SITES = """
, f AS (SELECT DISTINCT source, target, edge_kind AS kind, coalesce(path, '') || ':' || coalesce(start_line::VARCHAR, '') AS site, confidence FROM semantic_facts
        WHERE fact_kind = 'edge' AND source IS NOT NULL AND target IS NOT NULL),
s AS (SELECT source, target, kind, count(DISTINCT site)::BIGINT AS n_sites, count(DISTINCT site) FILTER (coalesce(confidence, '') <> 'heuristic') AS n_sure FROM f GROUP BY ALL)"""


def _callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, n_sites, n_guessed) from the facts of edges; a place that any delivery is sure of is no guess."""
    facts = table(spark, sf_dir, "semantic_facts").where("fact_kind = 'edge' AND source IS NOT NULL AND target IS NOT NULL")
    site = F.concat(F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    sites = facts.groupBy("source", "target", F.col("edge_kind").alias("kind"), site.alias("site")).agg(
        F.bool_and(F.coalesce("confidence", F.lit("")) == "heuristic").alias("guessed")
    )
    return sites.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("guessed").alias("n_guessed"))


@query(_SITES + """
SELECT CASE WHEN coalesce(resolution_status, 'resolved') <> 'resolved' THEN 'unresolved'
            WHEN confidence = 'heuristic' OR s.n_sites > 0 AND s.n_sure = 0 THEN 'heuristic' WHEN s.n_sure < s.n_sites THEN 'mixed_evidence'
            WHEN confidence = 'runtime-only' THEN 'runtime_evidence' ELSE 'static_evidence' END AS basis, e.kind, count(*)::BIGINT AS n_edges
FROM e LEFT JOIN s ON s.source = e.source AND s.target = e.target AND s.kind = e.kind GROUP BY ALL""")
def connection_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, edges="id source target kind confidence resolution_status").edges
    joined = edges.join(_callsites(spark, sf_dir), ["source", "target", "kind"], "left")
    return joined.groupBy(filters.connection_basis("n_sites", "n_guessed").alias("basis"), "kind").agg(F.count(F.lit(1)).alias("n_edges"))


@query(_SITES + """
, g AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL)
SELECT s.source, s.target, s.kind, s.n_sites, (s.n_sites - s.n_sure)::BIGINT AS n_guessed, CASE WHEN g.source IS NULL THEN 'no_edge' ELSE 'edge' END AS state
FROM s LEFT JOIN g ON g.source = s.source AND g.target = s.target AND g.kind = s.kind""")
def callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each call, how many are guesses, and whether the graph has an edge for it."""
    key = ["source", "target", "kind"]
    edges = load(spark, sf_dir).edges.where("target IS NOT NULL").select(*key).distinct().withColumn("has", F.lit(True))
    return _callsites(spark, sf_dir).join(edges, key, "left").select(*key, "n_sites", "n_guessed", F.when(F.col("has"), "edge").otherwise("no_edge").alias("state"))


@query("""
, hits AS (
  SELECT id, kind, name, qualname, path, CASE WHEN starts_with(lower(name), 'bind_') THEN 0 WHEN starts_with(lower(qualname), 'bind_') THEN 1
         WHEN starts_with(lower(id), 'bind_') THEN 2 WHEN starts_with(lower(path), 'bind_') THEN 3 ELSE 4 END AS rank
  FROM n WHERE contains(lower(name), 'bind_') OR contains(lower(qualname), 'bind_') OR contains(lower(id), 'bind_') OR contains(lower(path), 'bind_'))
SELECT id, kind, name, qualname, path, rank::INT AS rank, (SELECT count(*) FROM hits)::BIGINT AS n_total FROM hits
ORDER BY rank, kind, name NULLS FIRST, id LIMIT 100""")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(load(spark, sf_dir, nodes="id kind name qualname path").nodes, "bind_")


@query("""
SELECT reason, count(*)::BIGINT AS n_nodes FROM (
  SELECT CASE WHEN kind IN ('source_root', 'package') THEN 'kind' WHEN path IS NULL THEN 'external'
    WHEN starts_with(path, 'tests/') OR starts_with(path, 'backend/tests/') OR contains(path, '/tests/') OR kind = 'test_case' THEN 'test'
    WHEN regexp_matches(lower(path), '(^|/)(generated|dist|build|node_modules)/|\\.(gen|generated|min)\\.[a-z]+$') THEN 'generated' ELSE '(kept)' END AS reason FROM n)
GROUP BY reason""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(filters.exclusion_reason(vocabulary.CONTAINER_KINDS), F.lit("(kept)"))
    return load(spark, sf_dir, nodes="id kind path").nodes.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query("""
, ev AS (SELECT id, kind, evidence FROM edges GROUP BY ALL)
SELECT kind, count(*)::BIGINT AS n_edges FROM ev
WHERE len(evidence) > 0 AND len(list_filter(evidence, lambda x: x.kind IS NOT DISTINCT FROM 'ast_local_import')) = len(evidence) GROUP BY kind""")
def local_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, edges="id kind evidence").edges
    return edges.where(filters.only_local_imports()).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"""
, q AS (SELECT DISTINCT name AS query FROM n WHERE kind IN ('class', 'table', 'route') UNION SELECT DISTINCT path FROM files UNION SELECT 'mod:' || module FROM files
        UNION SELECT DISTINCT split_part(qualname, '.', -2) || '.' || split_part(qualname, '.', -1) FROM n WHERE kind = 'method' AND qualname IS NOT NULL),
keys AS (
  SELECT id AS k, id, 0 AS r FROM n UNION SELECT qualname, id, 1 FROM n UNION SELECT path, id, 3 FROM n
  UNION SELECT name, id, CASE WHEN kind IN ({_names(vocabulary.RESOURCE_KINDS)}) THEN 4 ELSE 5 END FROM n
  UNION SELECT array_to_string(list_slice(string_split(qualname, '.'), i, 10000), '.'), id, 6
        FROM (SELECT qualname, id, unnest(range(2, len(string_split(qualname, '.')) + 1)) AS i FROM n WHERE qualname IS NOT NULL)
), forms AS (
  SELECT query, query AS k, NULL AS f FROM q WHERE query <> ''
  UNION SELECT query, p || ':' || query, 2 FROM q, (SELECT unnest([{_names(vocabulary.ID_PREFIXES)}]) AS p) WHERE NOT contains(query, ':') AND query <> ''
), hits AS (
  SELECT DISTINCT query, id, coalesce(f, r) AS r FROM forms JOIN keys USING (k) WHERE k <> '' AND (f IS NULL OR r = 0)
), best AS (SELECT query, r, count(*) AS c, min(id) AS id FROM hits h WHERE r = (SELECT min(r) FROM hits g WHERE g.query = h.query) GROUP BY query, r)
SELECT query, CASE WHEN b.c IS NULL THEN 'unresolved' WHEN b.c = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  (['exact_id', 'exact_qualname', 'normalized_id', 'exact_path', 'resource_name', 'exact_name', 'qualname_suffix'])[b.r + 1] AS strategy,
  CASE WHEN b.c = 1 THEN b.id END AS id, coalesce(b.c, 0)::BIGINT AS n_candidates
FROM (SELECT DISTINCT query FROM q WHERE query <> '') LEFT JOIN best b USING (query)""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, files = load(spark, sf_dir, nodes="id kind name qualname path").nodes, table(spark, sf_dir, "files")
    parts = F.split("qualname", r"\.")
    tail = F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.concat(F.lit("."), F.col("qualname")))
    asked = (
        nodes.where(F.col("kind").isin("class", "table", "route")).select(F.col("name").alias("query"))
        .unionByName(files.select(F.col("path").alias("query")))
        .unionByName(files.select(F.concat(F.lit("mod:"), F.col("module")).alias("query")))
        .unionByName(nodes.where("kind = 'method' AND qualname IS NOT NULL").select(tail.alias("query")))
    )
    return resolve.resolve(asked, nodes)


# Merging ----------------------------------------------------------------------


@query(f"""
, r AS (SELECT *, {_case("coalesce(confidence, 'confirmed')", {c: i for i, c in enumerate(vocabulary.CONFIDENCE_LEVELS)}, 1)} AS rk FROM e),
ev AS (SELECT source, target, kind, semantic_role, count(DISTINCT x)::BIGINT AS n FROM
       (SELECT DISTINCT id, source, target, kind, semantic_role, unnest(evidence) AS x FROM edges) WHERE x IS NOT NULL GROUP BY ALL)
SELECT r.source, r.target, r.kind, r.semantic_role, arg_max_null(confidence, (rk, -id)) AS confidence, arg_max_null(resolution_status, (rk, -id)) AS resolution_status,
       count(*)::BIGINT AS n_merged, min(id) AS first_seq, coalesce(any_value(ev.n), 0)::BIGINT AS n_evidence
FROM r LEFT JOIN ev ON ev.source IS NOT DISTINCT FROM r.source AND ev.target IS NOT DISTINCT FROM r.target AND ev.kind = r.kind
  AND ev.semantic_role IS NOT DISTINCT FROM r.semantic_role
GROUP BY r.source, r.target, r.kind, r.semantic_role""")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_edges(load(spark, sf_dir, edges="id source target kind confidence semantic_role resolution_status evidence").edges)


@query("SELECT kind, count(*)::BIGINT AS n_nodes, count(path)::BIGINT AS n_with_path, min(id) AS first_id FROM n GROUP BY kind")
def node_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, nodes="id kind path").nodes.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count("path").alias("n_with_path"), F.min("id").alias("first_id")
    )


@query("""
, x AS (SELECT DISTINCT source, kind, target, v.path AS path, v.start_line AS start_line FROM
        (SELECT source, kind, target, unnest(evidence) AS v FROM edges WHERE confidence = 'confirmed' AND target IS NOT NULL)
        WHERE v IS NOT NULL AND v.path IS NOT NULL AND v.start_line IS NOT NULL),
y AS (SELECT source, kind, path, start_line, count(*)::BIGINT AS n_targets FROM x GROUP BY ALL HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY path, start_line)::INT AS occurrence FROM y""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.conflicts(load(spark, sf_dir, edges="id source target kind confidence evidence").edges)


@query("""
SELECT id, 'source' AS "end", source AS node_id, 'error' AS severity FROM e WHERE source NOT IN (SELECT id FROM n)
UNION ALL SELECT id, 'target', target, 'error' FROM e WHERE target NOT IN (SELECT id FROM n)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, nodes="id")
    return merge.dangling(g.edges, g.nodes)


@query("""
SELECT source, target, max(w)::DOUBLE AS score FROM (
  SELECT least(source, target) AS source, greatest(source, target) AS target, """ + _case("coalesce(confidence, 'confirmed')", vocabulary.CONFIDENCE_WEIGHTS, 0.25) + """ AS w
  FROM e WHERE kind = 'similar_to' AND source IS NOT NULL AND target IS NOT NULL) GROUP BY ALL""")
def undirected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, edges="id source target kind confidence").edges.where("kind = 'similar_to'")
    weight = vocabulary.lookup(F.coalesce("confidence", F.lit("confirmed")), vocabulary.CONFIDENCE_WEIGHTS, vocabulary.OTHER_CONFIDENCE_WEIGHT)
    return merge.undirected(edges.withColumn("score", weight), "score")


# Traversal --------------------------------------------------------------------

_CALLS = _names(vocabulary.CALL_KINDS)


@query(f"""SELECT target AS id, count(DISTINCT source)::BIGINT AS n_callers FROM e
WHERE kind IN ({_CALLS}) AND target IN (SELECT id FROM n WHERE kind IN ('class', 'table')) GROUP BY target""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    found = traverse.neighbours(g.edges, g.nodes.where(F.col("kind").isin("class", "table")), "target", vocabulary.CALL_KINDS)
    return found.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n_callers"))


@query(f"""SELECT source AS id, count(DISTINCT target)::BIGINT AS n_callees FROM e
WHERE kind IN ({_CALLS}) AND source IN (SELECT id FROM n WHERE kind = 'function') GROUP BY source""")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    found = traverse.neighbours(g.edges, g.nodes.where("kind = 'function'"), "source", vocabulary.CALL_KINDS)
    return found.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n_callees"))


@query(f"""
SELECT id, direction, kind, count(*)::BIGINT AS n_edges, count(*) FILTER (coalesce(confidence, 'confirmed') = 'unresolved')::BIGINT AS n_excluded FROM (
  SELECT target AS id, 'in' AS direction, kind, confidence FROM e UNION ALL SELECT source, 'out', kind, confidence FROM e)
WHERE kind IN ({_names(vocabulary.RELATION_EDGES)}) AND id IN (SELECT id FROM n WHERE kind IN ({_names(vocabulary.RESOURCE_KINDS)})) GROUP BY ALL""")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, edges="id source target kind confidence")
    ends = g.edges.where(F.col("kind").isin(*vocabulary.RELATION_EDGES)).select(
        "kind", "confidence", F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit("in").alias("direction")), F.struct(F.col("source").alias("id"), F.lit("out").alias("direction")))).alias("x")
    ).select("kind", "confidence", "x.*")
    kept = ends.join(g.nodes.where(F.col("kind").isin(*vocabulary.RESOURCE_KINDS)).select("id"), "id", "left_semi")
    return kept.groupBy("id", "direction", "kind").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.coalesce("confidence", F.lit("confirmed")) == "unresolved").alias("n_excluded")
    )


@query("""
SELECT m.id, count(DISTINCT o.target)::BIGINT AS n_out, (SELECT count(DISTINCT source) FROM e WHERE kind = 'imports' AND target = m.id)::BIGINT AS n_in
FROM (SELECT id FROM n WHERE kind = 'module') m LEFT JOIN e o ON o.kind = 'imports' AND o.source = m.id GROUP BY m.id""")
def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    links = g.edges.where("kind = 'imports'")
    out = links.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n_out"))
    into = links.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n_in"))
    zero = F.lit(0).cast("bigint")
    modules = g.nodes.where("kind = 'module'").select("id")
    return modules.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


@query(f"""RECURSIVE
c AS (SELECT DISTINCT source, target FROM e WHERE kind IN ({_CALLS}) AND coalesce(confidence, 'confirmed') <> 'unresolved'),
w AS (SELECT id, 0 AS depth FROM n WHERE kind = 'table' UNION SELECT c.source, w.depth + 1 FROM w JOIN c ON c.target = w.id WHERE w.depth < 3)
SELECT id, min(depth)::INT AS depth FROM w WHERE id IS NOT NULL GROUP BY id""")
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    edges = filters.by_kind(g.deliveries, vocabulary.CALL_KINDS)
    return traverse.reach_nodes(edges, g.nodes.where("kind = 'table'"), 3, reverse=True, settle=g.settle("review_default"))


@query(f"""
, c AS (SELECT DISTINCT source, target, kind FROM e WHERE kind IN ({_CALLS}) AND target IS NOT NULL AND coalesce(confidence, 'confirmed') <> 'unresolved'),
s1 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY source, kind) AS r FROM c WHERE target IN (SELECT id FROM n WHERE kind = 'external_package')) WHERE r <= 200),
t1 AS (SELECT source, target, kind FROM s1 ORDER BY source, target, kind LIMIT 5000),
f1 AS (SELECT DISTINCT source AS id FROM t1 WHERE source NOT IN (SELECT id FROM n WHERE kind = 'external_package')),
s2 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY source, kind) AS r FROM c WHERE target IN (SELECT id FROM f1)) WHERE r <= 200),
t2 AS (SELECT source, target, kind FROM s2 ORDER BY source, target, kind LIMIT (5000 - (SELECT count(*) FROM t1)))
SELECT source, target, kind, 1 AS depth FROM t1 UNION ALL SELECT source, target, kind, 2 FROM t2""")
def impact_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk with its caps on: 200 edges into a node, 5000 in all."""
    g = load(spark, sf_dir)
    edges = filters.by_kind(g.deliveries, vocabulary.CALL_KINDS)
    seeds = g.nodes.where("kind = 'external_package'")
    return traverse.reach(edges, seeds, 2, True, vocabulary.FAN_IN_CAP, vocabulary.EDGE_CAP, g.settle("review_default"))[1]


_CAPPED = """c AS (SELECT DISTINCT source, target, kind FROM e WHERE kind IN ({kinds}) AND target IS NOT NULL AND coalesce(confidence, 'confirmed') <> 'unresolved'),
seed AS (SELECT id FROM n WHERE kind IN ({seeds})),
s1 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY source, kind) AS r FROM c WHERE target IN (SELECT id FROM seed))),
t1 AS (SELECT source, target, kind FROM s1 WHERE r <= {fan} ORDER BY source, target, kind LIMIT {cap}),
f1 AS (SELECT DISTINCT source AS id FROM t1 WHERE source NOT IN (SELECT id FROM seed)),
s2 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY target ORDER BY source, kind) AS r FROM c WHERE target IN (SELECT id FROM f1))),
t2 AS (SELECT source, target, kind FROM s2 WHERE r <= {fan} ORDER BY source, target, kind LIMIT greatest(0, {cap} - (SELECT count(*) FROM t1))),
f2 AS (SELECT DISTINCT source AS id FROM t2 WHERE source NOT IN (SELECT id FROM seed UNION SELECT id FROM f1))"""


@query(", " + _CAPPED.format(kinds=_CALLS, seeds="'table', 'class'", fan=40, cap=5000) + """,
full1 AS (SELECT count(*) >= 5000 AS full_ FROM t1)
SELECT 1 AS depth, 'max_fan_in' AS reason, count(*)::BIGINT AS n FROM s1 WHERE r = 41 HAVING count(*) > 0
UNION ALL SELECT 1, 'max_edges', count(*) - (SELECT count(*) FROM t1) FROM s1 WHERE r <= 40 HAVING count(*) > (SELECT count(*) FROM t1)
UNION ALL SELECT 2, 'max_fan_in', count(*) FROM s2 WHERE r = 41 AND NOT (SELECT full_ FROM full1) HAVING count(*) > 0
UNION ALL SELECT 2, 'max_edges', count(*) - (SELECT count(*) FROM t2) FROM s2 WHERE r <= 40 AND NOT (SELECT full_ FROM full1) HAVING count(*) > (SELECT count(*) FROM t2)
UNION ALL SELECT 2, 'max_edges', count(*) FROM s2 WHERE (SELECT full_ FROM full1) HAVING count(*) > 0
UNION ALL SELECT 2, 'max_depth', count(*) FROM c WHERE target IN (SELECT id FROM f2) AND NOT (SELECT full_ FROM full1) HAVING count(*) > 0""")
def impact_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a capped walk of two steps left edges out, and why."""
    g = load(spark, sf_dir)
    edges = filters.by_kind(g.deliveries, vocabulary.CALL_KINDS)
    seeds = g.nodes.where("kind IN ('table', 'class')")
    return traverse.walk(edges, seeds, 2, True, 40, vocabulary.EDGE_CAP, g.settle("review_default"))[2]


@query(f"""RECURSIVE
c AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL AND coalesce(confidence, 'confirmed') <> 'unresolved'),
seed AS (SELECT id FROM n WHERE kind IN ('route', 'worker_task')),
start AS (SELECT id FROM seed UNION SELECT source FROM c WHERE kind IN ('enqueues', 'consumes') AND target IN (SELECT id FROM seed)),
w AS (SELECT id, 0 AS depth FROM start UNION SELECT c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 4 AND c.kind IN ({_names(vocabulary.FLOW_KINDS)}))
SELECT id, min(depth)::INT AS depth FROM w GROUP BY id""")
def entrypoint_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entrypoints reach in four steps, begun at them and at what enqueues or consumes into them."""
    edges, settle, start, depth = _flow(spark, sf_dir, 4)
    return traverse.reach_nodes(edges, start, depth, settle=settle)


@query(f"""RECURSIVE
c AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL AND coalesce(confidence, 'confirmed') <> 'unresolved'),
seed AS (SELECT id FROM n WHERE kind IN ('route', 'worker_task')),
start AS (SELECT id FROM seed UNION SELECT source FROM c WHERE kind IN ('enqueues', 'consumes') AND target IN (SELECT id FROM seed)),
w AS (SELECT id, 0 AS depth FROM start UNION SELECT c.target, w.depth + 1 FROM w JOIN c ON c.source = w.id WHERE w.depth < 2 AND c.kind IN ({_names(vocabulary.FLOW_KINDS)})),
d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT 2 AS depth, 'max_depth' AS reason, count(*)::BIGINT AS n FROM c JOIN d ON d.id = c.source AND d.depth = 2
WHERE c.kind IN ({_names(vocabulary.FLOW_KINDS)}) HAVING count(*) > 0""")
def entrypoint_flow_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two steps leave anything of the flow out."""
    edges, settle, start, depth = _flow(spark, sf_dir, 2)
    return traverse.walk(edges, start, depth, settle=settle)[2]


def _flow(spark: SparkSession, sf_dir: str, depth: int) -> tuple:
    """Edges, their settling, where the flow starts, and how far it goes."""
    g = load(spark, sf_dir)
    seeds = g.nodes.where(F.col("kind").isin("route", "worker_task")).select("id")
    settle = g.settle("review_default")
    feeding = settle(g.deliveries.where("kind IN ('enqueues', 'consumes')").join(seeds.withColumnRenamed("id", "target"), "target", "left_semi"))
    start = seeds.unionByName(feeding.select(F.col("source").alias("id")))
    return filters.by_kind(g.deliveries, vocabulary.FLOW_KINDS), settle, start, min(depth, vocabulary.DEPTH_CAP)


@query("SELECT target AS endpoint, kind, count(*)::BIGINT AS n_edges FROM e WHERE target IS NOT NULL GROUP BY ALL ORDER BY n_edges DESC, endpoint, kind LIMIT 20")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.fan(load(spark, sf_dir).edges, "target")


@query("SELECT source AS endpoint, kind, count(*)::BIGINT AS n_edges FROM e WHERE source IS NOT NULL GROUP BY ALL ORDER BY n_edges DESC, endpoint, kind LIMIT 20")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.fan(load(spark, sf_dir).edges, "source")


@query("""RECURSIVE
p AS (SELECT source AS a, target AS b FROM e WHERE kind = 'similar_to' AND target IS NOT NULL UNION SELECT target, source FROM e WHERE kind = 'similar_to' AND target IS NOT NULL),
r AS (SELECT a AS id, a AS o FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.o)
SELECT id, min(o) AS component FROM r GROUP BY id""")
def similarity_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.components(load(spark, sf_dir).deliveries.where("kind = 'similar_to'"))


@query("""RECURSIVE
c AS (SELECT DISTINCT source, target FROM e WHERE kind = 'imports' AND starts_with(source, 'mod:') AND starts_with(target, 'mod:')),
r AS (SELECT source AS id, target AS o FROM c UNION SELECT r.id, c.target FROM r JOIN c ON c.source = r.o)
SELECT r.id, min(r.o) AS component FROM r JOIN r s ON s.id = r.o AND s.o = r.id GROUP BY r.id""")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir).deliveries.where("kind = 'imports' AND startswith(source, 'mod:') AND startswith(target, 'mod:')")
    return traverse.strong_components(edges)


@query("""RECURSIVE
c AS (SELECT DISTINCT source, target FROM e WHERE kind IN ('contains', 'defines') AND source IS NOT NULL AND target IS NOT NULL),
t AS (SELECT id FROM (SELECT source AS id FROM c UNION SELECT target FROM c) WHERE id NOT IN (SELECT target FROM c)
  UNION SELECT c.target FROM t JOIN c ON c.source = t.id),
k AS (SELECT * FROM c WHERE source NOT IN (SELECT id FROM t)),
r AS (SELECT source AS id, target AS o FROM k UNION SELECT r.id, k.target FROM r JOIN k ON k.source = r.o)
SELECT r.id, min(r.o) AS component FROM r JOIN r s ON s.id = r.o AND s.o = r.id GROUP BY r.id""")
def containment_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that hold themselves by way of contains and defines, by cycle."""
    return traverse.strong_components(load(spark, sf_dir).deliveries.where("kind IN ('contains', 'defines')"))


@query("""
, s AS (SELECT id FROM n WHERE kind = 'route'),
one AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL AND (source IN (SELECT id FROM s) OR target IN (SELECT id FROM s))),
f AS (SELECT source AS id FROM one UNION SELECT target FROM one),
two AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL AND (source IN (SELECT id FROM f WHERE id NOT IN (SELECT id FROM s)) OR target IN (SELECT id FROM f WHERE id NOT IN (SELECT id FROM s))))
SELECT * FROM one UNION SELECT * FROM two""")
def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    return traverse.ego(g.edges, g.nodes.where("kind = 'route'"), 2)


_WEIGHT = f"round({_case('kind', vocabulary.KIND_WEIGHTS, 1.0)} * {_case(chr(99) + 'onf', vocabulary.CONFIDENCE_WEIGHTS, 0.25)} * 10000)::BIGINT"


@query(f"""
, m AS MATERIALIZED (SELECT id, repo_id AS module FROM n WHERE repo_id IS NOT NULL),
y AS MATERIALIZED (SELECT source, target, kind, coalesce(confidence, 'confirmed') AS conf FROM e),
x AS (SELECT a.module AS from_module, b.module AS to_module, conf, {_WEIGHT} AS w FROM y e
      JOIN m a ON a.id = e.source JOIN m b ON b.id = e.target WHERE a.module <> b.module AND kind NOT IN ({_names(vocabulary.LAYOUT_EXCLUDED_EDGES)})),
l AS (SELECT from_module, to_module, conf, count(*) AS c, sum(w) AS w FROM x GROUP BY ALL)
SELECT from_module, to_module, sum(c)::BIGINT AS n_edges, sum(w)::BIGINT / 10000 AS weight,
       arg_max(conf, (c, -{_case('conf', {c: i for i, c in enumerate(vocabulary.LAYOUT_ORDER)}, 5)})) AS dominant
FROM l GROUP BY ALL""")
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, nodes="id repo_id", edges="id source target kind confidence")
    return aggregate.module_graph(g.edges, g.nodes.where("repo_id IS NOT NULL").select("id", F.col("repo_id").alias("module")))


@query(f"""
, x AS (SELECT unnest([source, target]) AS id, {_WEIGHT} AS w FROM (SELECT *, coalesce(confidence, 'confirmed') AS conf FROM e)
        WHERE kind NOT IN ({_names(vocabulary.LAYOUT_EXCLUDED_EDGES)}))
SELECT id, sum(w)::BIGINT / 10000 AS degree FROM x WHERE id IS NOT NULL GROUP BY id HAVING sum(w) >= 50000 ORDER BY degree DESC, id LIMIT 400""")
def symbol_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.weighted_degree(load(spark, sf_dir, edges="id source target kind confidence").edges)


@query("""
, f AS (SELECT DISTINCT regexp_replace(path, '^(\\./)+', '') AS path, source_root FROM files)
SELECT coalesce(f.source_root, 'external') AS source_root, n.kind, count(*)::BIGINT AS n_nodes FROM n LEFT JOIN f USING (path) GROUP BY ALL""")
def system_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select(F.regexp_replace("path", r"^(\./)+", "").alias("path"), "source_root").distinct()
    joined = load(spark, sf_dir, nodes="id kind path").nodes.join(files, "path", "left")
    return joined.groupBy(F.coalesce("source_root", F.lit("external")).alias("source_root"), "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


_LAYERS = {"source_root": 0, "package": 1, "module": 2, "class": 3, "interface": 3, "component": 3, "function": 4, "method": 4}


@query(f"""
, k AS (SELECT id, kind AS k, path FROM n)
SELECT a.k AS from_kind, b.k AS to_kind, count(*)::BIGINT AS n_edges,
       count(*) FILTER (coalesce(starts_with(a.path, 'tests/') OR starts_with(a.path, 'backend/tests/') OR contains(a.path, '/tests/'), false))::BIGINT AS n_exempt
FROM e JOIN k a ON a.id = e.source JOIN k b ON b.id = e.target
WHERE e.kind = 'imports' AND {_case('b.k', _LAYERS, -1)} > {_case('a.k', _LAYERS, 99)} GROUP BY ALL""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, nodes="id kind path")
    order = lambda c, other: vocabulary.lookup(F.col(c), _LAYERS, other)
    joined = (
        g.edges.where("kind = 'imports'").select("source", "target")
        .join(g.nodes.select(F.col("id").alias("source"), F.col("kind").alias("from_kind"), "path"), "source")
        .join(g.nodes.select(F.col("id").alias("target"), F.col("kind").alias("to_kind")), "target")
    )
    return joined.where(order("to_kind", -1) > order("from_kind", 99)).groupBy("from_kind", "to_kind").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(identity.is_test_path(F.col("path"))).alias("n_exempt")
    )


@query("""RECURSIVE
changed AS (SELECT DISTINCT 'mod:' || module AS id FROM files WHERE module IS NOT NULL AND index_version = (SELECT max(index_version) FROM files))
, dep AS (SELECT DISTINCT source, target FROM e WHERE kind = 'imports' AND target IS NOT NULL)
, walk AS (SELECT id, 0 AS depth FROM changed
  UNION SELECT d.source, w.depth + 1 FROM walk w JOIN dep d ON d.target = w.id WHERE w.depth < (SELECT count(DISTINCT source) FROM dep))
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""")
def dependent_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules changed by the newest build and all that imports them, until nothing new is met."""
    files = table(spark, sf_dir, "files")
    newest = files.agg(F.max("index_version").alias("index_version"))
    changed = files.join(F.broadcast(newest), "index_version").select(F.concat(F.lit("mod:"), F.col("module")).alias("id"))
    return traverse.reach_nodes(load(spark, sf_dir).deliveries.where("kind = 'imports'"), changed, 2**31 - 1, reverse=True)


@query("""
, live AS (SELECT DISTINCT id FROM n), born AS (SELECT DISTINCT id FROM nodes WHERE first_indexed_at >= TIMESTAMP '2026-05-01')
SELECT kind, count(*)::BIGINT AS n_edges FROM e WHERE source IN (SELECT id FROM live) AND source NOT IN (SELECT id FROM born)
  AND target IS NOT NULL AND target NOT IN (SELECT id FROM live) GROUP BY kind""")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, nodes="id")
    born = table(spark, sf_dir, "nodes").where("first_indexed_at >= TIMESTAMP_NTZ '2026-05-01'").select("id")
    return deltas.stale_targets(g.edges, g.nodes, born).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"))


def _has(column: str, words, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, '{w}')" for w in words) + ")"


#: The rules of the triage over facts that are not resolved; a fact delivered in several ways is judged in each.
_UNRESOLVED = f"""
WITH u AS (
  SELECT DISTINCT fact_id, path, start_line, nullif(split_part(coalesce(target, ''), ':', 2), '') AS raw_expression,
         resolution_json ->> '$.fallbacks[0]' AS failed_strategy, properties_json
  FROM semantic_facts WHERE (resolution_json ->> '$.status') <> 'resolved'
), t AS (
  SELECT *, lower(coalesce(raw_expression, '<unknown>')) AS x, coalesce(failed_strategy, 'unknown') AS f,
         lower(replace(coalesce(path, ''), chr(92), '/')) AS file FROM u
), judged AS (
  SELECT fact_id, path, start_line, raw_expression, failed_strategy, CASE
    WHEN f = 'union_receiver' AND (properties_json ->> '$.semantic_reason') = 'ambiguous_union_receiver' THEN 'true_dynamic_call'
    WHEN {_has('x', triage.MOCK_PARTS)} THEN 'mock_or_assertion'
    WHEN x IN ({_names(triage.FRAMEWORK_NAMES)}) THEN 'framework_magic'
    WHEN {_has('x', triage.DECORATOR_ENDS, 'ends_with')} AND {_has('x', triage.FRAMEWORK_RECEIVERS)} THEN 'framework_magic'
    WHEN NOT {_has('x', triage.DECORATOR_ENDS, 'ends_with')} AND {_has('x', triage.FRAMEWORK_PARTS)} THEN 'framework_magic'
    WHEN x IN ({_names(triage.SERVICE_NAMES)}) OR {_has('x', triage.SERVICE_METHODS)} AND {_has('x', triage.SERVICE_RECEIVERS)} THEN 'external_service_boundary'
    WHEN f IN ({_names(triage.UNTYPED_STRATEGIES)}) OR {" OR ".join(f"coalesce(properties_json ->> '$.{n}', '') = 'true'" for n in triage.UNTYPED_FLAGS)}
      OR lower(coalesce(properties_json ->> '$.receiver_type_status', '')) IN ({_names(triage.UNTYPED_STATES)}) THEN 'missing_type_context'
    WHEN {_has('file', triage.GENERATED_PATHS)} OR {_has('x', triage.REFLECTION_PARTS)} THEN 'generated_or_reflection'
    WHEN f IN ({_names(triage.DYNAMIC_STRATEGIES)}) OR coalesce(properties_json ->> '$.callee_binding_kind', '') IN ({_names(triage.DYNAMIC_BINDINGS)}) THEN 'true_dynamic_call'
    ELSE 'static_candidate' END AS category FROM t
), c(category, risk, blocking) AS (VALUES {", ".join(f"('{c}', '{r}', {b})" for c, (r, b) in triage.CATEGORIES.items())})"""


def _unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get_json_object("resolution_json", "$.status")
    return table(spark, sf_dir, "semantic_facts").where(status != "resolved").select(
        "fact_id", "path", "start_line", F.nullif(F.split_part(F.coalesce("target", F.lit("")), F.lit(":"), F.lit(2)), F.lit("")).alias("raw_expression"),
        F.get_json_object("resolution_json", "$.fallbacks[0]").alias("failed_strategy"), "properties_json",
    ).distinct()


@query(_UNRESOLVED + """
SELECT j.fact_id, j.path, coalesce(j.start_line, -1)::INT AS start_line, j.raw_expression, j.failed_strategy, j.category, c.risk AS risk_level, c.blocking AS release_blocking
FROM judged j JOIN c USING (category)""", graph=False)
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact that is not resolved, with why; -1 for no line."""
    found = triage.annotate(_unresolved(spark, sf_dir)).withColumn("start_line", F.coalesce("start_line", F.lit(-1)))
    return found.select("fact_id", "path", "start_line", "raw_expression", "failed_strategy", "category", "risk_level", "release_blocking")


@query(_UNRESOLVED + """
SELECT c.category, c.risk, c.blocking, (SELECT count(*) FROM judged j WHERE j.category = c.category)::BIGINT AS n_calls FROM c""", graph=False)
def unresolved_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triage_counts(_unresolved(spark, sf_dir))


@query(f"""
SELECT n.kind, count(*)::BIGINT AS n_symbols, count(*) FILTER (id NOT IN (SELECT target FROM e WHERE kind = 'covers' AND target IS NOT NULL))::BIGINT AS n_gaps
FROM n WHERE kind IN ({_names(vocabulary.SEARCHABLE_KINDS)}) GROUP BY n.kind""")
def test_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    covered = g.edges.where("kind = 'covers'").select(F.col("target").alias("id")).distinct().withColumn("covered", F.lit(True))
    symbols = g.nodes.where(F.col("kind").isin(*vocabulary.SEARCHABLE_KINDS)).join(covered, "id", "left")
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("covered").isNull()).alias("n_gaps"))


# Intervals, prefixes, deltas --------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    at = table(spark, sf_dir, "edges").select(F.explode("evidence").alias("v")).where("v.path IS NOT NULL AND v.start_line IS NOT NULL")
    if kind:
        at = at.where(F.col("v.kind") == kind)
    return at.select(F.col("v.path").alias("path"), F.col("v.start_line").alias("line")).distinct()


@query("""
, p AS (SELECT DISTINCT v.path AS path, v.start_line AS line FROM (SELECT unnest(evidence) AS v FROM edges) WHERE v.kind = 'coverage_json')
SELECT n.id, count(DISTINCT p.line)::BIGINT AS n_lines FROM n JOIN p ON p.path = n.path AND p.line BETWEEN n.start_line AND coalesce(n.end_line, n.start_line) GROUP BY n.id""")
def coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, nodes="id path start_line end_line").nodes.select("id", "path", "start_line", "end_line")
    held = intervals.containing(_lines(spark, sf_dir, "coverage_json"), nodes, "path", "line", "start_line", "end_line")
    return held.groupBy("id").agg(F.countDistinct("line").alias("n_lines"))


@query("""
, p AS (SELECT DISTINCT v.path AS path, v.start_line AS line FROM (SELECT unnest(evidence) AS v FROM edges) WHERE v.path IS NOT NULL AND v.start_line IS NOT NULL),
h AS (SELECT p.path, p.line, n.id, coalesce(n.end_line, n.start_line) - n.start_line AS w FROM p JOIN n ON n.path = p.path
      AND p.line BETWEEN n.start_line AND coalesce(n.end_line, n.start_line)),
b AS (SELECT path, line, count(DISTINCT id) AS c, min(id) AS id FROM h WHERE w = (SELECT min(w) FROM h g WHERE g.path = h.path AND g.line = h.line) GROUP BY ALL)
SELECT path, line, CASE WHEN c = 1 THEN id END AS "match", CASE WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS match_state, c::BIGINT AS n_matches FROM b""")
def narrowest_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, nodes="id path start_line end_line").nodes.select("id", "path", "start_line", "end_line")
    return intervals.narrowest(_lines(spark, sf_dir), nodes, "path", "line", "start_line", "end_line", ["path", "line"], "id")


@query("""
, pk AS (SELECT DISTINCT regexp_replace(path, '/__init__\\.py$', '') AS d FROM n WHERE kind = 'package' AND path IS NOT NULL),
f AS (SELECT DISTINCT regexp_replace(path, '^(\\./)+', '') AS path FROM files)
SELECT f.path, arg_max(pk.d, length(pk.d)) AS parent FROM f LEFT JOIN pk ON f.path = pk.d OR starts_with(f.path, pk.d || '/') GROUP BY f.path""")
def package_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = load(spark, sf_dir, nodes="id kind path").nodes.where("kind = 'package' AND path IS NOT NULL").select(F.regexp_replace("path", r"/__init__\.py$", "").alias("folder"))
    files = table(spark, sf_dir, "files").select(F.regexp_replace("path", r"^(\./)+", "").alias("path"))
    return intervals.longest_prefix(files, "path", packages, "folder")


@query("""
, s AS (SELECT DISTINCT node_id, created_at, max(confidence) AS conf FROM semantic_facts WHERE node_id IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)
SELECT e.id, (SELECT arg_max(s.conf, s.created_at) FROM s WHERE s.node_id = e.source AND s.created_at <= e.created_at) AS fact_confidence
FROM e WHERE kind = 'calls'""")
def latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with the confidence of its source's latest fact before it."""
    calls = load(spark, sf_dir, edges="id source kind created_at").edges.where("kind = 'calls'").select("id", F.col("source").alias("node_id"), "created_at")
    facts = table(spark, sf_dir, "semantic_facts").where("confidence IS NOT NULL").select("node_id", F.col("created_at").alias("since"), F.col("confidence").alias("fact_confidence"))
    return intervals.as_of(calls, facts, "node_id", "created_at", "since", "fact_confidence").select("id", "fact_confidence")



@query("""
, v AS (SELECT DISTINCT index_version AS v FROM files ORDER BY 1 DESC LIMIT 2),
f AS (SELECT repo_id, regexp_replace(path, '^(\\./)+', '') AS path, index_version, max(lower(file_hash)) AS h FROM files GROUP BY ALL),
a AS (SELECT * FROM f WHERE index_version = (SELECT max(v) FROM v)), b AS (SELECT * FROM f WHERE index_version = (SELECT min(v) FROM v))
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path,
       CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.repo_id IS NOT DISTINCT FROM b.repo_id AND a.path = b.path""")
def file_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    clean = files.groupBy("repo_id", F.regexp_replace("path", r"^(\./)+", "").alias("path"), "index_version").agg(F.max(F.lower("file_hash")).alias("h"))
    last = files.select("index_version").distinct().orderBy(F.desc("index_version")).limit(2)
    order = F.row_number().over(Window.orderBy(F.desc("index_version")))  # two rows
    ranked = clean.join(F.broadcast(last.withColumn("age", order)), "index_version")
    return deltas.outer_diff(ranked.where("age = 2"), ranked.where("age = 1"), ["repo_id", "path"], ["h"])


def _field(name: str) -> str:
    return f"p ->> '$.{name}'"


@query(f"""
, s AS (SELECT stable_identity AS k, snapshot, arg_max(node_payload, delivered_at)::JSON AS p FROM node_identities GROUP BY ALL),
d AS (SELECT k, {_field('kind')} AS kind, {_field('path')} AS path, {_field('start_line')} AS line, {_field('qualname')} AS q, snapshot FROM s),
a AS (SELECT * FROM d WHERE snapshot = (SELECT min(snapshot) FROM s)), b AS (SELECT * FROM d WHERE snapshot = (SELECT max(snapshot) FROM s))
SELECT k AS key, unnest(CASE WHEN a.snapshot IS NULL THEN ['added'] WHEN b.snapshot IS NULL THEN ['removed'] ELSE
  list_filter([CASE WHEN a.kind IS DISTINCT FROM b.kind OR a.q IS DISTINCT FROM b.q THEN 'semantic' END,
               CASE WHEN a.path IS DISTINCT FROM b.path OR a.line IS DISTINCT FROM b.line THEN 'location' END], lambda x: x IS NOT NULL) END) AS category
FROM a FULL JOIN b USING (k)""")
def graph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the first and the last snapshot of nodes, by category."""
    rows = table(spark, sf_dir, "node_identities").groupBy("snapshot", F.col("stable_identity").alias("key")).agg(F.max_by("node_payload", "delivered_at").alias("p"))
    ends = table(spark, sf_dir, "node_identities").agg(F.min("snapshot").alias("lo"), F.max("snapshot").alias("hi"))
    field = lambda name: F.get_json_object("p", f"$.{name}")
    rows = rows.join(F.broadcast(ends)).where("snapshot IN (lo, hi)").select(
        "key", F.struct(field("kind"), field("qualname")).alias("semantic"), F.struct(field("path"), field("start_line")).alias("location"), (F.col("snapshot") == F.col("lo")).alias("first")
    )
    groups = {"semantic": F.col("semantic"), "location": F.col("location")}
    return deltas.graph_delta(rows.where("first"), rows.where("NOT first"), "key", groups)


@query("""
, d AS (SELECT DISTINCT path, coalesce(start_line, -1) AS start_line, frontend_name, index_version FROM semantic_facts WHERE fact_kind = 'diagnostic')
SELECT path, start_line, frontend_name, min(index_version) AS first_seen, max(index_version) AS last_seen, count(*)::BIGINT AS seen_count FROM d GROUP BY ALL""")
def diagnostic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "semantic_facts").where("fact_kind = 'diagnostic'").select(
        "path", F.coalesce("start_line", F.lit(-1)).alias("start_line"), "frontend_name", "index_version"
    ).distinct()
    return rows.groupBy("path", "start_line", "frontend_name").agg(
        F.min("index_version").alias("first_seen"), F.max("index_version").alias("last_seen"), F.count(F.lit(1)).alias("seen_count")
    )


@query("""
, b AS (SELECT index_version, run_status = 'success' AS done FROM index_builds),
c AS (SELECT max(index_version) AS v FROM b WHERE done)
SELECT index_version, CASE WHEN index_version = (SELECT v FROM c) THEN 'keep'
  WHEN done AND (SELECT count(*) FROM b x WHERE x.done AND x.index_version > b.index_version AND x.index_version <> (SELECT v FROM c)) < 4 THEN 'keep' ELSE 'remove' END AS action FROM b""")
def build_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.retention(table(spark, sf_dir, "index_builds"), "index_version", 5, complete=F.col("run_status") == "success")


@query("""
, r AS (SELECT DISTINCT repo_id FROM n WHERE repo_id IS NOT NULL),
a AS (SELECT repo_id, unnest(list_distinct([repo_id, split_part(repo_id, '-', 2), split_part(repo_id, '-', 1)])) AS alias FROM r),
d AS (SELECT DISTINCT s.repo_id, string_split(split_part(e.target, ':', 2), '.')[1] AS dep FROM e JOIN n s ON s.id = e.source
      WHERE e.kind = 'imports' AND s.repo_id IS NOT NULL AND e.target IS NOT NULL),
x AS (SELECT d.repo_id, d.dep, list_sort(list_distinct(list(a.repo_id))) AS found FROM d JOIN a ON a.alias = regexp_replace(d.dep, '_[0-9a-z]+$', '') AND a.repo_id <> d.repo_id GROUP BY ALL)
SELECT repo_id, dep AS dependency, CASE WHEN len(found) = 1 THEN found[1] END AS provider, CASE WHEN len(found) = 1 THEN 'hint' ELSE 'ambiguous' END AS state, len(found)::BIGINT AS n_candidates FROM x""")
def workspace_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which repository may provide what another one imports, by names and parts of names."""
    g = load(spark, sf_dir, nodes="id repo_id")
    repos = g.nodes.where("repo_id IS NOT NULL").select("repo_id").distinct()
    alias = F.array_distinct(F.array("repo_id", F.split_part("repo_id", F.lit("-"), F.lit(2)), F.split_part("repo_id", F.lit("-"), F.lit(1))))
    aliases = repos.select(F.col("repo_id").alias("provider"), F.explode(alias).alias("alias"))
    imports = g.edges.where("kind = 'imports' AND target IS NOT NULL").select("source", "target").join(
        g.nodes.where("repo_id IS NOT NULL").select(F.col("id").alias("source"), "repo_id"), "source"
    )
    top = F.split_part(F.split_part("target", F.lit(":"), F.lit(2)), F.lit("."), F.lit(1))
    wanted = imports.select("repo_id", top.alias("dependency")).distinct().withColumn("alias", F.regexp_replace("dependency", "_[0-9a-z]+$", ""))
    found = wanted.join(aliases, "alias").where("provider <> repo_id").groupBy("repo_id", "dependency").agg(F.countDistinct("provider").alias("n"), F.min("provider").alias("p"))
    return found.select(
        "repo_id", "dependency", F.when(F.col("n") == 1, F.col("p")).alias("provider"), F.when(F.col("n") == 1, "hint").otherwise("ambiguous").alias("state"), F.col("n").alias("n_candidates")
    )


@query("SELECT source, count(*)::BIGINT AS n_texts, count(*) FILTER ("
    + " OR ".join(f"regexp_matches(text, '{p}', '{'i' if any_case else 'c'}')" for p, _, any_case in identity.DETECTORS)
    + ")::BIGINT AS n_redacted FROM documents WHERE text IS NOT NULL GROUP BY source", graph=False)
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "text", identity.redact(F.col("text")).alias("clean"))
    return texts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("clean") != F.col("text")).alias("n_redacted"))


# Similarity -------------------------------------------------------------------


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, nodes="id kind qualname repo_id").nodes.where("kind IN ('function', 'method', 'class') AND qualname IS NOT NULL")
    words = F.regexp_replace("qualname", r"([a-z0-9])([A-Z])", "$1 $2")
    return nodes.select("id", F.concat_ws("|", "repo_id", "kind").alias("block"), similar.grams(F.regexp_replace(words, r"[._0-9]+", " "), 2).alias("members"))


@query("""
, w AS (SELECT id, concat_ws('|', repo_id, kind) AS block, regexp_extract_all(lower(regexp_replace(regexp_replace(qualname, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[._0-9]+', ' ', 'g')), '[a-z_]+') AS ws
        FROM n WHERE kind IN ('function', 'method', 'class') AND qualname IS NOT NULL),
g AS (SELECT id, block, list_sort(list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS m FROM w),
c AS (SELECT block, m, min(id) AS class_id FROM g GROUP BY ALL)
SELECT least(a.class_id, b.class_id) AS class_a, greatest(a.class_id, b.class_id) AS class_b, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 4) AS score
FROM c a JOIN c b ON a.block = b.block AND a.class_id < b.class_id AND len(a.m) > 0 AND len(b.m) > 0
WHERE len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))) >= 0.82""")
def similar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar symbols, by classes of equal token sets."""
    return similar.near_sets(_profiles(spark, sf_dir), "id", "block", "members")[1]


@query(None)
def similar_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol with its class, links and family."""
    return similar.families(*similar.near_sets(_profiles(spark, sf_dir), "id", "block", "members"), "id")


@query(None)
def strongest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.strongest(similar.near_sets(_profiles(spark, sf_dir), "id", "block", "members")[1])


# Sorting, limits, sets, windows -----------------------------------------------


@query("""
, d AS (SELECT DISTINCT fact_id, path, start_line, frontend_name, fact_kind FROM semantic_facts WHERE fact_kind = 'diagnostic')
SELECT fact_id, row_number() OVER (PARTITION BY path, frontend_name ORDER BY start_line NULLS FIRST, fact_id)::INT AS occurrence FROM d""")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "semantic_facts").where("fact_kind = 'diagnostic'").select("fact_id", "path", "start_line", "frontend_name").distinct()
    return rows.select("fact_id", F.row_number().over(Window.partitionBy("path", "frontend_name").orderBy("start_line", "fact_id")).alias("occurrence"))


@query("""
SELECT id, kind, name, greatest(0, (SELECT count(*) FROM n WHERE kind = 'class') - 200)::BIGINT AS n_omitted FROM n WHERE kind = 'class' ORDER BY name NULLS FIRST, id LIMIT 200""")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = load(spark, sf_dir, nodes="id kind name").nodes.where("kind = 'class'").select("id", "kind", "name")
    return aggregate.bounded(classes, ["name", "id"], 200).select("id", "kind", "name", F.col("n_omitted").cast("bigint").alias("n_omitted"))


@query("""
, b AS (SELECT id, repo_id, sum(octet_length(encode(id))) OVER (PARTITION BY repo_id ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes_upto FROM n WHERE repo_id IS NOT NULL)
SELECT id, repo_id, bytes_upto FROM b WHERE bytes_upto <= 32768""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, nodes="id repo_id").nodes.where("repo_id IS NOT NULL").select("id", "repo_id")
    return aggregate.byte_budget(nodes, "repo_id", "id", "id", 32 * 1024)


@query("""
SELECT 'nodes only' AS side, count(*)::BIGINT AS n_paths FROM (SELECT path FROM n WHERE path IS NOT NULL EXCEPT SELECT regexp_replace(path, '^(\\./)+', '') FROM files)
UNION ALL SELECT 'files only', count(*)::BIGINT FROM (SELECT regexp_replace(path, '^(\\./)+', '') FROM files EXCEPT SELECT path FROM n)
UNION ALL SELECT 'both', count(*)::BIGINT FROM (SELECT path FROM n INTERSECT SELECT regexp_replace(path, '^(\\./)+', '') FROM files)""")
def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = load(spark, sf_dir, nodes="id path").nodes.where("path IS NOT NULL").select("path").distinct()
    theirs = table(spark, sf_dir, "files").select(F.regexp_replace("path", r"^(\./)+", "").alias("path")).distinct()
    both = mine.withColumn("a", F.lit(1)).join(theirs.withColumn("b", F.lit(1)), "path", "full_outer")
    side = F.when(F.col("b").isNull(), "nodes only").when(F.col("a").isNull(), "files only").otherwise("both")
    sides = spark.createDataFrame([("nodes only",), ("files only",), ("both",)], "side string")
    counted = both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return sides.join(counted, "side", "left").select("side", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_paths"))


@query("""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n_events, round(sum(coalesce(value, 0)), 2) AS total FROM events GROUP BY ALL""", graph=False)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")


@query("""
SELECT w AS window_start, event_type, count(*)::BIGINT AS n_events, round(sum(coalesce(value, 0)), 2) AS total FROM
 (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""", graph=False)
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value")


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, user_id, count(*)::BIGINT AS n_events, round(sum(coalesce(value, 0)), 2) AS total FROM h GROUP BY user_id, k""", graph=False)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], "value")


@query("""
WITH s AS (SELECT id, created_at, max(created_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT id, created_at FROM edges))
SELECT id, created_at FROM s WHERE top - created_at > INTERVAL 150 DAY""", graph=False)
def late_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges more than 150 days behind the latest before them in order of id."""
    edges = load(spark, sf_dir, edges="id created_at").edges.select("id", "created_at")
    return windows.late_events(edges, "created_at", "id", 150 * 86_400).select("id", "created_at")
