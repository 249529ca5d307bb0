"""Queries of the source operators, over reports made of the tables' own rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import load
from skein.plans.graphs import GRAPH
from skein.runtime import table
from skein.sources import coverage, protocols, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {GRAPH}, {sql.strip()}"
        return f

    return register


def _evidence(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Distinct (source, target, kind, path, line) of evidence with a place."""
    at = table(spark, sf_dir, "edges").select("source", "target", "kind", F.explode("evidence").alias("v")).where("v.path IS NOT NULL AND v.start_line IS NOT NULL")
    if kind:
        at = at.where(F.col("v.kind") == kind)
    return at.select("source", "target", "kind", F.col("v.path").alias("path"), F.col("v.start_line").alias("line")).distinct()


_EVIDENCE = """v AS (SELECT DISTINCT source, target, kind, x.kind AS how, x.path AS path, x.start_line AS line FROM (SELECT source, target, kind, unnest(evidence) AS x FROM edges)
  WHERE x.path IS NOT NULL AND x.start_line IS NOT NULL)"""


@query(_EVIDENCE + """,
ev AS MATERIALIZED (SELECT DISTINCT CASE kind WHEN 'calls' THEN 'call' WHEN 'reads' THEN 'read' ELSE kind END AS kind, regexp_replace(source, '^[a-z_]+:', '') AS source, target, path, line
       FROM v WHERE how = 'runtime_trace'),
k AS (SELECT id AS k, 0 AS r, id FROM n UNION ALL SELECT qualname, 1, id FROM n UNION ALL SELECT regexp_replace(id, '^[a-z_]+:', ''), 2, id FROM n),
b AS MATERIALIZED (SELECT k, id FROM k WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, id) = 1)
SELECT s.id AS source, t.id AS target, CASE ev.kind WHEN 'call' THEN 'calls' WHEN 'read' THEN 'reads' ELSE ev.kind END AS kind, 'runtime-only' AS confidence, count(*)::BIGINT AS n_events
FROM ev JOIN b s ON s.k = ev.source JOIN b t ON t.k = ev.target WHERE s.id <> t.id GROUP BY ALL""")
def trace_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime events, named without the prefix of their source, bound to nodes and merged to edges."""
    nodes = load(spark, sf_dir, nodes="id qualname").nodes
    kind = F.when(F.col("kind") == "calls", "call").when(F.col("kind") == "reads", "read").otherwise(F.col("kind"))
    found = _evidence(spark, sf_dir, "runtime_trace")
    events = found.select(kind.alias("kind"), F.regexp_replace("source", "^[a-z_]+:", "").alias("source"), "target", "path", "line").distinct()
    return traces.trace_edges(traces.bind_events(events, nodes))


@query(_EVIDENCE + """,
d AS (SELECT id, path, start_line::BIGINT * 10000 AS lo, end_line::BIGINT * 10000 + 99 AS hi FROM n WHERE path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
f AS (SELECT DISTINCT path, target AS symbol, line::BIGINT * 10000 + 4 AS lo FROM v WHERE how = 'scip_occurrence' AND target IS NOT NULL),
w AS (SELECT f.path, f.symbol, f.lo, arg_min(d.id, (d.hi - d.lo, d.id)) AS owner FROM f JOIN d ON d.path = f.path AND d.lo <= f.lo AND d.hi >= f.lo + 2 GROUP BY ALL)
SELECT coalesce(w.owner, 'mod:' || f.path) AS source, f.symbol AS target, f.symbol NOT IN (SELECT id FROM d) AS external, count(*)::BIGINT AS n_places
FROM f LEFT JOIN w ON w.path = f.path AND w.symbol = f.symbol AND w.lo = f.lo GROUP BY ALL""")
def scip_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of an index as references from the narrowest definition around them."""
    nodes = load(spark, sf_dir, nodes="id path start_line end_line").nodes.where("path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    at = lambda line, column: F.col(line).cast("bigint") * 10_000 + column
    defined = nodes.select("path", F.col("id").alias("symbol"), F.lit(True).alias("is_definition"), at("start_line", 0).alias("lo"), at("end_line", 99).alias("hi"))
    used = _evidence(spark, sf_dir, "scip_occurrence").where("target IS NOT NULL").select(
        "path", F.col("target").alias("symbol"), F.lit(False).alias("is_definition"), at("line", 4).alias("lo"), at("line", 6).alias("hi")
    )
    return protocols.reference_edges(defined.unionByName(used)).groupBy("source", "target", "external").agg(F.count(F.lit(1)).alias("n_places"))


@query("""
o AS (SELECT upper(split_part(id, ':', 2)) AS method, regexp_replace(id, '^route:[^:]*:', '') AS route, name AS operation_id FROM n WHERE kind = 'route' AND starts_with(id, 'route:')),
h AS (SELECT name, count(*) AS c, min(id) AS id FROM n WHERE kind IN ('function', 'method') GROUP BY name)
SELECT method, route, operation_id, CASE WHEN h.c = 1 THEN h.id END AS handler, CASE WHEN h.c IS NULL THEN 'unmatched' WHEN h.c = 1 THEN 'matched' ELSE 'ambiguous' END AS state
FROM o LEFT JOIN h ON h.name = o.operation_id""")
def openapi_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the routes, bound to the functions that bear their names."""
    nodes = load(spark, sf_dir, nodes="id kind name").nodes
    operations = nodes.where("kind = 'route' AND startswith(id, 'route:')").select(
        F.upper(F.split_part("id", F.lit(":"), F.lit(2))).alias("method"), F.regexp_replace("id", "^route:[^:]*:", "").alias("route"), F.col("name").alias("operation_id"), F.array().cast("array<string>").alias("schemas")
    )
    return protocols.bind_operations(operations, nodes).drop("schemas")


@query(_EVIDENCE + """,
l AS (SELECT DISTINCT '/work/' || path AS path, line FROM v WHERE how = 'coverage_json'),
p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL),
m AS (SELECT x.path, min(p.path) AS file FROM (SELECT DISTINCT path FROM l) x JOIN p ON x.path = p.path OR ends_with(x.path, '/' || p.path) OR ends_with(p.path, '/' || x.path) GROUP BY x.path HAVING count(*) = 1)
SELECT l.path, m.file, count(*)::BIGINT AS n_lines FROM l LEFT JOIN m USING (path) GROUP BY ALL""")
def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered lines, reported below another root, with the file they belong to where that is certain."""
    lines = _evidence(spark, sf_dir, "coverage_json").select(F.concat(F.lit("/work/"), "path").alias("path"), "line").distinct()
    files = table(spark, sf_dir, "files").where("path IS NOT NULL").select("path")
    return coverage.match_paths(lines, files).groupBy("path", "file").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
h AS (SELECT DISTINCT path, start_line AS a, greatest(end_line - start_line, 0) AS c FROM n WHERE kind = 'method' AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL)
SELECT path, a::INT AS start_line, (a + c - 1)::INT AS end_line FROM h""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed places read back from the lines of a diff that touches every method."""
    methods = load(spark, sf_dir, nodes="id kind path start_line end_line").nodes.where("kind = 'method' AND path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    places = methods.select("path", F.col("start_line").alias("a"), F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)).alias("c")).distinct()
    header = F.format_string("@@ -%d,0 +%d,%d @@ def", "a", "a", "c")
    lines = places.select(F.col("path").alias("file"), F.col("a"), F.col("c"), F.posexplode(F.array(F.concat(F.lit("+++ b/"), "path"), header, F.lit("+    pass"))).alias("p", "value"))
    return protocols.hunks(lines.select("file", F.struct("a", "c", "p").alias("line_no"), "value"))
