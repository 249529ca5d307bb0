"""Composite reports over several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vocabulary
from skein.graph import load, once
from skein.operators import deltas, filters, traverse
from skein.plans.graphs import GRAPH, _names
from skein.runtime import Stage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            recursive = text.startswith("RECURSIVE")
            SQL[f.__name__] = f"WITH RECURSIVE {GRAPH}, {text[len('RECURSIVE') :].lstrip()}" if recursive else f"WITH {GRAPH} {text}"
        return f

    return register


_WALK = f"""
c AS (SELECT DISTINCT source, target FROM e WHERE kind IN ({_names(vocabulary.CALL_KINDS)}) AND coalesce(confidence, 'confirmed') <> 'unresolved'),
t AS (SELECT id FROM n WHERE kind IN ('table', 'queue')),
w AS (SELECT id, 0 AS depth FROM t UNION SELECT c.source, w.depth + 1 FROM w JOIN c ON c.target = w.id WHERE w.depth < 3),
hit AS (SELECT DISTINCT id FROM w WHERE id IS NOT NULL)"""


@query(f"""RECURSIVE {_WALK}
SELECT 'impacted' AS section, coalesce(n.kind, '(unknown)') AS kind, count(*)::BIGINT AS n FROM hit LEFT JOIN n USING (id) GROUP BY ALL
UNION ALL SELECT 'entrypoint', n.kind, count(DISTINCT e.source)::BIGINT FROM e JOIN hit ON hit.id = e.target JOIN n ON n.id = e.source WHERE e.kind = 'invokes' GROUP BY ALL
UNION ALL SELECT 'resource', e.kind, count(DISTINCT e.target)::BIGINT FROM e JOIN hit ON hit.id = e.source WHERE e.kind IN ({_names(vocabulary.RESOURCE_EDGES)}) AND e.target IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'test', 'covers', count(DISTINCT e.source)::BIGINT FROM e JOIN hit ON hit.id = e.target WHERE e.kind = 'covers' HAVING count(*) > 0
UNION ALL SELECT 'unresolved', e.kind, count(DISTINCT e.id)::BIGINT FROM e JOIN hit ON hit.id = e.source WHERE coalesce(e.resolution_status, '') = 'unresolved' GROUP BY ALL""")
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of tables and queues reaches, and what bears on it there."""
    g = load(spark, sf_dir)
    calls = filters.by_kind(g.deliveries, vocabulary.CALL_KINDS)
    hit = traverse.reach_nodes(calls, g.nodes.where("kind IN ('table', 'queue')"), 3, reverse=True, settle=g.settle("review_default")).select("id")
    hit = Stage(spark, "impact").put(hit.distinct(), "hit")
    into = g.deliveries.where("kind IN ('invokes', 'covers')").join(hit.withColumnRenamed("id", "target"), "target", "left_semi")
    outof = once(g.deliveries.join(hit.withColumnRenamed("id", "source"), "source", "left_semi"), ["id", "target", "kind", "resolution_status"])
    kinds = g.nodes.select("id", "kind")

    def section(name: str, df: DataFrame, kind: str, what: Column) -> DataFrame:
        return df.groupBy(F.col(kind).alias("kind")).agg(what.alias("n")).select(F.lit(name).alias("section"), "kind", "n")

    impacted = hit.join(kinds, "id", "left").withColumn("kind", F.coalesce("kind", F.lit("(unknown)")))
    entries = into.where("kind = 'invokes'").select("source").join(kinds.withColumnRenamed("id", "source"), "source")
    return (
        section("impacted", impacted, "kind", F.count(F.lit(1)))
        .unionByName(section("entrypoint", entries, "kind", F.countDistinct("source")))
        .unionByName(section("resource", outof.where(F.col("kind").isin(*vocabulary.RESOURCE_EDGES) & F.col("target").isNotNull()), "kind", F.countDistinct("target")))
        .unionByName(section("test", into.where("kind = 'covers'"), "kind", F.countDistinct("source")))
        .unionByName(section("unresolved", outof.where("resolution_status = 'unresolved'"), "kind", F.countDistinct("id")))
    )


@query("""
SELECT n.id, n.kind, count(DISTINCT e.target) FILTER (e.kind = 'invokes')::BIGINT AS n_invokes, count(DISTINCT e.target) FILTER (e.kind = 'injects')::BIGINT AS n_injects,
       count(DISTINCT e.target) FILTER (e.kind = 'consumes')::BIGINT AS n_consumes,
       (SELECT count(DISTINCT source) FROM e x WHERE x.target = n.id AND x.kind = 'enqueues')::BIGINT AS n_enqueued_by
FROM n LEFT JOIN e ON e.source = n.id WHERE n.kind IN ('route', 'worker_task') GROUP BY n.id, n.kind""")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and workers with what they invoke, inject and consume, and who enqueues them."""
    g = load(spark, sf_dir)
    own = g.nodes.where("kind IN ('route', 'worker_task')").select("id", "kind")

    def of(kind: str) -> Column:
        return F.countDistinct(F.when(F.col("kind") == kind, F.col("target"))).alias(f"n_{kind}")

    out = g.edges.where("kind IN ('invokes', 'injects', 'consumes')").groupBy(F.col("source").alias("id")).agg(of("invokes"), of("injects"), of("consumes"))
    into = g.edges.where("kind = 'enqueues'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n_enqueued_by"))
    zero = F.lit(0).cast("bigint")
    names = ("n_invokes", "n_injects", "n_consumes", "n_enqueued_by")
    return own.join(out, "id", "left").join(into, "id", "left").select("id", "kind", *[F.coalesce(c, zero).alias(c) for c in names])


@query("""
, x AS (SELECT DISTINCT target, kind, v.path AS path, v.start_line AS line FROM (SELECT target, kind, unnest(evidence) AS v FROM edges) WHERE v IS NOT NULL)
SELECT x.target, count(*)::BIGINT AS n_places, count(DISTINCT x.path)::BIGINT AS n_files FROM x JOIN n ON n.id = x.target WHERE n.kind IN ('class', 'interface') GROUP BY x.target""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places at which classes and interfaces are referred to."""
    g = load(spark, sf_dir, edges="id target kind evidence")
    places = g.edges.select("target", "kind", F.explode("evidence").alias("v")).where("v IS NOT NULL").select("target", "kind", "v.path", F.col("v.start_line").alias("line")).distinct()
    asked = g.nodes.where("kind IN ('class', 'interface')").select(F.col("id").alias("target"))
    return places.join(asked, "target", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("path").alias("n_files"))


@query("""
, f AS (SELECT DISTINCT source, target, edge_kind AS kind FROM semantic_facts WHERE fact_kind = 'edge' AND source IS NOT NULL AND target IS NOT NULL),
g AS (SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL)
SELECT coalesce(f.kind, g.kind) AS kind, CASE WHEN f.kind IS NULL THEN 'edge_only' WHEN g.kind IS NULL THEN 'fact_only' ELSE 'both' END AS state, count(*)::BIGINT AS n
FROM f FULL JOIN g ON f.source = g.source AND f.target = g.target AND f.kind = g.kind GROUP BY ALL""")
def facts_and_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge facts against edges: which of them only one side has."""
    key = ["source", "target", "kind"]
    facts = table(spark, sf_dir, "semantic_facts").where("fact_kind = 'edge'").select("source", "target", F.col("edge_kind").alias("kind")).dropna().distinct()
    edges = load(spark, sf_dir).edges.select(*key).dropna().distinct()
    both = facts.withColumn("f", F.lit(True)).join(edges.withColumn("g", F.lit(True)), key, "full_outer")
    state = F.when(F.col("f").isNull(), "edge_only").when(F.col("g").isNull(), "fact_only").otherwise("both")
    return both.groupBy("kind", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
, t AS (SELECT id, path FROM n WHERE kind = 'test_case'),
c AS (SELECT e.target AS id, e.source AS test, 'covers' AS via FROM e WHERE e.kind = 'covers'
      UNION SELECT e.target, e.source, 'imports' FROM e JOIN t ON t.id = e.source WHERE e.kind IN ('imports', 'calls', 'uses'))
SELECT c.id, count(DISTINCT test)::BIGINT AS n_tests, count(DISTINCT test) FILTER (via = 'covers')::BIGINT AS n_covering FROM c JOIN n ON n.id = c.id
WHERE n.kind IN ('class', 'function', 'method') GROUP BY c.id""")
def test_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that cover a symbol, or import, call or use it."""
    g = load(spark, sf_dir)
    tests = g.nodes.where("kind = 'test_case'").select(F.col("id").alias("source"))
    covering = g.edges.where("kind = 'covers'").select(F.col("target").alias("id"), F.col("source").alias("test"), F.lit("covers").alias("via"))
    using = g.edges.where("kind IN ('imports', 'calls', 'uses')").join(tests, "source", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("test"), F.lit("imports").alias("via"))
    asked = g.nodes.where("kind IN ('class', 'function', 'method')").select("id")
    found = covering.unionByName(using).join(asked, "id", "left_semi")
    return found.groupBy("id").agg(F.countDistinct("test").alias("n_tests"), F.countDistinct(F.when(F.col("via") == "covers", F.col("test"))).alias("n_covering"))


@query(None)
def diagnostic_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest build's diagnostics carried on from the builds before, two keys tried."""
    rows = table(spark, sf_dir, "semantic_facts").where("fact_kind = 'diagnostic'").select("path", "start_line", "frontend_name", "index_version").distinct()
    newest = rows.agg(F.max("index_version").alias("v")).first()["v"] or ""
    exact, loose = ["path", "start_line", "frontend_name"], ["path", "start_line"]
    before = rows.where(F.col("index_version") < newest).groupBy(*exact).agg(F.min("index_version").alias("first_seen"), F.count(F.lit(1)).alias("seen_count"))
    now = rows.where(F.col("index_version") == newest).select(*exact)
    return deltas.lifecycle(before, now, newest, exact, loose)


def chains_complete(chains: DataFrame, by: str, position: str) -> DataFrame:
    """(by, n_handlers, complete): whether positions are 0 to n - 1, each once."""
    grouped = chains.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_handlers"), F.countDistinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi")
    )
    complete = (F.col("d") == F.col("n_handlers")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_handlers") - 1)
    return grouped.select(by, "n_handlers", F.coalesce(complete, F.lit(False)).alias("complete"))


def weakest(statuses: DataFrame, by: str, status: str, order: tuple[str, ...]) -> DataFrame:
    """The weakest status of each group, ``order`` from weak to strong; unknown ones are weakest."""
    rank = vocabulary.lookup(F.col(status), {s: i for i, s in enumerate(order)}, -1)
    return statuses.groupBy(by).agg(F.min_by(status, rank).alias(status))


def first_verdict(findings: DataFrame, by: str, code: str, precedence: list[tuple[set[str], str]], otherwise: str) -> DataFrame:
    """Each group's verdict by the first rule that any of its finding codes meets."""
    rank = F.lit(len(precedence))
    for i, (codes, _) in reversed(list(enumerate(precedence))):
        rank = F.when(F.col(code).isin(*codes), i).otherwise(rank)
    names = F.array(*[F.lit(v) for _, v in precedence], F.lit(otherwise))
    return findings.groupBy(by).agg(F.min(rank).alias("r")).select(by, F.element_at(names, F.col("r") + 1).alias("verdict"))
