"""Runtime traces, spans and network logs as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.identity import canonical_url_path

TRACE = (
    "trace_run struct<trace_run_id string, commit_sha string, index_version string, test_id string, source string>, "
    "events array<struct<kind string, source string, target string, path string, line int, column int, test_id string, detail string, semantic_role string>>"
)
_ANY = "struct<stringValue string, intValue string, doubleValue double, boolValue boolean>"
SPANS = f"resourceSpans array<struct<scopeSpans array<struct<spans array<struct<spanId string, name string, attributes array<struct<key string, value {_ANY}>>>>>>>>"
HAR = "log struct<entries array<struct<request struct<method string, url string>, response struct<status int>>>>"

# What events are called as edges.
EVENT_EDGES = {"call": "calls", "construct": "constructs", "read": "reads", "write": "writes", "enqueue": "enqueues", "consume": "consumes"}


def read_traces(spark: SparkSession, path: str, commit: str | None = None, version: str | None = None) -> DataFrame:
    """Events of trace files, one row each; whole files of another commit or build are left out."""
    raw = spark.read.schema(TRACE).option("multiLine", True).json(path)
    if commit is not None:
        raw = raw.where(F.coalesce(F.col("trace_run.commit_sha") == commit, F.lit(True)))
    if version is not None:
        raw = raw.where(F.coalesce(F.col("trace_run.index_version") == version, F.lit(True)))
    return raw.select("trace_run", F.posexplode("events").alias("pos", "e")).select(F.col("trace_run.trace_run_id").alias("trace_run_id"), "pos", "e.*")


def read_spans(spark: SparkSession, path: str, source_key: str = "trace.source", target_key: str = "trace.target", lines: bool = False) -> DataFrame:
    """Spans with explicit source and target attributes as events; the others with nulls."""
    raw = spark.read.schema(SPANS).option("multiLine", not lines).json(path)
    spans = (
        raw.select(F.explode("resourceSpans").alias("r"))
        .select(F.explode("r.scopeSpans").alias("s"))
        .select(F.explode("s.spans").alias("p"))
        .select("p.spanId", "p.name", "p.attributes")
    )
    text = F.transform(
        F.filter(F.coalesce("attributes", F.array()), lambda a: a["key"].isNotNull()),
        lambda a: F.struct(
            a["key"].alias("key"),
            F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value"),
        ),
    )

    def member(key: str):
        return F.get(F.transform(F.filter(text, lambda a: a["key"] == key), lambda a: a["value"]), F.lit(0))

    def pick(*keys: str):
        return F.coalesce(*[member(k) for k in keys])

    return spans.select(
        "spanId",
        F.coalesce(pick("trace.kind"), F.lit("call")).alias("kind"),
        pick(source_key).alias("source"),
        pick(target_key).alias("target"),
        pick("code.filepath", "code.file.path").alias("path"),
        pick("code.lineno").cast("int").alias("line"),
        pick("test.id").alias("test_id"),
    )


def bind_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with source_id and target_id: by id, else by qualname, else by either without prefix.

    Of several nodes under one key the least id is taken. null where none is.
    """
    stripped = F.regexp_replace("id", "^[a-z_]+:", "")
    keys = nodes.select(
        "id", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("id").alias("k")), F.struct(F.lit(1).alias("r"), F.col("qualname").alias("k")), F.struct(F.lit(2).alias("r"), stripped.alias("k")))).alias("x")
    ).select("id", "x.r", "x.k").where("k IS NOT NULL")
    best = keys.groupBy("k").agg(F.min(F.struct("r", "id")).alias("b")).select("k", F.col("b.id").alias("found"))
    out = events
    for end in ("source", "target"):
        out = out.join(best.select(F.col("k").alias(end), F.col("found").alias(f"{end}_id")), end, "left")
    return out


def trace_edges(bound: DataFrame) -> DataFrame:
    """Distinct runtime-only edges of events whose two ends are known and differ."""
    kind = F.coalesce(*[F.when(F.coalesce(F.col("kind"), F.lit("call")) == k, v) for k, v in EVENT_EDGES.items()], F.col("kind"))
    kept = bound.where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
    return kept.groupBy(F.col("source_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind")).agg(
        F.lit("runtime-only").alias("confidence"), F.count(F.lit(1)).alias("n_events")
    )


def har_routes(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Requests of network logs with the route they hit.

    state 'matched', 'ambiguous', 'unmatched', 'not_http' or 'malformed'; a
    route is a node ``route:METHOD:path``.
    """
    raw = spark.read.schema(HAR).option("multiLine", True).json(path)
    entries = raw.select(F.posexplode("log.entries").alias("pos", "e")).select(
        "pos", F.upper("e.request.method").alias("method"), F.col("e.request.url").alias("url"), F.col("e.response.status").alias("status")
    )
    http = F.col("url").rlike("(?i)^https?://")
    route = canonical_url_path(F.try_url_decode(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))))
    entries = entries.withColumn("key", F.when(http & F.col("method").isNotNull(), F.concat_ws(":", "method", route)))
    routes = nodes.where("kind = 'route' AND startswith(id, 'route:')").select(
        "id", F.concat_ws(":", F.upper(F.split_part("id", F.lit(":"), F.lit(2))), canonical_url_path(F.regexp_replace("id", "^route:[^:]*:", ""))).alias("key")
    )
    grouped = routes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("route_id"))
    joined = entries.join(grouped, "key", "left")
    state = (
        F.when(F.col("url").isNull() | F.col("method").isNull(), "malformed")
        .when(~http, "not_http")
        .when(F.col("n").isNull(), "unmatched")
        .when(F.col("n") == 1, "matched")
        .otherwise("ambiguous")
    )
    return joined.select("pos", "method", "url", "status", F.when(F.col("n") == 1, F.col("route_id")).alias("route_id"), state.alias("state"))
