"""Why calls stay unresolved, by fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories with their risk and whether they block a release.
CATEGORIES = {
    "mock_or_assertion": ("low", False),
    "framework_magic": ("medium", False),
    "external_service_boundary": ("medium", False),
    "missing_type_context": ("high", True),
    "generated_or_reflection": ("medium", False),
    "true_dynamic_call": ("low", False),
    "static_candidate": ("high", True),
}
# What tells a category, all in lower case.
MOCK_PARTS = ("assert_called", "assert_any_call", "assert_has_calls", "mock.", "mocker.", "monkeypatch.")
FRAMEWORK_NAMES = ("apirouter", "depends", "fastapi", "celery", "shared_task", "django", "typer", "click", "blueprint")
DECORATOR_ENDS = (
    ".route", ".get", ".post", ".put", ".patch", ".delete", ".websocket", ".command", ".task", ".add_api_route", ".include_router", ".autodiscover_tasks", ".add_command",
)
FRAMEWORK_RECEIVERS = ("router", "app", "api", "blueprint", "celery", "cli", "typer", "click")
FRAMEWORK_PARTS = ("dependency", "route_handler", "viewset", "urlpattern", "fixture")
SERVICE_NAMES = ("async_session", "session_maker", "from_pretrained")
SERVICE_METHODS = (
    ".execute", ".fetch", ".fetchall", ".fetchone", ".post", ".get", ".put", ".delete", ".publish", ".send", ".query", ".commit", ".rollback", ".connect", ".basic_publish",
)
SERVICE_RECEIVERS = (
    "broker", "channel", "client", "session", "redis", "db", "database", "connection", "cursor", "http", "api", "sdk", "queue", "producer", "consumer", "session_maker",
)
UNTYPED_STRATEGIES = ("missing_type_context", "receiver_type_unknown", "receiver_type_unresolved", "type_context_missing", "type_resolution_unresolved")
UNTYPED_FLAGS = ("missing_type_context", "receiver_type_missing", "type_context_missing")
UNTYPED_STATES = ("missing", "unknown", "unresolved")
GENERATED_PATHS = ("/generated/", "/gen/", "generated_", ".generated.", "/migrations/")
REFLECTION_PARTS = ("getattr", "setattr", "hasattr", "__import__", "import_module", "globals()", "locals()", "eval(", "exec(")
DYNAMIC_BINDINGS = ("parameter", "assignment", "annotated_assignment", "for_target", "with_as", "except_as", "nonlocal")
DYNAMIC_STRATEGIES = ("dynamic_call", "dynamic_dispatch", "runtime_dynamic_call")


def _any(words: tuple[str, ...], test) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | test(w)
    return hit


def category(expression: Column, strategy: Column, path: Column, properties: Column) -> Column:
    """The category of an unresolved call.

    ``expression`` is its text, ``strategy`` what failed to resolve it, both
    may be null; ``properties`` a JSON object of what the analyser recorded.
    """
    text = F.lower(F.coalesce(expression, F.lit("<unknown>")))
    failed = F.coalesce(strategy, F.lit("unknown"))
    file = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    said = lambda name: F.coalesce(F.get_json_object(properties, f"$.{name}"), F.lit(""))
    has = lambda w: F.contains(text, F.lit(w))
    decorated = _any(DECORATOR_ENDS, lambda w: F.endswith(text, F.lit(w)))
    framework = F.when(decorated, _any(FRAMEWORK_RECEIVERS, has)).otherwise(_any(FRAMEWORK_PARTS, has))
    service = _any(SERVICE_METHODS, has) & _any(SERVICE_RECEIVERS, has)
    untyped = failed.isin(*UNTYPED_STRATEGIES) | _any(UNTYPED_FLAGS, lambda n: said(n) == "true") | F.lower(said("receiver_type_status")).isin(*UNTYPED_STATES)
    return (
        F.when((failed == "union_receiver") & (said("semantic_reason") == "ambiguous_union_receiver"), "true_dynamic_call")
        .when(_any(MOCK_PARTS, has), "mock_or_assertion")
        .when(text.isin(*FRAMEWORK_NAMES) | framework, "framework_magic")
        .when(text.isin(*SERVICE_NAMES) | service, "external_service_boundary")
        .when(untyped, "missing_type_context")
        .when(_any(GENERATED_PATHS, lambda w: F.contains(file, F.lit(w))) | _any(REFLECTION_PARTS, has), "generated_or_reflection")
        .when(said("callee_binding_kind").isin(*DYNAMIC_BINDINGS) | failed.isin(*DYNAMIC_STRATEGIES), "true_dynamic_call")
        .otherwise("static_candidate")
    )


def annotate(calls: DataFrame) -> DataFrame:
    """Calls (raw_expression, failed_strategy, path, properties_json among their columns) with category, risk_level and release_blocking."""
    found = calls.withColumn("category", category(F.col("raw_expression"), F.col("failed_strategy"), F.col("path"), F.col("properties_json")))
    table = F.create_map(*[x for c, (risk, blocks) in CATEGORIES.items() for x in (F.lit(c), F.struct(F.lit(risk).alias("risk"), F.lit(blocks).alias("blocks")))])
    known = table[F.col("category")]
    return found.withColumns({"risk_level": known["risk"], "release_blocking": known["blocks"]})


def triage_counts(calls: DataFrame) -> DataFrame:
    """Counts of all categories, those without a call too, with risk and blocking."""
    spark = calls.sparkSession
    fixed = spark.createDataFrame([(c, r, b) for c, (r, b) in CATEGORIES.items()], "category string, risk string, blocking boolean")
    counted = annotate(calls).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return fixed.join(counted, "category", "left").select("category", "risk", "blocking", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_calls"))
