"""Kinds, confidence levels and weights the graph operators switch on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary, orders and weights that results depend on.
CONFIDENCE_LEVELS = ("unresolved", "heuristic", "runtime-only", "inferred", "confirmed")
LAYOUT_ORDER = ("confirmed", "inferred", "runtime-only", "heuristic", "unresolved")
CONFIDENCE_WEIGHTS = {"confirmed": 1.0, "inferred": 0.75, "runtime-only": 0.65, "heuristic": 0.35, "unresolved": 0.1}
OTHER_CONFIDENCE_WEIGHT = 0.25
CALL_KINDS = (
    "calls", "constructs", "renders", "uses_hook", "extends", "implements", "initializes", "logs", "configures", "declares", "invokes", "overrides", "uses",
)
FLOW_KINDS = (
    "registers", "invokes", "injects", "calls", "constructs", "renders", "uses_hook", "provides", "enqueues", "consumes", "reads", "writes",
)
CALLSITE_KINDS = ("calls", "constructs", "initializes", "logs", "configures", "declares", "uses", "dynamic_call")
RESOURCE_EDGES = ("reads", "writes", "enqueues", "consumes", "publishes", "configures")
STRUCTURAL_EDGES = ("defines", "exports", "extends", "implements", "overrides", "contains")
RELATION_EDGES = ("reads", "writes", "enqueues", "consumes")
ENTRYPOINT_KINDS = ("route", "mcp_tool", "worker_task", "cli_command", "test_case", "component", "queue")
RESOURCE_KINDS = ("table", "queue", "config", "log_sink", "pydantic_model")
SEARCHABLE_KINDS = (
    "function", "method", "component", "class", "interface", "type_alias", "enum", "module", "route", "mcp_tool", "worker_task", "table", "queue", "test_case",
)
CONTAINER_KINDS = ("source_root", "package")
LAYOUT_EXCLUDED_EDGES = ("similar_to", "covers", "dynamic_call")
KIND_WEIGHTS = {
    "invokes": 5.0, "calls": 5.0, "constructs": 4.5, "initializes": 4.0, "reads": 4.0, "writes": 4.0, "enqueues": 4.0, "consumes": 4.0,
    "injects": 3.5, "provides": 3.0, "renders": 3.0, "uses_hook": 3.0, "extends": 3.0, "implements": 3.0, "overrides": 3.0,
    "configures": 2.5, "logs": 2.0, "imports": 1.5, "exports": 1.5, "maps_to": 1.5, "registers": 1.5,
    "references": 0.3, "uses": 0.3, "contains": 0.1, "defines": 0.1, "declares": 0.1,
}
OTHER_KIND_WEIGHT = 1.0
ID_PREFIXES = ("fn", "method", "class", "mod", "component", "interface", "type_alias", "enum")
#: profile -> (levels it lets through, depth of a walk unless asked otherwise)
PROFILES = {
    "review_default": (("confirmed", "inferred", "heuristic", "runtime-only"), 3),
    "debugging_default": (("confirmed", "inferred", "heuristic", "runtime-only", "unresolved"), 5),
    "strict_static": (("confirmed",), 2),
    "evidence_only": (("confirmed", "inferred", "runtime-only"), 3),
}
DEPTH_CAP = 10
FAN_IN_CAP = 200
EDGE_CAP = 5000


def lookup(column: Column, table: dict, other) -> Column:
    """A constant table as an expression: it stays in code generation, no join."""
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(pairs[column], F.lit(other))


def confidence_rank(column: Column) -> Column:
    """0 for unresolved to 4 for confirmed; a missing level counts as confirmed."""
    return lookup(F.coalesce(column, F.lit("confirmed")), {c: i for i, c in enumerate(CONFIDENCE_LEVELS)}, 1)


def layout_rank(column: Column) -> Column:
    return lookup(F.coalesce(column, F.lit("confirmed")), {c: i for i, c in enumerate(LAYOUT_ORDER)}, len(LAYOUT_ORDER))


def edge_weight(kind: Column, confidence: Column) -> Column:
    return lookup(kind, KIND_WEIGHTS, OTHER_KIND_WEIGHT) * lookup(
        F.coalesce(confidence, F.lit("confirmed")), CONFIDENCE_WEIGHTS, OTHER_CONFIDENCE_WEIGHT
    )
