"""Predicates and projections over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.identity import is_test_path, like_escaped
from skein.functions.vocabulary import PROFILES


def by_profile(edges: DataFrame, profile: str) -> DataFrame:
    """Edges whose confidence a profile lets through; none counts as confirmed."""
    return edges.where(F.coalesce("confidence", F.lit("confirmed")).isin(*PROFILES[profile][0]))


def without_guesses(edges: DataFrame, callsites: str = "callsites") -> DataFrame:
    """Guessed callsites taken out of stronger edges; edges left with none go.

    ``callsites``: ARRAY<STRUCT<id, guessed BOOLEAN>>. An edge that never had
    callsites stays.
    """
    kept = F.filter(callsites, lambda c: ~F.coalesce(c["guessed"], F.lit(False)))
    had = F.coalesce(F.size(callsites), F.lit(0))
    return edges.withColumn("__had", had).withColumn(callsites, kept).where((F.col("__had") <= 0) | (F.size(callsites) > 0)).drop("__had")


def by_kind(edges: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Edge kinds to keep (none named: all) and to leave out."""
    if include:
        edges = edges.where(F.col("kind").isin(*include))
    return edges.where(~F.coalesce(F.col("kind").isin(*exclude), F.lit(False))) if exclude else edges


def connection_basis(sites: str = "n_sites", guessed: str = "n_guessed") -> Column:
    """What kind of evidence an edge rests on, from its status, confidence and callsites.

    ``sites`` and ``guessed`` name columns that count its callsites and those
    that are guesses; null is none.
    """
    status, confidence = F.coalesce("resolution_status", F.lit("resolved")), F.coalesce("confidence", F.lit("confirmed"))
    n, bad = F.coalesce(sites, F.lit(0)), F.coalesce(guessed, F.lit(0))
    return (
        F.when(status != "resolved", "unresolved")
        .when((confidence == "heuristic") | ((n > 0) & (bad == n)), "heuristic")
        .when(bad > 0, "mixed_evidence")
        .when(confidence == "runtime-only", "runtime_evidence")
        .otherwise("static_evidence")
    )


def only_local_imports(evidence: str = "evidence") -> Column:
    """All evidence, and there is some, comes from imports inside functions."""
    return F.coalesce(
        (F.size(evidence) > 0) & F.forall(evidence, lambda e: F.coalesce(e["kind"] == "ast_local_import", F.lit(False))), F.lit(False)
    )


def routable(properties: str = "properties_json") -> Column:
    """An entrypoint that is not known to be unmounted."""
    return F.coalesce(F.get_json_object(properties, "$.route_mounted") != "false", F.lit(True))


def search(nodes: DataFrame, term: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Nodes with the term in id, name, qualname or path, letter case apart.

    Ranked by which column begins with it; n_total counts all matches. At most
    100 rows, which is the feature; an empty term finds nothing.
    """
    if not term:
        return nodes.limit(0).select("id", "kind", "name", "qualname", "path", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("n_total"))
    pattern = like_escaped(term)
    columns = ("name", "qualname", "id", "path")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    found = nodes.where(hit)
    if kind:
        found = found.where(F.col("kind") == kind)
    rank = F.lit(len(columns))
    for i, c in reversed(list(enumerate(columns))):
        rank = F.when(F.startswith(F.lower(c), F.lit(term.lower())), i).otherwise(rank)
    total = found.agg(F.count(F.lit(1)).alias("n_total"))
    top = found.select("id", "kind", "name", "qualname", "path", rank.alias("rank")).orderBy("rank", "kind", "name", "id").limit(min(100, max(1, limit)))
    return top.join(F.broadcast(total))


def exclusion_reason(kinds: tuple[str, ...], include_tests: bool = False, include_external: bool = False) -> Column:
    """Why a node is left out of a layout, null where it stays."""
    generated = F.coalesce(F.lower("path").rlike(r"(^|/)(generated|dist|build|node_modules)/|\.(gen|generated|min)\.[a-z]+$"), F.lit(False))
    reason = F.when(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "kind")
    if not include_external:
        reason = reason.when(F.col("path").isNull(), "external")
    if not include_tests:
        reason = reason.when(is_test_path(F.col("path")) | (F.col("kind") == "test_case"), "test")
    return reason.when(generated, "generated")


def explode_property(nodes: DataFrame, path: str, schema: str) -> DataFrame:
    """Records of a list-valued property, one row each, with the node's id."""
    return nodes.select("id", F.posexplode(F.from_json(F.get_json_object("properties_json", path), f"array<{schema}>")).alias("pos", "item"))


def scope_warnings(warnings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Warnings on the given paths, and counts by kind of all others."""
    inside = warnings.join(paths.select("path").distinct(), "path", "left_semi")
    others = warnings.join(paths.select("path").distinct(), "path", "left_anti")
    return inside, others.groupBy("kind").agg(F.count(F.lit(1)).alias("n_omitted"))
