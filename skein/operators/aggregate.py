"""Counts, rates, exact percentiles, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vocabulary import CALLSITE_KINDS, LAYOUT_EXCLUDED_EDGES, edge_weight, layout_rank


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole to four digits; 1.0 of nothing."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, digits))


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, kind, n) with a total of each entity as kind '(all)'."""
    rows = nodes.select(F.lit("node").alias("entity"), "kind").unionByName(edges.select(F.lit("edge").alias("entity"), "kind"))
    grouped = rows.groupingSets([["entity", "kind"], ["entity"]], "entity", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    return grouped.select("entity", F.when(F.col("g") > 0, "(all)").otherwise(F.col("kind")).alias("kind"), "n")


def confidence_summary(edges: DataFrame) -> DataFrame:
    """Edges by kind and confidence bucket; unknown levels count as heuristic."""
    level = F.coalesce("confidence", F.lit("confirmed"))
    known = F.when(level.isin("confirmed", "inferred", "runtime-only", "heuristic", "unresolved"), level).otherwise("heuristic")
    return edges.groupBy("kind", known.alias("bucket")).agg(F.count(F.lit(1)).alias("n_edges"))


def resolution_rates(edges: DataFrame, by: str) -> DataFrame:
    """Callsites, resolved ones and their rate, by a column."""
    sites = edges.where(F.col("kind").isin(*CALLSITE_KINDS))
    counted = sites.groupBy(by).agg(F.count(F.lit(1)).alias("n_callsites"), F.count_if(F.col("resolution_status") == "resolved").alias("n_resolved"))
    return counted.withColumn("rate", rate(F.col("n_resolved"), F.col("n_callsites")))


def nearest_rank(df: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """count, min, max, avg and sorted[min(n - 1, int(n * p))] per group, exact.

    Values are counted per distinct value first, then ranked by running totals,
    so a hot group is shuffled as its distinct values. Nulls are no values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    totals = counted.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("avg_value")
    )
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("v"))
    ranked = counted.withColumn("upto", upto).join(totals, by)
    picks = [
        F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("v"))).alias(f"p{round(p * 100)}") for p in points
    ]
    out = ranked.groupBy(*by, "n", "min_value", "max_value", "avg_value").agg(*picks)
    return out.select(*by, "n", *[F.round(c, 3).alias(c) for c in ("min_value", "max_value", "avg_value", *(f"p{round(p * 100)}" for p in points))])


def budget_violations(stats: DataFrame, budgets: DataFrame, by: str, measure: str) -> DataFrame:
    """Groups whose measure exceeds their budget; groups without one pass."""
    return stats.join(F.broadcast(budgets), by).where(F.col(measure) > F.col("budget")).select(by, measure, "budget")


def module_graph(edges: DataFrame, modules: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Symbol edges rolled up to pairs of modules.

    ``modules``: (id, module), each id once. Loops within a module are left
    out. weight sums kind weight times confidence weight; dominant is the
    confidence most edges have, of equal counts the better by layout order.
    Partial sums by pair and confidence come before the pair's own, so a pair
    that holds most edges is combined map-side.
    """
    shown = edges.where(~F.col("kind").isin(*LAYOUT_EXCLUDED_EDGES))
    level = F.coalesce("confidence", F.lit("confirmed"))
    grouped = shown.groupBy("source", "target", "kind", level.alias("confidence")).agg(F.count(F.lit(1)).alias("c"))
    pairs = (
        grouped.join(modules.select(F.col("id").alias("source"), F.col("module").alias("from_module")), "source")
        .join(modules.select(F.col("id").alias("target"), F.col("module").alias("to_module")), "target")
        .where("from_module <> to_module")
    )
    levels = pairs.groupBy("from_module", "to_module", "confidence").agg(
        F.sum("c").alias("c"), F.sum(F.round(edge_weight(F.col("kind"), F.col("confidence")) * 10000).cast("bigint") * F.col("c")).alias("w")
    )
    return (
        levels.groupBy("from_module", "to_module")
        .agg(
            F.sum("c").alias("n_edges"),
            (F.sum("w") / 10000).alias("weight"),
            F.max_by("confidence", F.struct("c", -layout_rank(F.col("confidence")))).alias("dominant"),
        )
        .where(F.col("weight") >= min_weight)
    )


def weighted_degree(edges: DataFrame, min_degree: float = 5.0, top: int = 400) -> DataFrame:
    """The ``top`` ids by weighted degree of at least ``min_degree``; ties by id."""
    shown = edges.where(~F.col("kind").isin(*LAYOUT_EXCLUDED_EDGES))
    weight = F.round(edge_weight(F.col("kind"), F.col("confidence")) * 10000).cast("bigint")
    ends = shown.select(F.explode(F.array("source", "target")).alias("id"), weight.alias("w")).where("id IS NOT NULL")
    degrees = ends.groupBy("id").agg((F.sum("w") / 10000).alias("degree"))
    return degrees.where(F.col("degree") >= min_degree).orderBy(F.desc("degree"), "id").limit(top)


def bounded(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows, each with how many were left out."""
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(total)).withColumn("n_omitted", F.greatest(F.lit(0), F.col("n_total") - limit)).drop("n_total")


def byte_budget(df: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of each group while their texts together stay within a budget of bytes."""
    running = F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("bytes_upto", running).where(F.col("bytes_upto") <= budget)


def retention(builds: DataFrame, version: str, keep: int, current: str | None = None, pinned: tuple[str, ...] = (), complete: Column | None = None) -> DataFrame:
    """'keep' or 'remove' for every build.

    The current one (the newest complete one unless named), pinned ones and the
    newest others up to ``keep`` in all stay; incomplete ones go.
    """
    done = F.coalesce(complete, F.lit(False)) if complete is not None else F.lit(True)
    marked = builds.select(version, done.alias("done"))
    named = F.lit(current) if current is not None else F.max(F.when(F.col("done"), F.col(version))).over(Window.partitionBy())
    marked = marked.withColumn("fixed", (F.col(version) == named) | F.col(version).isin(*pinned) if pinned else (F.col(version) == named))
    rank = F.row_number().over(Window.partitionBy("done", "fixed").orderBy(F.desc(version)))
    fixed = F.count_if("fixed").over(Window.partitionBy())
    stays = F.col("fixed") | (F.col("done") & (rank <= F.lit(keep) - fixed))
    return marked.select(version, F.when(stays, "keep").otherwise("remove").alias("action"))
