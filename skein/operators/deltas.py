"""Differences between builds: files, graph rows, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_diff(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """``key`` and state: 'added', 'removed', 'changed' or 'same'.

    One full outer join on null-safe keys; nulls in compared columns are equal.
    Keys are taken to be unique on each side.
    """
    left = before.select(*[F.col(k).alias(f"b_{k}") for k in key], F.struct(*compare).alias("was"), F.lit(True).alias("in_b"))
    right = after.select(*[F.col(k).alias(f"a_{k}") for k in key], F.struct(*compare).alias("now"), F.lit(True).alias("in_a"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}"))
    both = left.join(right, on, "full_outer")
    state = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], state.alias("state"))


def graph_delta(before: DataFrame, after: DataFrame, key: str, groups: dict[str, Column]) -> DataFrame:
    """(key, category) of what differs: added, removed, or a group's name.

    ``groups``: category -> column whose change is of that category; a row may
    change in several.
    """
    names = list(groups)
    left = before.select(F.col(key), *[c.alias(f"b{i}") for i, c in enumerate(groups.values())], F.lit(True).alias("in_b"))
    right = after.select(F.col(key), *[c.alias(f"a{i}") for i, c in enumerate(groups.values())], F.lit(True).alias("in_a"))
    both = left.join(right, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    category = F.when(F.col("in_b").isNull(), F.array(F.lit("added"))).when(F.col("in_a").isNull(), F.array(F.lit("removed"))).otherwise(changed)
    return both.select(key, F.explode(category).alias("category"))


def lifecycle(previous: DataFrame, current: DataFrame, version: str, exact: list[str], loose: list[str]) -> DataFrame:
    """Current diagnostics with first_seen, last_seen, seen_count and lifecycle.

    ``previous`` has ``exact``, ``loose``, first_seen and seen_count. A current
    row goes on from the previous one of its exact key; else from one of its
    loose key if that key is unique on both sides and not taken; else it is
    new. Repeated exact keys within a build count once. Null-safe keys by text.
    """

    def text(columns: list[str]) -> Column:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    cur = current.withColumn("ek", text(exact)).withColumn("lk", text(loose)).dropDuplicates(["ek"])
    prev = previous.withColumn("ek", text(exact)).withColumn("lk", text(loose)).groupBy("ek", "lk").agg(F.min("first_seen").alias("first_seen"), F.max("seen_count").alias("seen_count"))
    hit = cur.join(prev.select("ek", F.col("first_seen").alias("f"), F.col("seen_count").alias("n")), "ek", "left")
    rest = hit.where("n IS NULL").select("ek", "lk")
    free = prev.join(cur.select("ek"), "ek", "left_anti")
    once_now = rest.groupBy("lk").agg(F.count(F.lit(1)).alias("c"), F.min("ek").alias("ek")).where("c = 1").select("lk", "ek")
    once_before = free.groupBy("lk").agg(F.count(F.lit(1)).alias("c"), F.min("first_seen").alias("f2"), F.min("seen_count").alias("n2")).where("c = 1")
    moved = once_now.join(once_before, "lk").select("ek", "f2", "n2")
    both = hit.join(moved, "ek", "left")
    first, count = F.coalesce("f", "f2", F.lit(version)), F.coalesce("n", "n2", F.lit(0).cast("bigint")) + 1
    state = F.when(F.col("n").isNotNull(), "existing").when(F.col("n2").isNotNull(), "moved").otherwise("new")
    return both.select(*current.columns, first.alias("first_seen"), F.lit(version).alias("last_seen"), count.alias("seen_count"), state.alias("lifecycle"))


def stale_targets(old_edges: DataFrame, live_nodes: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """Old edges whose source lives on unchanged and whose target is gone."""
    live = live_nodes.select("id").distinct()
    kept = old_edges.join(live.withColumnRenamed("id", "source"), "source", "left_semi").join(changed_sources.select(F.col("id").alias("source")).distinct(), "source", "left_anti")
    return kept.where("target IS NOT NULL").join(live.withColumnRenamed("id", "target"), "target", "left_anti")
