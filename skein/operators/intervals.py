"""Positions and line ranges: containment, narrowest match, longest prefix, as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per bin of the containment join.
BIN = 64


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Each point with every range of the same key that holds it.

    Ranges are cut into bins, so the join is an equi-join on key and bin and a
    file with very many points and ranges is spread over its bins. A range
    without an end holds its start only; one without a start, or turned round,
    holds nothing. Columns of both sides must differ but for ``key``.
    """
    closed = ranges.withColumn("__end", F.coalesce(end, start)).where(F.col(start).isNotNull() & (F.col("__end") >= F.col(start)))
    binned = closed.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col("__end") / BIN))))
    joined = points.where(F.col(at).isNotNull()).withColumn("__bin", F.floor(F.col(at) / BIN)).join(binned, [key, "__bin"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col("__end"))).drop("__bin", "__end")


def narrowest(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, point_key: list[str], range_id: str) -> DataFrame:
    """Each point's narrowest range; several equally narrow are 'ambiguous'.

    ``point_key``, match (the range's id, null if ambiguous), match_state
    'matched' or 'ambiguous', n_matches. Points in no range do not come out.
    Aggregated, not ranked: a point in very many ranges keeps one row map-side.
    """
    held = containing(points, ranges, key, at, start, end)
    width = F.coalesce(F.col(end), F.col(start)) - F.col(start)
    best = held.groupBy(*point_key, width.alias("width")).agg(F.countDistinct(range_id).alias("n"), F.min(range_id).alias("id"))
    best = best.groupBy(*point_key).agg(F.min(F.struct("width", "n", "id")).alias("b"))
    return best.select(
        *point_key,
        F.when(F.col("b.n") == 1, F.col("b.id")).alias("match"),
        F.when(F.col("b.n") == 1, "matched").otherwise("ambiguous").alias("match_state"),
        F.col("b.n").alias("n_matches"),
    )


def longest_prefix(paths: DataFrame, path: str, parents: DataFrame, parent: str, separator: str = "/") -> DataFrame:
    """Each distinct path with the longest parent that is a leading part of it.

    Paths are exploded to all their leading parts and joined on equality;
    parent is null where none fits.
    """
    pieces = F.split(F.col(path), separator)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), separator))
    asked = paths.select(path).where(F.col(path).isNotNull()).distinct()
    spread = asked.select(path, F.explode(starts).alias("__start"))
    found = spread.join(parents.select(F.col(parent).alias("__start")).distinct(), "__start")
    best = found.groupBy(path).agg(F.max_by("__start", F.length("__start")).alias("parent"))
    return asked.join(best, path, "left")


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each event with the value of the latest state at or before it.

    One union and one window by key instead of a join of all pairs; among
    states of one moment the greatest value holds. Events keep their columns
    and gain ``value``, null before the first state. Null keys match nothing.
    """
    columns = events.columns
    left = events.select(*columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(states.dtypes)[value]).alias("__v"))
    right = states.where(F.col(key).isNotNull() & F.col(since).isNotNull()).groupBy(key, since).agg(F.max(value).alias("__v"))
    right = right.select(key, F.col(since).alias("__t"), F.lit(0).alias("__side"), "__v")
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return filled.withColumn(value, F.when(F.col(key).isNotNull(), F.col(value))).select(*columns, value)
