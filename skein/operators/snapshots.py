"""What changed between full snapshots of a table, by validity intervals.

Of each key's versions only a hash of the row travels. Consecutive snapshots
in which a key keeps its hash form an island; an island's start, end and
whether the next one adjoins are the change events. One shuffle by key serves
the choice of the valid delivery and a second, of one row per key and snapshot,
all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(rows: DataFrame, snapshot: str, key: str, version: str, delivered: str) -> DataFrame:
    """Islands (key, version, first, last, n_snapshots) of constant versions.

    ``first`` and ``last`` count the table's distinct snapshots by name, from
    0. Of several deliveries of a key in a snapshot the latest holds; of those
    delivered at the same moment the one with the greatest version, and a
    delivery without a time comes before all others. Rows with a null snapshot
    or key belong nowhere and are left out.
    """
    kept = rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.col(version).alias("version"), F.col(delivered).alias("delivered")
    )
    # A snapshot's name is one of few; the list is small whatever the table is.
    calendar = (
        kept.select("snapshot")
        .distinct()
        .select("snapshot", (F.row_number().over(Window.orderBy("snapshot")) - 1).alias("idx"))
        .withColumn("n_snapshots", F.count(F.lit(1)).over(Window.partitionBy()))
    )
    chosen = kept.groupBy("key", "snapshot").agg(F.max(F.struct("delivered", "version")).alias("v"))
    placed = chosen.join(F.broadcast(calendar), "snapshot").select("key", F.col("v.version").alias("version"), "idx", "n_snapshots")
    placed = placed.repartition("key")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("key", "version").orderBy("idx"))
    return (
        placed.withColumn("island", run)
        .groupBy("key", "version", "island", "n_snapshots")
        .agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
        .drop("island")
    )


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, version: str, delivered: str) -> DataFrame:
    """(snapshot, key, change_type) from each snapshot to the next.

    'added', 'removed' or 'changed'; ``snapshot`` is the later of the two. The
    first snapshot adds nothing.
    """
    spans = validity_intervals(rows, snapshot, key, version, delivered)
    order = Window.partitionBy("key").orderBy("first")
    spans = spans.withColumn("before", F.lag("last").over(order)).withColumn("after", F.lead("first").over(order))
    adjoins = F.col("before") == F.col("first") - 1
    start = F.when(F.coalesce(adjoins, F.lit(False)), "changed").when(F.col("first") > 0, "added")
    end = F.when((F.col("last") < F.col("n_snapshots") - 1) & ~F.coalesce(F.col("after") == F.col("last") + 1, F.lit(False)), "removed")
    events = spans.select(
        "key",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("idx"), start.alias("change_type")),
                F.struct((F.col("last") + 1).alias("idx"), end.alias("change_type")),
            )
        ).alias("e"),
    ).where("e.change_type IS NOT NULL")
    names = (
        rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
        .select(F.col(snapshot).alias("snapshot"))
        .distinct()
        .select("snapshot", (F.row_number().over(Window.orderBy("snapshot")) - 1).alias("idx"))
    )
    return events.select("key", "e.*").join(F.broadcast(names), "idx").select("snapshot", "key", "change_type")
