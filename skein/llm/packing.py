"""Items of varying length into containers of several permitted capacities.

Sizes are integers of at most the largest capacity, so the plan needs nothing
but how many items there are of each size: a histogram that is as small for a
billion items as for a thousand. Best fit decreasing runs over it with whole
groups of equal bins: a size goes to the open bins with the least room that
still takes it; where none does, bins of the capacity are opened that the sizes
still to come would leave the least of unused; at the end every bin shrinks to
the smallest capacity that holds its contents. Items then take their places by
their rank among those of their size, which is counted in parts, so that a size
a third of all items share is no task of its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import Stage

_PER_BUCKET = 50_000


@dataclass
class Bins:
    """``repeat`` bins with the same contents [(size, copies), ...]."""

    repeat: int
    capacity: int
    contents: list[tuple[int, int]] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(s * c for s, c in self.contents)


def _unused(gap: int, sizes: list[int], left: dict[int, int]) -> int:
    """What stays of a gap if the largest sizes that fit go in first."""
    while gap:
        i = bisect_right(sizes, gap)
        while i and not left[sizes[i - 1]]:
            i -= 1
        if not i:
            return gap
        size = sizes[i - 1]
        gap -= size * min(gap // size, left[size])
        sizes = sizes[: i - 1]
    return 0


def plan_bins(histogram: dict[int, int], capacities: list[int]) -> list[Bins]:
    """Bins that hold every item of a histogram size -> count."""
    capacities = sorted(set(capacities))
    sizes = sorted(s for s in histogram if s > 0)
    if sizes and sizes[-1] > capacities[-1]:
        raise ValueError("an item exceeds every capacity")
    left = dict(histogram)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_: dict[int, list[Bins]] = {}

    def keep(bins: Bins, room: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(bins)

    for at in range(len(sizes) - 1, -1, -1):
        size, n = sizes[at], left[sizes[at]]
        left[size] = 0
        smaller = sizes[:at]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                # Least cost a unit of capacity; of equal ones the largest.
                def cost(c: int, size: int = size, n: int = n, smaller: list[int] = smaller) -> tuple:
                    return (_unused(c - size * min(n, c // size), smaller, left) / c, -c)

                room = min((c for c in capacities if c >= size), key=cost)
                bins = Bins(-(-n // (room // size)), room)
            copies = room // size
            full = min(bins.repeat, n // copies)
            if full:
                keep(Bins(full, bins.capacity, [*bins.contents, (size, copies)]), room - copies * size)
                n -= full * copies
                bins.repeat -= full
            elif n:
                keep(Bins(1, bins.capacity, [*bins.contents, (size, n)]), room - n * size)
                n = 0
                bins.repeat -= 1
            if bins.repeat and bins.contents:  # bins just opened hold nothing yet
                keep(bins, room)
    done = [b for group in open_.values() for b in group]
    for bins in done:
        bins.capacity = capacities[bisect_left(capacities, bins.used)]
    return done


def _places(done: list[Bins]) -> dict[int, tuple[np.ndarray, ...]]:
    """size -> arrays (first rank, copies, first bin, capacity) in rank order."""
    out: dict[int, list[tuple]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for bins in done:
        for size, copies in bins.contents:
            start = next_rank.get(size, 0)
            out.setdefault(size, []).append((start, copies, base, bins.capacity))
            next_rank[size] = start + copies * bins.repeat
        base += bins.repeat
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for s, rows in out.items()}


def pack(sizes: DataFrame, id_col: str, size_col: str, plans: dict[str, list[int]]) -> DataFrame:
    """Every item's containers: one row per plan and piece.

    Columns plan, container, capacity, ``id_col``, piece_no, piece_start,
    piece_size. ``plans`` names lists of permitted capacities. An item is split
    only if it exceeds the largest of its plan, into pieces of that capacity
    and one of the rest. An item of size 0, or null, needs no room: it comes
    out with a null container and capacity. Repeated rows are items of their
    own. No plans or no items give no rows.
    """
    spark = sizes.sparkSession
    plans = {p: sorted({c for c in cs if c and c > 0}) for p, cs in plans.items()}
    plans = {p: cs for p, cs in plans.items() if cs}
    kind = dict(sizes.dtypes)[id_col]
    schema = f"plan string, container bigint, capacity bigint, `{id_col}` {kind}, piece_no int, piece_start bigint, piece_size bigint"
    if not plans:
        return spark.createDataFrame([], schema)
    stage = Stage(spark, "packing")
    tops = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(cs[-1]).cast("bigint").alias("top")) for p, cs in plans.items()])
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    spread = sizes.select(F.col(id_col), n.alias("n"), F.explode(tops).alias("p")).select(id_col, "n", "p.plan", "p.top")
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("top"))).cast("int")
    pieces = spread.select(id_col, "n", "plan", "top", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no") * F.col("top")
    pieces = stage.put(
        pieces.select(
            "plan", id_col, "piece_no", start.cast("bigint").alias("piece_start"), F.least(F.col("top"), F.col("n") - start).cast("bigint").alias("piece_size")
        ),
        "pieces",
    )
    # At most as many rows as the capacities of all plans add up to.
    counted = pieces.groupBy("plan", "piece_size").agg(F.count(F.lit(1)).alias("n")).collect()
    places = {
        plan: _places(plan_bins({r["piece_size"]: r["n"] for r in counted if r["plan"] == plan and r["piece_size"] > 0}, cs))
        for plan, cs in plans.items()
    }
    buckets = max(1, -(-sum(r["n"] for r in counted) // _PER_BUCKET))
    placed = spark.sparkContext.broadcast(places)

    keys = ["plan", "piece_size", "bucket"]
    cut = pieces.where("piece_size > 0").withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(buckets)))
    before = Window.partitionBy("plan", "piece_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).withColumn("skip", F.coalesce(F.sum("k").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col, "piece_no")) - 1
    ranked = cut.withColumn("rank", rank).join(offsets.select(*keys, "skip"), keys)
    ranked = ranked.select("plan", id_col, "piece_no", "piece_start", "piece_size", (F.col("rank") + F.col("skip")).cast("bigint").alias("rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = np.zeros(len(batch), dtype=np.int64)
            caps = np.zeros(len(batch), dtype=np.int64)
            for (plan, size), at in batch.groupby(["plan", "piece_size"]).indices.items():
                starts, copies, bases, capacity = placed.value[plan][size]
                ranks = batch["rank"].to_numpy()[at]
                run = np.searchsorted(starts, ranks, side="right") - 1
                bins[at] = bases[run] + (ranks - starts[run]) // copies[run]
                caps[at] = capacity[run]
            out = batch.drop(columns="rank")
            out.insert(1, "container", bins)
            out.insert(2, "capacity", caps)
            yield out

    empty = pieces.where("piece_size = 0").select(
        "plan", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("capacity"), id_col, "piece_no", "piece_start", "piece_size"
    )
    return ranked.mapInPandas(assign, schema).unionByName(empty)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per plan and capacity: containers, capacity, tokens and unused share."""
    bins = packed.where(F.col("container").isNotNull()).groupBy("plan", "container", "capacity").agg(F.sum("piece_size").alias("used"))
    return bins.groupBy("plan", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("capacity").alias("capacity_total"),
        F.sum("used").alias("used_total"),
        (1 - F.sum("used") / F.sum("capacity")).alias("unused_share"),
    )
