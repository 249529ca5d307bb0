"""Walks over the graph: neighbours, bounded reach, components, cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.runtime import Stage

#: Rows up to which a frontier is sent to every executor instead of shuffled.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def neighbours(edges: DataFrame, ids: DataFrame, end: str, kinds: tuple[str, ...]) -> DataFrame:
    """Edges of ``kinds`` whose ``end`` is among ``ids`` (column id)."""
    return edges.where(F.col("kind").isin(*kinds)).join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")


#: Levels after which a walk writes the links out once instead of scanning the edges again.
STAGED_FROM = 4
Settle = Callable[[DataFrame], DataFrame]


def reach_nodes(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False, settle: Settle | None = None) -> DataFrame:
    """Nodes (id, depth) within ``max_depth`` steps of the seeds, as ``walk`` finds them without caps."""
    return _walk(edges, seeds, max_depth, reverse, None, None, settle, False, False)[0]


def reach(
    edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False, fan_cap: int | None = None, edge_cap: int | None = None, settle: Settle | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``max_depth`` steps of the seeds, and the edges walked: ``walk`` without its evidence."""
    return _walk(edges, seeds, max_depth, reverse, fan_cap, edge_cap, settle, True, False)[:2]


def walk(
    edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False, fan_cap: int | None = None, edge_cap: int | None = None, settle: Settle | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and cuts of a breadth-first walk.

    Nodes (id, depth) at the least depth, seeds at 0; edges (source, target,
    kind, depth), each (source, target, kind) once, at the step that first
    walked it. ``fan_cap`` edges at most of each node at a step, by the other
    end and kind; ``edge_cap`` in all, by depth, then source, target, kind. Both
    are off unless asked for.

    Cuts (depth, reason, n) say where edges are left out, and only where some
    are: 'max_fan_in' with the nodes that have more, told by one edge beyond
    the cap; 'max_edges' with the edges of that step beyond the budget;
    'max_depth' with the edges not walked that lead on from the last level.

    Each level is a semi-join of the edges with a frontier, broadcast where it
    is counted small, right above the scan. ``settle`` is applied to what is
    left: where edges are delivered repeatedly, only those met are merged. A
    walk that goes on for long stages the links once.
    """
    return _walk(edges, seeds, max_depth, reverse, fan_cap, edge_cap, settle, True, True)


def _walk(edges, seeds, max_depth, reverse, fan_cap, edge_cap, settle, keep, evidence):
    spark = edges.sparkSession
    near, far = ("target", "source") if reverse else ("source", "target")
    key = ["source", "target", "kind"]
    stage = Stage(spark, "reach")
    links = edges.where("source IS NOT NULL AND target IS NOT NULL")
    settle = settle or (lambda found: found)
    seen = Observation()
    frontier = stage.put(
        seeds.where("id IS NOT NULL").select("id", F.lit(0).alias("depth")).distinct().observe(seen, F.count(F.lit(1)).alias("n")), "level"
    )
    n, visited, walked, total, depth, staged = seen.get["n"], frontier, None, 0, 0, False
    cuts: list[tuple[int, str, int]] = []

    def onward() -> DataFrame:
        met = links.join(_small(frontier.select(F.col("id").alias(near)), n), near, "left_semi")
        return (met if staged else settle(met)).select(*key).distinct()

    # A level's near ends were never expanded before, so its edges are new.
    while n and depth < max_depth:
        if edge_cap is not None and total >= edge_cap:
            if evidence and (left := onward().count()):
                cuts.append((depth + 1, "max_edges", left))
            break
        depth += 1
        if depth >= STAGED_FROM and max_depth > STAGED_FROM and not staged:
            links, staged = stage.put(settle(links).select(*key).distinct(), "links"), True
        step = onward()
        if fan_cap is not None:
            order = Window.partitionBy(near).orderBy(far, "kind")
            over = Observation()
            step = step.withColumn("rn", F.row_number().over(order)).observe(
                over, F.count_if(F.col("rn") == fan_cap + 1).alias("nodes"), F.count_if(F.col("rn") <= fan_cap).alias("edges")
            )
            step = step.where(F.col("rn") <= fan_cap).drop("rn")
        elif edge_cap is not None:
            over = Observation()
            step = step.observe(over, F.lit(0).alias("nodes"), F.count(F.lit(1)).alias("edges"))
        if edge_cap is not None:
            step = step.orderBy(*key).limit(edge_cap - total)
        step = step.withColumn("depth", F.lit(depth))
        if keep:
            taken = Observation()
            step = stage.put(step.observe(taken, F.count(F.lit(1)).alias("n")), "edges")
            had = taken.get["n"]
            if fan_cap is not None or edge_cap is not None:
                if over.get["nodes"]:
                    cuts.append((depth, "max_fan_in", over.get["nodes"]))
                if over.get["edges"] > had:
                    cuts.append((depth, "max_edges", over.get["edges"] - had))
            total += had
            walked = step if walked is None else walked.unionByName(step)
        if not evidence and depth == max_depth:
            # Nobody asks how many the last level is.
            visited = visited.unionByName(step.select(F.col(far).alias("id"), "depth").distinct().join(visited.select("id"), "id", "left_anti"))
            break
        seen = Observation()
        frontier = stage.put(
            step.select(F.col(far).alias("id"), "depth").distinct().join(visited.select("id"), "id", "left_anti").observe(seen, F.count(F.lit(1)).alias("n")),
            "level",
        )
        n = seen.get["n"]
        visited = visited.unionByName(frontier)
    if evidence and n and depth == max_depth and depth and (left := onward().count()):
        cuts.append((depth, "max_depth", left))
    if walked is None:
        walked = links.select(*key).limit(0).withColumn("depth", F.lit(0))
    return visited, walked, spark.createDataFrame(cuts, "depth int, reason string, n bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph; component is its least id.

    Alternates linking every node to the least label around it with pointer
    jumping, staged each round, until nothing moves. Ends are compared as
    strings.
    """
    stage = Stage(edges.sparkSession, "components")
    pairs = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    both = stage.put(
        pairs.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")).select("e.*").distinct(),
        "pairs",
    )
    labels = stage.put(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        hooked = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "least").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("label").alias("top"))
        jumped = hooked.join(up, "to", "left").select("id", "label", F.least("to", F.coalesce("top", "to")).alias("to"))
        moved = Observation()
        after = stage.put(jumped.observe(moved, F.count_if(F.col("to") < F.col("label")).alias("n")).select("id", F.col("to").alias("label")), "labels")
        stage.drop(labels)
        labels = after
        if not moved.get["n"]:
            return labels.withColumnRenamed("label", "component")


def _first_reaching(stage: Stage, links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label): of all nodes with a way to a node, the first by label.

    ``links``: source, target; ``labels``: id and its own label, a struct whose
    member ``id`` names the node. A label is a node that reaches the one that
    holds it, so a node may also take its label's label: ways of any length
    shrink by half each round.
    """
    labels = stage.put(labels, "labels")

    def closer(now: DataFrame) -> DataFrame:
        comes = links.join(now.select(F.col("id").alias("source"), "label"), "source").groupBy(F.col("target").alias("id")).agg(F.min("label").alias("least"))
        hooked = now.join(comes, "id", "left").select("id", "was", F.least("label", F.coalesce("least", "label")).alias("label"))
        up = now.select(F.col("id").alias("via"), F.col("label").alias("top"))
        return hooked.withColumn("via", F.col("label.id")).join(up, "via", "left").select("id", "was", F.least("label", F.coalesce("top", "label")).alias("label"))

    while True:
        moved = Observation()
        step = closer(labels.withColumn("was", F.col("label")))
        after = stage.put(step.observe(moved, F.count_if(F.col("label") < F.col("was")).alias("n")).select("id", "label"), "labels")
        stage.drop(labels)
        labels = after
        if not moved.get["n"]:
            return labels


def _trimmed(links: DataFrame, layers: int = 3) -> DataFrame:
    """Links without those that begin at nodes nothing leads to, or end where nothing goes on, some layers deep."""
    for _ in range(layers):
        links = links.join(links.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        links = links.join(links.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on cycles; component is the least id of its cycle set.

    Each round orders the nodes by a hash of its own. A forward pass finds for
    each node the first that reaches it, a backward pass among nodes of the same
    first the first they reach; where both agree they form a set, alone or on a
    cycle. Links between different firsts are on no cycle and go, as do settled
    nodes. With orders drawn anew, a graph without cycles is used up in rounds
    as few as the logarithm of its longest way, each of as few passes. A
    self-loop is a cycle of one.
    """
    stage = Stage(edges.sparkSession, "strong")
    whole = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    loops = whole.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("component")).distinct()
    left = stage.put(_trimmed(stage.put(whole.where("source <> target").distinct(), "links")), "links")
    found, turn = None, 0
    while not left.isEmpty():
        turn += 1
        ids = left.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        own = ids.select("id", F.struct(F.xxhash64(F.lit(turn), "id").alias("order"), "id").alias("label"))
        label = _first_reaching(stage, left, own)
        same = (
            left.join(label.select(F.col("id").alias("source"), F.col("label").alias("ls")), "source")
            .join(label.select(F.col("id").alias("target"), F.col("label").alias("lt")), "target")
            .where("ls = lt")
        )
        same = stage.put(same.select(F.col("target").alias("source"), F.col("source").alias("target")), "same")
        back = _first_reaching(stage, same, own)
        settled = stage.put(label.join(back.withColumnRenamed("label", "reached"), "id").where("label = reached").select("id", "label"), "settled")
        sets = settled.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
        part = settled.join(sets, "label").select("id", "component")
        found = part if found is None else found.unionByName(part)
        gone = settled.select("id")
        rest = stage.put(
            same.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
            .join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
            .select(F.col("target").alias("source"), F.col("source").alias("target")),
            "links",
        )
        left = stage.put(_trimmed(rest), "links")
    if found is None:
        return loops
    return found.unionByName(loops.join(found.select("id"), "id", "left_anti"))


def ego(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """Edges among the nodes within 1 or 2 steps that a walk crossed."""
    depth = min(2, max(1, depth))  # two steps at most, by definition
    links = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target", "kind").distinct()
    visited = seeds.select("id").distinct()
    frontier, crossed = visited, None
    for _ in range(depth):
        parts = []
        if direction in ("out", "both"):
            parts.append(links.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "kind"))
        if direction in ("in", "both"):
            parts.append(links.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "kind"))
        step = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        crossed = step if crossed is None else crossed.unionByName(step)
        ends = step.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        frontier = ends.join(visited, "id", "left_anti")
        visited = visited.unionByName(frontier)
    return crossed.distinct()


def fan(edges: DataFrame, end: str, top: int = 20) -> DataFrame:
    """The ``top`` (end, kind) with most edges; ties by name, then kind."""
    counted = edges.where(F.col(end).isNotNull()).groupBy(F.col(end).alias("endpoint"), "kind").agg(F.count(F.lit(1)).alias("n_edges"))
    return counted.orderBy(F.desc("n_edges"), "endpoint", "kind").limit(top)
