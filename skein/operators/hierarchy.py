"""Parent-child rows to full hierarchies, by hash splitters.

Every node has at most one parent, so the links are pointers. A node whose key
hashes to 0 modulo ``every`` is a splitter. All nodes walk to the next splitter
or root above them, the splitters' own pointers form a graph ``every`` times
smaller that is solved in the same way, and each node's depth, root and path
follow from its splitter's. Walking doubles its stride each round. Nodes that
never reach a splitter sit on, or below, a cycle without one; a round in which
nobody newly arrives proves that no walk left will ever arrive, since a walk of
length g passes through nodes with every shorter length. Cycles found either
way are settled by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.runtime import Stage, digest


def _walk(stage: Stage, state: DataFrame, track: bool) -> tuple[DataFrame, int]:
    """Advance every pointer until it is done or known never to be.

    ``state``: k, ptr, dist, done and, with ``track``, seg (the ids strictly
    between ptr and k, top first). A pointer that meets a done one is done.
    Returns the last state and the number of nodes that are not done.
    """
    extra = ["seg"] if track else []
    held, done_before = None, -1
    while True:
        seen = Observation()
        written = stage.put(state.observe(seen, F.count_if(~F.col("done")).alias("left"), F.count_if("done").alias("done")), "walk")
        stage.drop(held)
        held, left, done = written, seen.get["left"], seen.get["done"]
        if not left or done == done_before:
            return held, left
        done_before = done
        active = held.where(~F.col("done"))
        ahead = held.select(
            F.col("k").alias("ptr"),
            F.col("ptr").alias("ptr2"),
            F.col("dist").alias("dist2"),
            F.col("done").alias("done2"),
            *([F.col("seg").alias("seg2"), F.col("id").alias("id2")] if track else []),
        )
        moved = active.join(ahead, "ptr").select(
            "k",
            F.col("ptr2").alias("ptr"),
            (F.col("dist") + F.col("dist2")).alias("dist"),
            F.col("done2").alias("done"),
            *(
                [
                    # A root ahead points to itself; it is then no node between.
                    F.when(F.col("dist2") == 0, F.col("seg"))
                    .otherwise(F.concat("seg2", F.array("id2"), "seg"))
                    .alias("seg"),
                    "id",
                ]
                if track
                else []
            ),
        )
        state = held.where("done").select("k", "ptr", "dist", "done", *extra, *(["id"] if track else [])).unionByName(moved)


def _cycles(stage: Stage, trapped: DataFrame, track: bool = False) -> DataFrame:
    """k, root_id, depth, node_state and, with ``track``, path of nodes that reach no root.

    ``trapped``: k, id, p, closed under p. The nodes on cycles are those that
    are still hit after a stride at least as long as every tail; the image of
    all nodes shrinks with the stride until only they are left.
    """
    names = stage.put(trapped.select("k", "id", "p"), "trapped")
    jump = names.select("k", F.col("p").alias("ptr"))
    size = -1
    while True:
        jump = stage.put(jump, "stride")
        image = jump.select("ptr").distinct()
        now = image.count()
        if now == size:
            break
        size = now
        jump = jump.join(jump.select(F.col("k").alias("ptr"), F.col("ptr").alias("far")), "ptr").select("k", F.col("far").alias("ptr"))
    on = stage.put(names.join(image.withColumnRenamed("ptr", "k"), "k", "left_semi"), "cycle")

    least = on.select("k", F.col("p").alias("ptr"), F.col("id").alias("least"), F.lit(True).alias("moved"))
    while True:
        seen = Observation()
        least = stage.put(least.observe(seen, F.count_if("moved").alias("moved")), "least")
        if not seen.get["moved"]:
            break
        ahead = least.select(F.col("k").alias("ptr"), F.col("ptr").alias("far"), F.col("least").alias("other"))
        least = least.join(ahead, "ptr").select(
            "k",
            F.col("far").alias("ptr"),
            F.least("least", "other").alias("least"),
            (F.col("other") < F.col("least")).alias("moved"),
        )

    extra = [F.array().cast("array<string>").alias("seg"), "id"] if track else []
    start = names.join(on.select("k", F.lit(True).alias("on")), "k", "left").select(
        "k",
        F.when(F.col("on"), F.col("k")).otherwise(F.col("p")).alias("ptr"),
        F.when(F.col("on"), 0).otherwise(1).cast("bigint").alias("dist"),
        F.coalesce("on", F.lit(False)).alias("done"),
        *extra,
    )
    reached, _ = _walk(stage, start, track=track)
    roots = least.select(F.col("k").alias("ptr"), F.col("least").alias("root_id"))
    path = []
    if track:
        roots = roots.join(on.select(F.col("k").alias("ptr"), F.col("id").alias("entry")), "ptr")
        path = [F.when(F.col("dist") == 0, F.array("id")).otherwise(F.concat(F.array("entry"), "seg", F.array("id"))).alias("path")]
    return reached.join(roots, "ptr").select(
        "k",
        "root_id",
        F.col("dist").alias("depth"),
        F.when(F.col("dist") == 0, "cycle").otherwise("below_cycle").alias("node_state"),
        *path,
    )


def hierarchy(links: DataFrame, child: str, parent: str, every: int = 8, paths: bool = False, rings: bool = False) -> DataFrame:
    """Each id's root, depth, node_state and, with ``paths``, path.

    Columns node, root, depth, node_state[, path ARRAY<STRING> from the root
    down to the node itself; null on and below cycles]. With ``rings`` too, the
    path below a cycle begins at the cycle's node it hangs from, and that of a
    node on a cycle is the node alone.
    A link may be repeated. A child of several parents, which the data should
    not hold, keeps the smallest one by digest. A link with one end null only
    makes its other end known. No links give no rows. A row names itself its
    parent: a cycle of one.

    A parent with a third of all children is a hot key only of the walking
    joins, which adaptive execution splits; its repeated rows are combined
    before they are shuffled.
    """
    stage = Stage(links.sparkSession, "hierarchy")
    c, p = F.col(child).cast("string"), F.col(parent).cast("string")
    ends = links.select(F.explode(F.array(F.struct(c.alias("id"), p.alias("up")), F.struct(p.alias("id"), F.lit(None).cast("string").alias("up")))).alias("e")).select("e.*")
    nodes = stage.put(
        ends.where(F.col("id").isNotNull())
        .select(digest("id").alias("k"), "id", digest("up").alias("p"))
        .groupBy("k")
        .agg(F.min("id").alias("id"), F.min("p").alias("p")),
        "nodes",
    )

    def splitter(key: str):
        return F.pmod(F.xxhash64(key), F.lit(every)) == 0

    root = F.col("p").isNull()
    none = F.array().cast("array<string>")
    extra = ["seg", "id"] if paths else []
    start = nodes.select(
        "k",
        F.when(root, F.col("k")).otherwise(F.col("p")).alias("ptr"),
        F.when(root, 0).otherwise(1).cast("bigint").alias("dist"),
        (root | splitter("p")).alias("done"),
        *([none.alias("seg"), "id"] if paths else []),
    )
    near, _ = _walk(stage, start, track=paths)

    # The reduced graph: roots, which are solved, and splitters, whose pointers
    # lead to roots or other splitters.
    is_root = (F.col("ptr") == F.col("k")) & (F.col("dist") == 0)
    reduced = near.where(F.col("done") & (is_root | splitter("k"))).select("k", "ptr", "dist", is_root.alias("done"), *extra)
    # A splitter may walk to a splitter that is itself trapped outside the
    # reduced graph; its inner join then drops it here, and it is trapped too.
    solved, _ = _walk(stage, reduced, track=paths)
    solved = solved.where("done")
    names = nodes.where(root).select(F.col("k").alias("ptr"), F.col("id").alias("root"))
    upper = stage.put(
        solved.join(names, "ptr").select(
            F.col("k").alias("ptr"),
            "root",
            F.col("dist").alias("above"),
            *([F.when(F.col("dist") == 0, F.array("root")).otherwise(F.concat(F.array("root"), "seg", F.array("id"))).alias("down")] if paths else []),
        ),
        "upper",
    )
    lower = near.where("done")
    tree_keys = lower.join(upper, "ptr")
    if paths:
        at = F.when(F.col("dist") == 0, F.col("down")).otherwise(F.concat("down", "seg", F.array("id")))
        tree = tree_keys.select("k", "root", (F.col("dist") + F.col("above")).alias("depth"), at.alias("path"))
    else:
        tree = tree_keys.select("k", "root", (F.col("dist") + F.col("above")).alias("depth"))
    seen = Observation()
    tree = stage.put(tree.observe(seen, F.count(F.lit(1)).alias("n")), "tree")
    named = tree.join(nodes.select("k", F.col("id").alias("node")), "k").select(
        "node", "root", "depth", F.lit("tree").alias("node_state"), *(["path"] if paths else [])
    )
    if seen.get["n"] == nodes.count():
        return named
    trapped = nodes.join(tree.select("k"), "k", "left_anti")
    caught = _cycles(stage, trapped, paths and rings).join(nodes.select("k", F.col("id").alias("node")), "k")
    path = [F.col("path") if rings else F.lit(None).cast("array<string>").alias("path")] if paths else []
    return named.unionByName(caught.select("node", F.col("root_id").alias("root"), "depth", "node_state", *path))


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all pairs in ``hierarchy(..., paths=True)``.

    The output is as long as all paths together. Nodes without a path take no
    part: those on or below cycles, unless ``rings`` was asked for.
    """
    spread = placed.where(F.col("path").isNotNull()).select(
        F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor")
    )
    return spread.where(F.col("pos") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
