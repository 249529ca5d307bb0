"""Merging repeated and conflicting rows of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vocabulary import confidence_rank


def first_by_order(rows: DataFrame, key: list[str], order: list[str], wanted: list[str], *ranks: Column, least: bool = True) -> DataFrame:
    """One row per ``key``: the first by ``ranks``, then by ``order``, with the columns ``wanted``.

    Compares the columns of ``order`` only as far as the last one wanted, so
    that the others are not read; whatever is wanted, it is the same row.
    ``least``: the least first, else the greatest. Aggregated map-side, so a
    key repeated in a third of all rows is no hot group.
    """
    upto = max((order.index(c) + 1 for c in wanted if c in order), default=0)
    if not upto:
        return rows.select(*key).distinct().select(*wanted)
    compared = F.struct(*[r.alias(f"__r{i}") for i, r in enumerate(ranks)], *order[:upto])
    best = rows.groupBy(*key).agg((F.min if least else F.max)(compared).alias("__first"))
    return best.select(*[c if c in key else F.col(f"__first.{c}").alias(c) for c in wanted])


def dedupe_nodes(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One row per id: resolved before unresolved, with a path before without, then the least row.

    A node is unresolved by its kind, or by what its properties say of its
    resolution or of being defined elsewhere. Columns are compared in
    alphabetical order, but for the key. Null ids are one id.
    """
    unresolved = F.coalesce(F.col("kind") == "unresolved", F.lit(False))
    if "properties_json" in nodes.columns:
        said = lambda name, value: F.coalesce(F.get_json_object("properties_json", f"$.{name}") == value, F.lit(False))
        unresolved = unresolved | said("resolution_status", "unresolved") | said("external_reference", "true")
    order = sorted(c for c in nodes.columns if c != key)
    return first_by_order(nodes, [key], order, nodes.columns, unresolved.cast("int"), F.col("path").isNull().cast("int"))


def canonical_config(nodes: DataFrame) -> DataFrame:
    """Shared configuration entries without a place of their own.

    A node of kind config whose id says that it is an environment variable or
    an entry of browser storage belongs to no file: path and lines go, its
    names are what the id says, and of its properties only those stay that
    tell which entry it is. Columns that ``nodes`` lacks are not made.
    """
    env, browser = (F.col("id").startswith(f"config:{k}:") for k in ("env", "browser_storage"))
    shared = F.coalesce((F.col("kind") == "config") & (env | browser), F.lit(False))
    own = F.regexp_replace("id", "^config:", "")
    put = {c: F.when(~shared, F.col(c)) for c in ("path", "start_line", "end_line") if c in nodes.columns}
    put |= {c: F.when(shared, own).otherwise(F.col(c)) for c in ("name", "qualname") if c in nodes.columns}
    if "properties_json" in nodes.columns:
        had = lambda name: F.get_json_object("properties_json", f"$.{name}").alias(name)
        key = F.coalesce(had("key"), F.regexp_replace(own, "^env:", "")).alias("key")
        said = F.when(env, F.to_json(F.struct(F.lit("env").alias("config_kind"), key))).otherwise(F.to_json(F.struct(had("config_kind"), had("storage"), had("key"))))
        put["properties_json"] = F.when(shared, said).otherwise(F.col("properties_json"))
    return nodes.withColumns(put)


def merge_edges(edges: DataFrame, key: tuple[str, ...] = ("source", "target", "kind", "semantic_role"), seq: str = "id") -> DataFrame:
    """Edges of equal key as one: strongest confidence, union of evidence.

    The greatest confidence wins and brings its resolution; of equal ones the
    first by ``seq`` does. Adds n_merged, first_seq and n_evidence. Evidence is
    distinct over all its fields. Nulls in the key are equal to each other.
    The evidence of a key is exploded and counted distinct instead of being
    gathered, so a hot key's union is no single array.
    """
    rank = confidence_rank(F.col("confidence"))
    merged = edges.groupBy(*key).agg(
        F.max_by("confidence", F.struct(rank, -F.col(seq))).alias("confidence"),
        F.max_by("resolution_status", F.struct(rank, -F.col(seq))).alias("resolution_status"),
        F.count(F.lit(1)).alias("n_merged"),
        F.min(seq).alias("first_seq"),
    )
    if "evidence" not in edges.columns:
        return merged
    pieces = edges.select(*key, F.explode("evidence").alias("e")).where("e IS NOT NULL")
    counted = pieces.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_evidence"))
    renamed = counted.select(*[F.col(k).alias(f"__{k}") for k in key], "n_evidence")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return merged.join(renamed, on, "left").select(*merged.columns, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def evidence_union(arrays: Column) -> Column:
    """Distinct members of an array of arrays, first seen first."""
    return F.array_distinct(F.flatten(arrays))


def undirected(edges: DataFrame, score: str) -> DataFrame:
    """Pairs with the smaller end as source; the highest score of a pair stays."""
    ends = edges.where("source IS NOT NULL AND target IS NOT NULL").select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), score
    )
    return ends.groupBy("source", "target").agg(F.max(score).alias(score))


def dangling(edges: DataFrame, nodes: DataFrame, adapter_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges with an end that is no node: id, end, node_id, severity.

    An edge all of whose evidence comes from adapters is only worth a warning.
    """
    ends = edges.select(
        "id",
        *(["evidence"] if "evidence" in edges.columns else []),
        F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).alias("node_id")) for c in ("source", "target")])).alias("e"),
    ).select("*", "e.*").drop("e")
    lost = ends.where("node_id IS NOT NULL").join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_anti")
    severity = F.lit("error")
    if "evidence" in edges.columns and adapter_kinds:
        soft = F.coalesce((F.size("evidence") > 0) & F.forall("evidence", lambda e: F.coalesce(e["kind"].isin(*adapter_kinds), F.lit(False))), F.lit(False))
        severity = F.when(soft, "warning").otherwise("error")
    return lost.select("id", "end", "node_id", severity.alias("severity"))


def conflicts(edges: DataFrame) -> DataFrame:
    """Places at which confirmed edges of a source and kind have several targets.

    source, kind, path, start_line, n_targets and occurrence, which numbers the
    conflicts of a source and kind in order of place.
    """
    at = edges.where("confidence = 'confirmed' AND target IS NOT NULL").select("source", "kind", "target", F.explode("evidence").alias("e"))
    places = (
        at.where("e IS NOT NULL AND e.path IS NOT NULL AND e.start_line IS NOT NULL")
        .select("source", "kind", "target", F.col("e.path").alias("path"), F.col("e.start_line").alias("start_line"))
        .distinct()
        .groupBy("source", "kind", "path", "start_line")
        .agg(F.count(F.lit(1)).alias("n_targets"))
        .where("n_targets >= 2")
    )
    order = Window.partitionBy("source", "kind").orderBy("path", "start_line")
    return places.withColumn("occurrence", F.row_number().over(order))


def incremental(old: DataFrame, new: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Old rows of paths that did not change, and all new rows."""
    return old.join(changed.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)
