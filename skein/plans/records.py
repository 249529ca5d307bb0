"""Queries of the record problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.canonical import json_digest
from skein.operators import drift, hierarchy, hotkeys, references, shred, snapshots
from skein.operators.incremental import IncrementalTarget, run_slices
from skein.plans import records_sql
from skein.runtime import Stage, table

FACT_SCHEMA = {
    "fact_id": "string",
    "schema_version": "string",
    "canonical_identity": "string",
    "path": "string",
    "start_line": "bigint",
    "end_line": "bigint",
    "language": "string",
    "confidence": "string",
    "semantic_role": "string",
    "is_test": "boolean",
    "frontend_version": "string",
    "tags": "array<string>",
}


# 1. nested records ------------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = shred.json_objects(table(spark, sf_dir, "lsp_messages"), "msg_id", "message", ("params", "result"))
    evidence = shred.list_objects(table(spark, sf_dir, "edges"), "id", "evidence")
    columns = ["record_type", "record_id", "obj_path", "parent_path"]
    return (
        messages.withColumn("record_type", F.lit("message"))
        .select(*columns)
        .unionByName(evidence.withColumn("record_type", F.lit("edge")).select(*columns))
    )


def p1_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of every message with the object it belongs to, rebuilt from its column's levels."""
    return shred.rebuild_leaves(shred.shredded_columns(table(spark, sf_dir, "lsp_messages"), "msg_id", "message", ("params", "result")))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the flat tables: scalars of messages and of edges' evidence, its kind among them."""
    evidence = shred.list_leaves(table(spark, sf_dir, "edges"), "id", "evidence", ["kind", "path", "start_line"])
    return p1_leaves(spark, sf_dir).withColumn("record_type", F.lit("message")).unionByName(evidence.withColumn("record_type", F.lit("edge")))


def p1_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables: each object with its parent, the table it is in, and its fields as one JSON object.

    table_path is obj_path with the positions left out, as ``result[].to.tags[]``.
    """
    found = p1_found(spark, sf_dir)
    key = ["record_type", "record_id", "obj_path"]
    fields = p1_values(spark, sf_dir).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("fields"))
    return found.join(fields, key, "left").select(
        *key, "parent_path", F.regexp_replace("obj_path", r"\[\d+\]", "[]").alias("table_path"), F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"),
        F.to_json(F.map_from_entries("fields"), {"ignoreNullFields": "false"}).alias("fields"),
    )


# 2. hot keys ------------------------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, sf_dir, "edges"), ["target", "kind"], "id").select("target", "kind")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.dense_key_counts(table(spark, sf_dir, "edges"), ["target", "kind"], "id")


# 3. hierarchies ---------------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").where(F.col("kind").isin("contains", "defines")).select("source", "target")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf_dir), "target", "source").select("node", "root", "depth", "node_state")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hierarchy.hierarchy(_links(spark, sf_dir), "target", "source", paths=True)
    return placed.where("node_state = 'tree'").select("node", "root", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hierarchy.hierarchy(_links(spark, sf_dir), "target", "source", paths=True)
    return hierarchy.descendants(placed).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


def p3_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_paths, with the nodes on and below cycles, whose paths begin on the cycle."""
    placed = hierarchy.hierarchy(_links(spark, sf_dir), "target", "source", paths=True, rings=True)
    return placed.select("node", "root", "depth", "node_state", F.array_join("path", " > ").alias("path"))


def p3_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_descendants, with the pairs below cycles."""
    placed = hierarchy.hierarchy(_links(spark, sf_dir), "target", "source", paths=True, rings=True)
    return hierarchy.descendants(placed).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


# 4. snapshots -----------------------------------------------------------------


def _identities(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    nodes = table(spark, sf_dir, "node_identities").select(
        "snapshot", F.col("stable_identity").alias("stable_key"), json_digest("node_payload").alias("version"), "delivered_at"
    )
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source_identity", "target_identity", "edge_kind", "semantic_role")])
    edges = table(spark, sf_dir, "edge_identities").select(
        "snapshot", key.alias("stable_key"), json_digest("edge_payload").alias("version"), "delivered_at"
    )
    return [("node", nodes), ("edge", edges)]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        snapshots.snapshot_changes(rows, "snapshot", "stable_key", "version", "delivered_at").select(
            F.lit(entity).alias("entity"), "snapshot", F.col("key").alias("stable_key"), "change_type"
        )
        for entity, rows in _identities(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long versions live: islands by entity, first snapshot and length."""
    parts = [
        snapshots.validity_intervals(rows, "snapshot", "stable_key", "version", "delivered_at").select(
            F.lit(entity).alias("entity"), "first", (F.col("last") - F.col("first") + 1).alias("n_held")
        )
        for entity, rows in _identities(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1]).groupBy("entity", "first", "n_held").agg(F.count(F.lit(1)).alias("n_versions"))


# 5. orphans -------------------------------------------------------------------


def _orphans(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    edges, facts = table(spark, sf_dir, "edges"), table(spark, sf_dir, "semantic_facts")
    ends = F.explode(
        F.array(
            F.struct(F.lit("source").alias("ref_column"), F.col("source").alias("fk")),
            F.struct(F.lit("target").alias("ref_column"), F.col("target").alias("fk")),
        )
    ).alias("e")
    refs = edges.select(F.lit("edges").alias("referrer"), F.col("id").cast("string").alias("record_key"), F.col("created_at").alias("at"), ends).select(
        "referrer", "record_key", "e.ref_column", "e.fk", "at"
    )
    refs = refs.unionByName(
        facts.select(
            F.lit("semantic_facts").alias("referrer"),
            F.col("fact_id").alias("record_key"),
            F.lit("node_id").alias("ref_column"),
            F.col("node_id").alias("fk"),
            F.col("created_at").alias("at"),
        )
    )
    lives = references.lifetimes(table(spark, sf_dir, "nodes"), "id", "first_indexed_at", "retired_at").unionByName(
        references.lifetimes(table(spark, sf_dir, "external_nodes"), "id", "first_indexed_at", None)
    )
    return references.orphans(refs, lives, distinct)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orphans(spark, sf_dir, distinct=False)
        .select("referrer", "record_key", "ref_column", "reason", F.date_format("at", "yyyy-MM").alias("ref_month"))
        .distinct()
    )


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, sf_dir))


# 6. incremental runs ----------------------------------------------------------


def successful_runs(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """(run_no, cutoff_at) in order; the table has a row per build, not per record."""
    builds = table(spark, sf_dir, "index_builds").where("run_status = 'success' AND cutoff_at IS NOT NULL AND run_no IS NOT NULL")
    return [(r["run_no"], r["cutoff_at"]) for r in builds.select("run_no", "cutoff_at").orderBy("cutoff_at", "run_no").collect()]


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("path", r"^(\./)+", "")
    files = table(spark, sf_dir, "files").where("file_hash IS NOT NULL AND file_hash <> ''").select(
        F.lit("file").alias("record_type"),
        F.concat(F.coalesce("repo_id", F.lit("")), F.lit(":"), path).alias("record_key"),
        F.lower("file_hash").alias("version"),
        F.col("scanned_at").alias("at"),
        "arrived_at",
    )
    facts = table(spark, sf_dir, "semantic_facts").select(
        F.lit("fact").alias("record_type"),
        F.col("fact_id").alias("record_key"),
        F.lit("").alias("version"),
        F.lit(None).cast("timestamp_ntz").alias("at"),
        "arrived_at",
    )
    return files.unionByName(facts)


def _target(spark: SparkSession, sf_dir: str) -> IncrementalTarget:
    stage = Stage(spark, "target")
    target = IncrementalTarget(spark, f"{stage.root}/target")
    runs = successful_runs(spark, sf_dir)
    if runs:
        sliced = stage.put(run_slices(source_records(spark, sf_dir), runs), "slices", partition_by="slice")
        sizes = {r["slice"]: r["count"] for r in sliced.groupBy("slice").count().collect()}  # a row per run
        for i, (run_no, _) in enumerate(runs):
            target.process(run_no, sliced.where(F.col("slice") == i).drop("slice"), sizes.get(i, 0))
    return target


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir).rows().where("changed").select("run_no", "record_type", "record_key")


# 7. drifting fields -----------------------------------------------------------


#: New fields that were approved for columns of their own.
PROMOTED = {"note": "string", "owner_team": "string", "reviewed": "string", "origin_ref": "string", "score": "double"}


def _ingested(spark: SparkSession, sf_dir: str, stage: Stage) -> DataFrame:
    return stage.put(drift.ingest(table(spark, sf_dir, "fact_exports"), "raw_record", FACT_SCHEMA, ["export_id", "line_no"]), "ingested")


def _changes(spark: SparkSession, sf_dir: str, ingested: DataFrame, stage: Stage) -> DataFrame:
    fields = drift.profile(ingested.select("*", F.col("fact_id").alias("record_key")), FACT_SCHEMA, ["export_id", "record_key"])
    fields = stage.put(fields.distinct(), "fields")
    exports = table(spark, sf_dir, "fact_exports").select("export_id", "feed", "exported_at")
    return drift.field_changes(exports, fields)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "drift")
    return _changes(spark, sf_dir, _ingested(spark, sf_dir, stage), stage).select("export_id", "change_type", "old_field", "new_field")


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent table: approved names replayed, approved new fields promoted.

    Lists, lines and flags come out as text, as comparisons of results take nulls there in different ways.

    n_rescued counts the members of a record that no column holds.
    """
    stage = Stage(spark, "drift")
    ingested, target = _ingested(spark, sf_dir, stage), {**FACT_SCHEMA, **PROMOTED}
    approved = drift.other_names(_changes(spark, sf_dir, ingested, stage), target)
    replayed = drift.replay(drift.promote(ingested, PROMOTED), target, ["export_id", "line_no"], approved)
    left = F.coalesce(F.size(F.json_object_keys("_rescued")), F.lit(0))
    return replayed.select("export_id", "line_no", *target, left.alias("n_rescued")).withColumns(
        {"tags": F.array_join("tags", ","), **{c: F.col(c).cast("string") for c in ("start_line", "end_line", "is_test")}}
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_leaves": p1_leaves,
    "p1_values": p1_values,
    "p1_objects": p1_objects,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p3_all_paths": p3_all_paths,
    "p3_all_descendants": p3_all_descendants,
    "p4_found": p4_found,
    "p4_intervals": p4_intervals,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_table": p7_table,
}

SQL = {**records_sql.SQL, "p7_table": records_sql.p7_table({**FACT_SCHEMA, **PROMOTED})}
