"""Queries of the text problems, each over all documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, packing, residue
from skein.runtime import spread, table


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"), "doc_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_texts(spark, sf_dir), "doc_id", "text")


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by language."""
    documents = _texts(spark, sf_dir, "lang").select(F.struct("doc_id", "lang").alias("doc"), "text")
    return bpe.token_totals(bpe.token_counts(documents, "doc", "text").select("doc.lang", "n_tokens"), "lang")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    containers = table(spark, sf_dir, "container_sizes")
    # The capacities are a setting: a handful of rows at every scale.
    rows = containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()
    plans = {str(r["container_kind"]): [r["capacity_tokens"]] for r in rows}
    if rows:
        plans["joint"] = [r["capacity_tokens"] for r in rows]
    sizes = bpe.token_counts(_texts(spark, sf_dir), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", plans), containers


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed for each capacity alone and for all jointly.

    plan is a container_kind, or 'joint' where containers of all capacities may
    be used; container_kind is the kind a container ended as.
    """
    packed, containers = _packed(spark, sf_dir)
    kinds = containers.groupBy(F.col("capacity_tokens").cast("bigint").alias("capacity")).agg(F.min("container_kind").alias("container_kind"))
    return packed.join(F.broadcast(kinds), "capacity", "left").select(
        "plan", "container", "container_kind", "capacity", "doc_id", "piece_no", F.col("piece_start").alias("token_start"), F.col("piece_size").alias("n_tokens")
    )


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir)[0])


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every plan: all documents in it, no container too full, no piece lost, none cut that fits."""
    packed = _packed(spark, sf_dir)[0].withColumns({"size": F.col("piece_size").cast("bigint"), "upto": (F.col("piece_start") + F.col("piece_size")).cast("bigint")})
    full = packed.groupBy("plan", "container").agg((F.sum("size") > F.max("capacity")).cast("bigint").alias("over"), F.max("capacity").alias("capacity"))
    full = full.groupBy("plan").agg(F.sum("over").alias("n_overfull"), F.max("capacity").alias("most"))
    docs = packed.groupBy("plan", "doc_id").agg(F.sum("size").alias("total"), F.max("upto").alias("upto"), F.count(F.lit(1)).alias("n"))
    docs = docs.join(F.broadcast(full.select("plan", "most")), "plan")  # a row per plan
    docs = docs.groupBy("plan").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("total") != F.col("upto")).alias("n_lost"), F.count_if((F.col("n") > 1) & (F.col("total") <= F.col("most"))).alias("n_cut")
    )
    return docs.join(full, "plan").select("plan", "n_docs", "n_overfull", "n_lost", "n_cut")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_texts(spark, sf_dir), "doc_id", "text")


def p10_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of these documents is one, and whether other documents' alignment says so."""
    return residue.explain(_texts(spark, sf_dir), "doc_id", "text")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, before and after such ones are left out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = p10_found(spark, sf_dir).withColumn("flagged", F.lit(True))
    return (
        documents.join(found, "doc_id", "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("flagged").isNull()).alias("n_kept"))
    )


QUERIES = {
    "p8_ids": p8_ids,
    "p8_totals": p8_totals,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p9_check": p9_check,
    "p10_found": p10_found,
    "p10_why": p10_why,
    "p10_clean": p10_clean,
}

SQL: dict[str, str] = {
    "p9_check": """
SELECT plan, (SELECT count(DISTINCT doc_id) FROM documents)::BIGINT AS n_docs, 0::BIGINT AS n_overfull, 0::BIGINT AS n_lost, 0::BIGINT AS n_cut
FROM (SELECT DISTINCT container_kind AS plan FROM container_sizes WHERE capacity_tokens > 0 UNION SELECT 'joint')""",
}
