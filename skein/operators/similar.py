"""Similarity of token sets within blocks, exactly and without all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.traverse import components
from skein.runtime import Stage

THRESHOLD = 0.82
SKETCH = 128


def grams(text: Column, n: int = 3, limit: int | None = None) -> Column:
    """Distinct sorted n-grams of the words of a text.

    Words are runs of letters and underscores, in lower case. Of fewer than n
    words the words themselves. All of them, unless ``limit`` asks for the first in order.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z_]+)"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    members = F.array_sort(F.array_distinct(F.when(F.size(words) < n, words).otherwise(runs)))
    return members if limit is None else F.slice(members, 1, limit)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members; 1 of two empty sets, 0 if only one is."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / joint)


def combined_score(tokens: Column, same_structure: Column, calls: Column, resources: Column) -> Column:
    """Token similarity raised by equal structure, shared calls and resources."""
    score = F.when(same_structure, F.greatest(tokens, F.lit(0.95))).otherwise(tokens)
    for part in (calls, resources):
        score = score + (1 - score) * 0.15 * part
    return F.round(score, 4)


def sketch(members: Column, k: int = SKETCH) -> Column:
    """The k least hashes of a set."""
    return F.slice(F.array_sort(F.transform(members, lambda m: F.xxhash64(m))), 1, k)


def containment(a: Column, b: Column, least: int = 32, sampled: int = 8) -> Column:
    """Estimated share of the smaller set in the other, from sketches.

    Only hashes up to where both sketches are complete are compared; 0 where
    either set is too small to tell.
    """
    cut = F.least(F.when(F.size(a) >= SKETCH, F.array_max(a)).otherwise(F.lit(2**63 - 1)), F.when(F.size(b) >= SKETCH, F.array_max(b)).otherwise(F.lit(2**63 - 1)))
    left, right = F.filter(a, lambda h: h <= cut), F.filter(b, lambda h: h <= cut)
    small = F.least(F.size(left), F.size(right))
    return F.when((F.least(F.size(a), F.size(b)) < least) | (small < sampled), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / small)


def near_sets(df: DataFrame, id_col: str, block: str, members: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of similar sets within blocks.

    classes: every row's ``id_col``, class_id (the least id of rows with the
    same block and set) and n_copies. links: class_a < class_b and score of all
    pairs of different sets with Jaccard of at least ``threshold``. No pair is
    lost and copies are not expanded.

    Two sets that similar share one of their rarest members: of n members the
    n - ceil(t * n) + 1 rarest. Only those prefixes are joined, so members that
    all sets share join nothing. Nulls and empty sets are classes without links.
    """
    stage = Stage(df.sparkSession, "similar")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(block), F.lit("")).alias("block"), F.coalesce(F.col(members), F.array()).alias("members"))
    rows = stage.put(rows.withColumn("set_key", F.md5(F.concat_ws("\x1f", "block", "members"))), "sets")
    sets = stage.put(
        rows.groupBy("set_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("block").alias("block"), F.first("members").alias("members")), "classes"
    )
    classes = rows.select("id", "set_key").join(sets.select("set_key", "class_id", "n_copies"), "set_key").select(F.col("id").alias(id_col), "class_id", "n_copies")
    flat = sets.where(F.size("members") > 0).select("set_key", "block", F.size("members").alias("n"), F.explode("members").alias("m"))
    counts = flat.groupBy("block", "m").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(counts, ["block", "m"]).where("df > 1").withColumn("pos", F.row_number().over(Window.partitionBy("set_key").orderBy("df", "m")))
    # Members of one set only were dropped; they come first in order, so the
    # prefix shrinks by as many.
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("set_key"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - alone
    prefix = stage.put(ranked.withColumn("take", length).where("pos <= take").select("block", "m", "set_key", "n"), "prefix")
    other = prefix.select("block", "m", F.col("set_key").alias("other"), F.col("n").alias("n2"))
    near = F.col("n") * threshold - 1e-9 <= F.col("n2")
    pairs = prefix.join(other, ["block", "m"]).where((F.col("set_key") < F.col("other")) & near & (F.col("n2") * threshold - 1e-9 <= F.col("n")))
    pairs = pairs.select("set_key", "other").distinct()
    full = sets.select("set_key", "class_id", "members")
    scored = (
        pairs.join(full, "set_key")
        .join(full.select(F.col("set_key").alias("other"), F.col("class_id").alias("class_2"), F.col("members").alias("m2")), "other")
        .withColumn("score", jaccard(F.col("members"), F.col("m2")))
        .where(F.col("score") >= threshold)
    )
    links = scored.select(F.least("class_id", "class_2").alias("class_a"), F.greatest("class_id", "class_2").alias("class_b"), F.round("score", 4).alias("score"))
    return classes, links


def families(classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Every row with its class, its family of linked classes and number of links."""
    grouped = components(links.select(F.col("class_a").cast("string").alias("source"), F.col("class_b").cast("string").alias("target")))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    out = classes.join(degree, "class_id", "left").join(grouped.withColumnRenamed("id", "__id"), F.col("class_id").cast("string") == F.col("__id"), "left")
    return out.select(
        id_col, "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", F.col("class_id").cast("string")).alias("family")
    )


def strongest(links: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` neighbours of each class by score, ties by id."""
    both = links.select(F.explode(F.array(F.struct(F.col("class_a").alias("id"), F.col("class_b").alias("neighbour"), "score"), F.struct(F.col("class_b").alias("id"), F.col("class_a").alias("neighbour"), "score"))).alias("e")).select("e.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)
