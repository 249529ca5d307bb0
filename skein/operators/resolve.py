"""Names to nodes, in batches, by the first rule that finds anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.identity import bare_candidates
from skein.functions.vocabulary import RESOURCE_KINDS

#: Rules in the order they are tried.
STRATEGIES = ("exact_id", "exact_qualname", "normalized_id", "exact_path", "resource_name", "exact_name", "qualname_suffix")
CANDIDATES = 8


def _keys() -> "F.Column":
    """Every key a node answers to, with the rank of the rule."""
    tail = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split("qualname", r"\.")))),
        lambda i: F.array_join(F.slice(F.split("qualname", r"\."), i, 10_000), "."),
    )
    suffixes = F.when(F.col("qualname").contains("."), tail).otherwise(F.array().cast("array<string>"))
    rule = lambda column, rank: F.array(F.struct(column.alias("key"), F.lit(rank).alias("rank")))
    resource = F.col("kind").isin(*RESOURCE_KINDS)
    return F.concat(
        rule(F.col("id"), 0),
        rule(F.col("qualname"), 1),
        rule(F.col("path"), 3),
        rule(F.when(resource, F.col("name")), 4),
        rule(F.when(~resource, F.col("name")), 5),
        F.transform(suffixes, lambda s: F.struct(s.alias("key"), F.lit(6).alias("rank"))),
    )


def resolve(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, status, strategy, id, n_candidates) for distinct non-null queries.

    One equi-join on keys, nodes exploded to all keys they answer to and
    queries to the ids a bare name may stand for. The best rule of a query
    decides: one node resolves it, several leave it 'ambiguous' with a null id
    and the number of candidates, none leaves it 'unresolved'.
    """
    asked = targets.select("query").where("query IS NOT NULL AND query <> ''").distinct()
    forms = asked.select("query", F.col("query").alias("key"), F.lit(None).cast("int").alias("forced")).unionByName(
        asked.select("query", F.explode(bare_candidates(F.col("query"))).alias("key"), F.lit(2).alias("forced")).where("key <> query")
    )
    keyed = nodes.select("id", F.explode(_keys()).alias("k")).select("id", "k.*").where("key IS NOT NULL AND key <> ''")
    hits = forms.join(keyed, "key").where("forced IS NULL OR rank = 0").select("query", "id", F.coalesce("forced", "rank").alias("rank"))
    best = (
        hits.distinct()
        .groupBy("query", "rank")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .groupBy("query")
        .agg(F.min(F.struct("rank", "n", "id")).alias("b"))
    )
    names = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("b.rank") + 1)
    status = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous")
    return asked.join(best, "query", "left").select(
        "query",
        status.alias("status"),
        F.when(F.col("b").isNotNull(), names).alias("strategy"),
        F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"),
        F.coalesce("b.n", F.lit(0).cast("bigint")).alias("n_candidates"),
    )


def candidates(targets: DataFrame, nodes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The first candidates of each ambiguous name, by kind, path, line and id."""
    order = Window.partitionBy("query").orderBy("kind", "path", "start_line", "id")
    found = targets.select(F.col("query")).distinct().join(nodes.select(F.col("name").alias("query"), "id", "kind", "path", "start_line"), "query")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
