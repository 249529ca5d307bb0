"""The graph of the tables: one row per node, one per distinct edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.filters import by_profile
from skein.operators.merge import canonical_config, first_by_order
from skein.runtime import table

NODE_COLUMNS = ("id", "kind", "path", "name", "qualname", "start_line", "end_line", "repo_id", "canonical_identity", "properties_json")
EDGE_COLUMNS = ("id", "source", "target", "kind", "confidence", "resolution_status", "semantic_role", "index_version", "created_at", "evidence")
_EDGE_KEY = ("id", "kind", "source", "target")


@dataclass
class Graph:
    """``deliveries`` are the rows of the edges table as they came, for operators that merge what they meet."""

    nodes: DataFrame
    edges: DataFrame
    deliveries: DataFrame

    def settle(self, profile: str):
        """Deliveries as links of a confidence profile, each edge once."""
        return lambda met: by_profile(once(met, ["source", "target", "kind", "confidence"]), profile)


def load(spark: SparkSession, sf_dir: str, nodes: str = "id kind", edges: str = "id kind source target") -> Graph:
    """Nodes not retired, external packages among them, and edges each once.

    ``nodes`` and ``edges`` name the columns a query needs; no others are read,
    but those that decide which of an id's rows counts. Of a node's rows that
    is the least in the order of NODE_COLUMNS, an unresolved kind last. An edge is its id, kind and ends, and a filter on these
    reaches the scan; of its deliveries the greatest in the order of the other
    EDGE_COLUMNS counts. As only a beginning of that order is ever compared,
    two queries with different columns see the same row.
    """
    wanted = nodes.split()
    own = table(spark, sf_dir, "nodes").where("retired_at IS NULL AND id IS NOT NULL").select(*NODE_COLUMNS)
    outside = table(spark, sf_dir, "external_nodes").where("id IS NOT NULL").select("id", "kind", "name", "canonical_identity")
    every = canonical_config(own.unionByName(outside, allowMissingColumns=True))
    picked = first_by_order(every, ["id"], [c for c in NODE_COLUMNS if c != "id"], wanted, F.coalesce(F.col("kind") == "unresolved", F.lit(False)).cast("int"))
    rows = table(spark, sf_dir, "edges")
    return Graph(picked, once(rows, edges.split()), rows)


def once(edges: DataFrame, wanted: list[str]) -> DataFrame:
    """Edges each once, with the columns ``wanted``."""
    rest = [c for c in EDGE_COLUMNS if c not in _EDGE_KEY]
    key = list(_EDGE_KEY)
    if set(wanted) <= {"id", "kind"}:
        key = ["id", "kind"]  # nothing else is read
    return first_by_order(edges, key, rest, wanted, least=False)
