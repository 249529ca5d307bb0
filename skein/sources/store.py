"""Versioned snapshots of graph tables, and exports of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import Fs


class SnapshotStore:
    """Immutable versions below a folder: ``builds/<version>/<table>`` and a pointer.

    A version is visible once its pointer entry is renamed into place; readers
    before that see the one before, and what a failed write left is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = Fs(spark, self.root)
        self.fs.mkdirs(f"{self.root}/current")

    def write(self, version: str, tables: dict[str, DataFrame]) -> None:
        place = f"{self.root}/builds/{version}"
        counts = {}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{place}/{name}")
            counts[name] = self.spark.read.parquet(f"{place}/{name}").count()
        number = len(self.pointers()) + 1
        text = json.dumps({"version": version, "tables": sorted(tables), "counts": counts})
        if not self.fs.publish_text(f"{self.root}/current/{number:08d}.json", text):
            raise RuntimeError("another version was published meanwhile")

    def pointers(self) -> list[str]:
        return [n for n in self.fs.names(f"{self.root}/current") if not n.startswith("_") and not n.startswith(".")]

    def current(self) -> str | None:
        names = self.pointers()
        return json.loads(self.fs.read_text(f"{self.root}/current/{names[-1]}"))["version"] if names else None

    def versions(self) -> list[str]:
        return self.fs.names(f"{self.root}/builds")

    def read(self, table: str, version: str | None = None) -> DataFrame:
        chosen = version or self.current()
        if chosen is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/builds/{chosen}/{table}")

    def prune(self, keep: int, pinned: tuple[str, ...] = ()) -> list[str]:
        """Remove all but the current, pinned and newest versions; names what went."""
        current = self.current()
        fixed = {current, *pinned}
        others = [v for v in reversed(self.versions()) if v not in fixed]
        gone = others[max(0, keep - len(fixed & set(self.versions()))) :]
        for version in gone:
            self.fs.delete(f"{self.root}/builds/{version}")
        return gone


def export_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object per row, members in order of name, nulls left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def summary(tables: dict[str, DataFrame], sample: int = 200) -> dict:
    """Counts and a bounded sample of each table, with how many rows it leaves out."""
    out = {}
    for name, df in tables.items():
        n = df.count()
        rows = [r["j"] for r in df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).orderBy("j").limit(sample).collect()]
        out[name] = {"count": n, "sample": rows, "omitted": max(0, n - sample)}
    return out


def force_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per node and link as JSON text, for a drawing program."""
    return nodes.select(F.lit("node").alias("entity"), F.to_json(F.struct("*")).alias("json")).unionByName(
        links.select(F.lit("link").alias("entity"), F.to_json(F.struct("*")).alias("json"))
    )


def markdown(title: str, df: DataFrame, order: list[str], limit: int = 50) -> str:
    """The first rows of a small result as a Markdown table."""
    rows = df.orderBy(*order).limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def manifest(spark: SparkSession, pattern: str, commit: str) -> DataFrame:
    """Artifacts with size and sha256, stamped with a commit."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.substring_index("path", "/", -1).alias("artifact"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.lit(commit).alias("commit_sha"))
