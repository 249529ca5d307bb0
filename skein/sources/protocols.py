"""Indexes, interface descriptions and other tools' output as graph rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCIP = "documents array<struct<relativePath string, occurrences array<struct<symbol string, range array<int>, symbolRoles int>>>>"
NODE = "struct<id string, kind string, name string, qualname string, path string, start_line int, end_line int>"
EDGE = "struct<source string, target string, kind string, confidence string, semantic_role string>"
EXTERNAL = f"schema_version string, extractor string, language string, nodes array<{NODE}>, edges array<{EDGE}>, warnings array<struct<kind string, message string, path string>>"
METRICS = "timestamp string, command string, tool_name string, status string, duration_ms double"

#: Lines and columns as one number, so that ranges compare as numbers.
_LINE = 10_000


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """(path, symbol, is_definition, lo, hi) of a document index; lo and hi pack line and column."""
    raw = spark.read.schema(SCIP).option("multiLine", True).json(path)
    rows = raw.select(F.explode("documents").alias("d")).select(F.col("d.relativePath").alias("path"), F.explode("d.occurrences").alias("o"))
    r = F.col("o.range")
    four = F.size(r) >= 4  # three numbers: one line
    last_line, last_col = F.when(four, F.get(r, F.lit(2))).otherwise(F.get(r, F.lit(0))), F.when(four, F.get(r, F.lit(3))).otherwise(F.get(r, F.lit(2)))
    return rows.where("o.symbol IS NOT NULL AND o.symbol <> '' AND size(o.range) >= 3").select(
        "path",
        F.col("o.symbol").alias("symbol"),
        (F.coalesce(F.col("o.symbolRoles"), F.lit(0)).bitwiseAND(1) == 1).alias("is_definition"),
        (F.get(r, F.lit(0)).cast("bigint") * _LINE + F.get(r, F.lit(1))).alias("lo"),
        (last_line.cast("bigint") * _LINE + last_col).alias("hi"),
    )


def reference_edges(found: DataFrame) -> DataFrame:
    """(source, target, path, lo, external): references from the narrowest definition around them.

    A reference outside all definitions comes from its document's module; a
    symbol that nothing defines is external.
    """
    definitions = found.where("is_definition")
    around = definitions.select(F.col("path"), F.col("symbol").alias("owner"), F.col("lo").alias("dlo"), F.col("hi").alias("dhi"))
    references = found.where("NOT is_definition").select("path", "symbol", "lo", "hi").distinct()
    # Ranges of one document; binned by line so that one long document is no single group.
    lines = around.withColumn("bin", F.explode(F.sequence(F.floor(F.col("dlo") / (_LINE * 64)), F.floor(F.col("dhi") / (_LINE * 64)))))
    held = references.withColumn("bin", F.floor(F.col("lo") / (_LINE * 64))).join(lines, ["path", "bin"], "left").where("owner IS NULL OR (dlo <= lo AND dhi >= hi)")
    best = held.groupBy("path", "symbol", "lo").agg(F.min(F.when(F.col("owner").isNotNull(), F.struct((F.col("dhi") - F.col("dlo")).alias("w"), "owner"))).alias("b"))
    joined = references.join(best, ["path", "symbol", "lo"], "left")
    known = definitions.select("symbol").distinct().withColumn("known", F.lit(True))
    return joined.join(known, "symbol", "left").select(
        F.coalesce("b.owner", F.concat(F.lit("mod:"), F.col("path"))).alias("source"), F.col("symbol").alias("target"), "path", "lo", F.col("known").isNull().alias("external")
    )


def openapi(spark: SparkSession, path: str) -> DataFrame:
    """(method, route, operation_id, schemas) of an interface description; no operation is left out."""
    text = spark.read.option("wholetext", True).text(path)
    paths = text.select(F.explode(F.from_json(F.get_json_object("value", "$.paths"), "map<string, string>")).alias("route", "item"))
    operations = paths.select("route", F.explode(F.from_json("item", "map<string, string>")).alias("method", "op"))
    verbs = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all("op", F.lit(r'"\$ref"\s*:\s*"[^"]*/([^"/]+)"'), F.lit(1))))
    return operations.where(F.lower("method").isin(*verbs)).select(
        F.upper("method").alias("method"), "route", F.get_json_object("op", "$.operationId").alias("operation_id"), refs.alias("schemas")
    )


def bind_operations(operations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Operations with the function their id names: 'matched', 'ambiguous' or 'unmatched'."""
    handlers = nodes.where("kind IN ('function', 'method')").groupBy(F.col("name").alias("operation_id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("handler"))
    joined = operations.join(handlers, "operation_id", "left")
    state = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return joined.select("method", "route", "operation_id", "schemas", F.when(F.col("n") == 1, F.col("handler")).alias("handler"), state.alias("state"))


def external(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, warnings) of other extractors' files; a malformed file stops the read."""
    raw = spark.read.schema(EXTERNAL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    tags = ["extractor", "language"]

    def rows(column: str) -> DataFrame:
        return raw.select(*tags, F.explode(column).alias("x")).select(*tags, "x.*")

    return rows("nodes"), rows("edges"), rows("warnings")


def changed_paths(name_status: DataFrame, text_col: str = "value") -> DataFrame:
    """(status, path, old_path) of ``git diff --name-status`` lines."""
    parts = F.split(text_col, "\t")
    code = F.substring(F.get(parts, F.lit(0)), 1, 1)
    named = F.when(code.isin("M", "A", "D", "R", "C"), code).otherwise("other")
    two = code.isin("R", "C")
    return name_status.where(F.size(parts) >= 2).select(
        named.alias("status"), F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(two, F.get(parts, F.lit(1))).alias("old_path")
    )


def hunks(diff: DataFrame, text_col: str = "value", order: str = "line_no") -> DataFrame:
    """(path, start_line, end_line) of the new side of zero-context diff lines of one file or more.

    A hunk that only removes has end_line = start_line - 1. ``diff`` has a
    column ``file`` for each diff read, within which lines are ordered.
    """
    name = F.regexp_extract(text_col, r"^\+\+\+ (?:b/)?(.*)$", 1)
    header = F.regexp_extract(text_col, r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 1)
    length = F.regexp_extract(text_col, r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", 2)
    placed = diff.withColumn("path", F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(Window.partitionBy("file").orderBy(order)))
    start = header.cast("int")
    return placed.where(F.col(text_col).startswith("@@ ")).select("path", start.alias("start_line"), (start + F.coalesce(F.nullif(length, F.lit("")).cast("int"), F.lit(1)) - 1).alias("end_line"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Events of a metrics log, a JSON object per line; broken lines are left out."""
    raw = spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("command", F.coalesce("command", "tool_name")).where("command IS NOT NULL AND duration_ms IS NOT NULL")
