"""Coverage reports of five shapes as covered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = ["path", "line", "context", "report"]


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """(test, covered) of ``{tests: [{test, covers: [...]}]}``."""
    raw = spark.read.schema("tests array<struct<test string, test_id string, symbol string, covers array<string>>>").option("multiLine", True).json(path)
    tests = raw.select(F.explode("tests").alias("t"))
    return tests.select(F.coalesce("t.test", "t.test_id", "t.symbol").alias("test"), F.explode("t.covers").alias("covered")).where("test IS NOT NULL AND covered IS NOT NULL").distinct()


def test_context(context: Column) -> Column:
    """``path::Class::test`` of a context, its phase and parameters taken off; null for others."""
    node = F.regexp_extract(context, r"^([^|\[]+::[^|\[]+)(?:\[.*\])?(?:\|[a-z]+)?$", 1)
    return F.nullif(node, F.lit(""))


def read_python(spark: SparkSession, path: str) -> DataFrame:
    """Covered lines of a line report with contexts: ``{files: {path: {executed_lines, contexts: {line: [..]}}}}``."""
    raw = spark.read.schema("files map<string, struct<executed_lines array<int>, contexts map<string, array<string>>>>").option("multiLine", True).json(path)
    files = raw.select(F.explode("files").alias("path", "f"))
    with_context = files.select("path", F.explode("f.contexts").alias("line", "cs")).select("path", F.col("line").cast("int").alias("line"), F.explode("cs").alias("c"))
    bare = files.select("path", F.explode("f.executed_lines").alias("line"), F.lit(None).cast("string").alias("context"))
    named = with_context.select("path", "line", test_context(F.col("c")).alias("context")).where("context IS NOT NULL")
    return bare.unionByName(named).withColumn("report", F.lit("python")).distinct()


_LOC = "struct<start struct<line int>, `end` struct<line int>>"


def _spans(loc: Column) -> Column:
    start, end = loc["start"]["line"], loc["end"]["line"]
    return F.when((start > 0) & (end >= start), F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def read_istanbul(spark: SparkSession, path: str) -> DataFrame:
    """Lines of statements and functions that ran, of ``{path: {statementMap, s, fnMap, f}}``."""
    item = f"struct<path string, statementMap map<string, {_LOC}>, s map<string, bigint>, fnMap map<string, struct<loc {_LOC}>>, f map<string, bigint>>"
    text = spark.read.option("wholetext", True).text(path)
    items = text.select(F.explode(F.from_json("value", f"map<string, {item}>")).alias("key", "i"))
    where = F.coalesce("i.path", "key").alias("path")
    ran = items.select(where, "i.s", F.explode("i.statementMap").alias("n", "loc")).where("s[n] > 0").select("path", F.explode(_spans(F.col("loc"))).alias("line"))
    called = items.select(where, "i.f", F.explode("i.fnMap").alias("n", "fn")).where("f[n] > 0").select("path", F.explode(_spans(F.col("fn.loc"))).alias("line"))
    return ran.unionByName(called).distinct().select("path", "line", F.lit(None).cast("string").alias("context"), F.lit("istanbul").alias("report"))


def read_browser(spark: SparkSession, path: str) -> DataFrame:
    """Lines that byte ranges of ``[{url, text, ranges: [{start, end}]}]`` touch."""
    raw = spark.read.schema("url string, text string, ranges array<struct<start int, `end` int>>").option("multiLine", True).json(path)
    pages = raw.where("url RLIKE '(?i)^https?://' AND text IS NOT NULL").withColumn("path", F.regexp_replace(F.try_url_decode(F.try_parse_url("url", F.lit("PATH"))), "^/+", ""))
    lines = pages.select("path", "ranges", F.posexplode(F.split("text", "\n")).alias("pos", "row"), "text")
    before = F.length(F.array_join(F.slice(F.split("text", "\n"), 1, F.col("pos")), "\n")) + F.when(F.col("pos") > 0, 1).otherwise(0)
    placed = lines.select("path", (F.col("pos") + 1).alias("line"), before.alias("lo"), (before + F.length("row") + 1).alias("hi"), "ranges")
    hit = F.exists("ranges", lambda r: (r["end"] > r["start"]) & (r["start"] < F.col("hi")) & (r["end"] > F.col("lo")))
    return placed.where(hit).select("path", "line", F.lit(None).cast("string").alias("context"), F.lit("browser").alias("report")).distinct()


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Lines with hits of an XML report."""
    schema = "_filename string, lines struct<line array<struct<_number int, _hits bigint>>>"
    raw = spark.read.schema(schema).option("rowTag", "class").format("xml").load(path)
    lines = raw.select(F.col("_filename").alias("path"), F.explode("lines.line").alias("l")).where("l._hits > 0")
    return lines.select("path", F.col("l._number").alias("line"), F.lit(None).cast("string").alias("context"), F.lit("cobertura").alias("report")).distinct()


def match_paths(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with the known file their path names or ends in; null if none or several do."""
    known = files.select(F.col("path").alias("file")).distinct()
    tails = known.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), i, 1000), "/"))).alias("tail"))
    asked = lines.select("path").distinct()
    spread = asked.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), i, 1000), "/"))).alias("tail"))
    # Whole file names as tails of the reported path, or the other way round.
    found = spread.join(known.select("file", F.col("file").alias("tail")), "tail").unionByName(asked.select("path", F.col("path").alias("tail")).join(tails, "tail").select("tail", "path", "file"))
    best = found.select("path", "file").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n = 1").drop("n")
    return lines.join(best, "path", "left")
