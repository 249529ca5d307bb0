"""Source trees as tables: files, their modules, roots and hashes."""

from __future__ import annotations

import ast
import configparser
import os
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.identity import module_name

# Folders that are never sources, and marks of generated files.
IGNORED_FOLDERS = (".git", ".hg", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "site-packages")
GENERATED_MARKS = ("@generated", "DO NOT EDIT", "Code generated by")
EMIT_MARK = "//# sourceMappingURL="


def ignored(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Paths in an ignored folder or matching one of the regular expressions."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))
    for p in patterns:
        hit = hit | path.rlike(p)
    return hit


def generated(text: Column, path: Column) -> Column:
    """Files whose head says that they were generated, and emitted scripts."""
    head = F.substring(text, 1, 4096)
    hit = F.lit(False)
    for mark in GENERATED_MARKS:
        hit = hit | head.contains(mark)
    return hit | (path.rlike(r"\.(js|mjs|cjs)$") & text.contains(EMIT_MARK))


def scan(spark: SparkSession, root: str, roots: list[str] | None = None, extensions: tuple[str, ...] = ("py",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row per source file: path, source_root, module, file_hash, line_count, file_size, is_package, is_generated, text.

    A file's root is the longest of ``roots`` (relative; '' is the folder
    itself) that leads to it. Text that is no UTF-8 has replacement characters.
    """
    base = os.path.abspath(root).rstrip("/")
    # Spark's own listing hides names that begin with an underscore, __init__.py
    # among them; so the paths are listed here and the files read in tasks.
    names = []
    for folder, folders, inside in os.walk(base):
        folders[:] = sorted(f for f in folders if f not in IGNORED_FOLDERS)
        names += [os.path.relpath(os.path.join(folder, n), base) for n in sorted(inside) if n.rsplit(".", 1)[-1] in extensions]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for name in batch["path"]:
                with open(os.path.join(base, name), "rb") as f:
                    contents.append(f.read())
            yield batch.assign(content=contents, length=[len(c) for c in contents])

    listed = spark.createDataFrame([(n,) for n in names], "path string")
    files = listed.where(~ignored(F.col("path"), exclude)).mapInPandas(read, "path string, content binary, length bigint")
    known = sorted({r.strip("/") for r in (roots if roots is not None else detect_roots(root))} | {""}, key=len, reverse=True)
    source_root = F.coalesce(*[F.when(F.lit(not r) | F.col("path").startswith(f"{r}/"), F.lit(r)) for r in known])
    text = F.decode(F.col("content"), "UTF-8")
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)
    return (
        files.withColumn("source_root", source_root)
        .withColumn("text", text)
        .select(
            "path",
            "source_root",
            module_name(F.col("path"), F.col("source_root")).alias("module"),
            F.sha2("content", 256).alias("file_hash"),
            lines.alias("line_count"),
            F.col("length").alias("file_size"),
            F.col("path").rlike(r"(^|/)__init__\.py$").alias("is_package"),
            generated(F.col("text"), F.col("path")).alias("is_generated"),
            "text",
        )
    )


def detect_roots(root: str) -> list[str]:
    """Source roots of a project, by the first rule that gives any.

    Build settings in pyproject.toml, then setup.cfg, then a src folder, then
    folders that hold packages; the project's own folder if all else fails.
    """
    found: list[str] = []
    settings = os.path.join(root, "pyproject.toml")
    if os.path.isfile(settings):
        with open(settings, "rb") as f:
            tool = tomllib.load(f).get("tool", {})
        setup = tool.get("setuptools", {})
        where = setup.get("packages", {}).get("find", {}).get("where", []) if isinstance(setup.get("packages"), dict) else []
        found += where + [v for k, v in setup.get("package-dir", {}).items() if k == ""]
        wheel = tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {})
        found += [os.path.dirname(p.rstrip("/")) for p in wheel.get("packages", [])]
    if not found and os.path.isfile(os.path.join(root, "setup.cfg")):
        parser = configparser.ConfigParser()
        parser.read(os.path.join(root, "setup.cfg"))
        where = parser.get("options.packages.find", "where", fallback="")
        found += [x.strip() for x in where.splitlines() if x.strip()]
    if not found and os.path.isdir(os.path.join(root, "src")):
        found.append("src")
    if not found:
        for name in sorted(os.listdir(root)):
            inside = os.path.join(root, name)
            if os.path.isdir(inside) and name not in IGNORED_FOLDERS and os.path.isfile(os.path.join(inside, "__init__.py")):
                found.append("")
                break
    kept = sorted({f.strip("/").replace("./", "") for f in found if os.path.isdir(os.path.join(root, f))})
    return kept or [""]


def workspace(spark: SparkSession, manifest: dict[str, str], read) -> DataFrame:
    """Several repositories' tables as one, with repo_id; fields may differ."""
    out = None
    for repo_id, place in sorted(manifest.items()):
        rows = read(spark, place).withColumn("repo_id", F.lit(repo_id))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


_FACTS = "entity string, id string, kind string, name string, qualname string, path string, start_line int, end_line int, source string, target string, confidence string"


class _Python(ast.NodeVisitor):
    """Symbols, imports and calls of one module."""

    def __init__(self, module: str, path: str):
        self.module, self.path, self.rows = module, path, []
        self.scope = [("mod", module)]
        self.known: dict[str, str] = {}

    def node(self, prefix: str, qualname: str, kind: str, item) -> None:
        self.rows.append(("node", f"{prefix}:{qualname}", kind, qualname.rsplit(".", 1)[-1], qualname, self.path, item.lineno, item.end_lineno, None, None, None))

    def edge(self, source: str, target: str, kind: str, item, confidence: str = "confirmed") -> None:
        self.rows.append(("edge", None, kind, None, None, self.path, item.lineno, item.end_lineno, source, target, confidence))

    @property
    def here(self) -> str:
        return ":".join(self.scope[-1])

    def enter(self, item, prefix: str, kind: str) -> None:
        qualname = f"{self.scope[-1][1]}.{item.name}"
        self.node(prefix, qualname, kind, item)
        self.edge(self.here, f"{prefix}:{qualname}", "defines", item)
        self.scope.append((prefix, qualname))
        self.generic_visit(item)
        self.scope.pop()

    def visit_ClassDef(self, item):  # noqa: N802
        for base in item.bases:
            if isinstance(base, ast.Name):
                self.edge(f"class:{self.scope[-1][1]}.{item.name}", self.known.get(base.id, f"class:{self.module}.{base.id}"), "extends", base, "inferred")
        self.enter(item, "class", "class")

    def visit_FunctionDef(self, item):  # noqa: N802
        method = self.scope[-1][0] == "class"
        self.enter(item, "method" if method else "fn", "method" if method else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, item):  # noqa: N802
        for alias in item.names:
            self.known[alias.asname or alias.name.split(".")[0]] = f"mod:{alias.name}"
            self.edge(self.here, f"mod:{alias.name}", "imports", item)

    def visit_ImportFrom(self, item):  # noqa: N802
        base = self.module.split(".")
        prefix = ".".join(base[: len(base) - item.level]) if item.level else ""
        target = ".".join(x for x in (prefix, item.module or "") if x)
        if target:
            self.edge(self.here, f"mod:{target}", "imports", item)
            for alias in item.names:
                self.known[alias.asname or alias.name] = f"fn:{target}.{alias.name}"

    def visit_Call(self, item):  # noqa: N802
        if isinstance(item.func, ast.Name):
            name = item.func.id
            self.edge(self.here, self.known.get(name, f"fn:{self.module}.{name}"), "calls", item, "inferred" if name in self.known else "heuristic")
        elif isinstance(item.func, ast.Attribute):
            value = item.func.value
            if isinstance(value, ast.Name) and value.id in self.known:
                self.edge(self.here, f"fn:{self.known[value.id].split(':', 1)[1]}.{item.func.attr}", "calls", item, "inferred")
            elif isinstance(value, ast.Name) and value.id == "self" and len(self.scope) > 1:
                owner = self.scope[-1][1].rsplit(".", 1)[0]
                self.edge(self.here, f"method:{owner}.{item.func.attr}", "calls", item, "inferred")
            else:
                self.edge(self.here, f"attr:{item.func.attr}", "dynamic_call", item, "unresolved")
        self.generic_visit(item)


def python_facts(files: DataFrame) -> DataFrame:
    """Nodes and edges of Python files (columns path, module, text).

    A file that does not parse gives one node of kind 'parse_error'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, module, text in zip(batch["path"], batch["module"], batch["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows.append(("node", f"mod:{module}", "parse_error", module, module, path, None, None, None, None, None))
                    continue
                visitor = _Python(module, path)
                last = len((text or "").splitlines())
                visitor.rows.append(("node", f"mod:{module}", "module", module.rsplit(".", 1)[-1], module, path, 1, max(1, last), None, None, None))
                visitor.visit(tree)
                rows += visitor.rows
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FACTS.split(", ")], dtype=object)
            out[["start_line", "end_line"]] = out[["start_line", "end_line"]].astype("Int32")
            yield out

    return files.select("path", "module", "text").mapInPandas(run, _FACTS)


def packages(files: DataFrame) -> DataFrame:
    """contains edges: each package under its parent package or source root, modules under their package."""
    module = F.col("module")
    parent = F.when(module.contains("."), F.concat(F.lit("package:"), F.regexp_replace(module, r"\.[^.]*$", ""))).otherwise(F.concat(F.lit("source_root:"), F.col("source_root")))
    child = F.when(F.col("is_package"), F.concat(F.lit("package:"), module)).otherwise(F.concat(F.lit("mod:"), module))
    return files.where(module != "").select(parent.alias("source"), child.alias("target"), F.lit("contains").alias("kind")).distinct()
