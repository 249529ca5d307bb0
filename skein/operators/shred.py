"""Columnar shredding of nested JSON and its way back to flat tables.

A record is split into columns, one per leaf path, each a sequence of
(repetition level, definition level, value). A path is a tuple of steps: a
member name, or ``LIST`` for any element of an array. The repetition level of
an entry is the number of the array, counted along the path, at which it
repeats (0: a new record); the definition level is how many steps of the path
are present. Each array also has a marker column, whose entries carry the JSON
kind of the element, so that arrays of mixed kinds keep their shape. Positions
and parents of a repeated ancestor are rebuilt from its marker column alone,
for a whole batch of records at once.

Records with paths another record lacks need no agreement on a schema: a
column a record does not have at all is one missing entry, and is left out.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST = None
MISSING, NULL, SCALAR, ARRAY, OBJECT = range(5)
_ABSENT = object()


sys.set_int_max_str_digits(0)  # JSON sets no bound to a number's digits
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


def _parse_deep(text: str):
    """The value of a JSON text of any depth, with a stack of its own."""
    at, held, key = _SPACE.match(text).end(), [], None  # held: (container, member name it goes to)
    top: list = []
    into, closing = top, ""
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            value: object = {} if c == "{" else []
            after = _SPACE.match(text, at + 1).end()
            if text[after : after + 1] == ("}" if c == "{" else "]"):
                at = after + 1
            else:
                held.append((into, key, closing))
                into, closing, key, at = value, "}" if c == "{" else "]", None, after
                if c == "{":
                    key, at = _member_name(text, at)
                continue
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        else:
            m = _ATOM.match(text, at)
            if not m or not m[0]:
                raise ValueError(f"no JSON at {at}")
            value, at = json.loads(m[0]), m.end()
        while True:  # the value is whole: put it away, and every container that ends with it
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            at = _SPACE.match(text, at).end()
            if into is top:
                if at != len(text):
                    raise ValueError(f"more than one value, at {at}")
                return value
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = _SPACE.match(text, at).end()
                if closing == "}":
                    key, at = _member_name(text, at)
                break
            if c != closing:
                raise ValueError(f"neither , nor {closing} at {at - 1}")
            value = into
            into, key, closing = held.pop()


def _member_name(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no member name at {at}")
    name, at = json.decoder.scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no : at {at}")
    return name, _SPACE.match(text, at + 1).end()


def parse_json(text: str | None):
    """The value of a JSON text, or ``_ABSENT`` where it is none.

    NaN and Infinity are not JSON. A member named twice has its last value.
    Neither depth nor the length of numbers is bounded.
    """
    if text is None:
        return _ABSENT
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        pass
    except ValueError:
        return _ABSENT
    try:
        return _parse_deep(text)
    except ValueError:
        return _ABSENT


def _kind(value) -> int:
    if value is _ABSENT:
        return MISSING
    if value is None:
        return NULL
    if isinstance(value, dict):
        return OBJECT
    return ARRAY if isinstance(value, list) else SCALAR


class _Node:
    __slots__ = ("path", "kids", "scalar")

    def __init__(self, path: tuple):
        self.path, self.kids, self.scalar = path, {}, False


def _outline(name: str, value) -> _Node:
    """The tree of paths that a value has."""
    top = _Node((name,))
    todo = [(top, value)]
    while todo:
        node, value = todo.pop()
        if isinstance(value, dict):
            steps = value.items()
        elif isinstance(value, list):
            steps = ((LIST, x) for x in value)
        else:
            node.scalar = True
            continue
        for step, inner in steps:
            kid = node.kids.get(step)
            if kid is None:
                kid = node.kids[step] = _Node((*node.path, step))
            todo.append((kid, inner))
    return top


def shred(name: str, value, leaves: bool = True) -> dict[tuple, tuple[list, list, list]]:
    """The columns of a value: path -> (repetition, definition, entries).

    Entries of a marker column (a path that ends in ``LIST``) are kinds, those
    of a leaf column JSON texts or None. With ``leaves`` false only marker
    columns are made. Walks with its own stack, so depth is no limit.
    """
    columns: dict[tuple, tuple[list, list, list]] = {}
    todo = [(_outline(name, value), value, 0, 1, 0)]
    while todo:
        node, value, rep, dfn, depth = todo.pop()
        kind = _kind(value)
        path = node.path
        if path[-1] is LIST:
            column = columns.get(path)
            if column is None:
                column = columns[path] = ([], [], [])
            column[0].append(rep)
            column[1].append(dfn)
            column[2].append(kind)
        if leaves and node.scalar:
            column = columns.setdefault((*path, ""), ([], [], []))
            column[0].append(rep)
            column[1].append(dfn)
            column[2].append(json.dumps(value) if kind in (NULL, SCALAR) else None)
        later = []
        for step, kid in node.kids.items():
            if step is LIST:
                if kind == ARRAY and value:
                    later.append((kid, value[0], rep, dfn + 1, depth + 1))
                    later.extend((kid, x, depth + 1, dfn + 1, depth + 1) for x in value[1:])
                else:
                    later.append((kid, _ABSENT, rep, dfn, depth + 1))
            elif kind == OBJECT and step in value:
                later.append((kid, value[step], rep, dfn + 1, depth))
            else:
                later.append((kid, _ABSENT, rep, dfn, depth))
        todo.extend(reversed(later))
    return columns


def positions(reps: np.ndarray, defs: np.ndarray, depth: int) -> np.ndarray:
    """Array positions of a column's entries, an [entries, depth] matrix.

    Entry by entry, position d grows where the repetition level is d and
    restarts where it is less; records follow each other, each starting at
    level 0.
    """
    out = np.empty((len(reps), depth), dtype=np.int64)
    index = np.arange(len(reps))
    for d in range(1, depth + 1):
        grown = np.cumsum(reps == d)
        start = np.maximum.accumulate(np.where(reps < d, index, 0))
        out[:, d - 1] = grown - grown[start]
    return out


def _member(step: str) -> str:
    return f".{step}"


def spell(path: tuple, row: np.ndarray, until: int) -> str:
    """``result[0].to.tags[2]``: the path with positions, up to a step."""
    text, d = path[0], 0
    for step in path[1:until]:
        if step is LIST:
            text += f"[{row[d]}]"
            d += 1
        else:
            text += _member(step)
    return text


def enclosing(path: tuple) -> int:
    """Length of the path of the nearest object that is itself an element.

    An element followed by a member name is an object. 1, the root's own
    length, if there is none.
    """
    for i in range(len(path) - 2, 0, -1):
        if path[i] is LIST and path[i + 1] is not LIST:
            return i + 1
    return 1


def _flat_objects(batch: pd.DataFrame, roots: tuple[str, ...]) -> pd.DataFrame:
    gathered: dict[tuple, list] = {}
    for record_id, text in zip(batch["record_id"], batch["text"]):
        record = parse_json(text)
        if not isinstance(record, dict):
            continue
        for root in roots:
            value = record.get(root)
            if isinstance(value, str):
                value = parse_json(value)
            if not isinstance(value, (dict, list)):
                continue
            for path, column in shred(root, value, leaves=False).items():
                parts = gathered.setdefault(path, [[], [], [], []])
                parts[0].extend([record_id] * len(column[0]))
                for part, levels in zip(parts[1:], column):
                    part.extend(levels)
    ids: list = []
    objects: list[str] = []
    parents: list[str] = []
    for path, (record, reps, defs, kinds) in gathered.items():
        depth = sum(s is LIST for s in path)
        reps, defs, kinds = (np.asarray(x) for x in (reps, defs, kinds))
        rows = positions(reps, defs, depth)
        up = enclosing(path)
        for i in np.flatnonzero((kinds == OBJECT) & (defs == len(path))):
            row = rows[i]
            ids.append(record[i])
            objects.append(spell(path, row, len(path)))
            parents.append(spell(path, row, up))
    return pd.DataFrame({"record_id": pd.array(ids, dtype="Int64"), "obj_path": objects, "parent_path": parents})


_FLAT = "record_id bigint, obj_path string, parent_path string"


def json_objects(df: DataFrame, id_col: str, json_col: str, roots: tuple[str, ...]) -> DataFrame:
    """Every JSON object that is a direct element of an array below ``roots``.

    One row (record_id, obj_path, parent_path) per object and record; repeated
    records count once. A root that is a string is read as the JSON in it.
    Records that are null, no JSON or no object give no rows, as do null ids'
    objects their own null record_id. Null elements hold a position. A skewed
    session or a huge record is no group: each record is shredded by itself.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _flat_objects(batch, roots)

    return rows.where(F.col("text").isNotNull()).mapInPandas(run, _FLAT).distinct()


def _list_levels(list_col: str, leaf: str | None = None) -> list:
    """The level columns reps, defs and entries of a column ARRAY<STRUCT>, or of one of its members.

    Repetition 0 opens a record, 1 goes on in its array. Definition 0: the
    array is absent, 1: it is empty, 2: the element is null, 3: it is an
    object, 4: its member is not null.
    """
    column = F.col(list_col)
    full = F.coalesce(F.size(column), F.lit(0)) > 0
    reps = F.when(full, F.transform(column, lambda x, i: F.when(i == 0, 0).otherwise(1).cast("tinyint"))).otherwise(F.array(F.lit(0).cast("tinyint")))
    there = (lambda x: F.when(x[leaf].isNotNull(), 4).otherwise(3)) if leaf else (lambda x: F.lit(3))
    defs = F.when(full, F.transform(column, lambda x: F.when(x.isNull(), 2).otherwise(there(x)).cast("tinyint"))).otherwise(
        F.array(F.when(column.isNull(), 0).otherwise(1).cast("tinyint"))
    )
    entries = F.when(full, F.transform(column, lambda x: x[leaf].cast("string"))).otherwise(F.array(F.lit(None).cast("string"))) if leaf else F.lit(None).cast("array<string>")
    return [reps.alias("reps"), defs.alias("defs"), entries.alias("entries")]


def _rebuild_lists(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(record_id, pos, value) of the entries at least ``least`` levels deep, from their levels."""
    for batch in batches:
        lists = batch.column("reps")
        of = pc.list_parent_indices(lists).to_numpy()
        reps, defs = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("reps", "defs"))
        kept = np.flatnonzero(defs >= least)
        values = pc.list_flatten(batch.column("entries"))
        values = values.take(pa.array(kept)) if len(values) else pa.nulls(len(kept), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("record_id").take(pa.array(of[kept])), pa.array(positions(reps, defs, 1)[kept, 0].astype(np.int32)), values], ["record_id", "pos", "value"]
        )


def list_values(df: DataFrame, id_col: str, list_col: str, leaf: str | None = None) -> DataFrame:
    """(record_id, pos, value) of every object of a column ARRAY<STRUCT>, or of every non-null member ``leaf``.

    Each row's level sequence is made in the JVM; positions are rebuilt from
    the sequences of a whole batch in numpy. Repeated rows count once, null
    elements hold a position.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), *_list_levels(list_col, leaf))
    least = 4 if leaf else 3
    return rows.mapInArrow(lambda batches: _rebuild_lists(batches, least), "record_id bigint, pos int, value string").distinct()


def _at(list_col: str):
    return F.concat(F.lit(f"{list_col}["), F.col("pos").cast("string"), F.lit("]"))


def list_objects(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """As ``json_objects``, for a column ARRAY<STRUCT>, by the levels of its marker column."""
    return list_values(df, id_col, list_col).select("record_id", _at(list_col).alias("obj_path"), F.lit(list_col).alias("parent_path"))


def list_leaves(df: DataFrame, id_col: str, list_col: str, leaves: list[str]) -> DataFrame:
    """As ``rebuild_leaves``, for members of a column ARRAY<STRUCT>."""
    parts = [
        list_values(df, id_col, list_col, leaf).select("record_id", _at(list_col).alias("obj_path"), F.lit(leaf).alias("field"), "value") for leaf in leaves
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_COLUMN = "record_id bigint, steps array<string>, leaf boolean, reps array<int>, defs array<int>, entries array<string>"


def shredded_columns(df: DataFrame, id_col: str, json_col: str, roots: tuple[str, ...]) -> DataFrame:
    """The level sequences themselves: one row per record and leaf path.

    (record_id, steps, leaf, reps, defs, entries). ``steps`` is the path, null
    for any element of an array; marker columns are no leaves, their entries
    are kinds. Entries of leaf columns are JSON texts, null where nothing
    stands. Repeated records count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, text in zip(batch["record_id"], batch["text"]):
                record = parse_json(text)
                if not isinstance(record, dict):
                    continue
                for root in roots:
                    value = record.get(root)
                    if isinstance(value, str) and (inner := parse_json(value)) is not _ABSENT:
                        value = inner
                    if value is None:
                        continue
                    for path, (reps, defs, entries) in shred(root, value).items():
                        leaf = path[-1] == ""
                        out.append((record_id, list(path[:-1] if leaf else path), leaf, reps, defs, entries if leaf else [str(k) for k in entries]))
            yield pd.DataFrame(out, columns=["record_id", "steps", "leaf", "reps", "defs", "entries"])

    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).alias("text"))
    return rows.where(F.col("text").isNotNull()).dropDuplicates().mapInPandas(run, _COLUMN)


def rebuild_leaves(columns: DataFrame) -> DataFrame:
    """Rows (record_id, obj_path, field, value) from stored level sequences.

    ``obj_path`` is the nearest enclosing object that is an element, or the
    root, as ``json_objects`` spells it; ``field`` leads from there to the
    scalar. A string is its text, any other scalar its JSON; a null member has
    a null value. Entries below the path's full definition level stand for
    something absent and give no row.
    """
    schema = "record_id bigint, obj_path string, field string, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, steps, _, reps, defs, entries in batch.itertuples(index=False):
                path = tuple(LIST if x is None else x for x in steps)
                up = enclosing(path)
                rows = positions(np.asarray(reps), np.asarray(defs), sum(x is LIST for x in path))
                for i, (dfn, entry) in enumerate(zip(defs, entries)):
                    if dfn == len(path) and entry is not None:
                        whole, above = spell(path, rows[i], len(path)), spell(path, rows[i], up)
                        value = json.loads(entry)
                        text = None if value is None else value if isinstance(value, str) else entry
                        out.append((record_id, above, whole[len(above) :].removeprefix("."), text))
            yield pd.DataFrame(out, columns=["record_id", "obj_path", "field", "value"])

    return columns.where("leaf").select("record_id", "steps", "leaf", "reps", "defs", "entries").mapInPandas(run, schema)
