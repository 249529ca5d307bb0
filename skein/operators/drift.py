"""Rescue-column ingestion of records whose fields drift.

Records are read into a fixed target schema. A field the schema does not know,
a value of another JSON type and an explicit null are kept in ``_rescued``, one
JSON object per record, so nothing is lost and presence stays visible. Once a
field is approved as another name of a target field, its rescued values are
replayed into the typed column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.canonical import canonical_text
from skein.operators.shred import parse_json
from skein.runtime import Stage

JSON_TYPES = {"string": "string", "bigint": "number", "double": "number", "boolean": "boolean", "array<string>": "array"}


def json_type(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def _fits(value, kind: str) -> bool:
    if kind == "string":
        return isinstance(value, str)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "bigint":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == "double":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def _frame(rows: list[tuple], keep: list[str], target: dict[str, str]) -> pd.DataFrame:
    columns = [*keep, *target, "_rescued"]
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    for name, kind in target.items():
        if kind == "bigint":
            out[name] = out[name].astype("Int64")
    return out


def _schema(df: DataFrame, keep: list[str], target: dict[str, str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` {t}" for c, t in target.items()), "_rescued string"])


def ingest(df: DataFrame, json_col: str, target: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep``, the target's columns and _rescued, a row per valid record.

    Texts that are null, no JSON or no object are left out. A kept column with
    the name of a target field must be renamed before. Floats keep the value of
    a double.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *kept, text in batch[[*keep, json_col]].itertuples(index=False, name=None):
                record = parse_json(text)
                if not isinstance(record, dict):
                    continue
                typed = [record.pop(c) if c in record and _fits(record[c], t) else None for c, t in target.items()]
                rows.append((*kept, *typed, json.dumps(record) if record else None))
            yield _frame(rows, keep, target)

    return df.select(*keep, json_col).mapInPandas(run, _schema(df, keep, target))


def _cast(value, kind: str):
    """The value as the target's type, or None where that would change it."""
    if _fits(value, kind):
        return value
    if kind == "string" and isinstance(value, (int, float)):
        return json.dumps(value)
    try:
        if kind == "bigint" and isinstance(value, (str, float)):
            number = int(value) if isinstance(value, str) else int(value) if value == int(value) else None
            return number if number is not None and _fits(number, kind) else None
        if kind == "double" and isinstance(value, str):
            return float(value)
    except (ValueError, OverflowError):
        return None
    if kind == "boolean" and value in ("true", "false"):
        return value == "true"
    return None


def promote(ingested: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The table with columns for fields approved since, empty until ``replay`` fills them from what was rescued."""
    added = {name: F.lit(None).cast(kind) for name, kind in fields.items()}
    return ingested.select(*[c for c in ingested.columns if c != "_rescued"], *[v.alias(k) for k, v in added.items()], "_rescued")


def replay(ingested: DataFrame, target: dict[str, str], keep: list[str], approved: dict[str, str]) -> DataFrame:
    """Rescued values moved into typed columns where approved and castable.

    ``approved``: other name -> target field. A target field's own rescued
    values come first, then other names in alphabetical order; what does not
    cast, finds its column filled or is an explicit null stays rescued.
    """
    sources: dict[str, list[str]] = {c: [c] for c in target}
    for other in sorted(approved):
        if approved[other] in sources:
            sources[approved[other]].append(other)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch[[*keep, *target, "_rescued"]].itertuples(index=False, name=None):
                kept, typed, rescued = values[: len(keep)], list(values[len(keep) : -1]), values[-1]
                typed = [None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x for x in typed]
                if rescued:
                    left = json.loads(rescued)
                    for i, (name, kind) in enumerate(target.items()):
                        for source in sources[name]:
                            if source not in left:
                                continue
                            if left[source] is not None and typed[i] is None and (cast := _cast(left[source], kind)) is not None:
                                typed[i] = cast
                                del left[source]
                    rescued = json.dumps(left) if left else None
                rows.append((*kept, *(int(x) if t == "bigint" and x is not None else x for x, t in zip(typed, target.values())), rescued))
            yield _frame(rows, keep, target)

    return ingested.mapInPandas(run, _schema(ingested, keep, target))


def _spell(value) -> str:
    """A rescued value as text, equal for equal JSON values, as ``profile`` spells typed ones."""
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, bool):
        return "b" + ("true" if value else "false")
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        value = int(value)
    if isinstance(value, (int, float)):
        return f"n{value}"
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return "a" + "".join(f"{len(x)}:{x}" for x in value)
    return "j" + (canonical_text(json.dumps(value)) or "")


def profile(ingested: DataFrame, target: dict[str, str], keep: list[str]) -> DataFrame:
    """(``keep``, field, json_type, value_digest) of every field of every record.

    Typed columns are spelled in the JVM, only rescued objects are taken apart
    in Python; null values have a null type and digest.
    """
    types = dict(ingested.dtypes)
    column = lambda c: F.col(f"`{c}`")
    spelled = {
        "string": lambda c: F.concat(F.lit("s"), c),
        "boolean": lambda c: F.concat(F.lit("b"), c.cast("string")),
        "bigint": lambda c: F.concat(F.lit("n"), c.cast("string")),
        "array<string>": lambda c: F.concat(F.lit("a"), F.array_join(F.transform(c, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")),
    }
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(JSON_TYPES[t]).alias("json_type"), spelled[t](column(c)).alias("value")) for c, t in target.items() if t in spelled])
    typed = ingested.select(*map(column, keep), F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select(*map(column, keep), "e.*")
    doubles = [c for c, t in target.items() if t == "double"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "field string, json_type string, value string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch[[*keep, *doubles, "_rescued"]].itertuples(index=False, name=None):
                kept = values[: len(keep)]
                members = [(c, float(v)) for c, v in zip(doubles, values[len(keep) :]) if v is not None and v == v]
                members += json.loads(values[-1]).items() if values[-1] else ()
                rows.extend((*kept, name, json_type(value), None if value is None else _spell(value)) for name, value in members)
            yield pd.DataFrame(rows, columns=[*keep, "field", "json_type", "value"], dtype=object)

    some = F.col("_rescued").isNotNull()
    for c in doubles:
        some = some | column(c).isNotNull()
    rescued = ingested.where(some).select(*map(column, [*keep, *doubles]), "_rescued").mapInPandas(run, schema)
    return typed.unionByName(rescued).withColumn("value_digest", F.unhex(F.md5("value"))).drop("value")


def field_changes(exports: DataFrame, fields: DataFrame) -> DataFrame:
    """(export_id, change_type, old_field, new_field) against the previous export.

    ``exports``: export_id, feed, exported_at, one row each or repeated.
    ``fields``: export_id, record_key, field, json_type, value_digest. Exports
    of one feed follow each other by exported_at, then export_id. A field whose
    values are all null in either export has no type to change. Every pair of a
    lost and a new field with equal values is 'renamed'. Records without a key
    take no part in that.
    """
    listed = exports.groupBy("export_id").agg(F.min("feed").alias("feed"), F.min("exported_at").alias("exported_at"))
    order = Window.partitionBy("feed").orderBy("exported_at", "export_id")
    chain = listed.select("export_id", F.lag("export_id").over(order).alias("previous")).where(F.col("previous").isNotNull())
    catalogue = fields.groupBy("export_id", "field").agg(F.array_sort(F.collect_set("json_type")).alias("types"))
    now = catalogue.join(chain, "export_id").select("export_id", "field", F.col("types").alias("new_types"))
    was = catalogue.select(F.col("export_id").alias("previous"), "field", F.col("types").alias("old_types"))
    was = was.join(chain, "previous").select("export_id", "field", "old_types")
    stage = Stage(fields.sparkSession, "changes")
    both = stage.put(now.join(was, ["export_id", "field"], "full_outer"), "both")
    retyped = both.where(
        (F.size("new_types") > 0) & (F.size("old_types") > 0) & (F.col("new_types") != F.col("old_types"))
    ).select("export_id", F.lit("type_changed").alias("change_type"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    gained = both.where("old_types IS NULL").select("export_id", "field")
    lost = both.where("new_types IS NULL").select("export_id", "field")

    # One row per export, record and field before anything is paired: a record
    # repeated with other values has no single one, and equals nothing.
    values = (
        fields.where(F.col("record_key").isNotNull() & F.col("value_digest").isNotNull())
        .groupBy("export_id", "record_key", "field")
        .agg(F.min("value_digest").alias("lo"), F.max("value_digest").alias("hi"))
    )
    new_values = values.join(gained, ["export_id", "field"], "left_semi")
    old_values = (
        values.withColumnRenamed("export_id", "previous")
        .join(chain, "previous")
        .drop("previous")
        .join(lost, ["export_id", "field"], "left_semi")
    )
    pairs = (
        new_values.withColumnRenamed("field", "new_field")
        .join(
            old_values.select("export_id", "record_key", F.col("field").alias("old_field"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi")),
            ["export_id", "record_key"],
        )
        .groupBy("export_id", "old_field", "new_field")
        .agg(F.bool_and((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("old_lo")) & (F.col("lo") == F.col("old_hi"))).alias("same"))
        .where("same")
    )
    pairs = stage.put(pairs, "pairs")
    renamed = pairs.select("export_id", F.lit("renamed").alias("change_type"), "old_field", "new_field")
    added = gained.join(pairs.select("export_id", F.col("new_field").alias("field")), ["export_id", "field"], "left_anti").select(
        "export_id", F.lit("added").alias("change_type"), F.lit("").alias("old_field"), F.col("field").alias("new_field")
    )
    removed = lost.join(pairs.select("export_id", F.col("old_field").alias("field")), ["export_id", "field"], "left_anti").select(
        "export_id", F.lit("removed").alias("change_type"), F.col("field").alias("old_field"), F.lit("").alias("new_field")
    )
    return renamed.unionByName(added).unionByName(removed).unionByName(retyped)


def other_names(changes: DataFrame, target: dict[str, str]) -> dict[str, str]:
    """Names that renames lead from a target field to, each to one field only.

    The distinct pairs of names are as few as names; a name that several target
    fields lead to is not approved.
    """
    renames = changes.where("change_type = 'renamed'").select("old_field", "new_field").distinct()
    pairs = {(r["old_field"], r["new_field"]) for r in renames.toLocalIterator()}
    leads = {c: {c} for c in target}
    grew = True
    while grew:
        grew = False
        for old, new in pairs:
            for names in leads.values():
                if old in names and new not in names and new not in target:
                    names.add(new)
                    grew = True
    owners: dict[str, list[str]] = {}
    for field, names in leads.items():
        for name in names - {field}:
            owners.setdefault(name, []).append(field)
    return {name: fields[0] for name, fields in owners.items() if len(fields) == 1}
