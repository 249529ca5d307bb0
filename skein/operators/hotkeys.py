"""Per-key results where a few keys hold most rows.

The distinct keys form one dictionary, cut into blocks by hash, in which every
key has a dense code. Rows are cut into equal splits, each of one block: a
block of few rows is one split, a block with a hot key as many as its rows
take. A split encodes its rows against the block's dictionary and scatters them
into a dense array as long as the block; arrays of a block are summed in a tree
and decoded at the end. A key that holds a third of all rows is one cell in the
arrays of many equal splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Slices of the hash space that blocks are put together from; their sizes are all the driver learns.
SLICES = 1 << 14
#: Arrays that one task sums.
FAN_IN = 64


def layout(sizes: dict[int, int], split_rows: int) -> list[tuple[int, int, int]]:
    """(slice, block, splits): neighbouring slices in blocks of about ``split_rows``, a larger slice alone in several splits."""
    out, block, held = [], 0, 0
    for piece in sorted(sizes):
        n = sizes[piece]
        if held and held + n > split_rows:
            block, held = block + 1, 0
        out.append((piece, block, max(1, -(-n // split_rows))))
        held += n
    return out


def _pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.empty(len(h1), dtype=[("a", np.int64), ("b", np.int64)])
    out["a"], out["b"] = h1, h2
    return out


def scatter(entries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """Distinct ids of each dictionary entry, in the entries' sorted order."""
    words = np.sort(_pairs(*entries))
    # The first hash finds the code; among equal first hashes the second decides.
    codes = np.searchsorted(words["a"], rows[0])
    off = words["b"][codes] != rows[1]
    if off.any():
        codes[off] = np.searchsorted(words, _pairs(rows[0][off], rows[1][off]))
    order = np.lexsort([*ids, codes])
    new = np.ones(len(order), dtype=bool)
    same = codes[order][1:] == codes[order][:-1]
    for i in ids:
        same &= i[order][1:] == i[order][:-1]
    new[1:] = ~same
    return np.bincount(codes[order][new], minlength=len(words))


def dense_key_counts(df: DataFrame, keys: list[str], id_col: str, split_rows: int | None = None) -> DataFrame:
    """Distinct ids of each key: columns ``keys`` and n_ids.

    A null is a key value like any other; rows with a null id count nothing,
    though their key comes out, with 0 if it has no other. Repeated rows count
    once. An empty table gives no rows. ``split_rows``: rows of a split, which
    bounds what a task holds; unless given, the table makes some thousand
    splits of 50,000 to two million rows. Keys, and ids that are no integers, travel as 128
    bits of hash.
    """
    spark = df.sparkSession
    flagged = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    named = [f"__k{i}" for i in range(len(keys))]
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    ids = [F.col(id_col).cast("bigint").alias("i0")] if whole else [F.xxhash64(id_col).alias("i0"), F.xxhash64(F.lit("second"), id_col).alias("i1")]
    on = ["i0"] if whole else ["i0", "i1"]
    keyed = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, named)],
        F.col(id_col).isNotNull().alias("counts"),
        *ids,
        F.xxhash64(*flagged).alias("h1"),
        F.xxhash64(F.lit("second"), *flagged).alias("h2"),
    ).withColumn("slice", F.pmod("h1", F.lit(SLICES)).cast("int"))
    # As many rows as there are slices, whatever the table holds.
    sizes = {r["slice"]: r["n"] for r in keyed.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan = layout(sizes, split_rows or min(max(sum(sizes.values()) // 4096, 50_000), 2_000_000))
    most = max((s for _, _, s in plan), default=1)
    n_splits = sum({b: s for _, b, s in plan}.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_splits)  # few splits share a task by chance
    blocks = F.broadcast(spark.createDataFrame(plan, "slice int, block int, splits int"))  # at most SLICES rows

    dictionary = keyed.select(*named, "h1", "h2", "slice").distinct().join(blocks, "slice")
    fresh = lambda *cols: [F.col(c).alias(c) for c in cols]  # noqa: E731 - columns told apart from the rows' own
    words = dictionary.select(*fresh("block", "h1", "h2"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    rows = keyed.where("counts").select("slice", *on, "h1", "h2").join(blocks, "slice")
    rows = rows.select("block", F.pmod(F.xxhash64(*on), F.col("splits")).cast("int").alias("split"), *on, "h1", "h2")

    def count(entries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"block": [], "split": [], "dense": []})
        dense = scatter(*((d["h1"].to_numpy(), d["h2"].to_numpy()) for d in (entries, part)), [part[c].to_numpy() for c in on])
        return pd.DataFrame({"block": [part["block"].iloc[0]], "split": [part["split"].iloc[0]], "dense": [dense]})

    def total(arrays: pd.DataFrame) -> np.ndarray:
        held = arrays["dense"].iloc[0].astype(np.int64)
        for more in arrays["dense"].iloc[1:]:
            held = held + more
        return held

    def reduce(arrays: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [arrays["block"].iloc[0]], "split": [arrays["split"].iloc[0] // FAN_IN], "dense": [total(arrays)]})

    shape = "block int, split int, dense array<bigint>"
    by = ["block", "split"]
    arrays = words.repartition(tasks, *by).groupBy(*by).cogroup(rows.repartition(tasks, *by).groupBy(*by)).applyInPandas(count, shape)
    while most > FAN_IN:
        arrays = arrays.groupBy("block", F.floor(F.col("split") / FAN_IN)).applyInPandas(reduce, shape)
        most = -(-most // FAN_IN)

    def decode(entries: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return pd.DataFrame({**{k: [] for k in named}, "n_ids": []})
        entries = entries.iloc[np.argsort(_pairs(entries["h1"].to_numpy(), entries["h2"].to_numpy()))]
        return entries[named].assign(n_ids=total(arrays) if len(arrays) else np.zeros(len(entries), dtype=np.int64))

    types = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in named), "n_ids bigint"])
    counted = dictionary.select("block", *named, "h1", "h2").groupBy("block").cogroup(arrays.groupBy("block")).applyInPandas(decode, schema)
    return counted.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "n_ids")


def heavy_keys(df: DataFrame, keys: list[str], id_col: str, one_in: int = 100) -> DataFrame:
    """Keys, none of them null in the first column, with at least one in ``one_in`` of all distinct ids."""
    total = df.agg(F.countDistinct(id_col).alias("__total"))  # one row
    counted = dense_key_counts(df, keys, id_col).join(F.broadcast(total))
    return counted.where(F.col(keys[0]).isNotNull() & (F.col("n_ids") > 0) & (F.col("n_ids") * one_in >= F.col("__total"))).drop("__total")
