"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.runtime import Stage, digest

REASONS = ("missing", "late", "deleted")


def lifetimes(parents: DataFrame, key: str, since: str, until: str | None) -> DataFrame:
    """(k, since, until, i.e. half-open lifetimes) of every parent row."""
    end = F.col(until) if until else F.lit(None)
    return parents.where(F.col(key).isNotNull()).select(
        digest(F.col(key)).alias("k"), F.col(since).alias("since"), end.cast("timestamp_ntz").alias("until")
    )


#: Suspect keys up to which all are broadcast; one in HOT rows makes a key hot, so that there are fewer than HOT such keys.
FEW, HOT = 200_000, 20_000


def orphans(refs: DataFrame, lives: DataFrame, distinct: bool = True) -> DataFrame:
    """References whose parent is not live at the moment of the reference.

    ``refs``: referrer, record_key, ref_column, fk, at. ``lives``: what
    ``lifetimes`` gives, of all parent tables together. Adds ``reason``; rows
    that are repeated come out once unless ``distinct`` is false. A null fk
    refers to nothing. A null since means never started; a reference without a
    time is only ever 'missing'.

    The distinct keys, with the span of time over which each is used and how
    often, are anti-joined against the parents; keys whose parent has one
    lifetime over that whole span are settled too. Only rows of the remaining
    keys are joined back: by broadcast where these are counted few. Where they
    are many, no row of a hot key is shuffled: hot keys are few by definition,
    suspect ones are joined and innocent ones left out by broadcast.
    """
    used = refs.where(F.col("fk").isNotNull()).select(
        "referrer", "record_key", "ref_column", digest("fk").alias("k"), "at"
    )
    stage = Stage(refs.sparkSession, "references")
    counted = Observation()
    spans = used.groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("uses"))
    spans = stage.put(spans.observe(counted, F.sum("uses").alias("n")), "spans")
    known = lives.groupBy("k").agg(
        F.collect_set(F.when(F.col("since").isNotNull(), F.struct("since", "until"))).alias("lives"), F.min("since").alias("born")
    )
    whole = F.exists("lives", lambda x: (x["since"] <= F.col("lo")) & (x["until"].isNull() | (x["until"] > F.col("hi"))))
    missing = spans.join(known.select("k"), "k", "left_anti").select("k", "uses", F.lit(None).alias("lives"), F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(True).alias("absent"))
    doubtful = spans.join(known, "k").where(F.col("lo").isNotNull() & ~whole).select("k", "uses", "lives", "born", F.lit(False).alias("absent"))
    found = Observation()
    suspects = stage.put(doubtful.unionByName(missing).observe(found, F.count(F.lit(1)).alias("n")), "suspects")
    live = F.exists("lives", lambda x: (x["since"] <= F.col("at")) & (x["until"].isNull() | (x["until"] > F.col("at"))))
    reason = (
        F.when(F.col("absent"), "missing")
        .when(F.col("at").isNull(), None)
        .when(F.col("born").isNull() | (F.col("born") > F.col("at")), "late")
        .when(~live, "deleted")
    )
    if found.get["n"] <= FEW:
        met = used.join(F.broadcast(suspects), "k")
    else:
        often = F.col("uses") * HOT > F.lit(counted.get["n"] or 0)
        hot = F.broadcast(spans.where(often).select("k"))
        met = used.join(F.broadcast(suspects.where(often)), "k").unionByName(used.join(hot, "k", "left_anti").join(suspects.where(~often), "k"))
    out = met.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("referrer", "record_key", "ref_column", "reason", "at")
    return out.distinct() if distinct else out


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referrer, column, reason and month."""
    return found.groupBy("referrer", "ref_column", "reason", F.date_format("at", "yyyy-MM").alias("ref_month")).agg(
        F.count(F.lit(1)).alias("n_refs")
    )
