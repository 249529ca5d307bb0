"""Only new or changed records per run, with the target itself as state.

The output rows are the state: each keeps its source key and the version taken
in. A run anti-joins its records against the rows of the same keys, writes what
is left as a part of its own, and publishes it by one atomic rename of a
manifest. Until then nothing has happened, and a run that is published does
nothing when it is started again. What a run writes follows what is new, never
the size of the target; what it reads of the target are keys and versions.

Layout below ``root``: ``parts/`` holds Parquet, ``manifests/00000007.json``
names the parts that version 7 consists of.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import Fs, digest

_PART = "record_type string, record_key string, k binary, version string, at timestamp_ntz, changed boolean, run_no bigint"
_COLUMNS = [x.split()[0] for x in _PART.split(", ")]
#: Records of a run up to which their keys are sent to every executor.
BROADCAST_ROWS = 100_000


class RunConflict(RuntimeError):
    """Another writer published this version first."""


class IncrementalTarget:
    """Published target versions below a folder.

    Records have record_type, record_key, version and at; ``at`` orders the
    versions of one key, whenever they arrive. A later version that equals the
    one held is taken in unchanged, as it moves ``at``. Of one key's records in
    a run the greatest (at, version) counts, a null ``at`` first. Null keys are
    left out. Records that a run before has seen may be given again.

    After ``compact_after`` parts they are written together, sorted by key, in
    ``files`` files; what no manifest of the last two versions names is removed
    once it is ``keep_s`` seconds old, so that no other writer's work is.
    """

    def __init__(self, spark: SparkSession, root: str, files: int | None = None, compact_after: int = 64, keep_s: int = 86_400):
        self.spark, self.root, self.compact_after, self.keep_s = spark, root.rstrip("/"), compact_after, keep_s
        self.files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fs = Fs(spark, self.root)
        self.fs.mkdirs(f"{self.root}/manifests")

    def _versions(self) -> list[str]:
        return [n for n in self.fs.names(f"{self.root}/manifests") if n.endswith(".json") and not n.startswith("_")]

    def manifest(self, back: int = 0) -> dict | None:
        names = self._versions()
        return json.loads(self.fs.read_text(f"{self.root}/manifests/{names[-1 - back]}")) if len(names) > back else None

    def _publish(self, version: int, runs: list, parts: list[str]) -> None:
        text = json.dumps({"version": version, "runs": runs, "parts": parts})
        if not self.fs.publish_text(f"{self.root}/manifests/{version:08d}.json", text):
            raise RunConflict(f"version {version} exists")

    def process(self, run_no: int, records: DataFrame, n_rows: int | None = None, fail_before_publish: bool = False) -> bool:
        """Take in one run's records; False if the run was published before.

        ``n_rows``: how many there are, each key once, where the caller knows;
        few keys are then looked up by broadcast. ``fail_before_publish`` stands
        for a crash between writing and publishing, for tests: what was written
        is never seen.
        """
        held = self.manifest()
        if held and run_no in held["runs"]:
            return False
        version = held["version"] + 1 if held else 1
        named = records.where(F.col("record_key").isNotNull())
        if n_rows is None:
            named = named.groupBy("record_type", "record_key").agg(F.max(F.struct("at", "version")).alias("v")).select("record_type", "record_key", "v.*")
        newest = named.select("record_type", "record_key", digest(F.concat_ws(":", "record_type", "record_key")).alias("k"), "version", "at")
        fresh = newest.withColumn("changed", F.lit(True))
        if held and held["parts"]:
            few = (lambda df: F.broadcast(df)) if n_rows is not None and n_rows <= BROADCAST_ROWS else (lambda df: df)
            rows = self._read(held["parts"]).select("k", "at", "version")
            known = rows.join(few(newest.select("k")), "k", "left_semi").groupBy("k").agg(F.max(F.struct("at", "version")).alias("had"))
            known = few(known.select(F.col("k").alias("kk"), "had"))
            # New is what no row of the target with its key equals or follows.
            same = F.col("k") == F.col("kk")
            unseen = newest.join(known, same & (F.struct("at", "version") <= F.col("had")), "left_anti")
            fresh = unseen.join(known, same, "left").withColumn("changed", F.col("kk").isNull() | ~F.col("version").eqNullSafe(F.col("had.version")))
        part = f"{self.root}/parts/{version:08d}-{uuid.uuid4().hex[:8]}"
        fresh.withColumn("run_no", F.lit(run_no).cast("bigint")).select(*_COLUMNS).write.parquet(part)
        if fail_before_publish:
            raise RuntimeError("stopped before publishing")
        parts = [*(held["parts"] if held else []), part]
        self._publish(version, [*(held["runs"] if held else []), run_no], parts)
        if len(parts) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """The same rows in fewer files, as a version of their own; then ``vacuum``."""
        held = self.manifest()
        if not held or len(held["parts"]) < 2:
            return
        version = held["version"] + 1
        part = f"{self.root}/parts/{version:08d}-{uuid.uuid4().hex[:8]}"
        self._read(held["parts"]).repartition(self.files, "k").sortWithinPartitions("k").write.parquet(part)
        self._publish(version, held["runs"], [part])
        self.vacuum()

    def vacuum(self) -> None:
        """Remove parts of runs that failed or were beaten, and of versions before the last two."""
        named = {p.rpartition("/")[2] for back in (0, 1) for p in (self.manifest(back) or {"parts": []})["parts"]}
        before = time.time() - self.keep_s
        for name, at in self.fs.ages(f"{self.root}/parts"):
            if name not in named and at < before:
                self.fs.delete(f"{self.root}/parts/{name}")

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(_PART).parquet(*parts)

    def rows(self) -> DataFrame:
        """All rows of the current target version, whatever run made them."""
        held = self.manifest()
        return self._read(held["parts"]) if held else self.spark.createDataFrame([], _PART)


def run_slices(records: DataFrame, runs: list[tuple], arrived: str = "arrived_at") -> DataFrame:
    """Records with ``slice``, the position of the first run that sees them.

    ``runs``: (run_no, cutoff) of the runs that succeeded, by cutoff. Records
    that arrive after the last cutoff, or at no known time, are left out. Each
    slice keeps one row per key, the one with the greatest (at, version).
    """
    cutoffs = F.array(*[F.lit(c).cast("timestamp_ntz") for _, c in runs])
    # An array constant is compared in the JVM; runs are as few as builds.
    number = F.size(F.filter(cutoffs, lambda c: c < F.col(arrived)))
    return (
        records.where(F.col(arrived).isNotNull() & F.col("record_key").isNotNull())
        .withColumn("slice", number)
        .where(F.col("slice") < len(runs))
        .groupBy("slice", "record_type", "record_key")
        .agg(F.max(F.struct("at", "version")).alias("v"))
        .select("slice", "record_type", "record_key", "v.version", "v.at")
    )
