"""Watching a folder of records and publishing target versions from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from skein.operators.incremental import IncrementalTarget


def sync(spark: SparkSession, folder: str, schema: str, target: IncrementalTarget, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None) -> StreamingQuery:
    """Take in what is new in a folder and stop; a failed batch publishes nothing.

    Each micro-batch is one run of the target, numbered by its batch id, so a
    batch that is run again after a failure changes nothing twice.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(folder)

    def publish(batch: DataFrame, batch_id: int) -> None:
        target.process(batch_id, prepare(batch) if prepare else batch)

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, folder: str, schema: str, target: IncrementalTarget, checkpoint: str, seconds: float = 0.5) -> StreamingQuery:
    """The same, going on until stopped."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        target.process(batch_id, batch)

    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


class DiagnosticState(StatefulProcessor):
    """First and last build and number of builds in which a diagnostic was seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "first_seen string, last_seen string, seen_count bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        versions = sorted({v for batch in rows for v in batch["index_version"] if v is not None})
        first, last, count = self.held.get() if self.held.exists() else (None, None, 0)
        for version in versions:
            if last is None or version > last:
                first, last, count = first or version, version, count + 1
        if last is not None:
            self.held.update((first, last, count))
            yield pd.DataFrame({"subject": [key[0]], "first_seen": [first], "last_seen": [last], "seen_count": [count]})

    def close(self) -> None:
        pass


def diagnostic_lifecycle(stream: DataFrame) -> DataFrame:
    """Lifecycle of diagnostics (subject, index_version) as their builds arrive."""
    return stream.groupBy("subject").transformWithStateInPandas(
        DiagnosticState(), "subject string, first_seen string, last_seen string, seen_count bigint", "Update", "None"
    )


def is_stale(trace_commit: str | None, trace_version: str | None, commit: str, version: str) -> bool:
    """A trace of another commit or build is rejected whole; an unnamed one is not."""
    return (trace_commit is not None and trace_commit != commit) or (trace_version is not None and trace_version != version)
