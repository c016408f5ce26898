"""Incremental indexing as a stream of file snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphquarry import index as indexing
from graphquarry.operators.changes import detect_changes, files_to_process, stored_snapshot


def index_stream(files: DataFrame, stored: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """For each micro-batch of a streaming ``files``: changes against ``stored()``, and ``apply(changed files, batch)``.

    ``apply`` must be idempotent, since a batch is repeated after a failure; deletions need a
    whole scan and aren't seen by a stream. Of a path that a batch holds twice one row counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        current = df.dropDuplicates(["path"]).persist()
        try:
            old = stored_snapshot(stored()).join(current.select("path"), "path", "left_semi")
            changed = files_to_process(detect_changes(current, old)).select("path", "status")
            apply(current.join(changed, "path"), number)
        finally:
            current.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_store(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """An ``apply`` that brings a store up to date with a batch's files (with content). A batch that is repeated finds them unchanged."""

    def apply(files: DataFrame, number: int) -> None:
        indexing.update(spark, files.drop("status"), path, whole=False)

    return apply
