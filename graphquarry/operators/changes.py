"""Change detection between a scan and the stored snapshot of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("NEW", "MODIFIED", "UNCHANGED", "DELETED")
TO_PROCESS = ("NEW", "MODIFIED")


def stored_snapshot(files: DataFrame) -> DataFrame:
    """path and checksum of stored files; those without either don't count as stored."""
    return files.filter((F.coalesce("path", F.lit("")) != "") & (F.coalesce("checksum", F.lit("")) != "")).select("path", "checksum")


def detect_changes(current: DataFrame, stored: DataFrame, scanned_prefix: str = "") -> DataFrame:
    """One row a path of either side: its status, checksums, size and extension.

    Only stored paths under ``scanned_prefix`` can be DELETED: what lies outside wasn't looked at.
    """
    old = stored_snapshot(stored).filter(F.startswith("path", F.lit(scanned_prefix))).select("path", F.col("checksum").alias("old_checksum"))
    new = current.select("path", "absolute_path", F.col("checksum").alias("new_checksum"), "size", "extension")
    gone, fresh = F.col("new_checksum").isNull() & F.col("absolute_path").isNull(), F.col("old_checksum").isNull()
    status = F.when(gone, "DELETED").when(fresh, "NEW").when(F.col("old_checksum") == F.col("new_checksum"), "UNCHANGED").otherwise("MODIFIED")
    joined = new.join(old, "path", "full_outer").withColumn("status", status)
    return joined.select("path", F.coalesce("absolute_path", F.lit("")).alias("absolute_path"), "status", "old_checksum", "new_checksum", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "extension")


def files_to_process(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status").isin(*TO_PROCESS))


def deleted_files(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("status") == "DELETED")


def change_summary(changes: DataFrame) -> DataFrame:
    """Files of each of the four statuses, also of those that don't occur."""
    wanted = changes.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    found = changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(F.broadcast(found.filter(F.col("status").isin(*STATUSES))), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
