"""Where intermediate tables go: always the folder that every executor shares.

A table that is written here is read by what follows it, so it can only be removed once the
result has been consumed: ``discard`` drops one that nothing reads any more, ``cleanup`` all
that a session wrote and still has.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_WRITTEN: dict[str, set[str]] = {}
#: Spark's own setting by which a query's shuffle files go when it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run within; jobs that other threads start on the session meanwhile see it too."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def byte_size(text: str) -> int:
    """A size as Spark's settings have it: a number, with a unit or without."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; on a local master that has none set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="graphquarry-"))
    return "file://" + _FALLBACK[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of our own that ``cleanup`` knows of."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialise(df: DataFrame, name: str, *partition_by: str, **options: str | int) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: what follows depends on files that survive the loss of an
    executor, and a consumer that scans twice does not compute twice. The shuffle files
    behind it go when it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _SHUFFLE_CLEANUP, "true"):
        writer = df.write.options(compression="zstd", **options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Rows for which a small table gets a partition, and partitions that it gets at least.
PART_ROWS, LEAST_PARTS = 25_000, 12


def gathered(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """``df`` of about so many rows in as many partitions as they are worth, if it has more; no row moves.

    Small rounds cost what their tasks and files cost, whatever the number of shuffle partitions is.
    """
    return df.coalesce(max(LEAST_PARTS, -(-rows // each)))


def discard(*tables: DataFrame | None) -> None:
    """Removes what ``materialise`` wrote, where nothing will read it again; other DataFrames and None are passed over."""
    for t in tables:
        discard(*getattr(t, "made_of", ()))
        path = getattr(t, "written_to", None)
        if path:
            remove(t.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Removes all that this application wrote through this module and still has."""
    for path in sorted(_WRITTEN.get(spark.sparkContext.applicationId, ())):
        remove(spark, path)


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours that nothing will read again."""
    store, target = located(spark, path)
    store.delete(target, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def exists(spark: SparkSession, path: str) -> bool:
    store, target = located(spark, path)
    return store.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands directly in a folder."""
    store, target = located(spark, path)
    return [x.getPath().getName() for x in store.listStatus(target)]
