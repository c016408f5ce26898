"""Bounds on what a Python worker holds at once."""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import SparkSession

from graphquarry.plans.storage import byte_size, setting

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Arrow batches of at most about ``most`` bytes in the jobs that run within, unless the session's are smaller."""
    return setting(spark, _KEY, str(min(most, byte_size(spark.conf.get(_KEY)))))
