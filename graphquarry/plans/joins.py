"""Joins with keys that hold a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the rows from which a key's rows are dealt over several tasks; fewer keys than its inverse have so many.
HUB_SHARE = 0.002
#: Rows that one task gets of a key at least.
LEAST_PART = 10_000


@dataclass(frozen=True)
class Split:
    """Rows with a part each, so that no part of a key has more than a small share of them, and the keys (key, parts) that have several."""

    rows: DataFrame
    key: str
    hubs: DataFrame

    def join(self, left: DataFrame, on: str, how: str | None = None) -> DataFrame:
        """Each row of ``left`` with the rows whose key is its column ``on``; rows at a hub go to each of its parts. ``how`` is a hint for the join."""
        named = F.broadcast(self.hubs.withColumnRenamed(self.key, on))
        sent = left.join(named, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return (sent.hint(how) if how else sent).join(self.rows, (F.col(on) == F.col(self.key)) & (F.col("_part") == F.col("_own"))).drop("_part", "_own")


def split(rows: DataFrame, key: str, spread: Column, share: float | None = None, least: int | None = None) -> Split:
    """``rows`` dealt by ``spread`` (a hash of what tells apart the rows of a key) where a key has many."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    most = max(least or LEAST_PART, int(total * (share or HUB_SHARE)))
    hubs = counts.filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hubs), key, "left").withColumn("_own", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(spread, F.col("_parts"))).cast("int")).drop("_parts")
    return Split(dealt, key, hubs)
