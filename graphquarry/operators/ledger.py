"""Work for a backend that costs: asked once, claimed for a time, and taken up again where a run broke off.

A ledger is a folder that all tasks see, or the URI of one in any store that Arrow opens. Its plan, written once, deals the work into batches. A run
claims some batches at a time, for so many seconds, and asks the backend for them in at most ``concurrency`` tasks. A
task writes each batch's answers as soon as it has them, whatever becomes of its task, job or driver; who runs again, or a task that is
repeated, reads them there and asks only for what has none. Batches that another run has claimed are passed over until its time is up.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.plans.storage import exists, materialise

#: Texts that a backend gets at once; batches that a run claims at once; tasks that ask at once; seconds that a claim holds.
BATCH, CLAIMED, CONCURRENCY, EXPIRY = 32, 64, 5, 3600
_ANSWERS = "batch int, id string, value string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Ledger:
    """A ledger of one piece of work (id, text)."""

    spark: SparkSession
    path: str
    batch: int = BATCH
    claimed: int = CLAIMED
    concurrency: int = CONCURRENCY
    expiry: float = EXPIRY

    def plan(self, work: DataFrame) -> DataFrame:
        """(batch, id, text): the plan that is there, else a new one of ``work``. A plan whose writer broke off is written again."""
        at = f"{self.path}/plan"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            rows = materialise(work.select("id", F.col("text").cast("string").alias("text")), "work")
            parts = max(1, -(-rows.count() // self.batch))
            # dealt by hash and then numbered, so that no batch has more than it should
            groups = max(1, parts // 64)
            dealt = rows.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)))
            nth = F.row_number().over(Window.partitionBy("_g").orderBy("id")) - 1
            number = F.floor(nth / self.batch) * groups + F.col("_g")
            dealt.select(number.cast("int").alias("batch"), "id", "text").write.mode("overwrite").parquet(at)
        return self.spark.read.schema("batch int, id string, text string").parquet(at)

    def answered(self) -> set[int]:
        """The batches that have answers."""
        store, base = _store(f"{self.path}/answers")
        found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return {int(posixpath.basename(x.path)[:-5]) for x in found if x.path.endswith(".json")}

    def claim(self, wanted: list[int], owner: str) -> list[int]:
        """Those of some batches that now are the owner's. Of two that claim one at a time, the earlier has it."""
        now = time.time()
        at = f"{self.path}/claims"
        schema = "batch int, owner string, since double, until double"
        read = lambda: self.spark.read.schema(schema).parquet(at).filter(F.col("until") > now) if exists(self.spark, at) else self.spark.createDataFrame([], schema)
        taken = {r["batch"] for r in read().filter(F.col("owner") != owner).select("batch").distinct().collect()}
        free = [b for b in wanted if b not in taken][: self.claimed]
        if not free:
            return []
        self.spark.createDataFrame([(b, owner, now, now + self.expiry) for b in free], schema).coalesce(1).write.mode("append").parquet(at)
        first = read().groupBy("batch").agg(F.min(F.struct("since", "owner")).alias("f")).filter(F.col("f.owner") == owner)
        return sorted({r["batch"] for r in first.collect()} & set(free))

    def ask(self, work: DataFrame, backend: Callable[[list[str]], list[str | None]], owner: str | None = None) -> DataFrame:
        """(id, value) of all work that has answers when nothing is left to claim; what others are at is left to them."""
        owner = owner or uuid.uuid4().hex
        plan = self.plan(work)
        every = sorted(r["batch"] for r in plan.select("batch").distinct().collect())
        while left := [b for b in every if b not in self.answered()]:
            mine = self.claim(left, owner)
            if not mine:
                break
            rows = plan.filter(F.col("batch").isin(mine)).repartition(min(self.concurrency, len(mine)), "batch").sortWithinPartitions("batch", "id")
            rows.mapInArrow(_asker(f"{self.path}/answers", backend), "batch int").write.format("noop").mode("overwrite").save()
        return self.answers()

    def answers(self) -> DataFrame:
        at = f"{self.path}/answers"
        if not self.answered():
            return self.spark.createDataFrame([], "id string, value string")
        whole = self.spark.read.schema("answers array<struct<id: string, value: string>>").option("pathGlobFilter", "*.json").json(at if "://" in at else f"file://{at}")
        return whole.select(F.explode("answers").alias("a")).select("a.id", "a.value")


def _asker(answers: str, backend: Callable[[list[str]], list[str | None]]):
    """Rows (batch, id, text), those of a batch behind each other, to batches that have answers."""

    def settle(store: pafs.FileSystem, base: str, batch: int, ids: list[str], texts: list[str]) -> None:
        target = posixpath.join(base, f"{batch}.json")
        if store.get_file_info(target).type != pafs.FileType.NotFound:
            return
        values = list(backend(texts))
        if len(values) != len(texts):
            raise ValueError(f"{len(values)} answers to {len(texts)} texts")
        made = json.dumps({"answers": [{"id": i, "value": v} for i, v in zip(ids, values, strict=True)]})
        part = f"{target}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(made.encode())
        store.move(part, target)  # whole or not there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(answers)
        store.create_dir(base, recursive=True)
        own: tuple[int, list[str], list[str]] | None = None
        for rows in batches:
            for batch, i, text in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if own and own[0] != batch:
                    settle(store, base, *own)
                    own = None
                own = own or (batch, [], [])
                own[1].append(i)
                own[2].append(text or "")
        if own:
            settle(store, base, *own)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["batch"])

    return run
