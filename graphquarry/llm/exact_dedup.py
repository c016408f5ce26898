"""Exact deduplication against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. Data comes in
batches. A batch is reduced to one row per digest before anything is joined, anti-joined against
the index by sort-merge (only the batch side moves: the index is already laid out by
digest), and its new digests are appended. A table is cut into BATCHES ranges of ids, the
largest ids first, so that what the index has is what stays.

Defined cases: null text counts as empty; empty texts form one group; among equal texts
of one call the largest doc_id stays, and a text that an earlier call has indexed is
dropped whatever its id; group_size counts the rows of this call; rows that repeat a doc_id belong to the same group, and each is
reported; rows without a doc_id stay only where no row of their group has one, keep_id then
being null; an empty table gives an empty result; very long texts are hashed whole, in one
buffer; other columns of the input are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.llm.columns import free_name
from graphquarry.plans.storage import discard, materialise, new_path, remove

#: Share of a call's rows from which a group of copies is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.002
#: Ranges of ids that a call's rows are put to the index in, one after the other.
BATCHES = 2


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


class DigestIndex:
    """A digest index that outlives the batches; ``name`` is a table, empty at first.

    Its files are in ``path``, by default a new folder of the one that all executors share, never in a warehouse that
    may be a folder of one machine.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = None
        if not spark.catalog.tableExists(self.name):
            self.path = path or new_path(spark, "digest-index")
            self._save(spark.createDataFrame([], "digest binary, keep_id bigint"))

    def _save(self, rows: DataFrame) -> None:
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("compression", "zstd").mode("append")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """The table and, where this object made it, its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            remove(self.spark, self.path)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows whose digest the index lacks, by sort-merge anti-join; the index side isn't exchanged."""
        return digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame) -> None:
        """Add the digests of (digest, doc_id) that the index lacks, each with its largest doc_id."""
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        self._save(self.unseen(groups).repartition(self.buckets, "digest"))


def descending(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows cut into ranges of doc_id, the largest first, those without one with the last. Only the cuts come to the driver."""
    cuts = digests.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in cuts}, reverse=True), None]
    out = []
    for high, low in zip(edges, edges[1:], strict=False):
        part = digests if high is None else digests.filter((F.col("doc_id") < high) | F.col("doc_id").isNull())
        out.append(part if low is None else part.filter(F.col("doc_id") >= low))
    return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    ``index`` is one that earlier calls have filled; without one, an index of our own is filled
    and dropped again.
    """
    spark = docs.sparkSession
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
    own = index is None
    index = index or DigestIndex(spark)
    try:
        found = _found(digests, index, own, batches)
    finally:
        if own:
            index.drop()
    every = _resolved(digests, found)
    stays = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return every.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _found(digests: DataFrame, index: DigestIndex, own: bool, batches: int) -> DataFrame:
    """keep_id, group_size and whether it is new, of every digest of the call, which the index gets."""
    # what earlier calls had indexed, before this one adds to it
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    if own:
        groups = groups.withColumn("fresh", F.lit(True))
    else:
        new = index.unseen(groups).withColumn("fresh", F.lit(True))
        groups = materialise(new.unionByName(groups.join(index.table().select("digest").hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))), "digest_groups")
    for part in descending(digests, batches):
        index.append(part)
    found = materialise(groups.join(index.table().hint("merge"), "digest"), "digests_found")
    discard(groups)
    return found


def _resolved(digests: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found of their digest.

    Digests that hold more than ``HOT_SHARE`` of the rows are fewer than
    1 / HOT_SHARE and are joined by broadcast, so that no task gets all of a group.
    """
    total = found.agg(F.sum("group_size")).first()[0] or 0
    hot = found.filter(F.col("group_size") > total * HOT_SHARE)
    if not hot.limit(1).count():
        return digests.join(found.hint("merge"), "digest")
    rest = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return digests.join(F.broadcast(hot), "digest").unionByName(rest.join(found.hint("merge"), "digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is the one that stays of its group.

    Of rows that repeat both id and text the one stays whose columns come first in order.
    """
    key, place = free_name(docs, "_key"), free_name(docs, "_place")
    # digest and id in one column, so that the join needs one exchange, null ids included
    named = lambda i, d: F.concat(d, F.coalesce(F.col(i).cast("string"), F.lit("")).cast("binary")).alias(key)
    result = exact_dedup(docs, None, id_col, text_col).filter("kept").select(named("doc_id", F.unhex("text_sha256")))
    kept = materialise(result.groupBy(key).agg(F.count(F.lit(1)).alias(place)), "digests_kept")
    marked = docs.withColumn(key, named(id_col, digest(F.col(text_col))))
    once = marked.join(kept.filter(F.col(place) == 1).select(key).hint("merge"), key, "left_semi")
    again = kept.filter(F.col(place) > 1).select(key)
    if not again.limit(1).count():
        return once.select(*docs.columns)
    order = [F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col])), F.xxhash64(text_col), text_col]
    repeats = marked.join(again.hint("merge"), key, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(place) == 1)
    return once.unionByName(repeats.drop(place)).select(*docs.columns)
