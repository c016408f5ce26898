"""A written index of names, by which a lookup goes straight to the names that can contain what it asks for.

Postings (gram, id) of the runs of GRAM characters of names and full names lie in buckets by the gram's hash, beside the
number of postings of each gram. Whatever contains an entity contains all its grams, so a lookup takes the rarest of
them, reads the postings of that one, and compares the names of the nodes that it finds. Entities shorter than a gram are held against the
names themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.operators.search import GRAM, best_by_name, grams, lookup
from graphquarry.plans.joins import split
from graphquarry.plans.storage import exists, materialise

BUCKETS = 64
#: Parts of a bucket at least, and nodes for each part that are written together.
LEAST_PARTS, PART_NODES = 4, 25_000


@dataclass(frozen=True)
class NameIndex:
    spark: SparkSession
    path: str

    def read(self, table: str, buckets: list[int]) -> DataFrame:
        """The rows of some buckets of ``postings`` (gram, id) or ``counts`` (gram, n); other buckets aren't opened."""
        schema = {"postings": "gram string, id string, bucket int", "counts": "gram string, n bigint, bucket int"}[table]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(buckets)).drop("bucket")


def _bucket(gram: str | Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(nodes: DataFrame, path: str) -> NameIndex:
    """Writes an index of all names to ``path``, which must be free."""
    spark = nodes.sparkSession
    if exists(spark, path):
        raise ValueError(f"{path} is taken")
    every = F.array_distinct(F.concat(*[grams(F.coalesce(c, F.lit("")), GRAM) for c in ("name", "full_name")]))
    postings = nodes.select("id", F.explode(every).alias("gram")).select("gram", "id", _bucket("gram").alias("bucket"))
    # a bucket by several tasks, the more the more nodes there are, each sorted, so that a gram's rows stand together in each file
    parts = max(LEAST_PARTS, -(-nodes.count() // PART_NODES))
    by = ["bucket", F.pmod(F.xxhash64("id"), F.lit(parts))]
    dealt = (postings.repartition(*by) if parts == LEAST_PARTS else postings.repartition(BUCKETS * parts // 2, *by)).sortWithinPartitions("bucket", "gram")
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema("gram string, id string, bucket int").parquet(f"{path}/postings")
    written.groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n")).select("gram", "n", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")
    return NameIndex(spark, path)


def rarest(index: NameIndex, names: DataFrame) -> DataFrame:
    """(lookup_id, entity, gram) of the entities that have grams: the rarest one, if all of them occur."""
    asked = names.filter(F.length("entity") >= GRAM).select("lookup_id", "entity", F.explode(grams(F.col("entity"), GRAM)).alias("gram"))
    buckets = [r[0] for r in asked.select(_bucket("gram")).distinct().collect()]
    found = asked.join(index.read("counts", buckets), "gram", "left")
    return found.groupBy("lookup_id", "entity").agg(F.min(F.struct("n", "gram")).alias("m"), F.count_if(F.col("n").isNull()).alias("missing")).filter("missing = 0").select("lookup_id", "entity", "m.gram")


def indexed_lookup(index: NameIndex, names: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """What ``search.lookup`` finds among the indexed nodes, for rows of ``names`` (lookup_id, entity)."""
    # lookups that ask for the same are one: pairs then grow with the nodes and not with nodes times lookups
    texts = materialise(names.filter("entity is not null").select("entity").distinct().withColumn("lookup_id", F.col("entity")), "entities")
    asked = materialise(rarest(index, texts), "lookups")
    buckets = [r[0] for r in asked.select(_bucket("gram")).distinct().collect()]
    wanted = index.read("postings", buckets).join(asked.select("gram").distinct(), "gram", "left_semi")
    # a gram that many names have is dealt over several tasks
    met = split(materialise(wanted, "postings"), "gram", F.xxhash64("id")).join(asked.withColumnRenamed("gram", "_asked"), "_asked").select("lookup_id", "entity", "id")
    known = nodes.select("id", "label", "name", "full_name")
    long = best_by_name(met.join(known, "id"), limit)
    short = lookup(texts.filter(F.length("entity") < GRAM), nodes, limit)
    best = materialise(long.unionByName(short).drop("lookup_id"), "found")
    return names.select("lookup_id", "entity").join(best, "entity").select("lookup_id", "entity", *[c for c in best.columns if c != "entity"])
