"""Nodes and edges as Parquet snapshots: upsert, merge, delete, interchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.operators.graph import component_of, resolved_edges
from graphquarry.schema import EDGE, INTERCHANGE, NODE_FIELDS, STORED, packed, unpacked


def latest(*batches: DataFrame) -> DataFrame:
    """One row an id: of each column the last batch's value that isn't null; within a batch that of the row with the largest hash."""
    tagged = None
    for n, b in enumerate(batches):
        hashed = [c for c, t in b.dtypes if "map<" not in t]
        part = b.withColumn("_order", F.struct(F.lit(n).alias("batch"), F.xxhash64(*hashed).alias("tie")))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    names = [c for c in tagged.columns if c not in ("id", "_order")]
    return tagged.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in names])


def upsert_nodes(stored: DataFrame, *incoming: DataFrame) -> DataFrame:
    """Merge by id: what the new rows have replaces, nulls leave the stored value.

    Ids that repeat among the new rows are one node; the last batch's values win.
    """
    return merged_nodes(stored, latest(*incoming))


def with_columns_of(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in the columns of the stored ones, null where they have none."""
    return new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])


def merged_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``upsert_nodes`` of new rows that are one an id."""
    names = [c for c in stored.columns if c != "id"]
    known = [c for c in names if c in new.columns]
    joined = stored.join(new.select("id", *[F.col(c).alias(f"_{c}") for c in known]), "id", "full_outer")
    return joined.select("id", *[F.coalesce(f"_{c}", c).alias(c) if c in known else F.col(c) for c in names])


def merge_edges(*batches: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type); of properties the later batch's win."""
    tagged = None
    for n, b in enumerate(batches):
        part = b.select("src", "dst", "type", "properties", F.lit(n).alias("batch"))
        tagged = part if tagged is None else tagged.unionByName(part)
    entries = tagged.select("src", "dst", "type", "batch", F.explode_outer("properties").alias("k", "v"))
    last = entries.groupBy("src", "dst", "type", "k").agg(F.max_by("v", F.struct("batch", "v")).alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    return last.groupBy("src", "dst", "type").agg(F.map_from_entries(pairs).alias("properties"))


def create_edges(nodes: DataFrame, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored edges and those new ones whose ends exist; running it again changes nothing."""
    return merge_edges(stored, resolved_edges(nodes, incoming))


def without_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that neither start from ``sources`` (id) nor lead to ``targets`` (id)."""
    slim = edges.select(packed("src").alias("src"), packed("dst").alias("dst"), "type", "properties")
    left = slim.join(sources.select(packed("id").alias("src")), "src", "left_anti").join(targets.select(packed("id").alias("dst")), "dst", "left_anti")
    return left.select(unpacked("src").alias("src"), unpacked("dst").alias("dst"), "type", "properties")


def owned_by(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes that files at ``paths`` (path) own, the files included."""
    return nodes.join(paths.select("path").distinct(), "path", "left_semi").select(*nodes.columns)


def delete_owned(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without everything that files at ``paths`` (path) own, and without edges to or from it."""
    return _without(nodes, edges, owned_by(nodes, paths).select("id"))


def delete_component(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the connected components of ``roots`` (id)."""
    return _without(nodes, edges, component_of(roots, edges))


def deletion_counts(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: the files among ``gone`` (id), the other nodes, and the edges that go with them."""
    ids = gone.select("id").distinct()
    n = nodes.join(ids, "id", "left_semi").agg(F.count_if(F.col("label") == "File").alias("files"), F.count_if(F.col("label") != "File").alias("related"))
    marked = edges.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return n.join(marked.agg(F.count_if(F.coalesce("_s", "_d").isNotNull()).alias("edges")), how="inner")


def _without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), kept.select(*edges.columns)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes laid out by label, edges by type: label filters prune folders."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(STORED).parquet(f"{path}/nodes").select(*spark.createDataFrame([], STORED).columns), spark.read.schema(EDGE).parquet(f"{path}/edges").select("src", "dst", "type", "properties")


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    """Documents of extraction runs, one JSON file each."""
    return spark.read.schema(INTERCHANGE).option("multiLine", True).json(path)


def parse_interchange(texts: DataFrame, column: str = "value") -> DataFrame:
    return texts.select(F.from_json(column, INTERCHANGE).alias("d")).select("d.*")


def nodes_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("nodes").alias("n")).select("n.*")


def edges_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("relationships").alias("r")).select(F.col("r.source_id").alias("src"), F.col("r.target_id").alias("dst"), "r.type", "r.properties")


@dataclass(frozen=True)
class Batch:
    """What several extraction runs found, as one batch."""

    language: str
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame


def combine(*documents: DataFrame) -> Batch:
    """The files, nodes and edges of all documents (rows of ``read_interchange``) together, language ``multi``. Repeats stay, for the upsert to reduce."""
    every = documents[0]
    for d in documents[1:]:
        every = every.unionByName(d)
    return Batch("multi", every.select(F.explode("processed_files").alias("path")), nodes_of(every), edges_of(every))


def write_interchange(nodes: DataFrame, edges: DataFrame, path: str, language: str = "multi") -> None:
    """One JSON document a file's worth of nodes: grouped by the path that owns them."""
    full = nodes.select(*[F.col(c) if c in nodes.columns else F.lit(None).alias(c) for c in NODE_FIELDS])
    owner = nodes.select(F.col("id").alias("src"), F.col("path").alias("_path"))
    n = full.groupBy("path").agg(F.collect_list(F.struct(*NODE_FIELDS)).alias("nodes"))
    e = edges.join(owner, "src").groupBy(F.col("_path").alias("path")).agg(F.collect_list(F.struct(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "type", "properties")).alias("relationships"))
    doc = F.struct(F.lit(language).alias("language"), F.lit("1.0.0").alias("version"), F.array("path").alias("processed_files"), "nodes", F.coalesce("relationships", F.array()).alias("relationships"))
    n.join(e, "path", "left").select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)


