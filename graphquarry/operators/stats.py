"""Counts and sums over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.schema import INDEXED, LEVELS



def nodes_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def file_stats(files: DataFrame) -> DataFrame:
    """Number of files, their languages and bytes."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def embedding_coverage(nodes: DataFrame) -> DataFrame:
    """Nodes with an embedding, for each indexed label, 0 included."""
    labels = nodes.sparkSession.createDataFrame([(x,) for x in INDEXED], "label string")
    found = nodes.filter(F.col("label").isin(*INDEXED)).groupBy("label").agg(F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("n"))
    return labels.join(F.broadcast(found), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n_embedded"))


def summary_progress(nodes: DataFrame) -> DataFrame:
    """Of each level that occurs: nodes, those summarised, in work and left."""
    done = F.coalesce("generated_summary", F.lit("")) != ""
    busy = F.coalesce(F.col("summary_status") == "PROCESSING", F.lit(False))
    counts = nodes.filter(F.col("label").isin(*LEVELS)).groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(busy).alias("processing"))
    return counts.withColumn("remaining", F.col("total") - F.col("completed"))


def traversal_summary(related: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, value, n): related nodes by label, links by type and by depth, the deepest and the totals."""
    count = F.count(F.lit(1)).alias("n")
    by = lambda df, kind, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(count).select(F.lit(kind).alias("kind"), "value", "n")
    deepest = links.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("n")).select(F.lit("max_depth").alias("kind"), F.lit("").alias("value"), "n")
    totals = [df.agg(count).select(F.lit(f"total_{k}").alias("kind"), F.lit("").alias("value"), "n") for k, df in (("nodes", related), ("links", links))]
    out = by(related, "node_type", "label")
    for df in (by(links, "relationship", "type"), by(links, "depth", "depth"), deepest, *totals):
        out = out.unionByName(df)
    return out


def hierarchy_counts(reached: DataFrame) -> DataFrame:
    """Size of each root's hierarchy in each direction."""
    return reached.groupBy("root").pivot("direction", ["IN", "OUT"]).agg(F.count(F.lit(1))).select("root", F.coalesce("IN", F.lit(0)).alias("n_in"), F.coalesce("OUT", F.lit(0)).alias("n_out"))


def ingestion_stats(nodes: DataFrame, edges: DataFrame, stored_nodes: DataFrame) -> DataFrame:
    """Nodes that are new and that are merged into stored ones, and edges."""
    old = stored_nodes.select("id").distinct().withColumn("old", F.lit(True))
    n = nodes.join(old, "id", "left").agg(F.count_if(F.col("old").isNull()).alias("nodes_created"), F.count_if("old").alias("nodes_merged"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges")), how="inner")
