"""Exact nearest neighbours by cosine, scored (1 + cosine) / 2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.plans.storage import materialise, new_path
from graphquarry.schema import INDEXED

MIN_SIMILARITY, MAX_RESULTS, EXACT_BOOST = 0.6, 20, 1.2
#: Bytes of query vectors that are sent to the tasks in a pass.
QUERY_BYTES = 8 << 20
#: Scores that a task holds at once: with more, memory would follow the number of queries until a pass is full.
SCORES = 1 << 17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2 of two arrays, null where a norm is 0 or the lengths differ. Stays in the JVM."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), (F.lit(1.0) + dot(a, b) / norm) / 2)


def similar_to(nodes: DataFrame, vector: list[float], k: int = MAX_RESULTS, least: float = MIN_SIMILARITY) -> DataFrame:
    """The k nearest of ``nodes`` to one vector, then those that score ``least``: one scan, no join."""
    scored = nodes.filter(F.size("embedding") > 0).withColumn("score", similarity(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])))
    return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(k).filter(F.col("score") >= least)


def knn(nodes: DataFrame, queries: DataFrame, k: int = MAX_RESULTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, label, score): the k nearest nodes of each label to each query (query_id, vector); of equal scores the smallest ids.

    Queries go to the tasks as many at a time as have ``query_bytes``, each time in a pass over the nodes. A task
    keeps each query's best of each label and passes on at most k rows, however many nodes are alike.
    """
    spark = nodes.sparkSession
    schema = result_schema(queries)
    asked, passes = in_passes(queries, query_bytes)
    slim = embedded(nodes)
    order = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id")

    def one(n: int) -> DataFrame:
        met = slim.mapInArrow(nearest(by_dim(asked, n), k, schema), schema)
        return met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")

    if passes == 1:
        return one(0)
    path = new_path(spark, "knn")
    for n in range(passes):
        one(n).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def result_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, label string, score double"


def embedded(nodes: DataFrame) -> DataFrame:
    """(id, label, v) of nodes that a search goes through."""
    return nodes.filter((F.size("embedding") > 0) & F.col("label").isin(*INDEXED)).select("id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def in_passes(queries: DataFrame, query_bytes: int) -> tuple[DataFrame, int]:
    """Written queries (query_id, v, pass), and the number of passes."""
    asked = queries.filter(F.size("vector") > 0).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    size = asked.agg(F.sum(8 * F.size("v").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // query_bytes))
    return materialise(asked.withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)).cast("int")), "queries"), passes


Asked = dict[int, tuple[pa.Array, np.ndarray]]


def by_dim(asked: DataFrame, n: int) -> Asked:
    """A pass's queries by their length: ids, and vectors of length 1. Those without a direction have no neighbours."""
    table = asked.filter(F.col("pass") == n).select("query_id", "v").toArrow()
    ids, lists = table.column("query_id").combine_chunks(), table.column("v").combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, {}
    for d in np.unique(sizes).tolist():
        at = np.nonzero(sizes == d)[0]
        m = unit(flat[starts[at][:, None] + np.arange(d)])
        known = ~np.isnan(m[:, 0])
        out[d] = (ids.take(pa.array(at[known])), m[known])
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN where a row is all zeros."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan, dtype=float), where=norm > 0)


class Best:
    """The k best rows of each query, by score and then by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, object)] * queries
        self.scores = [np.zeros(0)] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        """Rows of length 1, in the order of their ids, met by the queries ``which``."""
        step = max(1, SCORES // max(1, len(rows)))
        for first in range(0, len(which), step):
            some = which[first : first + step]
            # rounded, so that equal vectors tie wherever they stand
            score = asked[some] @ rows.T
            score += 1
            score /= 2
            np.round(score, 12, out=score)
            for q, own in ((some[n], score[n]) for n in np.nonzero(score.max(axis=1) >= self.least[some])[0].tolist()):
                at = np.nonzero(own >= self.least[q])[0]
                if len(at) > self.k:  # what is above the k-th, and of its equals the first
                    edge = np.partition(own[at], -self.k)[-self.k]
                    above = at[own[at] > edge]
                    at = np.r_[above, at[own[at] == edge][: self.k - len(above)]]
                names, scores = np.concatenate([self.ids[q], ids[at]]), np.concatenate([self.scores[q], own[at]])
                order = np.array(sorted(range(len(names)), key=lambda n: (-scores[n], names[n]))[: self.k])
                self.ids[q], self.scores[q] = names[order], scores[order]
                if len(order) == self.k:
                    self.least[q] = scores[order[-1]]


def rows_of(best: dict[tuple[int, str], Best], asked: Asked, names: list[str]) -> Iterator[pa.RecordBatch]:
    for (dim, label), b in best.items():
        for at in range(0, len(b.ids), 2048):
            ids, scores = b.ids[at : at + 2048], b.scores[at : at + 2048]
            own = asked[dim][0].take(pa.array(np.repeat(np.arange(at, at + len(ids)), [len(x) for x in ids])))
            yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(ids), pa.string()), pa.array([label] * len(own), pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=names)


def nearest(asked: Asked, k: int, schema: str):
    """Rows (id, label, v) to the k nearest of each label to each query."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str], Best] = {}
        for batch in batches:
            ids, labels, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            dims, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            for dim, label in sorted(set(zip(dims.tolist(), labels.tolist(), strict=True))):
                if not len(asked.get(dim, ((),))[0]):
                    continue
                at = np.nonzero((dims == dim) & (labels == label))[0]
                at = at[np.argsort(ids[at].astype(str), kind="stable")]
                m = unit(flat[starts[at][:, None] + np.arange(dim)])
                known = ~np.isnan(m[:, 0])
                if known.any():
                    held = best.setdefault((dim, label), Best(len(asked[dim][1]), k))
                    held.add(asked[dim][1], m[known], ids[at[known]], np.arange(len(asked[dim][1])))
        yield from rows_of(best, asked, names)

    return run


def exact_match(text: Column, name: Column, summary: Column) -> Column:
    """Name within the query or the query within the name, or a query word of over 3 letters within the summary.

    An empty query is within every name.
    """
    t, n, s = F.lower(text), F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(summary, F.lit("")))
    return F.contains(t, n) | F.contains(n, t) | F.exists(F.split(t, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(s, w))


def vector_search(nodes: DataFrame, queries: DataFrame, k: int = MAX_RESULTS, least: float = MIN_SIMILARITY, boost: bool = True, per_label: bool = False) -> DataFrame:
    """(query_id, id, label, original_score, score): nearest nodes of each label to queries (query_id, text, vector[, node_types]).

    The threshold comes before the boost, the limit over all labels after it; scores may pass 1.
    Null or empty node_types mean all labels.
    """
    asked = queries if "node_types" in queries.columns else queries.withColumn("node_types", F.lit(None).cast("array<string>"))
    near = knn(nodes, queries, k).filter(F.col("score") >= least).withColumnRenamed("score", "original_score")
    names = nodes.select("id", "name", "generated_summary")
    texts = asked.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "node_types")
    joined = near.join(texts, "query_id").filter((F.coalesce(F.size("node_types"), F.lit(0)) <= 0) | F.expr("array_contains(node_types, label)")).join(names, "id")
    up = exact_match(F.col("text"), F.col("name"), F.col("generated_summary")) & F.lit(boost)
    scored = joined.withColumn("score", F.when(up, F.col("original_score") * EXACT_BOOST).otherwise(F.col("original_score")))
    if not per_label:
        place = F.array_position(F.array(*[F.lit(x) for x in INDEXED]), F.col("label"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), place, "id")
        scored = scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return scored.select("query_id", "id", "label", "name", "original_score", "score")


def similar_nodes(nodes: DataFrame, ids: list[str] | DataFrame, k: int = MAX_RESULTS, least: float = MIN_SIMILARITY, boost: bool = True) -> DataFrame:
    """For each of some nodes (ids, or rows with an id) its nearest of the same label, itself taken out after the limit, hence k - 1 at most."""
    asked = nodes.filter(F.col("id").isin(ids)) if isinstance(ids, list) else nodes.join(ids.select("id").distinct(), "id", "left_semi")
    own = asked.select(F.col("id").alias("query_id"), F.lit("").alias("text"), F.col("embedding").alias("vector"), F.array("label").alias("node_types"))
    return vector_search(nodes, own, k, least, boost, per_label=True).filter("query_id <> id")
