"""A written index of embeddings that finds the exact nearest neighbours without reading all of them.

Vectors of length 1 lie in cells around centres, which are chosen from a bounded sample; every vector is in the cell of its
nearest centre. A cell's radius is the largest angle to its centre, so no vector of it is nearer to a query than the angle
to the centre less the radius. A search reads the cells with the highest bounds until they hold k rows, takes the k-th
score as the limit, and then reads the other cells whose bound reaches it. The index is laid out by label and cell, so cells that aren't
read are folders that aren't opened.

What comes to the driver is one row a cell and label, at most CELLS of each, and the queries of a pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.operators.vector import MAX_RESULTS, QUERY_BYTES, Asked, Best, by_dim, embedded, in_passes, result_schema, rows_of, unit
from graphquarry.plans.storage import exists, materialise, new_path, remove

#: Cells at most, and vectors that their centres are chosen from.
CELLS, SAMPLE = 1024, 50_000
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Room for rounding in bounds.
_SLACK = 1e-9
_ROWS = "label string, cell int, dim int, ids array<string>, vectors array<double>"
_DIRECTORY = "label string, cell int, dim int, rows bigint, radius double, centre array<double>"


@dataclass(frozen=True)
class VectorIndex:
    """Where an index is, and its directory: by label and length the cells' numbers, rows, radii and centres."""

    spark: SparkSession
    path: str
    directory: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def blocks(self, wanted: dict[tuple[str, int], set[int]]) -> DataFrame:
        """The blocks of some cells, by label and length."""
        keep = F.lit(False)
        for (label, dim), cells in wanted.items():
            keep = keep | ((F.col("label") == label) & F.col("cell").isin(sorted(cells)) & (F.col("dim") == dim))
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/blocks").filter(keep).select("label", "cell", "dim", "ids", "vectors")


def centres(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres of a sample of vectors of length 1, by a few rounds of spherical k-means, from evenly spread starts."""
    if len(sample) <= cells:
        return sample
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        made = unit(total)
        c = np.where(np.isnan(made[:, :1]), c, made)
    return c


def _assigner(cells: dict[int, np.ndarray]):
    """Rows (id, label, v) to (label, cell, dim, id, v, angle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                m = unit(flat[starts[at][:, None] + np.arange(dim)])
                known = ~np.isnan(m[:, 0])
                at, m = at[known], m[known]
                near = m @ cells[dim].T if dim in cells else np.zeros((len(m), 1))
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(m)), cell], -1, 1)) if dim in cells else np.full(len(m), np.pi)
                where = pa.array(at)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) * dim + 1, dim), pa.int32()), pa.array(m.ravel()))
                columns = [batch.column(1).take(where), pa.array(cell, pa.int32()), pa.array([dim] * len(m), pa.int32()), batch.column(0).take(where), vectors, pa.array(angle, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "cell", "dim", "id", "v", "angle"])

    return run


def _packer(block_rows: int):
    """Rows (label, cell, dim, id, v), those of a cell behind each other, to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for first, last in zip(cut, cut[1:], strict=False):
                for at in range(first, last, block_rows):
                    part = batch.slice(at, min(block_rows, last - at))
                    whole = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(t))
                    columns = [part.column(0).slice(0, 1), part.column(1).slice(0, 1), part.column(2).slice(0, 1), whole(part.column(3), pa.string()), whole(part.column(4).flatten(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")])

    return run


def build(nodes: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Writes an index of all nodes with embeddings to ``path``, which must be free, and opens it."""
    spark = nodes.sparkSession
    if exists(spark, path):
        raise ValueError(f"{path} is taken")
    slim = embedded(nodes)
    counts = {r["dim"]: r["n"] for r in slim.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, np.ndarray] = {}
    for dim, n in counts.items():
        some = slim.filter(F.size("v") == dim).select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("v").toArrow().column(0).combine_chunks()
        m = unit(some.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        m = m[~np.isnan(m[:, 0])]
        if len(m):
            chosen[dim] = centres(m, min(CELLS, cells or max(1, round(n**0.5))))
    placed = materialise(slim.mapInArrow(_assigner(chosen), "label string, cell int, dim int, id string, v array<double>, angle double"), "placed_vectors")
    spread = placed.repartition("label", "dim", "cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("label", "dim", "cell", "id").select("label", "cell", "dim", "id", "v")
    spread.mapInArrow(_packer(block_rows), _ROWS).write.partitionBy("label", "cell").parquet(f"{path}/blocks")
    facts = placed.groupBy("label", "cell", "dim").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius")).collect()
    rows = [(r["label"], r["cell"], r["dim"], r["rows"], r["radius"], chosen[r["dim"]][r["cell"]].tolist() if r["dim"] in chosen else []) for r in facts]
    spark.createDataFrame(rows, _DIRECTORY).coalesce(1).write.parquet(f"{path}/directory")
    if placed.written_to:
        remove(spark, placed.written_to)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    found: dict[tuple[str, int], list] = {}
    for r in spark.read.schema(_DIRECTORY).parquet(f"{path}/directory").collect():
        found.setdefault((r["label"], r["dim"]), []).append(r)
    column = lambda rows, c, t=float: np.array([r[c] for r in rows], t)
    return VectorIndex(spark, path, {k: (column(v, "cell", int), column(v, "rows", int), column(v, "radius"), column(v, "centre")) for k, v in found.items()})


def _visitor(asked: Asked, visits: dict[tuple[str, int, int], np.ndarray], k: int, schema: str):
    """Blocks to the k best rows of each query that visits their cell."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str], Best] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                label, cell, dim = (batch.column(c)[n].as_py() for c in range(3))
                which = visits.get((label, dim, cell))
                if which is None or not len(which):
                    continue
                ids = batch.column(3)[n].values.to_numpy(zero_copy_only=False)
                rows = batch.column(4)[n].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = np.argsort(ids.astype(str), kind="stable")
                best.setdefault((dim, label), Best(len(asked[dim][1]), k)).add(asked[dim][1], rows[order], ids[order], which)
        yield from rows_of(best, asked, names)

    return run


def search(index: VectorIndex, queries: DataFrame, k: int = MAX_RESULTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """What ``vector.knn`` gives for the indexed nodes."""
    spark = index.spark
    schema = result_schema(queries)
    asked, passes = in_passes(queries, query_bytes)
    order = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    path = new_path(spark, "nearest")
    for n in range(passes):
        own = by_dim(asked, n)
        first, bounds = {}, {}
        for (label, dim), (cells, rows, radius, centre) in index.directory.items():
            if dim not in own or not len(own[dim][1]):
                continue
            angle = np.arccos(np.clip(own[dim][1] @ centre.T, -1, 1)) if centre.shape[1] else np.zeros((len(own[dim][1]), len(cells)))
            bound = (1 + np.cos(np.maximum(0, angle - radius))) / 2 + _SLACK
            by_bound = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(rows[by_bound], axis=1) - rows[by_bound]
            need = np.zeros_like(bound, bool)
            np.put_along_axis(need, by_bound, before < k, axis=1)
            first[label, dim], bounds[label, dim] = need, bound
        if not first:
            continue
        met = materialise(top(_visited(index, own, first, k, schema)), "nearest_first")
        limits = met.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).toArrow()
        least = {key: v for key, v in zip(zip(limits.column("query_id").to_pylist(), limits.column("label").to_pylist(), strict=True), limits.column("least").to_pylist(), strict=True)}
        then = {}
        for (label, dim), bound in bounds.items():
            limit = np.array([least.get((q, label), -1.0) for q in own[dim][0].to_pylist()])
            then[label, dim] = (bound >= limit[:, None]) & ~first[label, dim]
        met.unionByName(_visited(index, own, then, k, schema)).write.mode("append").parquet(path)
    return top(spark.read.schema(schema).parquet(path)) if exists(spark, path) else spark.createDataFrame([], schema)


def _visited(index: VectorIndex, asked: Asked, need: dict[tuple[str, int], np.ndarray], k: int, schema: str) -> DataFrame:
    """The best rows of the cells that each query needs (by label and length: query by cell)."""
    visits, wanted = {}, {}
    for (label, dim), m in need.items():
        for column, cell in enumerate(index.directory[label, dim][0].tolist()):
            which = np.nonzero(m[:, column])[0]
            if len(which):
                visits[label, dim, cell] = which
                wanted.setdefault((label, dim), set()).add(cell)
    return index.blocks(wanted).mapInArrow(_visitor(asked, visits, k, schema), schema)
