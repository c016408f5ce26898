"""Exact top-k search by inner product on a bit-sliced index.

Rows are gathered into blocks. Per block and attribute the quantised values, shifted to
be non-negative, are kept as bitmaps, one a bit ("slices"). A query's score of all rows
of a block is the sum of its weighted attributes, added slice by slice with carry-save
adders on whole bitmaps; a negative weight takes the complement. The top rows are then
selected from the most significant slice of the sum downward, and the rows left at the
boundary, which have equal scores, are resolved by id.

The blocks are written once and stay where they were written. Queries go to them: all that
fit QUERY_BYTES at a time, in passes over the index. A task keeps each query's best rows over all
blocks that it reads, passes over blocks whose best possible score is below the query's k-th, and
sends on at most k rows a query.

Defined cases: rows without an id take no part; vectors that are null, empty or hold a null or non-finite component take
no part; vectors of another length than the query's are not compared with it; a query's
own rows are those of its id; a vector whose scores could pass 64 bits (its length times the square of its largest
quantised component is 2**60 or more) raises an error, as no score of it would be right; of repeated query ids the smallest vector asks; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.plans.storage import discard, materialise, new_path

#: Bytes of query vectors that the driver and each task hold in a pass over the index.
QUERY_BYTES = 16 << 20
BLOCKS_A_FILE = 16
BLOCK = "dim int, rows int, low array<bigint>, bits array<int>, ids binary, slices binary"


def quantise(vector: str, scale: int = 64):
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: str):
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def slice_blocks(block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gathers rows (vec_id, v) of a partition into bit-sliced blocks of up to block_rows rows."""

    def pack(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        low = v.min(axis=0)
        u = (v - low).astype(np.uint64)
        width = [max(1, int(x).bit_length()) for x in u.max(axis=0)]
        pad = -len(ids) % 64
        u = np.pad(u, ((0, pad), (0, 0)))
        out = [np.packbits(((u[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little") for d, w in enumerate(width) for b in range(w)]
        return pa.RecordBatch.from_arrays(
            [pa.array([v.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([width], pa.list_(pa.int32())), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate(out).tobytes()], pa.binary())],
            names=["dim", "rows", "low", "bits", "ids", "slices"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x for x, _ in held[dim]])
            v = np.concatenate([x for _, x in held[dim]])
            for k in range(0, len(ids), block_rows):
                yield pack(ids[k : k + block_rows], v[k : k + block_rows])
            held.pop(dim), count.pop(dim)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                v = flat[starts[at][:, None] + np.arange(dim)[None, :]]
                held.setdefault(int(dim), []).append((ids[at], v))
                count[int(dim)] = count.get(int(dim), 0) + len(at)
                if count[int(dim)] >= block_rows:
                    yield from flush(int(dim))
        for dim in list(held):
            yield from flush(dim)

    return run


def add_slices(planes: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum of bitmaps, planes[w] having weight 2**w: one bitmap a weight, by carry-save addition."""
    out, w = [], 0
    while w < len(planes):
        have = planes[w]
        stack = np.concatenate(have) if have else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            if len(stack) == 2:
                a, b = stack
                carry, stack, rest = (a & b)[None], (a ^ b)[None], None
            else:
                n = len(stack) // 3
                a, b, c, rest = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n], stack[3 * n :]
                half = a ^ b
                carry = (a & b) | (c & half)
                stack = np.concatenate([half ^ c, rest]) if len(rest) else half ^ c
            if w + 1 == len(planes):
                planes.append([])
            planes[w + 1].append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        w += 1
    return out


def select_top(total: list[np.ndarray], live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top k, and of the rows tied at the boundary."""
    count = lambda x: int(np.bitwise_count(x).sum())
    sure, tied = np.zeros_like(live), live.copy()
    n_sure = 0
    for plane in reversed(total):
        ones = tied & plane
        n = count(ones)
        if n_sure + n > k:
            tied = ones
        else:
            sure, n_sure = sure | ones, n_sure + n
            tied = tied & ~plane
        if n_sure == k:
            return sure, np.zeros_like(tied)
    return sure, tied


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0]


class Block:
    """A block of the index, as it is searched."""

    def __init__(self, row: dict):
        self.ids, n = np.frombuffer(row["ids"], "<i8"), row["rows"]
        self.words = (n + 63) // 64
        self.planes = np.frombuffer(row["slices"], np.uint64).reshape(-1, self.words)
        self.bits = row["bits"]
        self.first = np.r_[0, np.cumsum(self.bits)]
        self.low = np.array(row["low"], np.int64)
        self.span = np.array([(1 << x) - 1 for x in self.bits], np.int64)
        live = np.zeros(self.words * 64, np.uint8)
        live[:n] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def best_possible(self, queries: np.ndarray) -> np.ndarray:
        """No row's score with a query is above this."""
        return queries @ self.low + np.maximum(queries, 0) @ self.span

    def top(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, but for the query's own."""
        by: list[list[np.ndarray]] = []
        base = int(query @ self.low)
        for d, weight in enumerate(query.tolist()):
            if not weight:
                continue
            own = self.planes[self.first[d] : self.first[d + 1]]
            if weight < 0:
                own, weight, base = ~own, -weight, base + weight * ((1 << self.bits[d]) - 1)
            while len(by) < weight.bit_length() + self.bits[d]:
                by.append([])
            for t in range(weight.bit_length()):
                if weight >> t & 1:
                    for s in range(self.bits[d]):
                        by[t + s].append(own[s : s + 1])
        total = add_slices(by, self.words)
        alive = self.live.copy()
        for r in np.nonzero(self.ids == own_id)[0]:
            alive[r // 64] &= ~np.uint64(1 << int(r % 64))
        sure, tied = select_top(total, alive, k)
        sure, tied = rows_of(sure), rows_of(tied)
        if len(sure) + len(tied) > k:
            tied = tied[np.argsort(self.ids[tied], kind="stable")[: k - len(sure)]]
        rows = np.r_[sure, tied].astype(np.int64)
        score = np.full(len(rows), base, np.int64)
        for w, plane in enumerate(total):
            score += ((plane[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], score


class Best:
    """Each query's k best rows so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # k-th score, where there are k

    def add(self, block: Block) -> None:
        for n in np.nonzero(block.best_possible(self.queries) >= self.least)[0].tolist():
            rows, scores = block.top(int(self.ids[n]), self.queries[n], self.k)
            rows, scores = np.r_[self.rows[n], rows], np.r_[self.scores[n], scores]
            keep = np.lexsort((rows, -scores))[: self.k]
            self.rows[n], self.scores[n] = rows[keep], scores[keep]
            if len(keep) == self.k:
                self.least[n] = scores[keep[-1]]


def search_blocks(asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Top k over all blocks of a task for queries given as dim: (ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, q, k) for dim, (ids, q) in asked.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in best:
                    best[row["dim"]].add(Block(row))
        for b in best.values():
            for at in range(0, len(b.ids), 4096):
                rows, scores = b.rows[at : at + 4096], b.scores[at : at + 4096]
                names = np.repeat(b.ids[at : at + 4096], [len(x) for x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, np.concatenate(rows), np.concatenate(scores))], names=["query_id", "vec_id", "score"])

    return run


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    slim = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    small = F.size("e") * F.pow(scale * F.array_max(F.transform("e", lambda x: F.abs(x.cast("double")))) + 1, 2.0) < float(1 << 60)
    fits = F.when(small, True).otherwise(F.raise_error(F.concat(F.lit("vector too large for 64-bit scores: "), F.col("vec_id").cast("string"))).cast("boolean"))
    # one condition, so that it is only asked of vectors that take part
    takes_part = F.when(usable("e") & F.col("vec_id").isNotNull(), fits).otherwise(False)
    return slim.filter(takes_part).select("vec_id", quantise("e", scale).alias("v"))


def build_index(candidates: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = 8192) -> DataFrame:
    """The bit-sliced index of all rows that take part, written, BLOCKS_A_FILE blocks a file, so that tasks can share it out."""
    return materialise(usable_vectors(candidates, id_col, vector_col, scale).mapInArrow(slice_blocks(block_rows), BLOCK), "slices", maxRecordsPerFile=BLOCKS_A_FILE)


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with the rows of an index."""
    spark = index.sparkSession
    asked = usable_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialise(asked, "queries")
    size = asked.agg(F.sum(8 * F.size("v").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // query_bytes))
    if passes > 1:
        whole = asked
        asked = materialise(asked.withColumn("pass", F.pmod(F.xxhash64("vec_id"), F.lit(passes)).cast("int")), "queries", "pass")
        discard(whole)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def one(n: int) -> DataFrame:
        table = (asked if passes == 1 else asked.filter(F.col("pass") == n)).select("vec_id", "v").toArrow()
        ids, lists = table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        by_dim = {int(d): (ids[sizes == d], flat[starts[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}
        part = index.mapInArrow(search_blocks(by_dim, k), "query_id bigint, vec_id bigint, score bigint")
        return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if passes == 1:
        return one(0)
    path = new_path(spark, "top-k")
    for n in range(passes):
        one(n).write.mode("append").parquet(path)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(path)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = 8192, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The same over an index made for the call."""
    return search(build_index(candidates, id_col, vector_col, scale, block_rows), queries, k, id_col, vector_col, scale, query_bytes)
