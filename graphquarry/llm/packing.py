"""Best-fit packing of documents into sequences of a fixed number of tokens.

Token counts are integers up to the capacity, so the plan is made on a histogram of at
most ``capacity`` lengths: pieces above one third of the capacity, of which no three fit
together, are matched greedily in at most pairs, the longest with the longest that fits;
smaller ones, longest first, go where they leave the smallest gap. A plan is a list of
slots, "the a-th to b-th piece of length L stand at offset o of sequences s to s+b-a";
each piece finds its slot by its number among the pieces of its length. The numbers come
from salted groups, whose sizes are added up first, so that no length gathers in one task;
a length has as many groups as bound their pieces, or their bytes where ids come along.

Defined cases: null counts as empty; an empty text is one piece holding only the end id;
texts beyond the capacity are cut into full pieces, the first taking what is left over;
added tokens' strings in a text give those tokens' ids; repeated rows are packed each;
equal lengths are numbered in groups, there by id, piece and checksum; an empty table gives an empty result; other
columns are ignored; bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.bpe import chunks
from graphquarry.plans.storage import materialise

CAPACITY = 1024
END_ID = 2
#: Words a worker keeps encoded; older ones go when twice as many are held.
KEPT_WORDS = 250_000
#: Bytes of the batches that workers get.
BATCH_BYTES = 4 << 20
#: Pieces that are numbered in one group, about, and bytes where they carry their ids.
GROUP = 25_000
GROUP_BYTES = 8 << 20


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first, last + 1, sequence of the first, offset) for so many pieces of each length."""
    slots: list[tuple[int, int, int, int, int]] = []
    used = {n: 0 for n in histogram}
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    sizes: list[int] = []
    sequences = 0

    def put(length: int, many: int, first: int, offset: int) -> None:
        slots.append((length, used[length], used[length] + many, first, offset))
        used[length] += many
        left[length] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while k >= 0 and (not left[large[k]] or (large[k] == n and left[n] < 2)):
                k -= 1
            other = large[k] if k >= 0 else None
            if other is None:
                many = left[n]
                put(n, many, sequences, 0)
                leave(capacity - n, sequences, many)
            else:
                many = left[n] // 2 if other == n else min(left[n], left[other])
                put(n, many, sequences, 0)
                put(other, many, sequences, n)
                leave(capacity - n - other, sequences, many)
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(sizes, n)
            if k == len(sizes):
                fit = capacity // n
                many = max(1, left[n] // fit)
                leave(capacity, sequences, many)
                sequences += many
                continue
            gap = sizes[k]
            first, many = gaps[gap].pop()
            fit = min(gap // n, left[n])
            whole = min(many, left[n] // fit)
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            for j in range(fit):
                put(n, whole, first, capacity - gap + j * n)
            leave(gap - fit * n, first, whole)
            leave(gap, first + whole, many - whole)
    return slots


def _letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Ids(dict):
    """Ids of words as bytes; a word that is missing is encoded by the tokenizer's model."""

    def __init__(self, model, old: dict[str, bytes]):
        super().__init__()
        self.model, self.old, self.letters = model, old, _letters()

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
            got = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = got
        return got


class WordTokens:
    """Ids of texts by a byte-level tokenizer, each distinct word of the pre-tokenizer's pattern being encoded once.

    Texts are split at the tokenizer's added tokens first, as the library does.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take in or look at their surroundings aren't supported")
        self.added = {t.content: struct.pack("<I", k) for k, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pattern = regex.compile(pattern)
        self.ids = _Ids(self.model, {})

    def encode(self, text: str) -> bytes:
        if len(self.ids) > KEPT_WORDS:
            old, self.ids.old = self.ids, {}
            self.ids = _Ids(self.model, old)
        if not any(x in text for x in self.added):
            return b"".join(map(self.ids.__getitem__, self.pattern.findall(text)))
        out = []
        for k, part in enumerate(self.split.split(text)):
            out += [self.added[part]] if k % 2 else map(self.ids.__getitem__, self.pattern.findall(part))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(x) for x in texts]


_LOADED: dict[tuple[str, str], WordTokens] = {}


def cutter(path: str, pattern: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _LOADED.get((path, pattern))
        if tokens is None:
            tokens = _LOADED[path, pattern] = WordTokens(path, pattern)
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                source, number, start, length, crc, cut = [], [], [], [], [], []
                for k, ids in enumerate(tokens.encode_all(texts)):
                    ids += end
                    n = len(ids) // 4
                    edge = (n - 1) % capacity + 1
                    for piece, at in enumerate([0, *range(edge, n, capacity)]):
                        stop = edge if piece == 0 else at + capacity
                        part = ids[4 * at : 4 * stop]
                        source.append(begin + k), number.append(piece), start.append(at), length.append(stop - at), crc.append(zlib.crc32(part))
                        if with_ids:
                            cut.append(part)
                columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())] if with_ids else columns, names=[*names, "ids"] if with_ids else names)

    return run


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [slim.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return slim.mapInArrow(cutter(path, pattern, capacity, end_id, with_ids), T.StructType(fields))


def salts(histogram: dict[int, int], capacity: int, with_ids: bool) -> list[int]:
    """How many groups the pieces of each length, from 1 to the capacity, are numbered in."""
    most = [min(GROUP, GROUP_BYTES // (4 * n) + 1) if with_ids else GROUP for n in range(1, capacity + 1)]
    return [max(1, -(-histogram.get(n, 0) // m)) for n, m in enumerate(most, 1)]


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``rows`` with sequence_id and offset; lengths run from 1 to the capacity.

    ``rows`` is read three times and should be a written table; a column ``ids`` is moved once.
    To the driver come the histogram (at most ``capacity`` rows); the plan that is sent out has
    a few slots a length.
    """
    spark = rows.sparkSession
    counts = {r["n"]: r["c"] for r in rows.groupBy(F.col(length_col).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "_length long, _first long, _end long, _sequence long, _offset long")
    groups = F.get(F.lit(salts(counts, capacity, "ids" in rows.columns)), F.col(length_col).cast("int") - 1)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), groups))
    sizes = salted.groupBy(length_col, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(length_col, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order_cols))
    numbered = salted.withColumn("_own", own).join(sizes, [length_col, "_salt"]).withColumn("_at", F.col("_before") + F.col("_own") - 1)
    here = (F.col(length_col) == F.col("_length")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))
    placed = numbered.join(F.broadcast(slots), here)
    return placed.select(*rows.columns, (F.col("_sequence") + F.col("_at") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, each with its place."""
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        written = materialise(pieces(docs, path, pattern, capacity, end_id, with_ids, id_col, text_col), "pieces")
    return pack(written, capacity, order_cols=("doc_id", "piece", "ids_crc32"))
