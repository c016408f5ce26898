"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

Texts are split by the pre-tokenizer's pattern. The distinct words of a chunk of texts
are laid out as one sequence of symbols; an inverted index holds, for each merge that is
possible in it, the positions of its pairs. Merges are applied in rank order, each to all
its positions, and only the two neighbours of a merged pair are looked up again. Words
are encoded once a chunk and kept, within bounds, for later chunks; no step moves rows
between tasks, so that a lost executor costs only its own partitions.

Defined cases: null counts as empty; an empty text has no ids; very long texts are one
chunk of their own; repeated rows each get their row; an empty table gives an empty
result; other columns are ignored; bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose new words are encoded together.
CHUNK = 4_000_000
#: Words a worker keeps encoded; older ones go when twice as many are held.
KEPT_WORDS = 400_000


class Vocabulary:
    """Byte strings and their ranks, which are also their ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, int] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, left: int, right: int) -> int:
        """The id that two neighbouring symbols merge to, or -1."""
        key = left << 20 | right
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return got

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all merges being applied to all words in rank order."""
        of_byte, merged = self.of_byte, self.merged
        sym: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([of_byte[b] for b in w])
            sym.append(-1)  # ends a word
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for at in range(1, n - 1):
            left, right = sym[at], sym[at + 1]
            if left >= 0 and right >= 0 and (m := merged(left, right)) >= 0:
                if m in index:
                    index[m].append(at)
                else:
                    index[m] = [at]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, at in enumerate(places):
                left = sym[at]
                if left < 0:
                    continue
                nxt = after[at]
                right = sym[nxt]
                if right < 0 or merged(left, right) != rank:
                    continue
                sym[at], sym[nxt] = rank, -2  # swallowed
                after[at] = end = after[nxt]
                before[end] = at
                lower = False
                prev, tail = before[at], sym[end]
                if sym[prev] >= 0 and (m := merged(sym[prev], rank)) >= 0:
                    if m in index:
                        index[m].append(prev)
                    else:
                        index[m] = [prev]
                        heapq.heappush(heap, m)
                    lower = m < rank
                if tail >= 0 and (m := merged(rank, tail)) >= 0:
                    if m in index:
                        index[m].append(at)
                    else:
                        index[m] = [at]
                        heapq.heappush(heap, m)
                    lower = lower or m < rank
                if lower:  # a merge that comes earlier has become possible
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(heap, rank)
                    break
        out = []
        for s in starts:
            ids = []
            while sym[s] >= 0:
                ids.append(sym[s])
                s = after[s]
            out.append(ids)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(x) for x in texts]
        wanted: set[str] = set().union(*split) if split else set()
        if len(self.new) + len(wanted) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        known: dict[str, bytes] = {}
        missing = []
        new, old = self.new, self.old
        for w in wanted:
            got = new.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    missing.append(w)
                    continue
            known[w] = got
        for w, ids in zip(missing, self.replay([w.encode() for w in missing]), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        if len(known) <= KEPT_WORDS:
            new.update(known)
        return [b"".join(map(known.__getitem__, x)) for x in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One a worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` bytes together, and where each starts; null is empty."""
    start, held, size = 0, [], 0
    for k, x in enumerate(column):
        data = x.as_buffer().to_pybytes() if x.is_valid else b""
        held.append(data.decode("utf-8", "replace"))
        size += len(data)
        if size >= most:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def encoder(path: str, pattern: str, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for start, texts in chunks(batch.column("text")):
                ids = v.encode_all(texts)
                key = batch.column(0).slice(start, len(texts))
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    columns = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids])]
                    yield pa.RecordBatch.from_arrays([key, n, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([key, n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row."""
    slim = _slim(docs, id_col, text_col)
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return slim.mapInArrow(encoder(path, pattern, False), schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of every row; null ids give null."""
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else v.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, without moving the ids."""
    slim = _slim(docs, id_col, text_col)
    text = [T.StructField(x, T.StringType()) for x in ("ids_sha256", "decoded_sha256")]
    return slim.mapInArrow(encoder(path, pattern, True), T.StructType([slim.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *text]))
