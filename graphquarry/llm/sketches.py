"""Sketches of bounded size: gathered in tasks, merged in streams, and brought to every task.

A task's sketch goes out as compressed blocks of cells. Blocks are merged by their number: a task streams those that it
gets through one array a block, so that it holds a bounded number of cells however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block.
BLOCK = 1 << 14
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BLOCKS = "block int, cells binary"


def places(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A cell of 2**bits for each hash, another in each row."""
    return ((hashes * np.uint64(_ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def blocks_of(cells: np.ndarray) -> pa.RecordBatch:
    """The blocks of an array of 8-bit cells that aren't all 0."""
    cells = np.pad(cells, (0, -len(cells) % BLOCK)).reshape(-1, BLOCK)
    used = np.nonzero(cells.any(axis=1))[0]
    press = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([press.compress(cells[k].tobytes()) for k in used], pa.binary())], names=["block", "cells"])


def _merger(join: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint8)
                held[k] = join(held[k], new) if k in held else new
        press = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([press.compress(x.tobytes()) for x in held.values()], pa.binary())], names=["block", "cells"])

    return run


def capped_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of 8-bit cells that stop at 255."""
    return np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)


def merged(sent: DataFrame, size: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int = 1) -> np.ndarray:
    """The merged array of ``size`` 8-bit cells, which the caller has bounded; it comes to the driver once."""
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = sent.repartition(min(n, -(-size // BLOCK)), "block").mapInArrow(_merger(join), BLOCKS).toArrow()
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
    for k, x in zip(table.column("block").to_pylist(), table.column("cells"), strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint8)
    return out[:size]


class Members:
    """A Bloom filter of 64-bit hashes with two places each: it finds all that were put in, and few others while it is roomy."""

    #: Places for a hash, and the largest filter: 2**28 bits, 32 MB.
    ROOM, LEAST_BITS, MOST_BITS = 32, 17, 28

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in (0, 1):
            at = places(hashes, row, self.bits)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    @classmethod
    def of(cls, hashes: DataFrame, count: int) -> Members:
        """A filter of the column of hashes (long), whose size follows their count up to the limit."""
        bits = max(cls.LEAST_BITS, min(cls.MOST_BITS, (count * cls.ROOM).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = np.zeros(1 << (bits - 3), np.uint8)
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for row in (0, 1):
                    at = places(h, row, bits)
                    np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield blocks_of(data)

        return cls(bits, merged(hashes.mapInArrow(run, BLOCKS), 1 << (bits - 3), np.bitwise_or))


class Counts:
    """A count-min sketch of 8-bit cells that stop at 255: up to there an estimate is never below the true count."""

    ROWS, LEAST_BITS, MOST_BITS = 4, 16, 22

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(self.ROWS << bits, np.uint32) if data is None else data

    def add(self, hashes: np.ndarray) -> None:
        for row in range(self.ROWS):
            part = self.data[row << self.bits : (row + 1) << self.bits]
            part += np.bincount(places(hashes, row, self.bits), minlength=1 << self.bits).astype(np.uint32)

    def blocks(self) -> pa.RecordBatch:
        return blocks_of(np.minimum(self.data, 255).astype(np.uint8))

    def at_least(self, hashes: np.ndarray, least: int) -> np.ndarray:
        """Which of the hashes may have been added so often; none that has is left out. Needs ``least`` of at most 255."""
        out = np.ones(len(hashes), bool)
        for row in range(self.ROWS):
            out &= self.data[(row << self.bits) + places(hashes, row, self.bits)] >= least
        return out

    @classmethod
    def bits_for(cls, texts: DataFrame, text_col: str) -> int:
        """A width that follows the bytes of text, up to 2**MOST_BITS cells a row: 16 MB in all."""
        size = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        return max(cls.LEAST_BITS, min(cls.MOST_BITS, (size // 512).bit_length()))
