"""Quality classification by a byte-level convolutional network in numpy.

A document's bytes are embedded; filters of WIDTH bytes, STRIDE apart, run over all of
it, beside one input channel that marks bytes repeating the 8 bytes some 2 to 40 bytes
before. The filters' responses are averaged in overlapping chunks, each chunk goes
through a second layer, chunks are max-pooled and the pooled units give one probability.
Filters, embedding and layers are learned by gradient descent on a bounded sample.

Defined cases: null and empty texts are scored as one blank chunk; very long texts are
scored whole, in blocks that give the same chunks; rows with null labels teach nothing, nor do documents
whose label rows differ; of rows that repeat a doc_id the one teaches whose text's hash is least; with no labels, or labels
of one kind only, every score is the share of label 1 (0.5 without any); repeated rows
each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.plans.storage import materialise

EMBED, WIDTH, STRIDE, FILTERS, UNITS = 6, 8, 4, 16, 16
#: Positions of the filters in a chunk (256 bytes), and from one chunk to the next.
CHUNK, HOP = 64, 32
#: Labelled documents that are learned from at most, about, and their bytes in all.
LEARN_DOCS, LEARN_BYTES = 3000, 9_000_000
#: Bytes scored at once.
BLOCK = 1 << 20
LAGS = range(2, 41)


def repeats(b: np.ndarray) -> np.ndarray:
    """1 where the 8 bytes that start here are also found 2 to 40 bytes before."""
    n = len(b) - 7
    out = np.zeros(len(b), np.float32)
    if n <= LAGS[0]:
        return out
    w = np.zeros(n, np.uint64)
    for k in range(8):
        w |= b[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    hit = np.zeros(n, bool)
    for lag in LAGS:
        if lag < n:
            hit[lag:] |= w[lag:] == w[:-lag]
    out[:n] = hit
    return out


def padded(data: bytes) -> bytes:
    """Blanks up to one chunk at least, and to a whole number of strides."""
    data = data.ljust(CHUNK * STRIDE + WIDTH - STRIDE, b" ")
    return data + b" " * (-(len(data) - WIDTH) % STRIDE)


def positions(data: bytes) -> int:
    return (len(data) - WIDTH) // STRIDE + 1


def windows(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and repeat marks of padded data under the filter positions from first to last - 1: two arrays of (positions, WIDTH).

    The marks are those that the whole data has there.
    """
    start, stop = first * STRIDE, (positions(data) if last is None else last) * STRIDE + WIDTH - STRIDE
    before, behind = max(0, start - LAGS[-1]), min(len(data), stop + 7)
    around = np.frombuffer(data[before:behind], np.uint8)
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x[start - before : stop - before], WIDTH)[::STRIDE]
    return view(around), view(repeats(around))


def chunk_starts(positions: int) -> np.ndarray:
    """Overlapping chunks over all positions; the last one ends with the document."""
    last = positions - CHUNK
    return np.unique(np.r_[np.arange(0, last + 1, HOP), last])


class Network:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        norm = lambda *s, scale: g.normal(0, scale, s).astype(np.float32)
        self.p = {
            "emb": norm(256, EMBED, scale=0.5),
            "w": norm(WIDTH, EMBED + 1, FILTERS, scale=0.2),
            "b": np.zeros(FILTERS, np.float32),
            "v": norm(FILTERS, UNITS, scale=0.4),
            "c": np.zeros(UNITS, np.float32),
            "u": norm(UNITS, scale=0.3),
            "o": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each of the WIDTH places."""
        return np.einsum("be,kef->kbf", self.p["emb"], self.p["w"][:, :EMBED])

    def chunk_means(self, data: bytes, starts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Mean responses of the filters in the chunks of padded data that begin at ``starts``, in order."""
        first = int(starts[0])
        b, rep = windows(data, first, int(starts[-1]) + CHUNK)
        h = rep @ self.p["w"][:, EMBED] + self.p["b"]
        for k in range(WIDTH):
            h += tables[k][b[:, k]]
        np.maximum(h, 0, out=h)
        total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(h, axis=0, dtype=np.float64)])
        s = starts - first
        return ((total[s + CHUNK] - total[s]) / CHUNK).astype(np.float32)

    def score(self, data: bytes, tables: np.ndarray) -> float:
        """The probability of label 1; chunks are gone through in blocks of about BLOCK bytes."""
        if self.constant is not None:
            return self.constant
        data = padded(data)
        starts, best = chunk_starts(positions(data)), None
        step = max(1, BLOCK // (HOP * STRIDE))
        for k in range(0, len(starts), step):
            g = np.maximum(self.chunk_means(data, starts[k : k + step], tables) @ self.p["v"] + self.p["c"], 0).max(axis=0)
            best = g if best is None else np.maximum(best, g)
        return float(1 / (1 + np.exp(-np.clip(best @ self.p["u"] + self.p["o"][0], -30, 30))))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
        if len(texts) == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(texts) else 0.5
            return self
        g = np.random.default_rng(seed)
        p = self.p
        self.p["o"][0] = np.log(labels.mean() / (1 - labels.mean()))
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        inputs = [windows(padded(x)) for x in texts]
        size = 16
        for epoch in range(epochs):
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = g.permutation(len(texts))
            for k in range(0, len(order), size):
                grad = self.gradient([inputs[i] for i in order[k : k + size]], labels[order[k : k + size]])
                t += 1
                for key in p:
                    m[key] = 0.9 * m[key] + 0.1 * grad[key]
                    v[key] = 0.999 * v[key] + 0.001 * grad[key] ** 2
                    p[key] -= (lr * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def gradient(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, over some documents' windows."""
        p = self.p
        starts, at = [], 0
        for b, _ in docs:
            starts.append(at + chunk_starts(len(b)))
            at += len(b)
        b, rep = np.concatenate([x for x, _ in docs]), np.concatenate([x for _, x in docs])
        s = np.concatenate(starts)
        doc = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
        first = np.r_[0, np.cumsum([len(x) for x in starts])[:-1]]
        x = np.concatenate([p["emb"][b], rep[:, :, None]], axis=2).reshape(len(b), -1)
        w = p["w"].reshape(-1, FILTERS)
        h = np.maximum(x @ w + p["b"], 0)
        total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(h, axis=0, dtype=np.float64)])
        mean = ((total[s + CHUNK] - total[s]) / CHUNK).astype(np.float32)
        a = np.maximum(mean @ p["v"] + p["c"], 0)
        z = np.maximum.reduceat(a, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["o"], -30, 30)))
        d = ((y - labels) / len(docs)).astype(np.float32)
        out = {"o": np.array([d.sum()], np.float32), "u": z.T @ d}
        dz = d[:, None] * p["u"]
        rank = np.where(a == z[doc], np.arange(len(a))[:, None], len(a))
        winner = np.minimum.reduceat(rank, first, axis=0)
        da = np.zeros_like(a)
        cols = np.broadcast_to(np.arange(UNITS), winner.shape)
        da[winner, cols] = dz * (a[winner, cols] > 0)
        out["v"], out["c"] = mean.T @ da, da.sum(axis=0)
        live = np.nonzero(da.any(axis=1))[0]
        dmean = (da[live] @ p["v"].T) / CHUNK
        change = np.zeros((len(b) + 1, FILTERS), np.float64)
        np.add.at(change, s[live], dmean)
        np.add.at(change, s[live] + CHUNK, -dmean)
        touched = np.unique((s[live][:, None] + np.arange(CHUNK)).ravel())
        dh = (np.cumsum(change, axis=0)[touched] * (h[touched] > 0)).astype(np.float32)
        xt = x[touched]
        out["w"], out["b"] = (xt.T @ dh).reshape(p["w"].shape), dh.sum(axis=0)
        dx = (dh @ w.T).reshape(len(touched), WIDTH, EMBED + 1)[:, :, :EMBED].reshape(-1, EMBED)
        flat = b[touched].ravel()
        out["emb"] = np.stack([np.bincount(flat, weights=dx[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(np.float32)
        return out


def within(sizes: list[tuple[int, int]], budget: int) -> list[int]:
    """Of (row, size) in turn, the rows that fit what is left of the budget; the smallest row where none fits."""
    picked, left = [], budget
    for row, size in sizes:
        if size <= left:
            picked.append(row)
            left -= size
    return picked or [row for row, _ in sorted(sizes, key=lambda x: x[1])[:1]]


def agreed(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label) of documents whose label rows all say the same, 0 or 1; nulls don't count."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_high")).filter("label = _high and label in (0, 1)").select("doc_id", "label")


def one_text(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: that whose text's hash is least."""
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.groupBy("doc_id", *others).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_first")).select("doc_id", "_first.text", *others)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = LEARN_DOCS, most_bytes: int = LEARN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network fitted on at most ``most`` labelled documents, as many of each label, chosen by hash of the id.

    The sample comes to the driver: ``most_bytes`` of text at most, half of it of each label. A document that
    doesn't fit what is left is passed over; where none of a label fits, its shortest is read up to the limit.
    """
    marked = agreed(labels, id_col, label_col).filter(learnable)
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Network().fit([], np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / 2 / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    likely = marked.filter(place / F.lit(float(1 << 20)) < share[F.col("label")]).withColumn("place", place)
    chosen = None
    for k in counts:
        part = likely.filter(F.col("label") == k).orderBy("place", "doc_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = one_text(texts.join(F.broadcast(chosen), "doc_id"))  # at most ``most`` ids
    sample = materialise(found.withColumn("row", F.monotonically_increasing_id()), "quality_sample")
    size = F.octet_length("text").cast("long").alias("size")
    listed = sample.select("row", "label", size).orderBy("place", "doc_id", F.xxhash64("text")).collect()
    picked = [n for k in counts for n in within([(r["row"], r["size"]) for r in listed if r["label"] == k], most_bytes // 2)]
    text = F.substring(F.col("text").cast("binary"), 1, most_bytes // 2).alias("text")
    wanted = docs.sparkSession.createDataFrame([(n,) for n in picked], "row long")
    rows = sample.join(F.broadcast(wanted), "row").select("doc_id", text, "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Network().fit([bytes(r["text"]) for r in rows], np.array([r["label"] for r in rows], np.float32))


def scorer(network: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            found = [network.score(x.as_buffer().to_pybytes() if x.is_valid else b"", tables) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(scorer(network), T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())]))
