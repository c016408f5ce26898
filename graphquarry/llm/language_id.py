"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3 letters, words padded
with a blank), ranked. A document is profiled the same way over its whole text, and its
distance to a language is the sum over its n-grams of how far out of place each one is;
an n-gram that the language lacks counts as the full profile length.

Defined cases: null, empty and letterless texts give ``und`` with score 0, digits of any
kind not being letters; ties between
languages go to the smaller name; rows with a null text or language teach nothing; with
nothing learned every text is ``und``; repeated rows each get their row; very long texts
are profiled whole, in pieces whose counts are added; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.plans.storage import discard, materialise

#: N-grams in a profile.
PROFILE = 400
#: Documents a language that the profiles are learned from, chosen by hash of the id.
LEARN_DOCS = 2000
#: Counts of n-grams that a task holds before it passes them on; languages whose counts are sent to all tasks.
HELD, SENT = 1_000_000, 10_000
#: Characters that are profiled at once.
PIECE = 1 << 20
UNDETERMINED = "und"
_GAP = re.compile(r"[\W\d_]+")
_BLANK = 32


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as integers, and how often each occurs."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        while stop < len(text) and not _GAP.match(text[stop]) and stop - start < 2 * PIECE:
            stop += 1
        words = _GAP.sub(" ", text[start:stop].lower()).strip()
        start = stop
        if not words:
            continue
        c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        one, two = c[c != _BLANK], (c[:-1] << np.uint64(21)) | c[1:]
        three = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[c[1:-1] != _BLANK]
        found = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if total is None:
            total = found
        else:
            grams, at = np.unique(np.concatenate([total[0], found[0]]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([total[1], found[1]])).astype(np.int64)
            total = grams, counts
    return total if total is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order, ties by the n-gram's number."""
    if len(grams) > 4 * most:
        least = np.partition(counts, -most)[-most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:most]]


class Profiles:
    """Profiles of some languages, laid out by n-gram: which languages have it, and at what rank."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.languages = sorted(profiles)
        grams = np.concatenate([np.zeros(0, np.uint64), *(profiles[x] for x in self.languages)])
        order = np.argsort(grams, kind="stable")
        self.lang = np.repeat(np.arange(len(self.languages)), [len(profiles[x]) for x in self.languages])[order]
        self.rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(profiles[x])) for x in self.languages)])[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.r_[first, len(grams)]

    def apart(self, own: np.ndarray) -> np.ndarray:
        """Distance of a profile to each language."""
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        place = np.nonzero(self.grams[at] == own)[0]
        begin, many = self.first[at[place]], np.diff(self.first)[at[place]]
        row = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        near = PROFILE - np.minimum(np.abs(self.rank[row] - np.repeat(place, many)), PROFILE)
        return PROFILE * len(own) - np.bincount(self.lang[row], weights=near, minlength=len(self.languages)).astype(np.int64)

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the nearest distance as a share of the largest possible."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        own = ranked(*gram_counts(text))
        if not len(own):
            return UNDETERMINED, 0.0
        apart = self.apart(own)
        best = int(np.argmin(apart))
        return self.languages[best], 1.0 - float(apart[best]) / (PROFILE * len(own))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition's texts, added up before they are dealt out, as far as HELD entries go."""
    total: dict[str, dict[int, int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])
        total.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            grams, counts = gram_counts(text)
            own = total.setdefault(lang, {})
            for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                own[g] = own.get(g, 0) + n
        if sum(map(len, total.values())) > HELD:
            yield from flush()
    yield from flush()


def learn(docs: DataFrame, learnable: Column, per_language: int = LEARN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from at most about ``per_language`` documents of each language.

    The share of a language's documents that is read follows from their number, and a
    document is in it by hash of its id. The profiles come to the driver: PROFILE n-grams, some
    3 kB, for every language that occurs.
    """
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = counts.limit(SENT + 1).count() <= SENT
    drawn = usable.join(F.broadcast(counts) if few else counts.hint("merge"), "lang").filter(place < F.lit(float(per_language)) / F.col("n"))
    part = drawn.select("lang", "text").mapInArrow(count_grams, "lang string, gram bigint, n bigint")
    total = part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    found: dict[str, list] = {}
    for r in top.orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    discard(counts)
    return Profiles({k: np.array(v, np.int64).astype(np.uint64) for k, v in found.items()})


def predictor(profiles: Profiles, id_type: pa.DataType | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.classify(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return slim.mapInArrow(predictor(profiles), schema)


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language: neither ``und`` nor scored under ``least``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.classify(x.as_py()) for x in batch.column(names.index(text_col))]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
