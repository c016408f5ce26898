"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings; those kept are the ones that lean most clearly to
toxic documents or away from them. Grades are 0 for labels of 0, and 1 (mild) or 2
(severe) for labels of 1, by how many toxic-leaning words the document holds against the
median of its kind. One weight vector serves all thresholds:
P(grade > j) = sigmoid(x.w - theta_j) with theta_0 < theta_1; the expected severity is the
sum of these probabilities.

Defined cases: null, empty and wordless texts have no features and score by the
thresholds alone; very long texts are read whole; rows with null labels teach nothing, nor do documents
whose label rows differ; of rows that repeat a doc_id the one teaches whose text's hash is least;
with no label 1 every severity is 0; repeated rows each get their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm.quality import agreed, one_text
from graphquarry.plans.storage import discard, materialise

GRADES = 3
#: Features kept, of each leaning; and documents of a label a feature must be in.
FEATURES, LEAST_DOCS = 1500, 3
#: Labelled documents that are learned from at most.
LEARN_DOCS = 20_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """The word itself and its first 4 and 5 letters."""
    return (word, f"{word[:4]}-", f"{word[:5]}-") if len(word) > 5 else (word, f"{word[:4]}-") if len(word) > 4 else (word,)


def word_counts(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in _WORD.findall((text or "").lower()):
        out[w] = out.get(w, 0) + 1
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, label, text): the features of each text, and how often each occurs."""
    for batch in batches:
        names, counts = [], []
        for text in batch.column("text").to_pylist():
            own = feature_counts(text)
            names.append(list(own)), counts.append(list(own.values()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "label", "features", "counts"])


def feature_counts(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, n in word_counts(text).items():
        for f in features(w):
            out[f] = out.get(f, 0) + n
    return out


class Ordinal:
    """Weights of features, and thresholds between grades."""

    def __init__(self, names: list[str]):
        self.names = names
        self.at = {x: k for k, x in enumerate(names)}
        self.w = np.zeros(len(names))
        self.theta = np.array([2.0, 4.0])
        self.never = False

    def weighed(self, counts: dict[str, int]) -> tuple[list[int], list[float]]:
        """Places of known features, and 1 + ln(count) of each."""
        known = [(self.at[f], n) for f, n in counts.items() if f in self.at]
        return [k for k, _ in known], [1 + np.log(n) for _, n in known]

    def sparse(self, text: str | None) -> tuple[list[int], list[float]]:
        """The same of a text, without counting what isn't known."""
        count: dict[int, int] = {}
        for w, n in word_counts(text).items():
            for f in features(w):
                k = self.at.get(f)
                if k is not None:
                    count[k] = count.get(k, 0) + n
        return list(count), [1 + np.log(n) for n in count.values()]

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > 0), P(grade > 1)."""
        if self.never:
            return np.zeros(GRADES - 1)
        k, x = self.sparse(text)
        s = float(np.dot(self.w[k], x)) if k else 0.0
        return 1 / (1 + np.exp(-np.clip(s - self.theta, -30, 30)))

    def fit(self, rows: list[tuple[list[int], list[float]]], grades: np.ndarray, steps: int = 800, rate: float = 0.2, ridge: float = 1e-4, counts_for: np.ndarray | None = None) -> Ordinal:
        n = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        k = np.concatenate([np.array(x, np.int64) for x, _ in rows]) if rows else np.zeros(0, np.int64)
        x = np.concatenate([np.array(v, float) for _, v in rows]) if rows else np.zeros(0)
        gap = np.array([self.theta[0], np.log(np.diff(self.theta)[0])])
        m, v = [np.zeros_like(self.w), np.zeros(2)], [np.zeros_like(self.w), np.zeros(2)]
        weight = np.ones(len(rows)) if counts_for is None else counts_for
        for t in range(1, steps + 1):
            theta = np.array([gap[0], gap[0] + np.exp(gap[1])])
            s = np.bincount(n, weights=self.w[k] * x, minlength=len(rows))
            cum = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))  # P(grade > j)
            full = np.c_[np.ones(len(rows)), cum, np.zeros(len(rows))]
            here = np.maximum(full[np.arange(len(rows)), grades] - full[np.arange(len(rows)), grades + 1], 1e-9)
            slope = np.c_[np.zeros(len(rows)), cum * (1 - cum), np.zeros(len(rows))]
            up, down = slope[np.arange(len(rows)), grades], slope[np.arange(len(rows)), grades + 1]
            ds = -weight * (up - down) / here / len(rows)
            d_theta = np.array([np.sum(weight * ((grades == j + 1) * up - (grades == j) * down) / here) for j in range(2)]) / len(rows)
            g = [np.bincount(k, weights=ds[n] * x, minlength=len(self.w)) + ridge * self.w, np.array([d_theta.sum(), d_theta[1] * np.exp(gap[1])])]
            for j, p in enumerate((self.w, gap)):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
                p -= rate * 0.5 * (1 + np.cos(np.pi * t / steps)) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.theta = np.array([gap[0], gap[0] + np.exp(gap[1])])
        return self


def quotas(counts: dict[int, int], most: int) -> dict[int, int]:
    """How many to draw of each of two labels: half of ``most``, and what the other one leaves."""
    return {k: min(n, max(most // 2, most - counts[1 - k])) for k, n in counts.items()}


def learn(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most: int = LEARN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """A model fitted on at most ``most`` labelled documents, as many of each label as far as there are, chosen by hash of the id.

    A label's documents weigh as much together as they would in a sample drawn without regard to labels.
    To the driver come at most 2 * FEATURES features, and the sample's counts of those.
    """
    marked = agreed(labels, id_col, label_col).filter(F.lit(True) if learnable is None else learnable)
    counts = {0: 0, 1: 0} | {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, quota = sum(counts.values()), quotas(counts, most)
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = None
    for k in (0, 1):
        part = marked.filter((F.col("label") == k) & (place < min(1.0, quota[k] / max(1, counts[k])))).orderBy(place, "doc_id").limit(quota[k])
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = one_text(texts.join(F.broadcast(chosen), "doc_id"))  # at most ``most`` ids
    schema = T.StructType([texts.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    sample = materialise(found.select("doc_id", "label", "text").mapInArrow(counted, schema), "toxic_sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        model = Ordinal([])
        model.never = True
        return model
    seen = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    rate1, rate0 = (F.col("toxic") + 0.5) / float(n[1] + 1), (F.col("clean") + 0.5) / float(n[0] + 1)
    lean = F.log(rate1 / rate0)
    spread = F.sqrt(1.0 / (F.col("toxic") + 0.5) + 1.0 / (F.col("clean") + 0.5))
    seen = seen.filter((F.col("toxic") >= LEAST_DOCS) | (F.col("clean") >= LEAST_DOCS)).withColumn("z", lean / spread).withColumn("lean", lean)
    seen = materialise(seen, "toxic_features")
    toxic = [r["feature"] for r in seen.filter("z > 2.5 and lean > 1.5").orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    clean = [r["feature"] for r in seen.filter("z < -2.5").orderBy("z", "feature").limit(FEATURES // 5).collect()]
    model = Ordinal(sorted(set(toxic) | set(clean)))
    names, leaning = model, set(toxic)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [names.weighed(dict(zip(f, c, strict=True))) for f, c in zip(batch.column("features").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([k for k, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["doc_id", "label", "k", "x"])

    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("k", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sample.mapInArrow(reduce, schema).orderBy("doc_id").collect()
    discard(sample, seen)
    hot = np.array([x in leaning for x in model.names], bool)
    dose = np.array([sum(x for k, x in zip(r["k"], r["x"], strict=True) if hot[k]) for r in rows])
    label = np.array([r["label"] for r in rows])
    middle = np.median(dose[label == 1])
    grades = np.where(label == 0, 0, np.where(dose > middle, 2, 1))
    stands_for = np.array([counts[k] / max(1, quota[k]) for k in (0, 1)]) * sum(quota.values()) / total
    return model.fit([(r["k"], r["x"]) for r in rows], grades, counts_for=stands_for[label])


def grader(model: Ordinal) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.above(x) for x in batch.column("text").to_pylist()]).reshape(-1, GRADES - 1)
            p = np.minimum.accumulate(p, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return run


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected severity (0 to 2), P(toxic), grade and whether it is toxic, of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = (("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType()))
    return slim.mapInArrow(grader(model), T.StructType([slim.schema["doc_id"], *(T.StructField(k, t) for k, t in types)]))
