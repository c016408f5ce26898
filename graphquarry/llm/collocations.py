"""Phrases of two to four words that hold together, found by generalised suffix automata.

Each shard of documents gets one automaton of its word sequences, cut at MOST words. It is made level by level: a node of depth d is a
sequence of d words of one language; it is reached from the node of its first d - 1 words, and its suffix link leads to
the node of its last d - 1 words. With every node stands how often it ends somewhere in the shard.

1. Hashes of nodes and their counts are summed over all shards, first at the depths 1 and 2, then at 3 and 4, where a node is
   only made if the node it is reached from and the one its link leads to may be frequent. A count of a hash is never
   below that of a phrase with that hash, so no frequent phrase is lost.
2. The automata are made once more, of nodes that may be frequent, and give their phrases; those are counted by their text,
   so that the counts are exact.
3. Candidates are scored by their cuts. The longer ones hand their counts down along the links, to what they are
   reached from and what their links lead to; a phrase goes if a longer one with at least SHARE of its count arrives.

Which nodes may be frequent comes to the tasks as a Bloom filter, of 32 MB at most; beyond that it lets more through, and
the result stays the same.

Defined cases: null, empty and blank texts have no words; a null language is ``und``; rows that repeat an id, or a text, count each; a language without candidates has no
rows; texts longer than SHARD_BYTES are read in slices that end where a piece does; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.sketches import Members
from graphquarry.llm.words import Words, mark, scramble, slices, table
from graphquarry.plans.storage import discard, materialise

LEAST, MOST = 30, 4
#: Of a phrase's count, in per cent, with which a longer one stands for it.
SHARE = 80
SCALE = 2_000_000
#: Phrases of a language that are reported.
TOP = 2000
#: Parts that a language's phrases are ranked in before they are ranked together.
PARTS = 32
SHARD_BYTES = 1 << 19
#: Bytes of text that reach a task at once.
BATCH_BYTES = 4 << 20
#: Bytes between pieces, and between words.
BREAK = table(*b".,;:!?", range(0x0A, 0x0E))
BETWEEN = table(0x20, 0x09, *b".,;:!?", range(0x0A, 0x0E))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASHED, _COUNTED = "hash bigint, n bigint", "lang string, phrase binary, n bigint"


class Automaton:
    """The suffix automaton of a shard (lang, text), cut at ``depth`` words.

    For each depth, of its nodes: ``count`` of ends, ``end``, a word at which one ends, ``came`` from, the node of all words but the last, and ``link``,
    the node of all but the first; ``hashes`` depend on language and words only. Nodes that ``frequent`` rules out, and what would come from
    them or link to them, are left out.
    """

    def __init__(self, texts: list[tuple[str, bytes]], depth: int = MOST, frequent: Members | None = None, known: int = MOST):
        """``known``: the depth up to which ``frequent`` knows the nodes."""
        self.words = w = Words([x for _, x in texts], BETWEEN)
        self.langs = sorted({x for x, _ in texts})
        lang = np.array([self.langs.index(x) for x, _ in texts], np.int64)[w.text]
        marks = np.array([mark(x) for x in self.langs], np.uint64)
        place = np.arange(len(w))
        number, first = w.numbered(place, lang)
        broken = np.cumsum(BREAK[w.bytes])
        new = np.r_[True, (w.text[1:] != w.text[:-1]) | (broken[w.begin[1:]] != broken[w.end[:-1] - 1])][: len(w)]
        run = place - np.maximum.accumulate(np.where(new, place, 0)) + 1 if len(w) else place
        self.lang = lang
        self.count, self.end, self.came, self.link, self.hashes = [np.bincount(number, minlength=len(first))], [first], [None], [None], [scramble(w.hash[first] + marks[lang[first]])]
        at = number.copy()  # the node that ends at each word, at the depth before
        self._rule_out(at, frequent, 1, known)
        kinds = len(first)
        for d in range(2, depth + 1):
            ends = np.nonzero((run >= d) & (at >= 0))[0]
            ends = ends[at[ends - 1] >= 0]
            pair, first, inverse, count = np.unique(at[ends - 1] * kinds + number[ends], return_index=True, return_inverse=True, return_counts=True)
            self.came.append(pair // kinds)
            self.link.append(at[ends][first])
            self.end.append(ends[first])
            self.count.append(count)
            self.hashes.append(scramble(self.hashes[-1][self.came[-1]] * _MIX + w.hash[self.end[-1]] + np.uint64(d)))
            at = np.full(len(w), -1, np.int64)
            at[ends] = inverse
            self._rule_out(at, frequent, d, known)

    def _rule_out(self, at: np.ndarray, frequent: Members | None, depth: int, known: int) -> None:
        if frequent is not None and depth <= known and len(self.hashes[-1]):
            at[(at >= 0) & ~frequent.has(self.hashes[-1])[at]] = -1

    def phrase(self, depth: int, node: int) -> bytes:
        end = int(self.end[depth - 1][node])
        return b" ".join(self.words.word(k) for k in range(end - depth + 1, end + 1))


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Texts (lang, text) in lower case, in shards of about ``most`` bytes; long ones in slices, cut between pieces."""
    texts: list[tuple[str, bytes]] = []
    size = 0
    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in slices(x.as_buffer().to_pybytes().lower() if x.is_valid else b"", most, BREAK):
                texts.append((lang, part))
                size += len(part)
                if size >= most:
                    yield texts
                    texts, size = [], 0
    if texts:
        yield texts


def hasher(shard_bytes: int, depths: tuple[int, ...], frequent: Members | None = None, known: int = 0):
    """Hashes and counts of the shards' nodes at some depths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in shards(batches, shard_bytes):
            a = Automaton(texts, max(depths), frequent, known)
            for d in depths:
                yield pa.RecordBatch.from_arrays([pa.array(a.hashes[d - 1].view(np.int64)), pa.array(a.count[d - 1].astype(np.int64))], names=["hash", "n"])

    return run


def phraser(shard_bytes: int, frequent: Members):
    """Phrases, and counts, of the shards' nodes that may be frequent; a null phrase has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in shards(batches, shard_bytes):
            a = Automaton(texts, MOST, frequent)
            totals = np.bincount(a.lang, minlength=len(a.langs))
            lang, phrase, n = list(a.langs), [None] * len(a.langs), totals.tolist()
            for d in range(1, MOST + 1):
                nodes = np.nonzero(frequent.has(a.hashes[d - 1]))[0]
                lang += [a.langs[k] for k in a.lang[a.end[d - 1][nodes]].tolist()]
                phrase += [a.phrase(d, k) for k in nodes.tolist()]
                n += a.count[d - 1][nodes].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return run


def _frequent(texts: DataFrame, run, least: int) -> DataFrame:
    return materialise(texts.mapInArrow(run, _HASHED).groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash"), "frequent_hashes")


def handed_down(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, _longer) of what the phrases of three words and more are reached from, and of what their links lead to."""
    longer = phrases.filter(F.size(F.split("phrase", " ")) > 2)
    came, link = F.regexp_replace("phrase", " [^ ]*$", ""), F.regexp_replace("phrase", "^[^ ]* ", "")
    return longer.select("lang", F.explode(F.array(came, link)).alias("phrase"), "_longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with batch_bytes(spark, BATCH_BYTES):
        short = _frequent(texts, hasher(shard_bytes, (1, 2)), least)
        some = context.broadcast(Members.of(short, short.count()))
        long = _frequent(texts, lambda batches: hasher(shard_bytes, (3, 4), some.value, 2)(batches), least)
        every = short.unionByName(long)
        most = context.broadcast(Members.of(every, every.count()))
        sent = texts.mapInArrow(lambda batches: phraser(shard_bytes, most.value)(batches), _COUNTED)
        counted = sent.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("phrase").isNull() | (F.col("n") >= least))
        counted = materialise(counted.withColumn("phrase", F.col("phrase").cast("string")), "phrase_counts")
    some.destroy(), most.destroy()
    discard(short, long)
    totals = counted.filter("phrase is null").select("lang", "n")
    phrases = counted.filter("phrase is not null").select("lang", "phrase", F.col("n").alias("a"))
    words = phrases.withColumn("words", F.split("phrase", " "))
    candidates = words.filter(F.size("words") > 1)
    joined = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    size = F.size("words")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("_first"), joined(F.col("k") + 1, size - F.col("k")).alias("_rest"))
    counts = lambda of, name: phrases.select("lang", F.col("phrase").alias(of), F.col("a").alias(name))
    cuts = cuts.join(counts("_first", "l"), ["lang", "_first"]).join(counts("_rest", "r"), ["lang", "_rest"])
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * F.col("a").cast("decimal(20,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(exact.cast("long").alias("score"), "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")

    once = handed_down(candidates.select("lang", "phrase", F.col("a").alias("_longer")))
    longer = once.unionByName(handed_down(once)).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    stay = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    # first in parts of a language, so that the task that ranks a language gets at most ``top`` phrases of each part
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = ranked(ranked(stay.withColumn("_part", part), "lang", "_part").drop("_part", "rank"), "lang")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
