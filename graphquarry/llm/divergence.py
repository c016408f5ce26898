"""How the sources of a language differ in their use of terms.

1. Sketch: each task counts, in a count-min sketch, in how many of its documents a term of a language occurs. The merged
   sketch never underestimates, so that terms below it can't be kept, and are discarded before anything is shuffled.
2. Count: the terms left are counted exactly, by their text, first in the tasks, then by (lang, source, term). Terms in
   at least LEAST documents of a language are kept.
3. Differences: a term that neither of two sources has adds the same as all such terms; a term that one of them has depends on
   the other by its total only. So pairs of sources are joined by the terms that both have, and a source's numbers
   of terms of one probability with the other sources' totals; no source gets a row for a term that it doesn't have.

Probabilities are whole, 1 + floor(SCALE * (count + EXTRA) / (N + EXTRA * V)), in exact arithmetic. The sketch has at most
4 rows of 2**22 cells of 8 bits; beyond some gigabytes of rare terms it discards less, and the result stays the same.

Defined cases: null texts, languages and sources are empty strings; documents without terms make their language and
source occur; rows that repeat an id are documents of their own; a language with one source has no pairs, and where no term is kept the pairs
have the value 0; texts longer than SHARD_BYTES are read in slices and counted as one document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.sketches import BLOCKS, Counts, capped_sum, merged
from graphquarry.llm.words import Words, mark, scramble, slices, table
from graphquarry.plans.storage import discard, materialise

#: Documents of a language that a kept term is in.
LEAST = 30
SCALE, EXTRA = 1_000_000_000, 5
#: Terms of a source that are reported.
TERMS = 50
#: Bytes of text that a task looks at together.
SHARD_BYTES = 1 << 19
#: Bytes of text that reach a task at once.
BATCH_BYTES = 4 << 20
#: Sources that a task joins with all others of their language.
SOURCES = 1024
#: All bytes but letters and those of characters beyond ASCII.
BETWEEN = table(range(0x00, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))
_COUNTED = "lang string, source string, term binary, n bigint, docs bigint"


class Shard:
    """Some documents (lang, source, text): their terms, the document of each, and hashes of terms with their language."""

    def __init__(self, docs: list[tuple[str, str, bytes]]):
        self.words = Words([x for _, _, x in docs], BETWEEN)
        self.doc = self.words.text
        self.langs = sorted({x for x, _, _ in docs})
        self.groups = sorted({(x, y) for x, y, _ in docs})
        lang, group = ({x: k for k, x in enumerate(names)} for names in (self.langs, self.groups))
        self.lang_of = np.array([lang[x] for x, _, _ in docs], np.int64)
        self.group_of = np.array([group[x, y] for x, y, _ in docs], np.int64)
        marks = np.array([mark(x) for x in self.langs], np.uint64)
        self.hash = scramble(self.words.hash + marks[self.lang_of[self.doc]])

    def each_once(self) -> np.ndarray:
        """The hashes of each document, once each."""
        order = np.lexsort((self.hash, self.doc))
        h, d = self.hash[order], self.doc[order]
        return h[np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]] if len(h) else h

    def counted(self, at: np.ndarray) -> tuple[list[tuple[str, str]], list[bytes], np.ndarray, np.ndarray]:
        """Group, term, occurrences and documents of the terms among the words ``at``."""
        doc = self.doc[at]
        number, first = self.words.numbered(at, self.lang_of[doc])
        pair, times = np.unique(number * len(self.lang_of) + doc, return_counts=True)
        number, doc = pair // len(self.lang_of), pair % len(self.lang_of)
        key, place = np.unique(number * len(self.groups) + self.group_of[doc], return_inverse=True)
        n, docs = np.bincount(place, times, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
        terms = [self.words.word(at[k]) for k in first[key // len(self.groups)].tolist()]
        return [self.groups[k] for k in (key % len(self.groups)).tolist()], terms, n, docs


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Shard, bool]]:
    """Documents in shards of about ``most`` bytes; one that is longer alone, in slices, the last of which says so."""
    docs: list[tuple[str, str, bytes]] = []
    size = 0
    for batch in batches:
        for lang, source, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = x.as_buffer().to_pybytes().lower() if x.is_valid else b""
            if len(text) > most:
                parts = list(slices(text, most, BETWEEN))
                for k, part in enumerate(parts):
                    yield Shard([(lang, source, part)]), k + 1 < len(parts)
                continue
            docs.append((lang, source, text))
            size += len(text)
            if size >= most:
                yield Shard(docs), False
                docs, size = [], 0
    if docs:
        yield Shard(docs), False


def sketcher(shard_bytes: int, bits: int):
    """A task's sketch of how many documents have each term of a language; a document in slices counts once a slice, which is no less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bits)
        for shard, _ in shards(batches, shard_bytes):
            counts.add(shard.each_once())
        yield counts.blocks()

    return run


def counter(shard_bytes: int, sketch: Counts, least: int):
    """Exact occurrences and documents, by (lang, source, term), of the terms that the sketch doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long: collections.Counter = collections.Counter()
        for shard, goes_on in shards(batches, shard_bytes):
            groups, terms, n, docs = shard.counted(np.nonzero(sketch.at_least(shard.hash, least))[0])
            if goes_on or long:  # slices of one document
                for x, k in zip(terms, n.tolist(), strict=True):
                    long[x] += k
                if goes_on:
                    continue
                group = shard.groups[0]
                groups, terms, n, docs = [group] * len(long), list(long), np.array(list(long.values()), np.int64), np.ones(len(long), np.int64)
                long = collections.Counter()
            columns = [pa.array([x for x, _ in groups], pa.string()), pa.array([x for _, x in groups], pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _COUNTED.split(", ")])

    return run


def probability(count: Column, total: str, terms: str) -> Column:
    """In whole numbers, which may pass 64 bits on the way."""
    big = lambda c: c.cast("decimal(18,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * big(count + EXTRA)
    below = big(F.col(total) + EXTRA * F.col(terms))
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", above, below)).otherwise(0).cast("long")


def _with_others(left: DataFrame, facts: DataFrame, parts: int, salt: Column) -> DataFrame:
    """Each row of ``left`` with the facts of the other sources of its language, shared out by ``salt`` where a language has many."""
    dealt = left.withColumn("_part", F.pmod(salt, F.lit(parts)))
    others = facts.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("item_own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return dealt.join(others, ["lang", "_part"]).filter(F.col("source") != F.col("item")).drop("_part")


def divergence(docs: DataFrame, least: int = LEAST, terms: int = TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        bits = Counts.bits_for(slim, "text")
        sketch = Counts(bits, merged(slim.mapInArrow(sketcher(shard_bytes, bits), BLOCKS), Counts.ROWS << bits, capped_sum))
        held = docs.sparkSession.sparkContext.broadcast(sketch)
        sent = slim.mapInArrow(lambda batches: counter(shard_bytes, held.value, least)(batches), _COUNTED)
        counted = materialise(sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    held.destroy()
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least).drop("docs")
    found = materialise(counted.join(kept, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n"), "kept_counts")
    discard(counted)
    langs = found.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    facts = slim.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "v", "lang_total"])
    facts = materialise(facts.withColumn("p0", probability(F.lit(0), "total", "v")), "source_facts")
    rows = found.join(facts, ["lang", "source"]).withColumn("p", probability(F.col("n"), "total", "v"))
    rows = materialise(rows.withColumn("q", probability(F.col("lang_n"), "lang_total", "v")).select("lang", "source", "term", "p", "p0", "q"), "term_probabilities")
    discard(found)

    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own_terms = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", order).filter(F.col("rank") <= terms)

    # what both have; then what one has, as if the other hadn't; then what neither has
    other = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = rows.drop("q").join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    more = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("q") - F.col("p0")) + F.abs(F.col("p0") - F.col("q0"))
    both = both.groupBy("lang", "source", "item").agg(F.sum(more).alias("value"))
    mirrored = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    parts = max(1, -(-facts.count() // SOURCES))
    alike = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    one = _with_others(alike, facts, parts, F.hash("source", "p"))
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("q0"))).alias("value"))
    none = _with_others(facts, facts, parts, F.hash("source"))
    none = none.select("lang", "source", "item", ((F.col("v") - F.col("own") - F.col("item_own")) * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    pairs = mirrored(both).unionByName(mirrored(one)).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", order)
    return shape(pairs, "pair").unionByName(shape(own_terms, "term"))
