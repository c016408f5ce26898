"""Mixing sources to target weights by subset-sum budget fitting.

The sources, in the order of their code points and null last, weigh 5, 2, 1 and again; they share as many words as all
documents have. A target stops at MOST times what its source has; the excess is shared by weight among the others.

A source takes each document as often as its target holds the whole source, and some documents once more. Which ones
is settled by length. The documents are counted by exact length; each length gives its share of the budget, rounded down, so that the mix keeps the
source's lengths; single documents are added while the budget is far; what is left, at most REACH words where documents aren't longer, is met by a bounded-knapsack
dynamic programme over the counts that are left, as nearly as any choice of them can. One task holds a source's lengths,
not its documents: of n words there are at most the root of 2n different lengths.

Of the documents of one length those with the smallest seeded hashes are taken. Groups are cut into buckets of hash
space, which are taken whole up to the one where the number is reached; only in that one are documents put in order.

Defined cases: null, empty and blank texts have no words, are taken nought times and change nothing; rows that repeat an
id are documents of their own, and where one of several equal rows goes, it doesn't matter which; a null source is a source of its own, the last; a source without words has the
target 0; documents are never cut, so a source misses its target by what no choice of whole documents can meet; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.batches import batch_bytes
from graphquarry.llm.words import table
from graphquarry.plans.storage import discard, materialise

WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
MOST = 3
#: Words of a budget that the dynamic programme meets.
REACH = 1 << 16
#: Bytes of text that reach a task at once.
BATCH_BYTES = 4 << 20
#: Documents of a bucket of a length's hash space.
BUCKET_DOCS = 256
#: Share of the rows from which a group is joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.002
_SPACE = table(0x20, range(0x09, 0x0E))
_PLAN = "_source string, size bigint, docs bigint, base int, extra bigint"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, text) to (doc_id, source, size)."""
    for batch in batches:
        sizes = []
        for x in batch.column(2):
            inside = ~_SPACE[np.frombuffer(x.as_buffer(), np.uint8)] if x.is_valid and x.as_buffer().size else np.zeros(0, bool)
            sizes.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "size"])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with the target of each: a row a source, ordered in one task.

    Sharing out what is above the limits ends with all others at one multiple of their weights. In the order of
    size / weight those before the first that keeps within its limit are at theirs.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    out = sources.withColumn("_place", F.row_number().over(named))
    out = out.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("long"))
    # exact, as all weights divide their product
    product = int(np.prod(weights))
    out = out.withColumn("_ratio", big("source_size") * F.floor(F.lit(product) / F.col("_w")))
    out = out.withColumn("_size", F.sum("source_size").over(whole)).withColumn("_weight", F.sum("_w").over(whole))
    out = out.withColumn("_left", F.col("_size") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
    out = out.withColumn("_share", F.col("_weight") - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    over = big("_left") * F.col("_w").cast("decimal(10,0)") > most * big("source_size") * F.col("_share").cast("decimal(10,0)")
    level = F.min(F.when(~over, F.struct("_ratio", "_place", (F.col("_left") / F.col("_share")).alias("level")))).over(whole)["level"]
    out = out.withColumn("_over", over).withColumn("_level", level)
    target = F.when(F.col("_over"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return out.select("source", "source_size", target.alias("target"))


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each length come nearest to the budget in words; below it rather than above, at one distance.

    Each length's share first. Where single documents can't meet the rest exactly, a budget within
    ``reach`` is met anew without the shares, as nearly as any choice of documents can.
    """
    total = sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True))
    taken = [int(c) * budget // total for c in counts]
    left = budget - sum(t * int(x) for t, x in zip(taken, lengths, strict=True))
    for k in np.argsort(-lengths, kind="stable").tolist():  # long ones first: they can't be fitted later
        if left <= reach:
            break
        more = min(int(counts[k]) - taken[k], -(-(left - reach) // int(lengths[k])), left // int(lengths[k]))
        taken[k] += more
        left -= more * int(lengths[k])
    out = np.array(taken, np.int64)
    more, missed = knapsack(lengths, counts - out, left)
    if missed and budget <= reach:
        return knapsack(lengths, counts, budget)[0]
    return out + more


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """The bounded-knapsack programme: the counts that come nearest to the budget, and by how much they miss it.

    A length's documents are choices of 1, 2, 4.. of them; with each sum stands the choice by which it was first reached, from
    one that earlier choices had reached, so memory follows the budget and not the number of lengths.
    """
    unit = int(np.gcd.reduce(lengths))
    size, whole = lengths // unit, budget // unit
    # the sums nearest to the budget that there can be, in units
    order = [whole, whole + 1] if 2 * (budget - whole * unit) <= unit else [whole + 1, whole]
    limit = whole + int(size.max())
    first = np.full(limit + 1, -1, np.int64)
    first[0] = 0
    choices = [(0, 0)]
    for k in np.argsort(size, kind="stable").tolist():
        n, part = min(int(counts[k]), limit // int(size[k])), 1
        while n and first[order[0]] < 0:
            part = min(part, n)
            step = part * int(size[k])
            fresh = np.nonzero((first[step:] < 0) & (first[: limit + 1 - step] >= 0))[0] + step
            first[fresh] = len(choices)
            choices.append((k, part))
            n, part = n - part, part * 2
    sums = np.nonzero(first >= 0)[0]
    at = int(min(sums.tolist(), key=lambda x: (abs(x * unit - budget), x)))
    missed, taken = abs(at * unit - budget), np.zeros(len(lengths), np.int64)
    while at:
        k, part = choices[first[at]]
        taken[k] += part
        at -= part * int(size[k])
    return taken, missed


def planner(most: int, reach: int):
    """A source's (_source, size, docs, target) to how often each length is taken whole, and how many of it once more."""

    def run(key, rows):
        size, docs = rows.column("size").to_numpy(), rows.column("docs").to_numpy()
        order = np.argsort(size, kind="stable")
        size, docs = size[order], docs[order]
        total, target = sum(int(a) * int(b) for a, b in zip(size, docs, strict=True)), rows.column("target")[0].as_py()
        base = min(most, int(target // total)) if total else 0
        extra = np.zeros(len(size), np.int64)
        if base < most and total:
            some = size > 0
            extra[some] = fitted(size[some], docs[some], round(target - base * total), reach)
        columns = [pa.array([key[0].as_py()] * len(size), pa.string()), pa.array(size), pa.array(docs), pa.array([base] * len(size), pa.int32()), pa.array(extra)]
        return pa.table(columns, names=[x.split()[0] for x in _PLAN.split(", ")])

    return run


def _with_plan(rows: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """Documents with their length's row of the plan. Lengths of more than HOT_SHARE of the rows go by broadcast, so that no task gets all of one."""
    key, hot = ["_source", "size"], F.col("docs") > total * HOT_SHARE
    rest = rows.join(F.broadcast(plan.filter(hot).select(*key)), key, "left_anti").join(plan.filter(~hot).hint("merge"), key)
    return rows.join(F.broadcast(plan.filter(hot)), key).unionByName(rest)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, reach: int = REACH, bucket_docs: int = BUCKET_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    # a source's name, with a mark that a null has not
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        sized = materialise(slim.mapInArrow(count_words, "doc_id bigint, source string, size bigint").select("doc_id", named.alias("_source"), "size"), "sizes")
    lengths = materialise(sized.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    sizes = lengths.groupBy("_source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    sources = materialise(targets(sizes.withColumn("source", F.expr("case when _source <> '' then substr(_source, 2) end")), weights, most), "targets").withColumn("_source", named).drop("source")
    plan = lengths.join(sources, "_source").groupBy("_source").applyInArrow(planner(most, reach), _PLAN)
    plan = materialise(plan.join(sources, "_source"), "mixing_plan")
    total = plan.agg(F.sum("docs")).first()[0] or 0
    discard(lengths, sources)
    # rows without an id are told apart by their place and come last: of one source and length it doesn't matter which of them go
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    hashed = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", place))
    buckets = F.ceil(F.col("docs") / bucket_docs).cast("long")
    found = _with_plan(hashed, plan, total).withColumn("_bucket", F.pmod("_hash", buckets) + F.when(F.col("doc_id").isNull(), buckets).otherwise(0))
    found = materialise(found, "mixing_rows")
    discard(sized, plan)
    shown = lambda df, more: df.select("doc_id", "size", "source_size", "target", ((F.col("base").cast("long") + more.cast("long")) * F.col("size")).alias("taken"))
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("docs"))
    # of a length that goes in part: buckets as long as they fit, and of the one in which the number is reached the first few
    bucket = ["_source", "size", "_bucket"]
    before = Window.partitionBy("_source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = found.filter(part).groupBy(*bucket).agg(F.count(F.lit(1)).alias("_held"), F.first("extra").alias("_want"))
    quota = held.select(*bucket, (F.col("_want") - F.coalesce(F.sum("_held").over(before), F.lit(0))).alias("_quota"))
    nth = F.row_number().over(Window.partitionBy(*bucket).orderBy("_hash", "doc_id"))
    chosen = found.filter(part).join(quota.hint("merge"), bucket).withColumn("_nth", nth)
    return shown(found.filter(~part), F.col("extra") > 0).unionByName(shown(chosen, F.col("_nth") <= F.col("_quota")))
