"""Bottom-up summaries and embeddings through pluggable backends."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.plans.storage import discard, materialise
from graphquarry.schema import INDEXED, LEVELS, SUMMARISED

CHILD_TYPES, RELATED_TYPES = ("CONTAINS", "DEFINES", "DECLARES"), ("CALLS", "USES", "REFERENCES")
#: Labels whose missing summary keeps their parent waiting.
BLOCKING = ("Class", "Interface", "Method", "Function", "Variable", "Parameter")
MAX_CHILDREN, MAX_RELATED = 10, 5
# The prompt's wording, in which each level's instruction closes it.
FOCUS = {
    "Parameter": "Focus on: parameter type, purpose, constraints, default values",
    "Variable": "Focus on: variable type, purpose, scope, usage pattern",
    "Method": "Focus on: purpose, parameters, return value, side effects, algorithm",
    "Function": "Focus on: purpose, parameters, return value, side effects, algorithm",
    "Class": "Focus on: responsibility, key methods, relationships, design patterns",
    "Interface": "Focus on: responsibility, key methods, relationships, design patterns",
    "File": "Focus on: main purpose, key classes/functions, external dependencies",
}
CLOSING = "Provide a concise technical summary (2-4 sentences):"


def blank(column: str) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def pending_summaries(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    found = nodes.filter(F.col("raw_code").isNotNull() & blank("generated_summary") & F.col("label").isin(*SUMMARISED))
    return found.orderBy("id").limit(limit) if limit else found


def pending_embeddings(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    found = nodes.filter(F.col("generated_summary").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) <= 0) & F.col("label").isin(*INDEXED))
    return found.orderBy("id").limit(limit) if limit else found


def pending_level(nodes: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Nodes of a level that have no summary and aren't in work: all, or the first by full name as one batch."""
    found = nodes.filter((F.col("label") == label) & blank("generated_summary") & (F.coalesce("summary_status", F.lit("")) != "PROCESSING"))
    return found.orderBy(F.asc_nulls_last("full_name"), "id").limit(limit) if limit else found


def ready(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those whose children of the blocking labels all have a summary."""
    waiting = nodes.filter(F.col("label").isin(*BLOCKING) & blank("generated_summary")).select(F.col("id").alias("dst")).hint("merge")
    blocked = edges.filter(F.col("type").isin(*CHILD_TYPES)).join(waiting, "dst", "left_semi").select(F.col("src").alias("id"))
    return candidates.join(blocked.hint("merge"), "id", "left_anti")


def neighbour_summaries(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], most: int) -> DataFrame:
    """(id, summaries): "name: summary" of the first ``most`` neighbours by name that have one."""
    ends = nodes.filter(~blank("generated_summary")).select(F.col("id").alias("dst"), "name", "generated_summary").hint("merge")
    joined = edges.filter(F.col("type").isin(*types)).select("src", "dst").distinct().join(ends, "dst")
    order = Window.partitionBy("src").orderBy(F.asc_nulls_last("name"), "dst")
    few = joined.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    line = F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.col("generated_summary"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"])
    return few.groupBy(F.col("src").alias("id")).agg(lines.alias("summaries"))


def prompt() -> Column:
    """A node's prompt, from its label, name, raw_code, children and related (arrays of lines)."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    bullets = lambda c, most: F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("- "), x))
    block = lambda c, title, most: F.when(some(c), F.concat(F.array(F.lit(title)), bullets(c, most), F.array(F.lit(""))))
    none = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("Analyze and summarize this "), F.lower("label"), F.lit(": "), F.coalesce("name", F.lit("")), F.lit("\n")))
    code = F.when(~blank("raw_code"), F.array(F.concat(F.lit("Code:\n"), F.col("raw_code"), F.lit("\n"))))
    focus = F.create_map(*[F.lit(x) for kv in FOCUS.items() for x in kv])[F.col("label")]
    parts = [head, code, block("children", "Contains these components:", MAX_CHILDREN), block("related", "Uses/References:", MAX_RELATED), F.when(focus.isNotNull(), F.array(focus)), F.array(F.lit(CLOSING))]
    return F.array_join(F.concat(*[F.coalesce(p, none) for p in parts]), "\n")


def prompts(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidates`` with children, related and prompt."""
    children = neighbour_summaries(nodes, edges, CHILD_TYPES, MAX_CHILDREN).withColumnRenamed("summaries", "children")
    related = neighbour_summaries(nodes, edges, RELATED_TYPES, MAX_RELATED).withColumnRenamed("summaries", "related")
    return candidates.join(children.hint("merge"), "id", "left").join(related.hint("merge"), "id", "left").withColumn("prompt", prompt())


def extractive_summary() -> Column:
    """The summary of the offline backend: what a node is, its first line of code, and how much it holds."""
    line = F.trim(F.substring_index(F.coalesce("raw_code", F.lit("")), "\n", 1))
    held = F.coalesce(F.size("children"), F.lit(0))
    text = F.concat(F.col("label"), F.lit(" "), F.coalesce("name", F.lit("")), F.when(line != "", F.concat(F.lit(": "), F.substring(line, 1, 160))).otherwise(""))
    return F.concat(text, F.when(held > 0, F.format_string(" (%d components)", held)).otherwise(""))


def batch_summariser(summarise: Callable[[list[str]], list[str | None]], batch: int = 32) -> Callable[[], Column]:
    """A backend that gets prompts in batches, as the levels want it.

    The prompts of a batch that raises are tried one by one; what raises alone, and what is
    null, has failed, and stops nothing else.
    """

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in prompts:
            yield pd.Series(_in_batches(summarise, s.fillna("").tolist(), batch), dtype=object)

    return lambda: run(F.col("prompt"))


def batch_embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 32, max_chars: int | None = None) -> Callable[[Column], Column]:
    """A backend that gets texts in batches, cut to ``max_chars`` if that is given; failures give no vector, so that the node stays pending."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            cut = [x[:max_chars] if max_chars else x for x in s.fillna("").tolist()]
            yield pd.Series([None if v is None else list(map(float, v)) for v in _in_batches(embed, cut, batch)], dtype=object)

    return run


def _in_batches(function: Callable[[list[str]], list], texts: list[str], batch: int) -> list:
    def tried(some: list[str]) -> list:
        try:
            made = list(function(some))
            if len(made) != len(some):
                raise ValueError(f"{len(made)} results for {len(some)} texts")
            return made
        except Exception:  # whatever the backend raises is its batch's own failure
            return [None] if len(some) == 1 else [x for one in some for x in tried([one])]

    return [x for k in range(0, len(texts), batch) for x in tried(texts[k : k + batch])]


def embed_text() -> Column:
    """What is embedded of a node: its summary, else the beginning of its code, else its name."""
    return F.when(F.trim(F.coalesce("generated_summary", F.lit(""))) != "", F.col("generated_summary")).when(~blank("raw_code"), F.substring("raw_code", 1, 1000)).otherwise(F.coalesce("name", F.lit("")))


def hashing_embedder(dims: int = 64, max_tokens: int = 512) -> Callable[[Column], Column]:
    """The offline embedding backend: signed hashes of lower-case words, averaged; needs no model and no seed.

    A word's MD5 gives its place (the first four hex digits, modulo ``dims``) and its sign (plus if the fifth is even).
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(dims, np.float32)
            words = (text or "").lower().split()[:max_tokens]
            for w in words:
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                v[int(h[:4], 16) % dims] += -1.0 if int(h[4], 16) & 1 else 1.0
            return (v / max(1, len(words))).tolist()

        return texts.map(one)

    return embed


def set_values(nodes: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``column`` taken from ``values`` (id, column) where that has it."""
    new = values.select("id", F.col(column).alias("_new"))
    return nodes.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).select(*nodes.columns)


def set_status(nodes: DataFrame, ids: DataFrame, status: str | None) -> DataFrame:
    """Marks, or with None unmarks, some nodes."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return nodes.join(hit, "id", "left").withColumn("summary_status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("summary_status"))).select(*nodes.columns)


def reset_status(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("summary_status", F.lit(None).cast("string"))


def summarise_levels(nodes: DataFrame, edges: DataFrame, summarise: Callable[[], Column] = extractive_summary, answers: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Summaries of all levels, bottom-up: one set-based step a level.

    ``answers`` takes the place of ``summarise`` where a backend is to be asked once and for all: from a level and its work (id, text) it makes
    (id, value), as a ``ledger.Ledger`` does; work without an answer stays pending.

    ``summarise`` makes a column from a node's columns, children, related and prompt; where
    it gives null the node gets a note that it failed, and is not tried again. A level writes its new summaries, and
    ids, names and summaries once for the next level to read; the nodes themselves are written once, whatever they are made of, and joined once, at the end. What is joined grows
    with the graph, hence is merged at any size: broadcasts of each level's tables would add up at the driver.
    """
    nodes = base = materialise(nodes, "summary_nodes")
    state = materialise(nodes.select("id", "label", "name", "generated_summary", "summary_status"), "summary_state")
    made: DataFrame | None = None
    for label in LEVELS:
        work = prompts(ready(pending_level(nodes, label), state, edges), state, edges)
        failed = F.concat(F.lit("Code "), F.lower("label"), F.lit(" - summary generation failed"))
        if answers:
            told = answers(label, work.select("id", F.col("prompt").alias("text")))
            said = work.select("id", "label").join(told.hint("merge"), "id").select("id", F.coalesce("value", failed).alias("_s"))
        else:
            said = work.select("id", F.coalesce(summarise(), failed).alias("_s"))
        done = materialise(said.withColumn("_t", F.lit("COMPLETED")), f"summaries-{label.lower()}")
        made = done if made is None else made.unionByName(done)
        if label != LEVELS[-1]:
            former, state = state, materialise(_with_summaries(state, done), "summary_state")
            discard(former)
    discard(state)
    out = materialise(_with_summaries(nodes, made), "summaries")
    discard(base)
    return out


def _with_summaries(nodes: DataFrame, made: DataFrame) -> DataFrame:
    columns = {"generated_summary": F.coalesce("_s", "generated_summary"), "summary_status": F.coalesce("_t", "summary_status")}
    return nodes.join(made.hint("merge"), "id", "left").withColumns(columns).select(*nodes.columns)


def embed_pending(nodes: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Embeddings of all nodes that have a summary and no embedding."""
    embed = embed or hashing_embedder()
    done = pending_embeddings(nodes).select("id", embed_text().alias("text")).select("id", embed(F.col("text")).alias("embedding"))
    return set_values(nodes, done, "embedding")


def enrich(nodes: DataFrame, edges: DataFrame, summarise: Callable[[], Column] = extractive_summary, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Levels first, then what they left out, then embeddings."""
    state = summarise_levels(nodes, edges, summarise)
    left = prompts(pending_summaries(state), state, edges).select("id", summarise().alias("generated_summary"))
    return embed_pending(set_values(state, left, "generated_summary"), embed)


def enrichment_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, n): nodes that got a summary, by level and in all."""
    new = after.filter(~blank("generated_summary")).select("id", "label").join(before.filter(~blank("generated_summary")).select("id").hint("merge"), "id", "left_anti")
    return new.rollup("label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("label", F.lit("total")).alias("label"), "n")
