"""Hybrid search: vector hits and name hits, merged, scored and put in context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions.query_parser import parsed
from graphquarry.operators.graph import call_hierarchy, expand_context_each, inheritance_hierarchy
from graphquarry.operators.enrich import hashing_embedder
from graphquarry.operators.stats import hierarchy_counts
from graphquarry.operators.vector import vector_search
from graphquarry.plans.storage import materialise
from graphquarry.schema import location_of, metadata_of


@dataclass(frozen=True)
class SearchConfig:
    max_vector_results: int = 20
    max_entity_results: int = 10
    max_total_results: int = 30
    min_similarity: float = 0.6
    context_expansion: bool = True
    context_roots: int = 10
    max_context_nodes: int = 50
    boost_exact: float = 1.5
    boost_entity: float = 1.3
    boost_label: float = 1.2
    boost_types: float = 1.1
    max_score: float = 2.0

    def __post_init__(self) -> None:
        counts = (self.max_vector_results, self.max_entity_results, self.max_total_results)
        if not all(1 <= x <= 100 for x in counts):
            raise ValueError("results are limited to 1 to 100")
        if not 0 <= self.min_similarity <= 2 or self.max_context_nodes < 0 or self.context_roots < 0:
            raise ValueError("the similarity lies from 0 to 2, numbers of context nodes from 0")


#: Characters of an entity by which it meets the names that have them, and lookups that are sent to all tasks.
GRAM, SENT_LOOKUPS = 3, 100_000


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; none of null or shorter ones."""
    n = F.length(text)
    return F.array_distinct(F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def lookup(names: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(.., id, label, match_score) for rows of ``names`` (lookup_id, entity): nodes whose name or full name contains the entity.

    1.0 for the name itself, 0.9 for the full name, 0.8 within the name, else 0.7; the best
    ``limit`` of each lookup, by name. What contains an entity contains its first GRAM characters: by those
    the two meet, and the pairs are checked. An empty entity is in every name; a null one in none.
    """
    size = F.least(F.length("entity"), F.lit(GRAM))
    asked = names.select("lookup_id", "entity").filter("entity is not null").withColumn("gram", F.substring(F.col("entity"), F.lit(1), size))
    sizes = sorted(r[0] for r in asked.select(size).distinct().collect())  # of 0 to GRAM
    if not sizes:
        sizes = [GRAM]
    full = F.coalesce("full_name", F.lit(""))
    made = [F.array(F.lit(""))] if sizes[0] == 0 else []
    made += [grams(F.coalesce(x, F.lit("")), n) for x in (F.col("name"), full) for n in sizes if n]
    known = nodes.filter("name is not null or full_name is not null").select("id", "label", "name", "full_name", F.explode(F.array_distinct(F.concat(*made))).alias("gram"))
    few = asked.limit(SENT_LOOKUPS + 1).count() <= SENT_LOOKUPS
    return best_by_name(known.join(F.broadcast(asked) if few else asked, "gram"), limit)


def best_by_name(pairs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of each lookup among pairs (lookup_id, entity, id, label, name, full_name), those that don't contain the entity being dropped."""
    entity = F.col("entity")
    found = pairs.filter(F.coalesce(F.contains("name", entity), F.lit(False)) | F.coalesce(F.contains("full_name", entity), F.lit(False)))
    score = F.when(F.col("name") == entity, 1.0).when(F.col("full_name") == entity, 0.9).when(F.contains("name", entity), 0.8).otherwise(0.7)
    order = Window.partitionBy("lookup_id").orderBy(F.desc("match_score"), F.asc_nulls_last("name"), "id")
    best = found.withColumn("match_score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return best.select("lookup_id", "entity", "id", "label", "name", "match_score", "place")


def named_like(nodes: DataFrame, name_part: str = "", full_name_part: str = "", labels: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose name and full name contain these parts, of some labels or of all."""
    found = nodes.filter(F.contains("name", F.lit(name_part)) & F.contains("full_name", F.lit(full_name_part)))
    return found.filter(F.col("label").isin(*labels)) if labels else found


def node_details(nodes: DataFrame, ids: DataFrame | None = None, include_source: bool = False) -> DataFrame:
    """What is shown of the nodes with these ids (id), or of all: score 1.0, the place if it is known, and the source code only if asked for."""
    found = nodes if ids is None else nodes.join(ids.select("id").distinct(), "id", "left_semi")
    source = F.col("raw_code") if include_source else F.lit(None).cast("string")
    extra = metadata_of(*[c for c in ("path", "visibility", "type") if c in nodes.columns])
    shown = ["id", "label", "name", "full_name", F.coalesce("generated_summary", F.lit("")).alias("summary"), source.alias("raw_code")]
    return found.select(*shown, F.lit(1.0).alias("score"), location_of().alias("location"), extra.alias("metadata"))


def merge_and_score(hits: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """One row a query and node from hits (query_id, seq, id, label, name, match_type, score, and the query's intent).

    The highest score counts; match types are joined in order of seq. ``related`` is the number of nodes of the
    query's context, of hits that have it; a node has its first hit's.
    """
    first = F.min("seq").alias("seq")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "match_type"))), lambda x: x["match_type"]), "+").alias("match_type")
    intent = ["entity_names", "keywords", "node_types", "confidence"]
    own = F.min_by(F.struct("label", "name", "related"), "seq").alias("own")
    merged = hits.groupBy("query_id", "id").agg(first, own, F.max("score").alias("base"), kinds, *[F.first(c).alias(c) for c in intent]).select("*", "own.*").drop("own")
    name = F.lower(F.coalesce("name", F.lit("")))
    exact = F.exists("entity_names", lambda e: F.lower(e) == name) | F.exists("keywords", lambda k: F.contains(name, k))
    score = F.col("base") * F.when(exact, config.boost_exact).otherwise(1.0) * F.col("confidence")
    score = score * F.when(F.array_contains("node_types", F.col("label")), config.boost_label).otherwise(1.0)
    score = score * F.when(F.contains("match_type", F.lit("+")), config.boost_types).otherwise(1.0)
    related = F.coalesce("related", F.lit(0))
    score = score + F.when(related > 0, F.least(F.lit(0.1), related * 0.002)).otherwise(0.0)
    return merged.withColumn("hybrid_score", F.least(F.lit(config.max_score), score)).select("query_id", "seq", "id", "label", "name", "match_type", "base", "hybrid_score", "related")


def with_vectors(queries: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Queries with a vector each, made from the text by the backend where they bring none."""
    if "vector" in queries.columns:
        return queries
    return queries.withColumn("vector", (embed or hashing_embedder())(F.col("text")))


def search_by_text(queries: DataFrame, nodes: DataFrame, config: SearchConfig = SearchConfig(), embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The nodes nearest to each query (query_id, text[, node_types]); labels that aren't indexed find nothing. The embedding must be the one that the nodes have."""
    asked = materialise(with_vectors(queries, embed), "queries")
    return vector_search(nodes, asked, config.max_vector_results, config.min_similarity)


def hybrid_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, config: SearchConfig = SearchConfig(), rules: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The best nodes for each query (query_id, text[, vector]): query_id, rank, id, label, name, match_type, hybrid_score, explanation.

    The intent decides the branches: vectors for semantic, hybrid and contextual queries, names for
    entity and hybrid ones, context for contextual ones or where the text asks for it. The context is
    the greedy one of a query's first hits, before scoring, and counts for those hits.
    """
    intents = materialise(parsed(with_vectors(queries, embed).select("query_id", "text", "vector")).withColumnRenamed("programming_terms", "keywords"), "intents")
    by_vector = intents.filter(F.col("query_type").isin("semantic", "hybrid", "contextual"))
    near = vector_search(nodes, by_vector, config.max_vector_results, config.min_similarity)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    near = near.select("query_id", place.cast("long").alias("seq"), "id", "label", "name", F.lit("vector").alias("match_type"), "score")
    by_name = intents.filter(F.col("query_type").isin("entity", "hybrid")).select("query_id", F.posexplode("entity_names").alias("nth", "entity"))
    by_name = by_name.withColumn("lookup_id", F.concat_ws("|", F.col("query_id").cast("string"), F.format_string("%06d", "nth")))
    named = lookup(by_name, nodes, config.max_entity_results).join(by_name.select("lookup_id", "query_id", "nth"), "lookup_id")
    named = named.select("query_id", (F.lit(1_000_000) + F.col("nth") * 1000 + F.col("place")).cast("long").alias("seq"), "id", "label", "name", F.lit("entity").alias("match_type"), (F.col("match_score") * config.boost_entity).alias("score"))
    hits = materialise(near.unionByName(named), "hits")

    wants = intents.filter(((F.col("query_type") == "contextual") | F.col("expand_context")) & F.lit(config.context_expansion)).select("query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    roots = hits.join(wants, "query_id", "left_semi").withColumn("place", rank).filter(F.col("place") <= config.context_roots)
    context = expand_context_each(roots.select("query_id", "id", F.col("place").alias("rank")), nodes, edges, rules, config.max_context_nodes, config.context_roots)
    counted = roots.select("query_id").distinct().join(context.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    related = roots.select("query_id", "seq").join(counted.select("query_id", F.coalesce("n", F.lit(0)).alias("related")), "query_id")

    full = hits.join(intents.select("query_id", "entity_names", "keywords", "node_types", "confidence"), "query_id").join(related, ["query_id", "seq"], "left")
    scored = merge_and_score(full, config)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "seq"))
    top = scored.withColumn("rank", best).filter(F.col("rank") <= config.max_total_results)
    why = F.concat(F.col("match_type"), F.lit(" match"), F.when(F.col("related").isNotNull(), F.format_string(" | Context: %d related nodes", "related")).otherwise(""))
    return top.select("query_id", "rank", "id", "label", "name", "match_type", "hybrid_score", why.alias("explanation"))


def hierarchical_context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, call_depth: int = 2) -> DataFrame:
    """For each hit (id) the sizes of its hierarchy: of calls for methods and functions, of inheritance for classes and interfaces."""
    nodes = materialise(nodes.select("id", "label", "name", "full_name"), "hierarchy_nodes")  # five joins read them
    labelled = hits.select("id").distinct().join(nodes.select("id", "label").hint("merge"), "id")
    calls = call_hierarchy(labelled.filter(F.col("label").isin("Method", "Function")), nodes, edges, call_depth)
    kin = inheritance_hierarchy(labelled.filter(F.col("label").isin("Class", "Interface")), nodes, edges)
    return hierarchy_counts(calls.unionByName(kin))
