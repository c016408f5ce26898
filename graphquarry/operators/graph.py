"""Neighbourhoods, rule-driven context, hierarchies and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.operators.components import connected_components
from graphquarry.plans.joins import Split, split
from graphquarry.plans.storage import materialise
from graphquarry.schema import packed, unpacked

# Fixed values: (label, edge type, label at the other end or None, direction), in the order in which they apply.
RULES = (
    ("File", "CONTAINS", "Class", "OUT"), ("File", "CONTAINS", "Function", "OUT"), ("File", "CONTAINS", "Interface", "OUT"),
    ("File", "IMPORTS", None, "OUT"), ("File", "IMPORTS", None, "IN"),
    ("Class", "CONTAINS", None, "IN"), ("Class", "DEFINES", "Method", "OUT"), ("Class", "DEFINES", "Variable", "OUT"), ("Class", "EXTENDS", "Class", "OUT"),
    ("Class", "IMPLEMENTS", "Interface", "OUT"), ("Class", "EXTENDS", None, "IN"), ("Class", "IMPLEMENTS", None, "IN"), ("Class", "INSTANTIATES", None, "IN"),
    ("Interface", "CONTAINS", None, "IN"), ("Interface", "DEFINES", "Method", "OUT"), ("Interface", "EXTENDS", "Interface", "OUT"),
    ("Interface", "IMPLEMENTS", None, "IN"), ("Interface", "EXTENDS", None, "IN"),
    ("Method", "DEFINES", None, "IN"), ("Method", "DECLARES", "Parameter", "OUT"), ("Method", "DECLARES", "Variable", "OUT"), ("Method", "CALLS", "Method", "OUT"),
    ("Method", "CALLS", "Function", "OUT"), ("Method", "INSTANTIATES", "Class", "OUT"), ("Method", "CALLS", None, "IN"),
    ("Function", "CONTAINS", None, "IN"), ("Function", "DECLARES", "Parameter", "OUT"), ("Function", "DECLARES", "Variable", "OUT"), ("Function", "CALLS", "Function", "OUT"),
    ("Function", "CALLS", "Method", "OUT"), ("Function", "INSTANTIATES", "Class", "OUT"), ("Function", "CALLS", None, "IN"),
    ("Variable", "DECLARES", None, "IN"), ("Variable", "SCOPES", None, "BOTH"),
    ("Parameter", "DECLARES", None, "IN"), ("Parameter", "SCOPES", None, "BOTH"),
)
CALLS = ("CALLS",)
INHERITANCE = ("EXTENDS", "IMPLEMENTS")


def rules_table(spark: SparkSession, rules=RULES, max_depth: int = 1) -> DataFrame:
    """Rules as rows; rules of one's own go in the same form and may have a depth as a fifth member."""
    seen: dict[str, int] = {}
    rows = []
    for r in rules:
        seen[r[0]] = seen.get(r[0], 0) + 1
        rows.append((r[0], seen[r[0]], r[1], r[2], r[3], r[4] if len(r) > 4 else max_depth))
    return spark.createDataFrame(rows, "from_label string, rule_ord int, rel_type string, to_label string, rule_direction string, max_depth int")


def directed(edges: DataFrame, direction: str = "BOTH") -> DataFrame:
    """(id, related, type, direction): each edge as seen from its source (OUT), its target (IN), or either."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("related"), "type", F.lit("OUT").alias("direction"))
    into = edges.select(F.col("dst").alias("id"), F.col("src").alias("related"), "type", F.lit("IN").alias("direction"))
    return {"OUT": out, "IN": into}.get(direction) or out.unionByName(into)


def neighbours(roots: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "OUT", types: tuple[str, ...] | None = None, to_label: str | None = None) -> DataFrame:
    """Nodes one edge away from ``roots`` (id): a row an edge, not counting the root itself."""
    e = directed(edges.filter(F.col("type").isin(*types)) if types else edges, direction)
    ends = nodes.select(F.col("id").alias("related"), F.col("label").alias("related_label"), F.col("name").alias("related_name"))
    if to_label:
        ends = ends.filter(F.col("related_label") == to_label)
    return roots.select("id").join(e, "id").filter("related <> id").join(ends, "related").select("id", "related", "related_label", "related_name", "type", "direction")


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist; others are dropped."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def _step(frontier: DataFrame, edges: Split) -> DataFrame:
    """One hop from (.., at, rel_type, direction); keeps the other columns. A hub's edges are dealt over several tasks."""
    return edges.join(frontier, "at").filter((F.col("rel_type") == F.col("type")) & F.col("rule_direction").isin("BOTH", F.col("direction"))).drop("id", "type")


def expand_candidates(hits: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Every neighbour that a rule gives a hit (id, rank): a row an edge, or a row a path for deeper rules."""
    wanted = [r["rel_type"] for r in rules.select("rel_type").distinct().collect()]
    both = split(directed(edges.filter(F.col("type").isin(wanted))), "id", F.xxhash64("related"))
    labels = nodes.select("id", "label")
    start = hits.select("id", "rank").join(labels, "id").join(F.broadcast(rules), F.col("label") == F.col("from_label"))
    start = start.select(F.col("id").alias("from_node"), "rank", "rule_ord", "rel_type", "to_label", "rule_direction", "max_depth", F.col("id").alias("at"))
    deepest = rules.agg(F.max("max_depth")).first()[0] or 0
    found, frontier = None, start
    for depth in range(1, deepest + 1):
        frontier = _step(frontier.filter(F.col("max_depth") >= depth), both).withColumn("at", F.col("related")).withColumn("depth", F.lit(depth))
        step = frontier.select("from_node", "rank", "rule_ord", "rel_type", "to_label", F.col("direction"), "depth", "related")
        found = step if found is None else found.unionByName(step)
        frontier = frontier.drop("related", "direction", "depth")
    ends = nodes.select(F.col("id").alias("related"), F.col("label").alias("related_label"), F.col("name").alias("related_name"))
    joined = found.filter("related <> from_node").join(ends, "related").filter("to_label is null or to_label = related_label")
    return joined.select("from_node", "rank", "rule_ord", "related", "related_label", "related_name", F.col("rel_type").alias("type"), "direction", "depth")


def expand_context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame | None = None, max_related: int = 50) -> DataFrame:
    """The context of some hits: each related node once, where it is first reached, the first ``max_related`` of them.

    Set-based: unlike ``expand_context_exact`` it also expands hits that are reached from an
    earlier hit, and nodes seen before use up none of the budget.
    """
    rules = rules if rules is not None else rules_table(nodes.sparkSession)
    order = ["rank", "rule_ord", "depth", F.asc_nulls_last("related_name"), "related"]
    once = F.row_number().over(Window.partitionBy("related").orderBy(*order))
    found = expand_candidates(hits, nodes, edges, rules).withColumn("_n", once).filter("_n = 1").drop("_n")
    return found.orderBy(*order).limit(max_related)


def expand_context_exact(hits: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame | None = None, max_related: int = 50, max_hits: int = 10) -> DataFrame:
    """The same by the greedy pass: hits in rank order, each rule within what is left of the budget.

    A hit reached before is not expanded; a node seen before uses up budget of its rule.
    """
    one = expand_context_each(hits.withColumn("query_id", F.lit(0)), nodes, edges, rules, max_related, max_hits)
    return one.drop("query_id")


def expand_context_each(hits: DataFrame, nodes: DataFrame, edges: DataFrame, rules: DataFrame | None = None, max_related: int = 50, max_hits: int = 10) -> DataFrame:
    """The greedy pass for each query of hits (query_id, id, rank): its first ``max_hits``, in one task, which holds at most ``max_related`` neighbours of each rule of each of them.

    Neighbours are cut to the budget by hit and rule before they meet the queries, so that a hub that many queries hit is
    expanded once and sends on no more than that.
    """
    rules = rules if rules is not None else rules_table(nodes.sparkSession)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    first = hits.select("query_id", "id", "rank").withColumn("_nth", nth).filter(F.col("_nth") <= max_hits).drop("_nth")
    order = Window.partitionBy("from_node", "rule_ord").orderBy("depth", F.asc_nulls_last("related_name"), "related", "direction")
    found = expand_candidates(first.select("id").distinct().withColumn("rank", F.lit(0)), nodes, edges, rules)
    few = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_related).drop("rank")
    met = first.withColumnRenamed("id", "from_node").join(few, "from_node", "left").select("query_id", "rank", *few.columns)
    kept = ", ".join(f"{c} {t}" for c, t in met.dtypes if c != "_n")
    names = [c for c in met.columns if c != "_n"]

    def greedy(rows):
        """A query's rows: a row a hit and neighbour, or one of a hit that has none."""
        rows = rows.sort_by([("rank", "ascending"), ("rule_ord", "ascending"), ("_n", "ascending")])
        done, used, taken, spent, skipped = set(), [], 0, 0, None
        rank, hit, rule = (rows.column(c).to_pylist() for c in ("rank", "from_node", "rule_ord"))
        related = rows.column("related").to_pylist()
        for k, node in enumerate(related):
            if k == 0 or rank[k] != rank[k - 1]:
                if k and not skipped:
                    done.add(hit[k - 1])
                if taken >= max_related:
                    break
                skipped = hit[k] in done
            if k == 0 or (rank[k], rule[k]) != (rank[k - 1], rule[k - 1]):
                room, spent = max_related - taken, 0
            if skipped or node is None or spent >= room:
                continue
            spent += 1
            if node not in done:
                done.add(node)
                taken += 1
                used.append(k)
        return rows.select(names).take(used)

    out = met.groupBy("query_id").applyInArrow(greedy, kept)
    return out.select("query_id", "from_node", "rank", "rule_ord", "related", "related_label", "related_name", "type", "direction", "depth")


def reach(roots: DataFrame, edges: DataFrame, types: tuple[str, ...], direction: str = "OUT", max_depth: int = 3) -> DataFrame:
    """(root, id, depth) of what each root reaches within ``max_depth`` edges, at its least depth, without itself.

    Breadth first from all roots together; each level is written, so that neither lineage
    nor plan grows with the depth, and is compared with what was reached before. The edges of a node that has a large share of
    them are dealt over several tasks, to which what has reached it goes.
    """
    return _reach(roots, edges, types, direction, max_depth).withColumns({c: unpacked(c) for c in ("root", "id")})


def _reach(roots: DataFrame | None, edges: DataFrame, types: tuple[str, ...], direction: str, max_depth: int) -> DataFrame:
    """``reach`` with packed ids; without ``roots``, of all that have edges. Levels grow with the graph, so they are merged with it and not sent through the driver.

    The first level of all roots is the edges themselves. Levels hold no root of its own, so that roots needn't be joined to be left out.
    """
    e = edges.filter(F.col("type").isin(*types)).select(packed("src").alias("src"), packed("dst").alias("dst"))
    e = e if direction == "OUT" else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = materialise(e, "reach_edges")
    e = split(steps, "src", F.xxhash64("dst"))
    start = None if roots is None else roots.select(packed("id").alias("id")).distinct()
    seen = frontier = None
    for depth in range(1, max_depth + 1):
        if frontier is None:
            step = steps.select(F.col("src").alias("root"), F.col("dst").alias("id")) if start is None else e.join(start.select(F.col("id").alias("root"), "id"), "id", "merge").select("root", F.col("dst").alias("id"))
        else:
            step = e.join(frontier.select("root", "id"), "id", "merge").select("root", F.col("dst").alias("id"))
        step = step.filter("root <> id").distinct()
        if seen is not None:
            # what is new is looked for only if there is any, as else all that was seen would be exchanged for nothing
            step = materialise(step, "reach_step")
            if not step.limit(1).count():
                break
            step = step.join(seen.hint("merge"), ["root", "id"], "left_anti")
        frontier = materialise(step.withColumn("depth", F.lit(depth)), "reach")
        if seen is not None and not frontier.limit(1).count():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
    return seen if seen is not None else steps.select(F.col("src").alias("root"), F.col("dst").alias("id"), F.lit(0).alias("depth")).limit(0)


def hierarchy(roots: DataFrame, nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], direction: str, max_depth: int, limit: int | None = None) -> DataFrame:
    """``reach`` with labels and names, the first ``limit`` of each root by name."""
    ends = nodes.select(packed("id").alias("id"), "label", "name", "full_name").hint("merge")
    found = _reach(roots, edges, types, direction, max_depth).join(ends, "id").withColumn("direction", F.lit(direction))
    if limit:
        order = Window.partitionBy("root").orderBy(F.asc_nulls_last("name"), "id")
        found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return found.select(unpacked("root").alias("root"), "direction", unpacked("id").alias("id"), "label", "name", "full_name", "depth")


def hierarchies(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], max_depth: int, limit: int | None = None) -> DataFrame:
    """``hierarchy`` of all ``nodes`` in both directions, with the full name of each root as root_name.

    What reaches a node lies as far from it as it lies from that: so one walk along the edges gives both directions,
    and each pair meets the names of its two ends once.
    """
    ends = nodes.select(packed("id").alias("id"), "label", "name", "full_name")
    at = lambda p: ends.select(F.col("id").alias(p), F.struct("label", "name", "full_name").alias(f"{p}_end")).hint("merge")
    pairs = _reach(None, edges, types, "OUT", max_depth).select(F.col("root").alias("a"), F.col("id").alias("b"), "depth").join(at("a"), "a").join(at("b"), "b")
    side = lambda d, x, y: F.struct(F.lit(d).alias("direction"), F.col(x).alias("root"), F.col(f"{x}_end.full_name").alias("root_name"), F.col(y).alias("id"), *[F.col(f"{y}_end.{c}").alias(c) for c in ("label", "name", "full_name")])
    found = pairs.select("depth", F.explode(F.array(side("OUT", "a", "b"), side("IN", "b", "a"))).alias("s")).select("s.*", "depth")
    if limit:
        order = Window.partitionBy("root", "direction").orderBy(F.asc_nulls_last("name"), "id")
        found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return found.select(unpacked("root").alias("root"), "root_name", "direction", unpacked("id").alias("id"), "label", "name", "full_name", "depth")


def call_hierarchy(roots: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, direction: str = "BOTH", limit: int | None = 20) -> DataFrame:
    """Callers (IN) and callees (OUT)."""
    sides = ("IN", "OUT") if direction == "BOTH" else (direction,)
    parts = [hierarchy(roots, nodes, edges, CALLS, d, max_depth, limit) for d in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def inheritance_hierarchy(roots: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """Ancestors (OUT) and descendants (IN)."""
    return hierarchy(roots, nodes, edges, INHERITANCE, "OUT", max_depth).unionByName(hierarchy(roots, nodes, edges, INHERITANCE, "IN", max_depth))


def component_of(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids in the connected components of ``roots`` (id), the roots included."""
    found = connected_components(edges)
    wanted = found.join(roots.select("id").distinct(), "id", "left_semi").select("component").distinct()
    return found.join(wanted, "component", "left_semi").select("id").unionByName(roots.select("id")).distinct()


def derived_inheritance(nodes: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges from the names in base_classes, interfaces and base_interfaces.

    A base is matched with the class or interface of that simple name; of several the one in the same file, else the least id.
    """
    named = nodes.filter(F.col("label").isin("Class", "Interface")).select(F.col("id").alias("dst"), F.col("label").alias("base_label"), F.col("name").alias("base"), F.col("path").alias("base_path"))
    wants = lambda c, t, label: nodes.select(F.col("id").alias("src"), "path", F.explode(c).alias("full"), F.lit(t).alias("type"), F.lit(label).alias("base_label"))
    w = wants("base_classes", "EXTENDS", "Class").unionByName(wants("interfaces", "IMPLEMENTS", "Interface")).unionByName(wants("base_interfaces", "EXTENDS", "Interface"))
    w = w.withColumn("base", F.regexp_extract("full", r"([^.<\s]+)(?:<.*)?$", 1))
    near = F.coalesce(F.col("path") == F.col("base_path"), F.lit(False)).cast("int")
    best = Window.partitionBy("src", "full", "type").orderBy(F.desc(near), "dst")
    found = w.join(named, ["base", "base_label"]).filter("src <> dst").withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return found.select("src", "dst", "type").distinct().withColumn("properties", F.lit(None).cast("map<string,string>"))


