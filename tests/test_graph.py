"""Traversal, components, upserts and deletes on hand-made graphs."""

import random

from graphquarry.operators import components
from graphquarry.operators.components import connected_components
from pyspark.sql import functions as F

from graphquarry.operators.graph import call_hierarchy, derived_inheritance, expand_context, expand_context_each, expand_context_exact, hierarchies, inheritance_hierarchy, neighbours, reach
from graphquarry.plans import joins
from graphquarry.plans.storage import LEAST_PARTS, setting
from graphquarry.sources.store import create_edges, delete_component, delete_owned, merge_edges, upsert_nodes


def graph(spark, edges, labels=None):
    ids = sorted({x for s, d, _ in edges for x in (s, d)} | set(labels or {}))
    nodes = spark.createDataFrame([(i, (labels or {}).get(i, "Method"), i, f"p::{i}", "p" + i) for i in ids], "id string, label string, name string, full_name string, path string")
    return nodes, spark.createDataFrame([(s, d, t, {}) for s, d, t in edges], "src string, dst string, type string, properties map<string,string>")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cycle_self_loop_and_diamond(spark):
    nodes, edges = graph(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "a", "CALLS"), ("a", "d", "CALLS"), ("c", "e", "CALLS"), ("d", "e", "CALLS"), ("a", "b", "CALLS")])
    root = nodes.filter("id = 'a'")
    assert rows(reach(root, edges, ("CALLS",), "OUT", 3), "id", "depth") == [("b", 1), ("c", 2), ("d", 1), ("e", 2)]
    both = call_hierarchy(root, nodes, edges, 3)
    assert rows(both.filter("direction = 'IN'"), "id", "depth") == [("b", 2), ("c", 1)]


def test_depth_limit_and_caller_limit(spark):
    chain = [(f"k{i}", f"k{i + 1}", "EXTENDS") for i in range(7)]
    callers = [(f"c{i:02d}", "t", "CALLS") for i in range(30)]
    nodes, edges = graph(spark, chain + callers)
    up = inheritance_hierarchy(nodes.filter("id = 'k0'"), nodes, edges)
    assert rows(up, "id", "depth") == [(f"k{i}", i) for i in range(1, 6)]
    assert [r[0] for r in rows(call_hierarchy(nodes.filter("id = 't'"), nodes, edges, 1, "IN"), "id")] == [f"c{i:02d}" for i in range(20)]


def test_reach_agrees_with_breadth_first_search(spark):
    g = random.Random(3)
    edges = sorted({(f"n{g.randrange(25)}", f"n{g.randrange(25)}", "CALLS") for _ in range(50)})
    nodes, e = graph(spark, edges)
    out = {}
    for s, d, _ in edges:
        out.setdefault(s, set()).add(d)
    want = []
    for root in {x for s, d, _ in edges for x in (s, d)}:
        depth, front = {root: 0}, [root]
        for k in range(1, 5):
            front = sorted({d for x in front for d in out.get(x, ()) if d not in depth})
            depth.update(dict.fromkeys(front, k))
        want += [(root, x, k) for x, k in depth.items() if k]
    assert rows(reach(nodes, e, ("CALLS",), "OUT", 4), "root", "id", "depth") == sorted(want)


def test_components_agree_with_union_find(spark):
    g = random.Random(5)
    pairs = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert rows(got, "id", "component") == sorted((x, find(x)) for x in parent)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_end_with_stars_and_small_rounds_take_few_tasks(spark, monkeypatch):
    written = []
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(df.rdd.getNumPartitions()) or write(df, name))
    star = spark.range(1, 300).selectExpr("id as src", "0l as dst")
    assert connected_components(star).filter("component = 0").count() == 300
    assert len(written) == 1
    with setting(spark, "spark.sql.shuffle.partitions", "64"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        chain = spark.range(100).selectExpr("id as src", "id + 1 as dst")
        assert {r["component"] for r in connected_components(chain, most=100).collect()} == {0}
        assert len(written) > 2 and set(written[1:]) == {LEAST_PARTS}

def test_neighbours_in_every_direction(spark):
    nodes, edges = graph(spark, [("a", "b", "CALLS"), ("c", "a", "CALLS"), ("a", "zz", "USES")], {"b": "Function"})
    root = nodes.filter("id = 'a'")
    assert rows(neighbours(root, nodes, edges, "OUT"), "related") == [("b",), ("zz",)]
    assert rows(neighbours(root, nodes, edges, "IN"), "related") == [("c",)]
    assert rows(neighbours(root, nodes, edges, "BOTH", ("CALLS",), "Function"), "related") == [("b",)]


def test_context_expansion_greedy_and_set_based(spark):
    nodes, edges = graph(spark, [("f", "c1", "CONTAINS"), ("f", "c2", "CONTAINS"), ("c1", "m", "DEFINES"), ("c2", "c1", "EXTENDS")], {"f": "File", "c1": "Class", "c2": "Class", "m": "Method"})
    hits = spark.createDataFrame([("f", 1), ("c1", 2)], "id string, rank int")
    assert rows(expand_context_exact(hits, nodes, edges), "related") == [("c1",), ("c2",)]  # c1 was reached, hence isn't expanded
    assert rows(expand_context(hits, nodes, edges), "related") == [("c1",), ("c2",), ("f",), ("m",)]
    assert expand_context(hits, nodes, edges, max_related=1).count() == 1
    deep = [("File", "CONTAINS", None, "OUT", 2), ("File", "DEFINES", None, "OUT", 1)]
    from graphquarry.operators.graph import rules_table

    assert rows(expand_context(hits.limit(1), nodes, edges, rules_table(spark, deep)), "related", "depth") == [("c1", 1), ("c2", 1)]


def test_upsert_and_edges_are_idempotent(spark):
    old = spark.createDataFrame([("a", "Class", "A", "s"), ("b", "Class", "B", None)], "id string, label string, name string, generated_summary string")
    new = spark.createDataFrame([("a", "Class", "A2", None), ("c", "File", "C", None)], old.schema)
    once = upsert_nodes(old, new)
    assert rows(once, "id", "name") == [("a", "A2"), ("b", "B"), ("c", "C")]
    assert once.filter("id = 'a'").first()["generated_summary"] == "s"
    assert sorted(map(str, upsert_nodes(once, new).collect())) == sorted(map(str, once.collect()))
    nodes, edges = graph(spark, [("a", "b", "CALLS")])
    extra = spark.createDataFrame([("a", "b", "CALLS", {"k": "2"}), ("a", "gone", "CALLS", {})], edges.schema)
    merged = create_edges(nodes, edges, extra)
    assert [(r["src"], r["dst"], r["properties"]) for r in merged.collect()] == [("a", "b", {"k": "2"})]
    assert merge_edges(merged, merged).count() == 1


def test_deletes(spark):
    nodes, edges = graph(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("x", "y", "CALLS")])
    n, e = delete_owned(nodes, edges, spark.createDataFrame([("pb",)], "path string"))
    assert rows(n, "id") == [("a",), ("c",), ("x",), ("y",)] and rows(e, "src") == [("x",)]
    n, e = delete_component(nodes, edges, nodes.filter("id = 'c'"))
    assert rows(n, "id") == [("x",), ("y",)] and e.count() == 1


def test_derived_inheritance(spark):
    made = spark.createDataFrame([("1", "Class", "A", "p", ["q.B", "Z"], ["I"], None), ("2", "Class", "B", "o", None, None, None), ("3", "Interface", "I", "p", None, None, ["J<int>"]), ("4", "Interface", "J", "p", None, None, None)], "id string, label string, name string, path string, base_classes array<string>, interfaces array<string>, base_interfaces array<string>")
    assert rows(derived_inheritance(made), "src", "dst", "type") == [("1", "2", "EXTENDS"), ("1", "3", "IMPLEMENTS"), ("3", "4", "EXTENDS")]


def test_context_of_many_queries_is_that_of_each(spark):
    g = random.Random(9)
    kinds = ["File", "Class", "Method", "Function"]
    labels = {f"n{i:02d}": kinds[i % 4] for i in range(40)}
    edges = [(f"n{g.randrange(40):02d}", f"n{g.randrange(40):02d}", g.choice(["CONTAINS", "DEFINES", "CALLS", "EXTENDS", "IMPORTS"])) for _ in range(300)]
    nodes, e = graph(spark, edges, labels)
    asked = {q: [f"n{g.randrange(40):02d}" for _ in range(g.randrange(1, 14))] for q in range(6)}
    hits = spark.createDataFrame([(q, x, k) for q, found in asked.items() for k, x in enumerate(found)], "query_id int, id string, rank int")
    for budget in (3, 50):
        got = expand_context_each(hits, nodes, e, max_related=budget)
        want = []
        for q, found in asked.items():
            own = spark.createDataFrame([(x, k) for k, x in enumerate(found)], "id string, rank int")
            want += [(q, *x) for x in rows(expand_context_exact(own, nodes, e, max_related=budget), "related", "rank", "rule_ord")]
            assert len([x for x in want if x[0] == q]) <= budget
        assert rows(got, "query_id", "related", "rank", "rule_ord") == sorted(want)


def test_a_hub_is_dealt_over_several_tasks(spark, monkeypatch):
    """Callers of one method: no part has more than its share, and what is reached is the same."""
    monkeypatch.setattr(joins, "LEAST_PART", 50)
    edges = spark.range(2000).select(F.format_string("c%04d", "id").alias("src"), F.when(F.col("id") < 1500, "hub").otherwise(F.format_string("d%d", F.col("id") % 400)).alias("dst"), F.lit("CALLS").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"))
    into = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    made = joins.split(into, "src", F.xxhash64("dst"), share=0.002, least=50)
    assert made.rows.filter("src = 'hub'").groupBy("_own").count().agg(F.max("count")).first()[0] < 120 and made.hubs.count() == 1
    met = made.join(spark.createDataFrame([("r1", "hub"), ("r2", "hub"), ("r2", "d7")], "root string, id string"), "id")
    assert met.filter("id = 'hub'").count() == 3000 and met.filter("id = 'd7'").count() == edges.filter("dst = 'd7'").count()
    nodes = edges.select(F.col("src").alias("id")).union(spark.createDataFrame([("hub",)], "id string")).select("id", F.lit("Method").alias("label"), F.col("id").alias("name"), F.col("id").alias("full_name"))
    root = nodes.filter("id = 'hub'").select("id")
    assert reach(root, edges, ("CALLS",), "IN", 2).count() == 1500
    assert [r[0] for r in rows(call_hierarchy(root, nodes, edges, 1, "IN"), "id")] == [f"c{i:04d}" for i in range(20)]


def test_hierarchies_of_all_nodes(spark):
    g = random.Random(5)
    pairs = [(f"n{g.randrange(30)}", f"n{g.randrange(30)}", g.choice(["CALLS", "EXTENDS", "IMPLEMENTS"])) for _ in range(70)] + [("n1", "n1", "EXTENDS"), ("n1", "lost", "EXTENDS"), ("lost", "n2", "EXTENDS")]
    nodes, edges = graph(spark, pairs)
    nodes = nodes.filter("id <> 'lost'")
    names = ("root", "direction", "id", "label", "full_name", "depth")
    every = hierarchies(nodes, edges, ("EXTENDS", "IMPLEMENTS"), 5)
    assert rows(every, *names) == rows(inheritance_hierarchy(nodes.select("id"), nodes, edges), *names) and every.filter("root_name <> concat('p::', root)").count() == 0
    assert rows(hierarchies(nodes, edges, ("CALLS",), 3, 2), *names) == rows(call_hierarchy(nodes.select("id"), nodes, edges, 3, limit=2), *names)
    assert hierarchies(nodes, edges, ("USES",), 3).count() == 0
