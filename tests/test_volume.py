"""What a run exchanges and writes: no more than what changed needs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry import extract
from graphquarry import index as indexing
from graphquarry.operators import enrich, name_index, vector
from graphquarry.plans import catalogue, storage
from graphquarry.plans.views import view
from graphquarry.schema import EDGE, packed, unpacked
from graphquarry.sources import store

TEXT = "class C{n}:\n    def m(self, x): return x\n"
SCHEMA = "path string, absolute_path string, content string, checksum string, size long, extension string, language string"


def files(spark, names, text=TEXT):
    rows = [(f"p{n}.py", f"/p{n}.py", text.replace("{n}", str(n)), str(hash((n, text))), 1, ".py", "python") for n in names]
    return spark.createDataFrame(rows, SCHEMA)


def written(spark, run):
    """Rows of the tables that a run writes, by their names."""
    known = storage._WRITTEN.setdefault(spark.sparkContext.applicationId, set())
    before = set(known)
    result = run()
    return result, {p.rpartition("/")[2].rpartition("-")[0]: spark.read.parquet(p).count() for p in known - before}


def facts(result):
    return sorted((r["full_name"], r["label"], r["generated_summary"]) for r in result.nodes.collect()), sorted((r["src"], r["dst"], r["type"]) for r in result.edges.collect())


def test_runs_write_what_changed(spark):
    one, tables = written(spark, lambda: indexing.index_files(files(spark, range(20)), *indexing.empty(spark)))
    assert one.nodes.count() == 20 * 5 and one.edges.count() == 20 * 4
    assert tables["extracted"] == 20 and sum(n for t, n in tables.items() if t.startswith(("nodes", "edges", "told"))) == 0
    same, tables = written(spark, lambda: indexing.index_files(files(spark, range(20)), one.nodes, one.edges))
    assert facts(same) == facts(one) and sum(n for t, n in tables.items() if t.startswith(("nodes", "edges", "told", "extracted"))) == 0
    noted = one.nodes.withColumn("generated_summary", F.when(F.col("label") == "Method", F.lit("s")))
    changed = files(spark, range(2, 20)).unionByName(files(spark, [1, 30], "class Other:\n    def m(self, x): return x\n"))
    two, tables = written(spark, lambda: indexing.index_files(changed, noted, one.edges))
    assert tables["nodes"] == 10 and tables["extracted"] == 2  # of 1 and 30; the 18 others stay where they are
    assert {r["metric"]: r["n"] for r in two.summary.collect()} == {"files new": 1, "files modified": 1, "files unchanged": 18, "files deleted": 1, "files failed": 0, "nodes created": 9, "nodes merged": 1, "edges": 80, "files removed": 1, "nodes removed": 8}
    assert two.nodes.filter("path = 'p5.py' and generated_summary = 's'").count() == 1 and two.nodes.filter("path = 'p0.py'").count() == 0


def test_repeats_and_open_files_are_merged(spark):
    twice = files(spark, [1, 1, 2])
    result = indexing.index_files(twice, *indexing.empty(spark))
    assert result.nodes.count() == result.nodes.select("id").distinct().count() == 10 and result.edges.count() == 8
    node, edge = lambda i: {"id": i}, lambda a, b: {"src": a, "dst": b, "type": "CONTAINS"}
    assert extract.is_closed([node("a"), node("b")], [edge("a", "b")])
    assert not extract.is_closed([node("a")], [edge("a", "b")]) and not extract.is_closed([node("a"), node("a")], [])
    assert not extract.is_closed([node("a"), node("b")], [edge("a", "b")] * 2)


@pytest.mark.parametrize("ids", [["0f" * 32, "x", "", None, "é" * 16, "0F" * 32, "\0" * 33]])
def test_packed_ids_come_back(spark, ids):
    rows = spark.createDataFrame([(x,) for x in ids], "id string").select("id", packed("id").alias("k"))
    assert [r[0] for r in rows.select(unpacked("k")).collect()] == ids and rows.select("k").distinct().count() == len(ids)
    assert rows.filter("octet_length(k) = 32").count() == 1


def test_edges_without_ends(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", None), ("b", "c", "CALLS", {"k": "v"}), ("c", "d", "CALLS", None)], EDGE)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert store.without_ends(edges, one("a"), one("d")).collect() == edges.filter("src = 'b'").collect()


def test_closed_files_store_places_of_ends(spark):
    out = extract.extract(files(spark, range(3)))
    assert out.select(F.explode("edges.src").alias("src"), "edges.src_at").filter("src is not null").count() == 0
    ids, edges = {r["id"] for r in extract.extracted_nodes(out).collect()}, extract.extracted_edges(out).collect()
    assert len(edges) == 12 and {r["src"] for r in edges} | {r["dst"] for r in edges} == ids


def test_lookups_of_one_name_are_one(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{k}", "Class", "red ring", f"pkg::red ring::{k}") for k in range(30)], "id string, label string, name string, full_name string")
    index = name_index.build(nodes, f"file://{tmp_path}/names")
    asked = spark.createDataFrame([(k, ("red ring", "re", None)[k % 3]) for k in range(90)], "lookup_id long, entity string")
    found, tables = written(spark, lambda: name_index.indexed_lookup(index, asked, nodes, 5))
    assert tables["lookups"] == 1 and tables["found"] == 10
    rows = found.collect()
    assert len(rows) == 60 * 5 and {r["place"] for r in rows} == {1, 2, 3, 4, 5} and {r["lookup_id"] % 3 for r in rows} == {0, 1}
    many = name_index.build(nodes, f"file://{tmp_path}/many")
    assert sorted(name_index.indexed_lookup(many, asked, nodes, 5).collect()) == sorted(rows)


def test_scores_are_held_in_small_blocks():
    g = np.random.default_rng(1)
    asked, rows = (vector.unit(g.normal(size=(n, 8))) for n in (4000, 1000))
    best = vector.Best(len(asked), 1)
    tracemalloc.start()
    best.add(asked, rows, np.array([f"n{k:04}" for k in range(len(rows))], object), np.arange(len(asked)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # 32 MB of scores in all
    want = np.round((1 + asked @ rows.T) / 2, 12).argmax(axis=1)
    assert [x[0] for x in best.ids] == [f"n{k:04}" for k in want]


def test_levels_read_written_nodes(spark):
    rows = [(str(k), ("Method", "Class", "File")[k % 3], f"n{k}", f"p::n{k}", "code", None, None) for k in range(30)]
    nodes = spark.createDataFrame(rows, "id string, label string, name string, full_name string, raw_code string, generated_summary string, summary_status string")
    plan = enrich.prompts(nodes, nodes, spark.createDataFrame([("1", "0", "DEFINES", None)], EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    done, tables = written(spark, lambda: enrich.summarise_levels(nodes, spark.createDataFrame([("1", "0", "DEFINES", None)], EDGE)))
    assert done.filter("generated_summary is not null").count() == 30 and "summary_nodes" not in tables


def test_new_files_are_not_exchanged(spark):
    """Texts of files meet the list of changes only where some file is left alone."""
    assert not extract.is_closed([{"id": "a"}, {"id": "b"}], [{"src": "a", "dst": "b", "type": t} for t in ("CONTAINS", "DEFINES")])
    out = extract.extract(files(spark, range(3)))
    names = {(r["full_name"], r["edge"], r["above"]) for r in extract.placed_nodes(out, {"full_name": "above"}, "full_name").filter("full_name like 'p1%'").collect()}
    assert names == {("p1.py", None, None), ("p1.py::C1", "CONTAINS", "p1.py"), ("p1.py::C1::m", "DEFINES", "p1.py::C1"), ("p1.py::C1::m::self", "DECLARES", "p1.py::C1::m"), ("p1.py::C1::m::x", "DECLARES", "p1.py::C1::m")}


def test_parents_of_closed_files_need_no_join(spark):
    plan = catalogue.QUERIES["extract_csharp"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    out = storage.materialise(extract.extract(files(spark, range(4))), "extracted")
    part = out.withColumn("closed", F.col("path") < "p2.py")
    facts = lambda df: sorted((r["full_name"], r["edge"] or "", r["parent"] or "") for r in df.collect())
    assert facts(catalogue._with_parents(part)) == facts(catalogue._with_parents(out)) and len(facts(catalogue._with_parents(out))) == 20
    assert "Join" in catalogue._with_parents(part)._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_merged_with_tables_that_grow(spark):
    nodes = view(spark, "/root/testdata/sf0.001", "nodes")
    for df in (nodes, nodes.select("id", "label"), catalogue.QUERIES["enrichment_totals"](spark, "/root/testdata/sf0.001")):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
