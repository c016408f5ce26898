"""Parsing, scoring, change detection, enrichment, scanning and extraction."""

import json

import pytest
from pyspark.sql import functions as F

from graphquarry import extract
from graphquarry.functions.query_parser import parsed
from graphquarry.operators import changes, enrich, search, vector
from graphquarry.schema import EDGE, NODE, catalogue, create_tables, duplicates, flattened
from graphquarry.sources import scan, store

GOLDEN = [
    ("PaymentService class that handles stripe payments", "hybrid", 0.8, ["PaymentService"] * 2, ["class"], ["paymentservice", "that", "handles", "stripe", "payments"], ["Class"], False),
    ("authentication methods", "semantic", 0.6, [], [], ["authentication"], ["Method"], False),
    ("UserController login function", "hybrid", 0.8, ["UserController"] * 2, ["login", "function"], ["usercontroller"], ["Function"], False),
    ("database connection configuration", "contextual", 0.7, [], ["database", "connection"], ["configuration"], [], False),
    ("error handling in api endpoints", "contextual", 0.7, [], ["error", "api"], ["handling", "endpoints"], [], False),
    ("Classes", "entity", 0.9, ["Classes"], [], [], ["Class"], False),
    ("DB", "entity", 0.9, ["DB"], [], [], [], False),
    ("which code causes error", "contextual", 0.7, [], ["error"], ["which", "code", "causes"], [], True),
    ("class method", "semantic", 0.4, [], ["class", "method"], [], ["Class", "Method"], False),
    ("", "semantic", 0.4, [], [], [], [], False),
]


def test_query_parser(spark):
    got = parsed(spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "query_id int, text string")).orderBy("query_id").collect()
    for r, g in zip(got, GOLDEN, strict=True):
        assert (r["text"], r["query_type"], r["confidence"], r["entity_names"], r["programming_terms"], r["semantic_terms"], r["node_types"], r["expand_context"]) == g


def test_hybrid_search_worked_scores(spark):
    nodes = spark.createDataFrame([("a", "Class", "PaymentService", "x.PaymentService", None, [1.0, 0.0]), ("b", "Method", "PaymentServiceTest", None, None, [-1.0, 0.0]), ("c", "File", None, None, None, [0.0, 0.0])], "id string, label string, name string, full_name string, generated_summary string, embedding array<double>")
    edges = spark.createDataFrame([], EDGE)
    asked = spark.createDataFrame([(1, GOLDEN[0][0], [-1.0, -1.0])], "query_id long, text string, vector array<double>")
    got = {r["id"]: r for r in search.hybrid_search(asked, nodes, edges, search.SearchConfig(min_similarity=2.0)).collect()}
    assert got["a"]["hybrid_score"] == 2.0 and got["a"]["match_type"] == "entity+entity"
    assert got["b"]["hybrid_score"] == pytest.approx(0.9152) and set(got) == {"a", "b"}
    assert 0 <= min(r["hybrid_score"] for r in got.values()) <= 2


def test_vectors(spark):
    nodes = spark.createDataFrame([("a", "Class", "A", "text", [1.0, 0.0]), ("b", "Class", "B", None, [0.0, 1.0]), ("z", "Class", "Z", None, [0.0, 0.0]), ("n", "Class", "N", None, None), ("m", "Method", "M", None, [1.0, 1.0])], "id string, label string, name string, generated_summary string, embedding array<double>")
    near = vector.similar_to(nodes, [1.0, 0.0], 5, 0.4).collect()
    assert [(r["id"], round(r["score"], 3)) for r in near] == [("a", 1.0), ("m", 0.854), ("b", 0.5)]
    found = vector.similar_nodes(nodes, ["a", "n"], 5, 0.4).collect()
    assert [(r["query_id"], r["id"], round(r["score"], 3)) for r in found] == [("a", "b", 0.6)]
    assert vector.knn(nodes, spark.createDataFrame([], "query_id long, vector array<double>")).count() == 0


def test_change_detection(spark):
    cur = spark.createDataFrame([("src/new.py", "/r/src/new.py", "1", 1, ".py"), ("src/mod.py", "/r/src/mod.py", "2", 1, ".py"), ("src/same.py", "/r/src/same.py", "3", 1, ".py"), ("src/empty.py", "/r/src/empty.py", "4", 1, ".py")], "path string, absolute_path string, checksum string, size long, extension string")
    old = spark.createDataFrame([("src/mod.py", "x"), ("src/same.py", "3"), ("src/gone.py", "9"), ("other/kept.py", "9"), ("src/empty.py", "")], "path string, checksum string")
    found = changes.detect_changes(cur, old, "src/")
    assert {r["path"]: r["status"] for r in found.collect()} == {"src/new.py": "NEW", "src/mod.py": "MODIFIED", "src/same.py": "UNCHANGED", "src/gone.py": "DELETED", "src/empty.py": "NEW"}
    assert {r["status"]: r["n"] for r in changes.change_summary(found).collect()} == {"NEW": 2, "MODIFIED": 1, "UNCHANGED": 1, "DELETED": 1}
    assert changes.change_summary(found.limit(0)).agg(F.sum("n")).first()[0] == 0


def test_levels_wait_for_children(spark):
    nodes = spark.createDataFrame([("f", "File", "f.py", None, None, None), ("c", "Class", "C", "class C:", None, None), ("m", "Method", "m", "def m()", None, None), ("p", "Parameter", "x", None, None, "PROCESSING")], "id string, label string, name string, raw_code string, generated_summary string, summary_status string")
    edges = spark.createDataFrame([("f", "c", "CONTAINS"), ("c", "m", "DEFINES"), ("m", "p", "DECLARES")], "src string, dst string, type string")
    stuck = {r["id"]: r["generated_summary"] for r in enrich.summarise_levels(nodes, edges).collect()}
    assert stuck == {"f": None, "c": None, "m": None, "p": None}  # a parameter in work blocks all above it
    done = {r["id"]: r for r in enrich.summarise_levels(enrich.reset_status(nodes), edges).collect()}
    assert done["c"]["generated_summary"] == "Class C: class C: (1 components)" and done["f"]["summary_status"] == "COMPLETED"
    embedded = enrich.embed_pending(spark.createDataFrame([("a", "Class", "A", "code", "sum", None)], "id string, label string, name string, raw_code string, generated_summary string, embedding array<float>"))
    assert len(embedded.first()["embedding"]) == 64


def test_scan_and_index(spark, tmp_path):
    for name, text in {"a/__init__.py": "class A:\n    def m(self): pass\n", "node_modules/x.js": "", "b.JS": "function f(a) {}\n", ".hidden.py": "", "bad.py": "def (", "t.txt": "", "deep/.git/c.py": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = scan.scan_directory(spark, str(tmp_path))
    assert {r["path"]: r["language"] for r in files.collect()} == {"a/__init__.py": "python", "b.JS": "javascript", "bad.py": "python"}
    out = extract.extract(files)
    assert [r["path"] for r in extract.failures(out).collect()] == ["bad.py"]
    nodes, edges = extract.extracted_nodes(out), extract.extracted_edges(out)
    assert sorted((r["label"], r["name"]) for r in nodes.collect()) == [("Class", "A"), ("File", "__init__.py"), ("File", "b.JS"), ("Function", "f"), ("Method", "m"), ("Parameter", "a"), ("Parameter", "self")]
    assert edges.count() == 5 and duplicates(nodes).count() == 0
    store.write_snapshot(nodes, edges, str(tmp_path / "snap"))
    again, _ = store.read_snapshot(spark, str(tmp_path / "snap"))
    assert store.upsert_nodes(again, nodes).count() == nodes.count()
    store.write_interchange(nodes, edges, str(tmp_path / "json"))
    assert store.nodes_of(store.parse_interchange(spark.read.text(str(tmp_path / "json")))).count() == nodes.count()
    with pytest.raises(FileNotFoundError):
        scan.scan_directory(spark, str(tmp_path / "none"))
    assert "start_line" in flattened(nodes).columns
    create_tables(spark, "graph_test")
    assert [r["table_name"] for r in catalogue(spark, "graph_test").collect()] == ["edges", "nodes"]
    assert spark.createDataFrame([], NODE).count() == 0


def test_csharp_and_typescript_members():
    cs = "using A.B;\nnamespace N {\n  /// doc\n  public abstract class C : Base, IThing {\n    private readonly int x = 1, y;\n    public string Name { get; set; } = \"a;b\";\n    public C(ref int a) { }\n    protected override async Task<int> Run(string s = \"{\", params int[] r) { return 1; }\n  }\n}\n"
    nodes, edges = extract.extract_text("c.cs", cs, "csharp")
    by = {n["full_name"]: n for n in nodes}
    assert by["N.C"]["base_classes"] == ["Base"] and by["N.C"]["interfaces"] == ["IThing"] and by["N.C"]["docstring"] == "doc"
    assert by["N.C.x"]["value"] == "1" and by["N.C.y"]["is_readonly"] and not by["N.C.Name"]["is_readonly"]
    assert by["N.C.Run(string, params int[])"]["is_async"] and by["N.C.Run(string, params int[])::r"]["is_params"]
    assert by["N.C.C(ref int)"]["return_type"] == "void" and by["N.C.C(ref int)"]["properties"] == {"is_constructor": "true"}
    assert len(edges) == len(nodes) - 1
    ts = "export default class Q extends R implements S { static m(a?: number, b = `}`): string { return ''; } }\nexport { Q as T };\nconst re = 1;\n"
    nodes, _ = extract.extract_text("q.ts", ts, "typescript")
    assert [(n["label"], n["name"]) for n in nodes[1:]] == [("Class", "Q"), ("Method", "m"), ("Parameter", "a"), ("Parameter", "b"), ("Export", "export T"), ("Variable", "re")]


def test_stream_indexes_changed_files_once(spark, tmp_path):
    from graphquarry.streaming.incremental import index_stream

    rows = [("a.py", "/r/a.py", "1", 1, ".py"), ("b.py", "/r/b.py", "2", 1, ".py")]
    schema = "path string, absolute_path string, checksum string, size long, extension string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    stored = spark.createDataFrame([("a.py", "1")], "path string, checksum string")
    q = index_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), lambda: stored, lambda df, n: seen.extend((r["path"], r["status"]) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == [("b.py", "NEW")]


def test_entry_contract():
    import __spark_entry__ as e

    assert {"hybrid_search", "knn_similar", "change_detection"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(e.oracle_sql())
