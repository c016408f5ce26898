"""Indexing from end to end, the command line, backends, lookups, and extraction in full."""

import collections
import json
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry import __main__ as cli
from graphquarry import extract
from graphquarry import index as indexing
from graphquarry.operators import components, enrich, search, vector
from graphquarry.plans import samples, storage
from graphquarry.sources import scan, store


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def metrics(result):
    return {r["metric"]: r["n"] for r in result.summary.collect()}


def names(df):
    return sorted((r["label"], r["full_name"]) for r in df.collect())


def test_index_follows_a_tree(spark, tmp_path):
    root, at = tmp_path / "tree", f"file://{tmp_path}/store"
    write(root, {"a/__init__.py": "class A:\n    def m(self): pass\n", "b.js": "module.exports = 1;\n", "c.py": "def f(): pass\n", "bad.py": "def (", "lib/x.js": "const y = require('z');\n", "lib/package.json": json.dumps({"type": "module"})})
    one = indexing.index(spark, str(root), at)
    assert metrics(one) == {"files new": 4 + 1, "files modified": 0, "files unchanged": 0, "files deleted": 0, "files failed": 1, "nodes created": 10, "nodes merged": 0, "edges": 6, "files removed": 0, "nodes removed": 0}
    assert [r["path"] for r in one.failures.collect()] == ["bad.py"]
    assert ("Export", "b.js::module.exports") in names(one.nodes) and ("Import", "lib/x.js::require::z") not in names(one.nodes)
    before = names(one.nodes)
    again = indexing.index(spark, str(root), at)  # what failed is new once more, and fails again
    assert names(again.nodes) == before and metrics(again)["files unchanged"] == 4 and metrics(again)["files failed"] == 1
    (root / "bad.py").unlink()
    indexing.write(enrich.enrich(*indexing.read(spark, at)), indexing.read(spark, at)[1], at)
    number = indexing.versions(spark, at)[-1]
    same = indexing.index(spark, str(root), at)
    assert indexing.versions(spark, at)[-1] == number and set(metrics(same).values()) == {0, 4, 6}
    write(root, {"c.py": "def f(): return 1\ndef g(): pass\n"})
    (root / "b.js").unlink()
    two = indexing.index(spark, str(root), at)
    assert metrics(two) == {"files new": 0, "files modified": 1, "files unchanged": 2, "files deleted": 1, "files failed": 0, "nodes created": 1, "nodes merged": 2, "edges": 6, "files removed": 1, "nodes removed": 1}
    kept = {r["full_name"]: r for r in two.nodes.collect()}
    assert kept["c.py::f"]["generated_summary"] and kept["c.py::f"]["raw_code"] == "def f(): return 1" and "b.js" not in kept and kept["c.py::g"]["generated_summary"] is None
    assert len(indexing.versions(spark, at)) == 2
    indexing.reset(spark, at)
    assert indexing.read(spark, at)[0].count() == 0


def test_command_line(spark, tmp_path, capsys):
    root, at = tmp_path / "tree", f"file://{tmp_path}/store"
    write(root, {"pay.py": 'class PaymentService:\n    """Pays."""\n    def charge(self, card): return card\n'})
    args = cli.parser().parse_args
    assert {r["metric"]: r["n"] for r in cli.run(spark, args(["index", str(root), at])).collect()}["nodes created"] == 5
    assert {r["label"]: r["n"] for r in cli.run(spark, args(["summarize", at])).collect()} == {"Class": 1, "File": 1, "Method": 1, "Parameter": 2, "total": 5}
    found = cli.run(spark, args(["search", at, "PaymentService class", "--similarity", "0.1"])).collect()
    assert found[0]["name"] == "PaymentService" and found[0]["rank"] == 1
    status = {(r["kind"], r["value"]): r["n"] for r in cli.run(spark, args(["status", at])).collect()}
    assert status["nodes", "Class"] == 1 and status["edges", "DEFINES"] == 1 and status["files", "python"] == 1 and status["embedded", "Class"] == 1
    assert cli.run(spark, args(["explain", "PaymentService class"])).first()["query_type"] == "hybrid"
    cli.show(cli.run(spark, args(["explain", "DB"])), True)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["query_type"] == "entity"
    assert cli.main(["index", str(tmp_path / "none"), at]) == 2 and cli.main(["search", at, " "]) == 2
    cli.run(spark, args(["reset", at]))
    assert indexing.read(spark, at)[0].filter("summary_status is not null").count() == 0
    assert cli.run(spark, args(["reset", at, "--everything"])).filter("kind = 'nodes'").count() == 0
    with pytest.raises(SystemExit):
        args(["search"])


def test_limits_of_a_search():
    for wrong in ({"max_total_results": 0}, {"max_vector_results": 101}, {"min_similarity": -0.1}, {"context_roots": -1}):
        with pytest.raises(ValueError):
            search.SearchConfig(**wrong)


def test_backends_fail_alone(spark):
    def summarise(prompts):
        if any("name: bad" in p for p in prompts):
            raise RuntimeError("no")
        return [None if "odd" in p else f"about {p.splitlines()[0].split()[-1]}" for p in prompts]

    nodes = spark.createDataFrame([(x, "Function", f"name: {x}" if x == "bad" else x, f"p::{x}", "code", None, None) for x in ("a", "bad", "odd", "z")], "id string, label string, name string, full_name string, raw_code string, generated_summary string, summary_status string").coalesce(1)
    edges = spark.createDataFrame([], "src string, dst string, type string")
    got = {r["id"]: r["generated_summary"] for r in enrich.summarise_levels(nodes, edges, enrich.batch_summariser(summarise, 3)).collect()}
    assert got == {"a": "about a", "bad": "Code function - summary generation failed", "odd": "Code function - summary generation failed", "z": "about z"}

    def embed(texts):
        if "x" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    pending = spark.createDataFrame([(str(k), "Class", "n", "c", t, None) for k, t in enumerate(["long text", "x", "abc"])], "id string, label string, name string, raw_code string, generated_summary string, embedding array<float>").coalesce(1)
    done = {r["id"]: r["embedding"] for r in enrich.embed_pending(pending, enrich.batch_embedder(embed, 2, 4)).collect()}
    assert done == {"0": [4.0, 1.0], "1": None, "2": [3.0, 1.0]}
    assert [r["id"] for r in enrich.pending_embeddings(enrich.embed_pending(pending, enrich.batch_embedder(embed, 2, 4))).collect()] == ["1"]


def test_nearest_neighbours_agree_with_numpy(spark):
    g = np.random.default_rng(2)
    rows = [(f"n{i:03d}", ("File", "Class")[i % 2], [float(x) for x in g.normal(size=4 if i % 7 else 3)]) for i in range(200)]
    rows += [("zero", "File", [0.0] * 4), ("none", "File", None), ("twin", "File", rows[2][2]), ("other", "Import", rows[2][2])]
    nodes = spark.createDataFrame(rows, "id string, label string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 60)] + [(900, [0.0] * 4), (901, []), (902, None)], "query_id long, vector array<double>")
    want = []
    for q in range(60):
        for label in ("File", "Class"):
            found = [(-round((1 + np.dot(rows[q][2], v) / np.linalg.norm(rows[q][2]) / np.linalg.norm(v)) / 2, 9), i) for i, x, v in rows if x == label and v and len(v) == len(rows[q][2]) and any(v)]
            want += [(q, i, label, -s) for s, i in sorted(found)[:6]]
    for size in (1 << 20, 300):  # one pass, and many
        got = vector.knn(nodes, asked, 6, query_bytes=size)
        assert sorted((r["query_id"], r["id"], r["label"], round(r["score"], 6)) for r in got.collect()) == sorted((*x, round(float(s), 6)) for *x, s in want)


def test_lookup_finds_whatever_contains(spark):
    words = ["", "a", "ab", "abc", "xabcx", "bca", "Äbc", "aaaa", None]
    nodes = spark.createDataFrame([(str(k), "Class", n, f) for k, (n, f) in enumerate((n, f) for n in words for f in ("p::" + (n or ""), None))], "id string, label string, name string, full_name string")
    asked = ["", "a", "b", "bc", "abc", "p::a", "Ä", "aaa", "nothing"]
    got = collections.Counter(r["entity"] for r in search.lookup(spark.createDataFrame([(x, x) for x in asked] + [("null", None)], "lookup_id string, entity string"), nodes, 1000).collect())
    want = collections.Counter({e: sum(e in (n or "\0") if n is not None and e in n else f is not None and e in f for n, f in ((n, f) for n in words for f in ("p::" + (n or ""), None))) for e in asked})
    assert got == +want


def test_upsert_reduces_repeated_ids(spark):
    old = spark.createDataFrame([("a", "A", 1)], "id string, name string, size long")
    one = spark.createDataFrame([("a", "B", None), ("b", None, 2), ("b", "x", None)], old.schema)
    two = spark.createDataFrame([("a", None, 7), ("c", "C", 3)], old.schema)
    assert sorted(map(tuple, store.upsert_nodes(old, one, two).collect())) == [("a", "B", 7), ("b", "x", 2), ("c", "C", 3)]


def test_hubs_are_split_in_large_edge_lists(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 10)
    edges = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, k + 1000) for k in range(5)] + [(7000, 7001)], "src long, dst long")
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in [*range(300), *range(1000, 1005)]} | {7000: 7000, 7001: 7000}


def test_scan_goes_down_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "FOLDERS", 2)
    files = {f"d{k}/e{k % 3}/f{j}.py": f"x = {k}\n" for k in range(6) for j in range(2)} | {"top.py": "", "d0/build/no.py": "", "d1/e1/.git/no.py": "", "d2/_u.py": ""}
    write(tmp_path, files)
    got = {r["path"]: r["size"] for r in scan.scan_directory(spark, str(tmp_path)).collect()}
    assert got == {k: len(v) for k, v in files.items() if "build" not in k and ".git" not in k}
    assert {r["path"] for r in scan.scan_directory(spark, f"file://{tmp_path}").collect()} == set(got)
    js = spark.createDataFrame([("a.ts",), ("a.d.ts",), ("dist/b.js",), ("c.py",)], "path string")
    assert [r["path"] for r in scan.javascript_files(js).collect()] == ["a.ts"]


@pytest.mark.parametrize("language", list(samples.SOURCES))
def test_extraction_of_the_samples(language):
    suffix, system, text = samples.SOURCES[language]
    path = f"f7.{suffix}"
    filled = text.replace("@decorated", "#1").replace("@static", "#2").replace("@", "7").replace("#1", "@decorated").replace("#2", "@static")
    nodes, edges = extract.extract_text(path, filled, language, system)
    own = {n["id"]: n for n in nodes}
    parent = {e["dst"]: (e["type"], own[e["src"]]["full_name"]) for e in edges}
    got = sorted((n["label"], n["name"], n["full_name"], *parent.get(n["id"], (None, None))) for n in nodes) if language != "csharp" else None
    want = [tuple(x.replace("@", "7") if isinstance(x, str) else x for x in r[:5]) for r in samples.EXPECTED[language]]
    key = lambda r: tuple(map(str, r))
    got = got or [(n["label"], n["name"], n["full_name"], *parent.get(n["id"], (None, None))) for n in nodes]
    assert sorted(got, key=key) == sorted(want, key=key)
    for n in nodes[1:]:
        if n.get("location") and n["label"] != "Variable":
            lines = filled.split("\n")[n["location"]["start_line"] - 1 : n["location"]["end_line"]]
            assert n["raw_code"].strip().split("\n")[0].strip() in "\n".join(lines)


CSHARP = """using System;
using System.Collections.Generic;
using System.Threading.Tasks;
using Acme.Core;

namespace Acme.Shop
{
    public interface IItem { int Id { get; } string Title { get; set; } decimal Price { get; } bool Sold { get; } string Show(); }
    public interface IShelf { IItem Find(int id); Task<bool> PutAsync(IItem item); IEnumerable<IItem> All(); void Drop(int id); }
    public interface INotes { void Note(string text); void Fail(string text, Exception why); }

    public abstract class Room
    {
        protected readonly INotes _notes;
        protected Room(INotes notes) { _notes = notes; }
        public abstract Task<bool> OpenAsync();
        protected virtual void Say(string text) { _notes.Note(text); }
    }

    public class Item : IItem
    {
        private DateTime _made;
        public int Id { get; set; }
        public string Title { get; set; }
        public decimal Price { get; set; }
        public bool Sold { get; private set; }
        public string Tag => $"{Title} {{{Id}}}";
        public Item() { _made = DateTime.Now; }
        public Item(int id, string title) { Id = id; Title = title; }
        public string Show() { return Tag; }
        public static bool Same(Item a, Item b) => a.Id == b.Id;
    }

    public sealed class Shelf : Room, IShelf
    {
        private List<IItem> _items = new List<IItem>();
        public Shelf(INotes notes) : base(notes) { }
        public override async Task<bool> OpenAsync() { await Task.Delay(1); return true; }
        public IItem Find(int id) { foreach (var x in _items) { if (x.Id == id) { return x; } } return null; }
        public async Task<bool> PutAsync(IItem item) { _items.Add(item); return true; }
        public IEnumerable<IItem> All() { return _items; }
        public void Drop(int id) { _items.RemoveAll(x => x.Id == id); }
    }

    public static class Shelves
    {
        private static Shelf _one;
        public static Shelf Get(INotes notes) { return _one ??= new Shelf(notes); }
    }
}
"""


def test_csharp_counts():
    """A file of our own with interfaces, an abstract, a sealed and a static class; counts derived by hand."""
    nodes, edges = extract.extract_text("Shop.cs", CSHARP, "csharp")
    assert collections.Counter(n["label"] for n in nodes) == {"File": 1, "Import": 4, "Interface": 3, "Class": 4, "Method": 21, "Variable": 13, "Parameter": 17}
    assert collections.Counter(e["type"] for e in edges) == {"IMPORTS": 4, "CONTAINS": 7, "DEFINES": 21, "HAS_MEMBER": 13, "DECLARES": 17}
    by = {n["full_name"]: n for n in nodes}
    assert by["Acme.Shop.Item"]["interfaces"] == ["Acme.Shop.IItem"] and by["Acme.Shop.Item"]["base_classes"] == []
    assert by["Acme.Shop.Shelf"]["base_classes"] == ["Acme.Shop.Room"] and by["Acme.Shop.Shelf"]["interfaces"] == ["Acme.Shop.IShelf"] and by["Acme.Shop.Shelf"]["is_sealed"]
    assert by["Acme.Shop.IItem.Show()"]["visibility"] == "private" and by["Acme.Shop.Shelves"]["is_static"] and by["Acme.Shop.Room"]["is_abstract"]
    assert sum("is_constructor" in (n.get("properties") or {}) for n in nodes) == 4


@pytest.mark.parametrize(("language", "unit"), [("typescript", "const a{0} = {0}\nfunction f{0}(x: number) {{ return x }}\n"), ("javascript", "let a{0} = {0};class C{0} {{ m(x) {{ return x }} }}\n"), ("csharp", "namespace N{0} {{ class C{0} {{ int f{0} = 1; void M(int a) {{ }} }} }}\n")])
def test_scanners_take_linear_time(language, unit):
    """Eight times the text takes far less than sixty-four times as long."""

    def seconds(n):
        text = "".join(unit.format(k) for k in range(n))
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            nodes, _ = extract.extract_text("f", text, language)
            best = min(best, time.perf_counter() - began)
        assert len(nodes) > 3 * n
        return best

    assert seconds(2400) < 24 * seconds(300) + 0.05


def test_storage(spark, monkeypatch):
    assert [storage.byte_size(x) for x in ("64m", "1024", "3 kb", "2GiB", "268435456b")] == [64 << 20, 1024, 3 << 10, 2 << 30, 268435456]
    with pytest.raises(ValueError):
        storage.byte_size("many")
    t = storage.materialise(spark.range(5), "kept")
    assert t.count() == 5 and storage.exists(spark, t.written_to)
    storage.discard(t, None, spark.range(1))
    assert not storage.exists(spark, t.written_to)
    t = storage.materialise(spark.range(5), "swept")
    storage.cleanup(spark)
    assert not storage.exists(spark, t.written_to)

    for master in ("yarn", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError):
            storage.shared_dir(cluster)
    cluster.conf.get = lambda key, default: "s3a://bucket/tmp/"
    assert storage.shared_dir(cluster) == "s3a://bucket/tmp"


def test_stream_into_a_store(spark, tmp_path):
    from graphquarry.streaming.incremental import index_stream, into_store

    at = f"file://{tmp_path}/store"
    schema = "path string, absolute_path string, content string, checksum string, size long, extension string, language string"
    for n, rows in enumerate(([("a.py", "/a.py", "def f(): pass", "1", 1, ".py", "python"), ("b.py", "/b.py", "x = 1", "1", 1, ".py", "python")], [("a.py", "/a.py", "def g(): pass", "2", 1, ".py", "python")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        files = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        index_stream(files, lambda: indexing.read(spark, at)[0].filter("label = 'File'"), into_store(spark, at), f"{tmp_path}/ck").awaitTermination()
        assert names(indexing.read(spark, at)[0]) == sorted([("File", "a.py"), ("File", "b.py"), ("Function", f"a.py::{'fg'[n]}")])


def test_entry_names_only_what_is_missing(monkeypatch):
    """A missing library isn't taken for the absence of the training-data operators."""
    import importlib
    import sys

    import __spark_entry__ as e

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError("gone", name=Gone.missing)
            return None

    held = sys.modules.pop("corpus_pipeline", None)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        Gone.missing = "corpus_pipeline"
        assert not any(x.startswith("op") for x in importlib.reload(e).queries())
        Gone.missing = "ahocorasick"
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(e)
    finally:
        monkeypatch.undo()
        if held:
            sys.modules["corpus_pipeline"] = held
        importlib.reload(e)


def test_flags_of_unknown_labels(spark):
    from graphquarry.schema import known_label

    rows = spark.createDataFrame([("Class",), ("Widget",), (None,)], "label string").select(known_label(F.col("label")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["Class", "Node", "Node"]
