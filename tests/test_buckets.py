"""A store that a change rewrites in part, and two writers at once."""

import pathlib

import pytest
from pyspark.sql import functions as F

from graphquarry import index as indexing
from graphquarry.sources import buckets

SCHEMA = "path string, absolute_path string, content string, checksum string, size long, extension string, language string"


def files(spark, texts):
    return spark.createDataFrame([(p, f"/{p}", t, str(hash(t)), len(t), ".py", "python") for p, t in texts.items()], SCHEMA)


def edges_of(n, e):
    full = {r["id"]: r["full_name"] for r in n.collect()}
    return sorted((full[r["src"]], full[r["dst"]], r["type"]) for r in e.collect())


def written(at):
    return {str(p): p.stat().st_size for p in pathlib.Path(at.removeprefix("file://")).rglob("*.parquet")}


def test_one_changed_file_rewrites_its_bucket_only(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    texts = {f"d{k % 40}/f{k}.py": f"class A{k}:\n    def m(self): pass\ndef g{k}(x): return A{k}()\n" for k in range(2000)}
    one = indexing.update(spark, files(spark, texts), at)
    assert one.nodes.count() == 2000 * 6 and one.edges.count() == 2000 * 6
    before = written(at)
    texts["d3/f3.py"] = "class A3:\n    def other(self): pass\n"
    two = indexing.update(spark, files(spark, texts), at)
    new = {k: v for k, v in written(at).items() if k not in before}
    assert sum(new.values()) <= 0.01 * sum(before.values())
    whole = indexing.index_files(files(spark, texts), *indexing.empty(spark))
    assert edges_of(two.nodes, two.edges) == edges_of(whole.nodes, whole.edges)
    assert {r["metric"]: r["n"] for r in two.summary.collect() if r["n"]} == {"files modified": 1, "files unchanged": 1999, "nodes created": 2, "nodes merged": 2, "edges": 2000 * 6 - 3, "nodes removed": 4}
    three = indexing.update(spark, files(spark, texts), at)  # nothing changed, nothing written
    assert indexing.versions(spark, at) == [1, 2] and three.edges.count() == two.edges.count()


def test_a_change_reaches_edges_of_other_buckets(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    texts = {f"f{k}.py": f"from hub import log\ndef g{k}(): log()\n" for k in range(30)} | {"hub.py": "def log(): pass\n"}
    calls = lambda r: sum(t == "CALLS" for _, _, t in edges_of(r.nodes, r.edges))
    assert calls(indexing.update(spark, files(spark, texts), at)) == 30
    texts["hub.py"] = "def other(): pass\n"
    assert calls(indexing.update(spark, files(spark, texts), at)) == 0
    texts["hub.py"] = "def log(): pass\n"
    del texts["f7.py"]
    assert calls(indexing.update(spark, files(spark, texts), at)) == 29
    own = indexing.read(spark, at)
    ids = {r["full_name"]: r["id"] for r in own[0].collect()}
    brought = spark.createDataFrame([(ids["f1.py::g1"], ids["hub.py::log"], "USES", {})], "src string, dst string, type string, properties map<string,string>")
    indexing.write(own[0], own[1].unionByName(brought), at)
    del texts["hub.py"]
    four = indexing.update(spark, files(spark, texts), at)
    assert not [x for x in edges_of(four.nodes, four.edges) if x[2] in ("USES", "CALLS")] and len(indexing.versions(spark, at)) == 2


def test_the_second_of_two_writers_loses_nothing(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    indexing.update(spark, files(spark, {"a.py": "x = 1\n"}), at)
    commit = buckets.commit

    def interrupted(*args, **kw):
        monkeypatch.setattr(buckets, "commit", commit)
        indexing.update(spark, files(spark, {"b.py": "def b(): pass\n"}), at, whole=False)  # another writer is faster
        return commit(*args, **kw)

    monkeypatch.setattr(buckets, "commit", interrupted)
    with pytest.raises(buckets.Conflict):
        indexing.update(spark, files(spark, {"c.py": "def c(): pass\n"}), at, whole=False)
    names = lambda: {r["full_name"] for r in indexing.read(spark, at)[0].collect()}
    assert names() == {"a.py", "b.py", "b.py::b"}
    folders = set(p.name for p in (tmp_path / "store" / "data").iterdir())
    indexing.update(spark, files(spark, {"c.py": "def c(): pass\n"}), at, whole=False)
    assert names() == {"a.py", "b.py", "b.py::b", "c.py", "c.py::c"} and len(folders) == 2


def test_a_commit_that_is_not_whole_is_none(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    indexing.update(spark, files(spark, {"a.py": "x = 1\n"}), at)
    (tmp_path / "store" / "commits" / "2.json").write_text('{"buckets": 25')
    assert buckets.newest(spark, at).number == 1 and indexing.read(spark, at)[0].filter(F.col("label") == "File").count() == 1
