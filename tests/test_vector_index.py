"""Exact nearest neighbours and names through written indexes, and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.operators import name_index, search, vector, vector_index
from graphquarry.plans import joins, storage


def facts(df):
    return sorted((r["query_id"], r["label"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(4)
    tops = g.normal(size=(30, 8))
    rows = [(f"n{i:04d}", ("File", "Class")[i % 2], [float(x) for x in tops[i % 30] + 0.05 * g.normal(size=8)]) for i in range(3000)]
    rows += [(f"same{i:03d}", "Class", [1.0] * 8) for i in range(400)]  # more of one kind than are asked for
    rows += [("zero", "File", [0.0] * 8), ("none", "File", None), ("short", "Class", [1.0, 2.0]), ("other", "Import", [1.0] * 8)]
    nodes = spark.createDataFrame(rows, "id string, label string, embedding array<double>").repartition(4)
    asked = [(i, rows[i * 7][2]) for i in range(40)] + [(100, [2.0] * 8), (101, [0.0] * 8), (102, []), (103, None), (104, [3.0, 1.0]), (105, [1.0, 2.0, 3.0])]
    return nodes, spark.createDataFrame(asked, "query_id long, vector array<double>")


def test_ties_keep_the_smallest_ids(spark, clustered):
    nodes, asked = clustered
    few = asked.filter("query_id = 100")
    got = vector.knn(nodes, few, 5).filter("label = 'Class'")
    assert [x[2] for x in facts(got)] == [f"same{i:03d}" for i in range(5)]
    same = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("Class").alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    sent = vector.embedded(same.coalesce(2)).mapInArrow(vector.nearest(vector.by_dim(*_first(asked.filter("query_id = 104"))), 5, vector.result_schema(asked)), vector.result_schema(asked))
    assert sent.count() == 2 * 5  # of each task, not all that tie


def _first(asked):
    return vector.in_passes(asked, 1 << 20)[0], 0


@pytest.mark.parametrize("k", [1, 7, 500])
def test_index_equals_brute_force(spark, clustered, k):
    nodes, asked = clustered
    index = vector_index.build(nodes, storage.new_path(spark, "index"), cells=40, block_rows=64)
    want = facts(vector.knn(nodes, asked, k))
    assert facts(vector_index.search(index, asked, k)) == want and len(want) > 40
    assert facts(vector_index.search(vector_index.open_index(spark, index.path), asked, k, query_bytes=600)) == want


def test_search_reads_few_cells_of_clustered_data(spark, clustered, monkeypatch):
    nodes, asked = clustered
    index = vector_index.build(nodes, storage.new_path(spark, "index"), cells=40)
    read = []
    blocks = vector_index.VectorIndex.blocks
    monkeypatch.setattr(vector_index.VectorIndex, "blocks", lambda self, wanted: (read.append(wanted), blocks(self, wanted))[1])
    assert vector_index.search(index, asked.filter("query_id = 3"), 10).count() == 20
    every = sum(len(cells) for cells, *_ in index.directory.values())
    assert sum(len(x) for w in read for x in w.values()) < every / 2
    plan = index.blocks(read[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_index_of_nothing(spark, clustered):
    nodes, asked = clustered
    index = vector_index.build(nodes.limit(0), storage.new_path(spark, "index"))
    assert vector_index.search(index, asked, 3).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(nodes, index.path)


def test_names_by_the_rarest_gram(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_PART", 20)
    words = ["getUser", "getUserName", "setName", "get", "x", "ab", "Äget", None, ""]
    rows = [(f"{k:03d}", "Class", n, f) for k, (n, f) in enumerate((n, f) for n in words for f in (f"mod::{n}", None))]
    rows += [(f"h{k:03d}", "Method", f"get{k}", f"hub::get{k}") for k in range(300)]  # a gram that nearly all have
    nodes = spark.createDataFrame(rows, "id string, label string, name string, full_name string")
    asked = spark.createDataFrame([(i, e) for i, e in enumerate(["get", "getUser", "serNa", "get27", "zzz", "getzz", "x", "ab", "", "mod::", "Äge", None, "hub::get1"])], "lookup_id int, entity string")
    index = name_index.build(nodes, storage.new_path(spark, "names"))
    facts = lambda df: sorted(map(tuple, df.collect()))
    assert facts(name_index.indexed_lookup(index, asked, nodes, 7)) == facts(search.lookup(asked, nodes, 7))
    chosen = {r["entity"]: r["gram"] for r in name_index.rarest(index, asked).collect()}
    assert chosen["getUser"] != "get" and "zzz" not in chosen and "getzz" not in chosen
    plan = index.read("postings", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
