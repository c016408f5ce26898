"""Indexing from end to end: scan, changes, extraction, upsert, edges, deletion and summary.

A store holds its rows in buckets by owning path (``sources.buckets``): a run reads the paths and checksums of all files, the rows of
the buckets that changed, and names; it writes the buckets that changed, and commits them together. So a run that breaks off
leaves the last commit as it was, and readers keep what they have opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry import extract
from graphquarry.operators import changes as changing
from graphquarry.operators import stats, symbols
from graphquarry.plans.storage import discard, exists, materialise, remove
from graphquarry.schema import EDGE, STORED, packed, unpacked
from graphquarry.sources import buckets, scan, store

@dataclass(frozen=True)
class Indexed:
    """A graph, what changed for it, which files couldn't be extracted, and the run in numbers (metric, n)."""

    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame
    failures: DataFrame
    summary: DataFrame


def index_files(files: DataFrame, nodes: DataFrame, edges: DataFrame, scanned_prefix: str = "", whole: bool = True, found: DataFrame | None = None, resolve: bool = True) -> Indexed:
    """The graph after ``files`` (path, absolute_path, content, checksum, size, extension, language[, module_system]) have been looked at.

    New and modified files are extracted. Nodes are merged by id, so that a node that is still there keeps its summary
    and embedding; nodes that a modified file no longer has, and all of deleted files, go with
    their edges; a file's own edges are made anew, and so are, over all files, the edges from names to what they stand
    for. A file that can't be extracted keeps what the graph has of it and its old checksum, hence is tried again by the
    next run. Edges whose ends don't exist are left out. ``files`` that aren't the
    ``whole`` of what was scanned cause no deletions. ``found`` are changes that are known already; without ``resolve``
    names are left alone. ``nodes`` and ``edges`` are a graph: each is there once, and edges have both ends.

    What changed files own is told from the rest by path, once; only that is merged, and what no changed file
    has to do with stays where it is stored. A file's own nodes and edges need no exchange at all where it is closed.
    """
    found = changes_of(files, nodes, scanned_prefix, whole) if found is None else found
    # texts are exchanged only if some file is to be left alone
    left = found.filter(~F.col("status").isin(*changing.TO_PROCESS)).limit(1).count()
    work = files.join(changing.files_to_process(found).select("path"), "path", "left_semi") if left else files.filter("path is not null")
    out = materialise(extract.extract(work), "extracted")
    done = out.filter("error is null")
    again = done.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    # files by themselves, and what has to be merged with other rows
    alone, others = (done.filter("false"), done) if again else (done.filter("closed"), done.filter("not closed"))
    mixed = others.limit(1).count() > 0
    new_nodes = extract.extracted_nodes(alone)
    new_nodes = new_nodes.unionByName(store.latest(extract.extracted_nodes(others))) if mixed else new_nodes

    paths = materialise(done.select("path").unionByName(changing.deleted_files(found).select("path")).distinct(), "touched_paths")
    told = touched = gone = None
    if paths.limit(1).count():
        slim = nodes.withColumn("id", packed("id")).join(paths.withColumn("_touched", F.lit(True)), "path", "left")
        told = materialise(slim.withColumn("id", unpacked("id")).select(*nodes.columns, "_touched"), "told")
        touched = told.filter("_touched").drop("_touched")
        touched = touched if touched.limit(1).count() else None
    rest = nodes if told is None else told.filter("_touched is null").drop("_touched")
    base = symbols.without_derived(edges)
    if touched is None:
        fresh = store.with_columns_of(nodes, new_nodes)
        kept = base
    else:
        gone = materialise(touched.select("id", "label").join(new_nodes.select("id"), "id", "left_anti"), "gone")
        fresh = materialise(store.merged_nodes(touched.join(gone, "id", "left_anti").select(*nodes.columns), new_nodes), "nodes")
        kept = materialise(store.without_ends(base, touched, gone), "edges_kept")
    state = rest.unionByName(fresh)
    state.made_of = (told, fresh)
    some = F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")
    former = kept.select("src", "dst", "type", some)
    if mixed:
        former = former.unionByName(store.merge_edges(store.resolved_edges(state, extract.extracted_edges(others))))
    written = former.unionByName(extract.extracted_edges(alone).select("src", "dst", "type", some))
    links = written
    if resolve and touched is None:
        # new closed files have all that lookups need of them but names
        apart = rest.unionByName(store.with_columns_of(nodes, store.latest(extract.extracted_nodes(others)))) if mixed else rest
        links = symbols.with_derived(written, symbols.derived_edges(apart, former, symbols.placed(alone)))
    elif resolve:
        links = symbols.with_derived(written, symbols.derived_edges(state, written))

    counted = [changing.change_summary(found).select(F.concat(F.lit("files "), F.lower("status")).alias("metric"), "n")]
    counted.append(extract.failures(out).agg(F.count(F.lit(1)).alias("n")).select(F.lit("files failed").alias("metric"), "n"))
    merged = touched.join(gone, "id", "left_anti").count() if touched is not None else 0
    n = {"nodes created": new_nodes.count() - merged, "nodes merged": merged, "edges": links.count()}
    n |= {"files removed": gone.filter("label = 'File'").count() if gone is not None else 0, "nodes removed": gone.filter("label <> 'File'").count() if gone is not None else 0}
    counted.append(nodes.sparkSession.createDataFrame(list(n.items()), "metric string, n bigint"))
    summary = counted[0]
    for c in counted[1:]:
        summary = summary.unionByName(c)
    return Indexed(state, links, found, extract.failures(out), materialise(summary, "summary"))


def changes_of(files: DataFrame, nodes: DataFrame, scanned_prefix: str = "", whole: bool = True) -> DataFrame:
    """What changed, from the files' checksums and those that are stored."""
    known = nodes.filter("label = 'File'").select("path", "checksum")
    known = known if whole else known.join(files.select("path"), "path", "left_semi")
    return materialise(changing.detect_changes(files, known, scanned_prefix), "changes")


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], STORED), spark.createDataFrame([], EDGE)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a store, oldest first."""
    return buckets.numbers(spark, path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the newest commit; empty ones of a store that has none."""
    last = buckets.newest(spark, path)
    return buckets.read(spark, path, last, "nodes"), buckets.read(spark, path, last, "edges")


def write(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """All rows as a new commit. Returns its number."""
    spark = nodes.sparkSession
    last = buckets.newest(spark, path)
    every = dict.fromkeys(("nodes", "edges"), range(last.buckets))
    return buckets.commit(spark, path, last, *_in_buckets(nodes, edges, last.buckets), every).number


def _in_buckets(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    owner = nodes.select(F.col("id").alias("src"), buckets.bucket_of("path", n).alias("bucket"))
    return nodes.withColumn("bucket", buckets.bucket_of("path", n)), edges.join(owner, "src")


def _numbers(rows: DataFrame) -> list[int]:
    """The buckets among some rows; there are never more than a store has."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def update(spark: SparkSession, files: DataFrame, path: str, whole: bool = True) -> Indexed:
    """Brings the store at ``path`` up to date with ``files``, as ``index_files`` does, and writes the buckets that differ.

    Rows are read of the buckets of changed paths only; of others the names that symbols and references have, and the
    ends of edges. If another writer commits meanwhile, buckets.Conflict is raised and nothing has happened.
    """
    last = buckets.newest(spark, path)
    n = last.buckets
    nodes, edges = buckets.read(spark, path, last, "nodes"), buckets.read(spark, path, last, "edges")
    found = changes_of(files, nodes, whole=whole)
    touched = _numbers(found.filter("status <> 'UNCHANGED'").select(buckets.bucket_of("path", n).alias("bucket")))
    own, links = buckets.read(spark, path, last, "nodes", touched), buckets.read(spark, path, last, "edges", touched)
    part = index_files(files, own, links, found=found, resolve=False)
    if touched:
        rest = [k for k in range(n) if k not in touched]
        others = symbols.without_derived(buckets.read(spark, path, last, "edges", rest))
        lost = own.select("id").join(part.nodes.select("id"), "id", "left_anti")
        cut = others.join(lost.select(F.col("id").alias("dst")), "dst", "left_semi")
        state = buckets.read(spark, path, last, "nodes", rest).unionByName(part.nodes)
        written = others.join(lost.select(F.col("id").alias("dst")), "dst", "left_anti").unionByName(part.edges)
        derived = materialise(symbols.derived_edges(state, written), "derived")
        # where edges differ from those stored
        keys = ["src", "dst", "type"]
        mark = lambda df, c: df.select(*keys, F.lit(True).alias(c))
        stored = edges.filter(F.col("properties")["derived"] == "true")
        differ = mark(stored, "_old").join(mark(derived, "_new"), keys, "full_outer").filter("_old is null or _new is null").select("src").unionByName(cut.select("src")).distinct()
        owner = state.select(F.col("id").alias("src"), buckets.bucket_of("path", n).alias("bucket"))
        changed = sorted({*touched, *_numbers(differ.join(owner, "src"))})
        rows = part.nodes.withColumn("bucket", buckets.bucket_of("path", n))
        ends = store.merge_edges(written, derived).join(owner.filter(F.col("bucket").isin(changed)), "src")
        last = buckets.commit(spark, path, last, rows, ends, {"nodes": touched, "edges": changed})
        discard(part.nodes, part.edges, derived)
    nodes, edges = buckets.read(spark, path, last, "nodes"), buckets.read(spark, path, last, "edges")
    total = F.when(F.col("metric") == "edges", F.lit(edges.count())).otherwise(F.col("n"))
    return Indexed(nodes, edges, found, part.failures, part.summary.withColumn("n", total))


def index(spark: SparkSession, root: str, path: str) -> Indexed:
    """Brings the store at ``path`` up to date with the source tree at ``root``. A run without changes writes nothing."""
    files = materialise(scan.scan_directory(spark, root), "files")
    systems = scan.module_systems(files, scan.package_files(spark, root))
    try:
        return update(spark, files.join(systems, "path", "left"), path)
    finally:
        discard(files)


def reset(spark: SparkSession, path: str) -> None:
    """Removes a store."""
    if exists(spark, path):
        remove(spark, path)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by label, edges by type, files by language, their bytes, and summaries and embeddings by label."""
    rows = [
        nodes.groupBy(F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "value", "n"),
        edges.groupBy(F.col("type").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "value", "n"),
    ]
    files = nodes.filter("label = 'File'")
    rows.append(files.groupBy(F.coalesce("language", F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("kind"), "value", "n"))
    rows.append(files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n")).select(F.lit("bytes").alias("kind"), F.lit("").alias("value"), "n"))
    rows.append(stats.embedding_coverage(nodes).select(F.lit("embedded").alias("kind"), F.col("label").alias("value"), F.col("n_embedded").alias("n")))
    rows.append(stats.summary_progress(nodes).select(F.lit("summarised").alias("kind"), F.col("label").alias("value"), F.col("completed").alias("n")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
