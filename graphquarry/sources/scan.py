"""Source trees to ``files`` DataFrames."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is skipped, and which suffix is which language.
IGNORED = ("__pycache__", ".git", ".svn", ".hg", "node_modules", "bin", "obj", ".vs", ".vscode", "build", "dist", "target", ".idea", ".pytest_cache")
DOT_FILES_KEPT = (".gitignore", ".env")
LANGUAGES = {".py": "python", ".cs": "csharp", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
JS_IGNORED = ("node_modules", "dist", "build")
#: Folders that the driver lists before tasks go on.
FOLDERS = 256
FILE = "path string, absolute_path string, size bigint, content binary"


def wanted(path: Column) -> Column:
    """Of paths relative to the scan root: no ignored part, and no dot file but those kept."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dot = F.startswith(name, F.lit(".")) & ~name.isin(*DOT_FILES_KEPT)
    return ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])) & ~dot


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Null for suffixes that no extractor knows."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def javascript_files(files: DataFrame) -> DataFrame:
    """What a directory run over JavaScript and TypeScript takes: no build folders, no declaration files."""
    parts = F.split("path", "/")
    skip = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in JS_IGNORED])) | F.endswith("path", F.lit(".d.ts"))
    return files.filter(language(F.col("path")).isin("javascript", "typescript") & ~skip)


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a folder, given as a path or as a URI."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


def _listed(store: pafs.FileSystem, root: str, folder: str) -> tuple[list[str], list[str]]:
    """Files and folders that stand directly in a folder, relative to the root; ignored folders aren't entered, unreadable ones are empty."""
    try:
        found = store.get_file_info(pafs.FileSelector(posixpath.join(root, folder) if folder else root))
    except OSError:
        return [], []
    named = [(posixpath.join(folder, x.base_name), x.type) for x in found]
    files = sorted(x for x, t in named if t == pafs.FileType.File)
    return files, sorted(x for x, t in named if t == pafs.FileType.Directory and posixpath.basename(x) not in IGNORED)


def walked(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """The path, relative to it, of every file under ``root`` that isn't in an ignored folder.

    ``root`` is a folder that all tasks see, or the URI of one in any store that Arrow opens. The driver
    lists the upper folders, until there are FOLDERS to share out; tasks walk those. A missing root raises.
    """
    store, top = _opened(root)
    if store.get_file_info(top).type != pafs.FileType.Directory:
        raise FileNotFoundError(root)
    names: list[str] = []
    folders = [""]
    while folders and len(folders) < FOLDERS:
        found = [_listed(store, top, x) for x in folders]
        names += [x for files, _ in found for x in files]
        folders = [x for _, inner in found for x in inner]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = _opened(root)
        for batch in batches:
            todo = batch.column("folder").to_pylist()
            while todo:
                files, inner = _listed(own, base, todo.pop())
                todo += inner
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["path"])

    paths = spark.createDataFrame([(x,) for x in names], "path string")
    if folders:
        inner = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(partitions or len(folders))
        paths = paths.unionByName(inner.mapInArrow(walk, "path string"))
    return paths


def _read(root: str):
    """Paths to rows of FILE; files that can't be read have no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = _opened(root)
        for batch in batches:
            for p in batch.column("path").to_pylist():
                full = posixpath.join(base, p)
                try:
                    with own.open_input_stream(full) as f:
                        data = f.read()
                except OSError:
                    data = None
                columns = [[p], [full], [len(data) if data is not None else 0], [data]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "absolute_path", "size", "content"])

    return run


def scan_directory(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """The known source files under ``root`` (see ``walked``): path relative to it, content and checksum. Files that can't be read get an empty checksum."""
    chosen = walked(spark, root, partitions).filter(wanted(F.col("path")) & language(F.col("path")).isNotNull())
    chosen = chosen.repartition(partitions or spark.sparkContext.defaultParallelism)
    return described(chosen.mapInArrow(_read(root), FILE))


def package_files(spark: SparkSession, root: str) -> DataFrame:
    """(dir, type) of the package.json files under ``root``, found by the same walk; those that can't be parsed have no type."""
    named = walked(spark, root).filter((F.col("path") == "package.json") | F.col("path").endswith("/package.json"))
    text = F.decode(F.coalesce("content", F.lit(b"")), "UTF-8")
    return named.mapInArrow(_read(root), FILE).select(F.regexp_replace("path", r"/?package\.json$", "").alias("dir"), F.get_json_object(text, "$.type").alias("type"))


def described(files: DataFrame) -> DataFrame:
    """Adds checksum (of the bytes; empty if there are none to read), extension and language."""
    return files.withColumns({"checksum": F.coalesce(F.sha2("content", 256), F.lit("")), "extension": extension(F.col("path")), "language": language(F.col("path"))})


def module_systems(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path and module_system of JavaScript and TypeScript files.

    ``packages`` (dir, type) are package.json files: the nearest folder above a file decides;
    the root folder is "". A file is joined by equality with each of its own ancestors.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = files.filter(language(F.col("path")).isin("javascript", "typescript")).select("path", F.explode(above).alias("dir"))
    near = known.join(packages.select("dir", F.coalesce("type", F.lit("")).alias("type")), "dir").groupBy("path").agg(F.max_by("type", F.length("dir")).alias("type"))
    kind, suffix = F.coalesce("type", F.lit("")), extension(F.col("path"))
    js = suffix == ".js"
    system = F.when((suffix == ".mjs") | (js & (kind == "module")), "esm").when((suffix == ".cjs") | (js & (kind == "commonjs")), "cjs").when(suffix.isin(".ts", ".tsx"), "esm").otherwise("cjs")
    return known.select("path").distinct().join(near, "path", "left").select("path", system.alias("module_system"))
