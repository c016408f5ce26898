"""Source text to nodes and edges: one function a language, applied to ``files`` in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphquarry.extract.csharp import extract_csharp
from graphquarry.extract.ecma import extract_ecma
from graphquarry.extract.python import extract_python
from graphquarry.schema import EDGE, NODE, NODE_FIELDS

#: Files that a task turns into rows at once.
BATCH = 64


def extract_source(path: str, text: str, language: str, module_system: str = "esm") -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, edges, and references (src, kind, name): what functions and methods call and create, by the names that the text has."""
    if language == "python":
        return extract_python(path, text)
    if language == "csharp":
        return extract_csharp(path, text)
    if language in ("javascript", "typescript"):
        return extract_ecma(path, text, language, module_system)
    raise ValueError(f"no extractor for {language}")


def extract_text(path: str, text: str, language: str, module_system: str = "esm") -> tuple[list[dict], list[dict]]:
    """Nodes and edges; calls and creations are properties of the functions and methods that hold them."""
    nodes, edges, references = extract_source(path, text, language, module_system)
    own = {n["id"]: n for n in nodes}
    said: dict[tuple[str, str], list[str]] = {}
    for r in references:
        said.setdefault((r["src"], {"call": "calls", "new": "creates"}[r["kind"]]), []).append(r["name"])
    for (src, key), names in said.items():
        own[src]["properties"] = (own[src].get("properties") or {}) | {key: ",".join(names)}
    return nodes, edges


def is_closed(nodes: list[dict], edges: list[dict]) -> bool:
    own, ends = {n["id"] for n in nodes}, {e["dst"] for e in edges}
    return len(own) == len(nodes) and len(ends) == len(edges) and all(e["src"] in own for e in edges) and ends <= own


def _row_type() -> StructType:
    return StructType.fromDDL(f"path string, error string, closed boolean, nodes array<struct<{_struct(NODE)}, edge_at: int>>, edges array<struct<{_struct(EDGE)}, src_at: int, dst_at: int>>")


def extract(files: DataFrame) -> DataFrame:
    """path, error, closed, nodes and edges (arrays of rows) of files (path, content, checksum, language[, module_system]).

    A file is closed if its nodes are each there once, with one edge at most that leads to each, and the edges' ends are all among the nodes; its edges
    then have the places of their ends there, from 1, in place of ids (``extracted_edges`` gives those), and nodes the place of the edge that leads to them.

    A file that can't be parsed gets an error and nothing else; it stops no other file.
    """
    system = F.col("module_system") if "module_system" in files.columns else F.lit("esm")
    slim = files.select("path", F.col("content").cast("binary").alias("content"), "checksum", "language", F.coalesce(system, F.lit("esm")).alias("module_system"))
    row_type = _row_type()
    schema = to_arrow_schema(row_type)

    def one(path: str, content: bytes | None, checksum: str, language: str, system: str) -> dict:
        try:
            data = content or b""
            nodes, edges = extract_text(path, data.decode("utf-8-sig", "replace"), language, system)
            nodes[0].update(size=len(data), checksum=checksum)
            for n in nodes:
                if n.get("properties"):
                    n["properties"] = list(n["properties"].items())
            if closed := is_closed(nodes, edges):
                at = {n["id"]: k for k, n in enumerate(nodes, 1)}
                for k, e in enumerate(edges, 1):
                    nodes[at[e["dst"]] - 1]["edge_at"] = k
                edges = [e | {"src": None, "dst": None, "src_at": at[e["src"]], "dst_at": at[e["dst"]]} for e in edges]
            return {"path": path, "closed": closed, "nodes": nodes, "edges": edges}
        except Exception as e:  # any failure is the file's own
            return {"path": path, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = [one(*r.values()) for r in batch.slice(at, BATCH).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return slim.mapInArrow(run, row_type)


def extracted_nodes(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is null").select(F.explode("nodes").alias("n")).select(*[F.col(f"n.{c}").alias(c) for c in NODE_FIELDS])


def placed_nodes(extracted: DataFrame, parent: dict[str, str], *columns: str) -> DataFrame:
    """``columns`` of the nodes of closed files, with the type of the edge that leads to each (edge) and, by the names that ``parent`` gives them, columns of the node that it leads from.

    A file has all of it, by places: no row leaves its task.
    """

    def node(n: Column) -> Column:
        edge = F.element_at("edges", n["edge_at"])
        above = F.element_at("nodes", edge["src_at"])
        return F.struct(*[n[c].alias(c) for c in columns], edge["type"].alias("edge"), *[above[c].alias(name) for c, name in parent.items()])

    return extracted.filter("closed").select(F.explode(F.transform("nodes", node)).alias("n")).select("n.*")


def extracted_edges(extracted: DataFrame) -> DataFrame:
    end = lambda e, c: F.coalesce(e[c], F.element_at("nodes", e[f"{c}_at"])["id"]).alias(c)
    named = F.transform("edges", lambda e: F.struct(end(e, "src"), end(e, "dst"), e["type"].alias("type"), e["properties"].alias("properties")))
    return extracted.filter("error is null").select(F.explode(named).alias("e")).select("e.*")


def failures(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is not null").select("path", "error")


def _struct(ddl: str) -> str:
    """Column definitions as members of a struct."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k].strip().replace(" ", ": ", 1))
            start = k + 1
    return ", ".join(out)
