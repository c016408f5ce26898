"""Collects the nodes and edges of one file."""

from __future__ import annotations

import bisect
import posixpath

from graphquarry.schema import node_id


class Graph:
    def __init__(self, path: str, text: str, language: str):
        self.path, self.text = path, text
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.seen: dict[tuple[str, str], int] = {}
        self.lines = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        suffix = posixpath.splitext(path)[1]
        self.file = self.add("File", posixpath.basename(path), path, absolute_path=path, extension=suffix.lower(), content=text, raw_code=None, language=language)

    def add(self, label: str, name: str, full_name: str, span: tuple[int, int] | None = None, parent: str | None = None, edge: str | None = None, at: tuple[int, int] | None = None, **fields) -> str:
        """A node, with the text between two offsets as its code and as its place, unless that is given, and an edge from its parent; returns its id."""
        nth = self.seen[label, full_name] = self.seen.get((label, full_name), -1) + 1
        own = node_id(label, self.path, full_name, nth)
        node = {"id": own, "label": label, "name": name, "full_name": full_name, "path": self.path}
        if span:
            node |= {"raw_code": self.text[span[0] : span[1]], "location": self.location(*(at or span))}
        self.nodes.append(node | fields)
        if parent:
            self.edges.append({"src": parent, "dst": own, "type": edge})
        return own

    def place(self, at: int) -> tuple[int, int]:
        """Line, from 1, and column, from 0."""
        line = bisect.bisect_right(self.lines, at)
        return line, at - self.lines[line - 1]

    def location(self, start: int, end: int) -> dict:
        (a, b), (c, d) = self.place(start), self.place(end)
        return {"start_line": a, "start_column": b, "end_line": c, "end_column": d}
