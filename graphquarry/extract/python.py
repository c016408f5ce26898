"""Python, by the standard library's parser."""

from __future__ import annotations

import ast

from graphquarry.extract.common import Graph


def dotted(node: ast.expr) -> str | None:
    """a.b.c of names and attributes; null for other expressions."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


def called(node: ast.expr) -> str | None:
    """The name that a call has; ``?.name`` for a method of a value that has none."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = called(node.value) if isinstance(node.value, (ast.Name, ast.Attribute)) else None
        return f"{head}.{node.attr}" if head and not head.startswith("?") else f"?.{node.attr}"
    return None


def docstring(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> str | None:
    """The text of a first statement that is a string, stripped; its lines keep their indentation."""
    first = node.body[0] if node.body else None
    found = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    return first.value.value.strip() if found else None


def has_yield(body: list[ast.stmt]) -> bool:
    todo: list[ast.AST] = list(body)
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Yield, ast.YieldFrom)):
            return True
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(n)
    return False


def extract_python(path: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, edges and references of a file."""
    tree = ast.parse(text)
    g = Graph(path, text, "python")
    raw = [line.encode() for line in text.split("\n")]
    references: dict[tuple[str, str], None] = {}

    def span(n: ast.AST) -> tuple[int, int]:
        at = lambda line, col: g.lines[line - 1] + len(raw[line - 1][:col].decode("utf-8", "ignore"))
        first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
        return (at(n.lineno, n.col_offset) if first == n.lineno else g.lines[first - 1]), at(n.end_lineno, n.end_col_offset)

    def visit(node: ast.AST, holder: tuple[str, str] | None, caller: str | None = None) -> None:
        """holder: id and full name of the class around; caller: id of the function around."""
        for n in ast.iter_child_nodes(node):
            if caller and isinstance(n, ast.Call) and called(n.func):
                references[caller, called(n.func)] = None
            if isinstance(n, ast.ClassDef):
                full = f"{path}::{n.name}"
                bases = [b for b in map(dotted, n.bases) if b]
                own = g.add("Class", n.name, full, span(n), g.file, "CONTAINS", base_classes=bases, docstring=docstring(n))
                visit(n, (own, full))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = [d.id for d in n.decorator_list if isinstance(d, ast.Name)]
                names = [a.arg for a in n.args.args]
                fields = {"parameters": names, "docstring": docstring(n), "is_async": isinstance(n, ast.AsyncFunctionDef), "return_type": ast.unparse(n.returns) if n.returns else None, "signature": f"{n.name}({', '.join(names)})", "properties": {"decorators": ",".join(marks)}}
                if holder:
                    full = f"{holder[1]}::{n.name}"
                    own = g.add("Method", n.name, full, span(n), holder[0], "DEFINES", is_static="staticmethod" in marks, **fields)
                else:
                    full = f"{path}::{n.name}"
                    own = g.add("Function", n.name, full, span(n), g.file, "CONTAINS", is_generator=has_yield(n.body), **fields)
                values = [None] * (len(n.args.posonlyargs) + len(n.args.args) - len(n.args.defaults)) + n.args.defaults
                for a, v in zip(n.args.args, values[len(n.args.posonlyargs) :], strict=True):
                    g.add("Parameter", a.arg, f"{full}::{a.arg}", span(a), own, "DECLARES", type=ast.unparse(a.annotation) if a.annotation else None, default_value=ast.unparse(v) if v else None, is_optional=v is not None)
                visit(n, holder, own)
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                names = [a.name for a in n.names]
                g.add("Import", f"from {module} import {', '.join(names)}", f"{path}::import::{module}", span(n), g.file, "IMPORTS", module=module, imported_names=names, is_wildcard=names == ["*"])
            elif isinstance(n, ast.Import):
                for a in n.names:
                    g.add("Import", f"import {a.name}" + (f" as {a.asname}" if a.asname else ""), f"{path}::import::{a.name}", span(n), g.file, "IMPORTS", module=a.name, alias=a.asname, imported_names=[a.name], is_wildcard=False)
            else:
                visit(n, holder, caller)

    visit(tree, None)
    return g.nodes, g.edges, [{"src": src, "kind": "call", "name": name} for src, name in references]
