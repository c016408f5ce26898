"""C#: declarations, by recursive descent over tokens.

Full names are made of the namespace, the types around and the member, with type parameters; bases are told
apart as the file shows them: a declared interface or class of that name, which then has its full name, else the
convention of a leading I; a first base that is neither is a class. Structs and records have
no node of their own, hence their members no parent; finalisers, operators, indexers, events, delegates and local functions have none either.
Of conditional directives the branch counts that is compiled with no symbols but the file's own.
"""

from __future__ import annotations

import re

from graphquarry.extract.common import Graph
from graphquarry.extract.lexing import Tokens, csharp_tokens

_MODIFIERS = {"public", "private", "protected", "internal", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "const", "partial", "new", "extern", "unsafe", "volatile", "required", "file", "fixed", "scoped"}
_PARAMETER_MODIFIERS = {"ref", "out", "in", "params", "this", "scoped", "readonly"}
_TYPES = {"class", "interface", "struct", "record", "enum"}
_NO_CALLS = {"if", "for", "foreach", "while", "switch", "catch", "return", "lock", "using", "fixed", "nameof", "typeof", "sizeof", "default", "checked", "unchecked", "await", "new", "when", "throw", "base", "this", "in", "is", "as", "and", "or", "not", "stackalloc", "yield", "var"}


def visibility(mods: list[str]) -> str:
    return next((x for x in ("public", "private", "protected", "internal") if x in mods), "private")


def spaced(text: str) -> str:
    """Type arguments with one blank behind each comma."""
    return re.sub(r"\s*,\s*", ", ", text)


class Parser:
    def __init__(self, path: str, text: str):
        self.g, self.path, self.text = Graph(path, text, "csharp"), path, text
        tokens, self.comments = csharp_tokens(text)
        self.t = Tokens(text, tokens)
        self.comment = 0
        self.types: list[dict] = []
        self.bodies: list[tuple[int, int, str]] = []  # first and last token of methods, with their ids
        self.usings: list[str] = []

    # --- tokens

    def documentation(self, k: int) -> str | None:
        """The first documentation comment between the token before k and k, without its marks."""
        begin, end = self.t.tokens[k - 1].end if k else 0, self.t.tokens[k].start
        lines: list[str] = []
        while self.comment < len(self.comments) and self.comments[self.comment].start < begin:
            self.comment += 1
        for c in self.comments[self.comment :]:
            if c.start > end:
                break
            if c.text.startswith("/**") and c.text != "/**/" and not lines:
                return "\n".join(x for x in (re.sub(r"^\s*\*(?!/)\s?", "", y).strip() for y in c.text[3:-2].split("\n")) if x) or None
            if c.text.startswith("///") and not c.text.startswith("////"):
                lines.append(c.text[3:].strip())
            elif lines:
                break
        return "\n".join(lines).strip() or None

    def attributes(self, k: int) -> int:
        while self.t.at(k) == "[":
            k = self.t.behind(k)
        return k

    def modifiers(self, k: int) -> tuple[list[str], int]:
        t, mods = self.t, []
        while t.at(k) in _MODIFIERS and (t.is_name(k + 1) or t.at(k + 1) in ("(", "~", "[")) and not (t.at(k) in ("file", "required", "scoped", "async") and t.at(k + 1) == "("):
            mods.append(t.at(k))
            k += 1
        return mods, k

    def type_end(self, k: int) -> int:
        """The token behind the type at k."""
        t = self.t
        while t.at(k) in ("ref", "readonly", "scoped"):
            k += 1
        if t.at(k) == "(":
            k = t.behind(k)
        elif t.at(k) == "delegate" and t.at(k + 1) == "*":
            k = t.angles(k + 2) or k + 2
        else:
            while t.is_name(k):
                k += 1
                if t.at(k) == "<":
                    k = t.angles(k) or k
                if t.at(k) not in (".", "::"):
                    break
                k += 1
        while t.at(k) in ("?", "*") or t.at(k) == "[" and (t.partner[k] == k + 1 or all(t.at(j) == "," for j in range(k + 1, t.partner[k]))):
            k = t.behind(k)
        return k

    def statement_end(self, k: int, end: int) -> int:
        """The token behind the next semicolon outside brackets."""
        t = self.t
        while k < end and t.at(k) != ";":
            k = t.behind(k)
        return min(end, k + 1)

    def body(self, k: int, end: int) -> tuple[int, int]:
        """Of what follows a head, constraints and initialisers included: the first token of the body, and the one behind it."""
        t = self.t
        while k < end and t.at(k) not in ("{", "=>", ";"):
            k = t.behind(k)
        if t.at(k) == "{":
            return k, t.partner[k] + 1
        return k, self.statement_end(k, end)

    # --- declarations

    def scope(self, k: int, end: int, space: str) -> None:
        """Namespaces and types; other statements are passed over."""
        t = self.t
        while k < end:
            first = k
            if t.at(k) == "namespace":
                begin = k = k + 1
                while t.is_name(k) or t.at(k) == ".":
                    k += 1
                name = ".".join(x for x in (space, re.sub(r"\s", "", t.slice(begin, k))) if x)
                if t.at(k) == "{":
                    self.scope(k + 1, t.partner[k], name)
                    k = t.behind(k)
                else:
                    space, k = name, k + 1
                continue
            if t.at(k) == "using" or t.at(k) == "global" and t.at(k + 1) == "using":
                behind = self.using(k)
                if behind:
                    k = behind
                    continue
            k = self.attributes(k)
            mods, k = self.modifiers(k)
            if self.is_type(k):
                k = self.type_declaration(first, k, end, mods, space, [])
            elif t.at(k) == "{":
                k = t.behind(k)
            else:  # delegates, and statements at the top
                while k < end and t.at(k) not in (";", "{"):
                    k = t.behind(k)
                k = t.behind(k) if k < end else k
            k = max(k, first + 1)

    def using(self, k: int) -> int | None:
        t, first = self.t, k
        k += 2 if t.at(k) == "global" else 1
        static = t.at(k) == "static"
        k += static + (t.at(k + static) == "unsafe")
        alias = t.at(k) if t.is_name(k) and t.at(k + 1) == "=" else None
        k += 2 if alias else 0
        begin, k = k, self.type_end(k)
        if t.at(k) != ";" or not t.is_name(begin):
            return None
        name = re.sub(r"\s", "", t.slice(begin, k))
        self.g.add("Import", f"using {name}", f"{self.path}::using::{name}", (t.tokens[first].start, t.tokens[k].end), self.g.file, "IMPORTS", module=name, alias=alias, imported_names=[], is_wildcard=False)
        if not alias and not static:
            self.usings.append(name)
        return k + 1

    def is_type(self, k: int) -> bool:
        t = self.t
        if t.at(k) == "record":
            return t.is_name(k + 1) and (t.at(k + 1) in ("class", "struct") or t.at(k + 2) in ("(", "{", ";", ":", "<"))
        return t.at(k) in _TYPES and t.is_name(k + 1)

    def type_declaration(self, first: int, k: int, end: int, mods: list[str], space: str, outer: list[str]) -> int:
        """A type with its members, given its first token and its keyword; returns the token behind it."""
        t, kind = self.t, self.t.at(k)
        docs = self.documentation(first)
        k += 2 if kind == "record" and t.at(k + 1) in ("class", "struct") else 1
        name = t.at(k)
        k += 1
        generic = ""
        if t.at(k) == "<":
            begin, k = k, t.angles(k) or k + 1
            generic = spaced(re.sub(r"\b(?:in|out)\s+", "", t.slice(begin, k)))
        if t.at(k) == "(":  # primary constructor
            k = t.behind(k)
        bases: list[str] = []
        if t.at(k) == ":":
            while t.at(k) in (":", ","):
                begin, k = k + 1, self.type_end(k + 1)
                bases.append(t.slice(begin, k))
                if t.at(k) == "(":
                    k = t.behind(k)
        while k < end and t.at(k) not in ("{", ";"):  # constraints
            k = t.behind(k)
        body = k if t.at(k) == "{" else None
        last = t.partner[k] if body is not None else k
        simple = name + generic
        full = ".".join([*([space] if space else []), *outer, simple])
        behind = last + 1 + (body is not None and t.at(last + 1) == ";")
        if kind == "enum":
            return behind
        entry = {"kind": kind, "name": name, "full": full, "bases": bases, "mods": mods, "docs": docs, "first": first, "last": min(last, len(t) - 1), "body": body, "id": None, "space": space, "outer": outer}
        self.types.append(entry)
        if kind in ("class", "interface"):
            span = (t.tokens[first].start, t.tokens[entry["last"]].end)
            common = {"visibility": visibility(mods), "docstring": docs}
            if kind == "interface":
                entry["id"] = self.g.add("Interface", name, full, span, self.g.file, "CONTAINS", **common)
            else:
                entry["id"] = self.g.add("Class", name, full, span, self.g.file, "CONTAINS", is_abstract="abstract" in mods, is_static="static" in mods, is_sealed="sealed" in mods, **common)
            entry["node"] = self.g.nodes[-1]
        if body is not None:
            self.members(entry, body + 1, last)
        return behind

    def members(self, owner: dict, k: int, end: int) -> None:
        while k < end:
            k = max(self.member(owner, k, end), k + 1)

    def member(self, owner: dict, first: int, end: int) -> int:
        t = self.t
        k = self.attributes(first)
        mods, k = self.modifiers(k)
        if self.is_type(k):
            return self.type_declaration(first, k, end, mods, owner["space"], [*owner["outer"], owner["full"][len(".".join([x for x in (owner["space"], *owner["outer"]) if x])) :].lstrip(".")])
        if t.at(k) == "delegate" and t.at(k + 1) != "*":
            return self.statement_end(k, end)
        if t.at(k) == "event":
            k = self.type_end(k + 1)
            while k < end and t.at(k) not in (";", "{"):
                k = t.behind(k)
            return t.behind(k)
        if t.at(k) == "~" or t.at(k) in ("implicit", "explicit"):
            return self.body(k + 1, end)[1]
        if t.at(k) == owner["name"] and t.at(k + 1) == "(":
            return self.method(owner, first, k, k + 1, None, mods, end)
        if not (t.is_name(k) or t.at(k) == "("):
            return k + 1 if t.at(k) != "{" else t.behind(k)
        begin, k = k, self.type_end(k)
        kind = t.slice(begin, k)
        if t.at(k) == "operator" or t.at(k) == "this" or t.at(k) == "checked":
            return self.body(k + 1, end)[1]
        # a name, behind the interface's that is implemented explicitly
        named = k
        while t.is_name(k):
            behind = t.angles(k + 1) if t.at(k + 1) == "<" else k + 1
            if t.at(behind or k) not in (".", "::"):
                break
            k = behind + 1
        if t.at(k) == "this":
            return self.body(k + 1, end)[1]
        if not t.is_name(k):
            return max(k, begin + 1)
        behind = k + 1
        if t.at(behind) == "<":
            behind = t.angles(behind) or behind
        if t.at(behind) == "(":
            return self.method(owner, first, k, behind, kind, mods, end, named)
        if t.at(k + 1) in ("{", "=>"):
            return self.property(owner, first, k, kind, mods, end, named)
        if t.at(k + 1) in ("=", ";", ","):
            return self.fields(owner, first, k, kind, mods, end)
        return k + 1

    def shown(self, first: int, mods: list[str]) -> dict:
        return {"visibility": visibility(mods), "is_static": "static" in mods, "docstring": self.documentation(first)}

    def parameters(self, open_: int) -> list[dict]:
        t, k, end, rows = self.t, open_ + 1, self.t.partner[open_], []
        while k < end:
            k = self.attributes(k)
            mods = []
            while t.at(k) in _PARAMETER_MODIFIERS:
                mods.append(t.at(k))
                k += 1
            begin, k = k, self.type_end(k)
            kind, name = t.slice(begin, k), t.at(k).removeprefix("@")
            k += 1
            default = None
            if t.at(k) == "=":
                begin = k = k + 1
                while k < end and t.at(k) != ",":
                    k = t.behind(k)
                default = t.slice(begin, k)
            rows.append({"name": name, "type": kind or None, "default": default, "mods": mods})
            while k < end and t.at(k) != ",":
                k = t.behind(k)
            k += 1
        return rows

    def method(self, owner: dict, first: int, name: int, open_: int, kind: str | None, mods: list[str], end: int, named: int | None = None) -> int:
        t = self.t
        begin, behind = self.body(t.partner[open_] + 1, end)
        rows = self.parameters(open_)
        shown = lambda r: " ".join([*(m for m in r["mods"] if m in ("ref", "out", "in", "params")), r["type"] or ""])
        qualifier = re.sub(r"\s", "", t.slice(named, name)) if named is not None else ""
        full = f"{owner['full']}.{qualifier}{t.at(name).removeprefix('@')}{spaced(t.slice(name + 1, open_))}({', '.join(map(shown, rows))})"
        more = {} if kind is not None else {"properties": {"is_constructor": "true"}}
        where = (t.tokens[first].start, t.tokens[behind - 1].end)
        own = self.g.add("Method", t.at(name).removeprefix("@"), full, where, owner["id"], "DEFINES", is_abstract="abstract" in mods, is_virtual="virtual" in mods, is_override="override" in mods, is_async="async" in mods, return_type=kind or "void", parameters=[r["name"] for r in rows], signature=full, **self.shown(first, mods), **more)
        for r in rows:
            mod = next((m for m in r["mods"] if m in ("ref", "out", "in")), None)
            self.g.add("Parameter", r["name"], f"{full}::{r['name']}", None, own, "DECLARES", type=r["type"], default_value=r["default"], is_optional=r["default"] is not None, is_params="params" in r["mods"], is_variadic="params" in r["mods"], modifier=mod)
        self.bodies.append((begin, behind - 1, own))
        return behind

    def property(self, owner: dict, first: int, name: int, kind: str, mods: list[str], end: int, named: int) -> int:
        t, k = self.t, name + 1
        readonly = False
        if t.at(k) == "{":
            inside = range(k + 1, t.partner[k])
            readonly = not any(t.at(j) in ("set", "init") and t.around[j] == k for j in inside)
            k = t.behind(k)
            if t.at(k) == "=":
                k = self.statement_end(k, end)
        else:
            k = self.statement_end(k, end)
        full = f"{owner['full']}.{re.sub(chr(92) + 's', '', t.slice(named, name))}{t.at(name).removeprefix('@')}"
        self.g.add("Variable", t.at(name).removeprefix("@"), full, (t.tokens[first].start, t.tokens[k - 1].end), owner["id"], "HAS_MEMBER", type=kind, is_readonly=readonly, is_constant=False, scope="static" if "static" in mods else "instance", properties={"is_property": "true"}, **self.shown(first, mods))
        return k

    def fields(self, owner: dict, first: int, k: int, kind: str, mods: list[str], end: int) -> int:
        t, behind = self.t, self.statement_end(k, end)
        shown = self.shown(first, mods)
        while k < behind:
            name, stop = k, k
            while stop < behind - 1 and t.at(stop) != ",":
                found = t.angles(stop) if t.at(stop) == "<" else None
                stop = found if found and t.at(found) in ("(", "{", "[") else t.behind(stop)
            value = t.slice(name + 2, stop) if t.at(name + 1) == "=" else None
            plain = t.at(name).removeprefix("@")
            here = (t.tokens[name].start, t.tokens[stop - 1].end)
            self.g.add("Variable", plain, f"{owner['full']}.{plain}", (t.tokens[first].start, t.tokens[behind - 1].end), owner["id"], "HAS_MEMBER", here, type=kind, value=value, is_constant="const" in mods, is_readonly="readonly" in mods, scope="static" if "static" in mods else "instance", **shown)
            k = stop + 1
        return behind

    # --- what names stand for

    def resolve_bases(self) -> None:
        """Bases by what the file itself declares."""
        interfaces = {x["name"] for x in self.types if x["kind"] == "interface"}
        classes = {x["name"] for x in self.types if x["kind"] in ("class", "record")}
        full: dict[str, str] = {}
        for x in self.types:
            full.setdefault(x["name"], x["full"])
        for x in self.types:
            if not x["id"]:
                continue
            plain = [re.sub(r"<.*", "", b, flags=re.S).split(".")[-1].strip() for b in x["bases"]]
            shown = [b if "<" in b or p not in full else full[p] for b, p in zip(x["bases"], plain, strict=True)]
            if x["kind"] == "interface":
                x["node"]["base_interfaces"] = shown
                continue
            is_interface = [p in interfaces or p not in classes and bool(re.match(r"I[A-Z]", p)) for p in plain]
            x["node"]["base_classes"] = [b for b, i in zip(shown, is_interface, strict=True) if not i]
            x["node"]["interfaces"] = [b for b, i in zip(shown, is_interface, strict=True) if i]

    def references(self) -> list[dict]:
        """Calls and creations in the bodies of methods."""
        t, out, seen = self.t, [], set()
        for first, last, own in self.bodies:
            for k in range(first, last + 1):
                if not t.is_name(k):
                    continue
                behind = k + 1
                if t.at(behind) == "<":
                    behind = t.angles(behind) or behind
                begin = k
                while t.at(begin - 1) in (".", "?.") and t.is_name(begin - 2):
                    begin -= 2
                new = t.at(begin - 1) == "new"
                if t.at(k) in _NO_CALLS or not (t.at(behind) == "(" or new and t.at(behind) == "{"):
                    continue
                # a name behind a type is a declaration's
                if begin == k and not new and (t.is_name(k - 1) and t.at(k - 1) not in ("return", "await", "throw", "in", "else", "case", "yield", "do", "is", "as", "or", "and", "not", "when") or t.at(k - 1) in (">", "]")):
                    continue
                name = f"?.{t.at(k)}" if begin == k and t.at(k - 1) in (".", "?.") else ".".join(t.at(j) for j in range(begin, k + 1, 2))
                found = (own, "new" if new else "call", name)
                if found not in seen:
                    seen.add(found)
                    out.append(dict(zip(("src", "kind", "name"), found, strict=True)))
        return out


def extract_csharp(path: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, edges and references of a file."""
    p = Parser(path, text)
    p.scope(0, len(p.t), "")
    p.resolve_bases()
    return p.g.nodes, p.g.edges, p.references()
