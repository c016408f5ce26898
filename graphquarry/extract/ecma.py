"""JavaScript and TypeScript: declarations, by recursive descent over tokens.

There is no parser for these languages on the cluster. The tokens tell strings, nested templates and regular expressions
apart; what is parsed of them are declarations with their heads, wherever a statement may stand. A file whose brackets, templates or comments don't
close is an error. In TypeScript the blanks and comments before a declaration belong to it; in JavaScript they don't.
Elements between angle brackets (JSX) are passed over as text, in which a lone quote doesn't matter but a lone bracket does.
"""

from __future__ import annotations

import re

from graphquarry.extract.common import Graph
from graphquarry.extract.lexing import BEFORE_EXPRESSION, Tokens, ecma_tokens

_MODIFIERS = {"public", "private", "protected", "static", "async", "abstract", "override", "readonly", "declare", "accessor", "get", "set", "export", "default", "in", "out"}
_BEFORE_DECLARATION = {"export", "default", "declare", "abstract", "async"}
_TYPE_PREFIXES = {"keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new"}
_ENDS = {"id", "num", "str", "re", "tpl)"}
_JOINS = {"in", "instanceof", "as", "satisfies", "of"}
_ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", "&&=", "||=", "??="}
#: Words that stand before a bracket without calling anything.
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "typeof", "await", "yield", "super", "import", "with", "function", "new", "delete", "void", "throw", "case", "do", "else", "in", "of", "instanceof", "constructor", "require"}


class Parser:
    def __init__(self, path: str, text: str, language: str, module_system: str):
        self.ts = language == "typescript"
        self.common = module_system == "cjs" and not self.ts
        self.g = Graph(path, text, "typescript-react" if path.endswith(".tsx") else language)
        self.t = Tokens(text, ecma_tokens(text))
        self.path, self.text = path, text
        self.bodies: set[int] = set()  # braces of classes, interfaces and enumerations, which hold no statements
        self.blocks: dict[int, bool] = {}
        self.owners: list[tuple[int, int, str]] = []  # first and last token of functions and methods, with their ids

    # --- places

    def colon_of_case(self, k: int) -> bool:
        """Whether the colon at k ends a case or a label, hence a statement may follow."""
        t, j = self.t, k - 1
        if t.around[k] >= 0 and not self.holds_statements(t.around[k]):
            return False
        while j >= 0 and t.around[j] == t.around[k] and t.at(j) not in (";", "{", "}", "?"):
            if t.at(j) in ("case", "default"):
                return True
            j = t.partner[j] - 1 if j in t.partner and t.partner[j] < j else j - 1
        return t.at(j) != "?" and j == k - 2 and t.is_name(k - 1)

    def holds_statements(self, brace: int) -> bool:
        if brace not in self.blocks:
            self.blocks[brace] = self.is_block(brace)
        return self.blocks[brace]

    def is_block(self, brace: int) -> bool:
        t, before = self.t, brace - 1
        if t.at(brace) != "{" or brace in self.bodies:
            return False
        if before < 0 or t.kind(before) == "str":  # a module's name
            return True
        if t.at(before) == ":":
            return self.colon_of_case(before)
        if t.is_name(before):
            return t.at(before) in ("else", "do", "try", "finally") or t.at(before) not in BEFORE_EXPRESSION and t.at(before) not in ("export", "import", "type", "as")
        return t.at(before) in (";", "{", "}", ")", "=>", ">", "]")

    def begins_statement(self, k: int) -> bool:
        t, before = self.t, k - 1
        if t.around[k] >= 0 and not self.holds_statements(t.around[k]):
            return False
        if before < 0 or before == t.around[k]:
            return True
        if t.is_name(before):
            word = t.at(before)
            if t.at(before - 1) in (".", "?."):
                return True
            if word in _BEFORE_DECLARATION:
                return self.begins_statement(before) or t.new_line(k)
            return word not in BEFORE_EXPRESSION | _JOINS | {"class", "function"} or word in ("else", "do")
        if t.at(before) == ":":
            return self.colon_of_case(before)
        if t.at(before) == ">":
            return t.new_line(k)
        return t.kind(before) in _ENDS or t.at(before) in (";", ")", "]", "}", "++", "--")

    def first_token(self, k: int) -> int:
        """Of a declaration: its first modifier or decorator."""
        t = self.t
        while True:
            before = k - 1
            if t.at(before) in _MODIFIERS and t.at(before - 1) not in (".", "?."):
                k = before
                continue
            j = t.partner[before] - 1 if t.at(before) == ")" else before
            while t.is_name(j) and t.at(j - 1) == ".":
                j -= 2
            if not (t.is_name(j) and t.at(j - 1) == "@"):
                return k
            k = j - 1

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Offsets of the tokens first to last."""
        tokens = self.t.tokens
        begin = tokens[first].start if not self.ts else tokens[first - 1].end if first else 0
        return begin, tokens[last].end

    # --- types and expressions

    def type_end(self, k: int) -> int:
        """The token behind the type that begins at k."""
        t = self.t
        while k < len(t):
            if t.at(k) in ("|", "&", "-"):
                k += 1
                continue
            if t.at(k) in _TYPE_PREFIXES and (t.is_name(k + 1) and t.at(k + 1) not in ("is", "extends") or t.at(k + 1) in ("(", "{", "[") or t.kind(k + 1) == "str"):
                k += 1
                continue
            if t.at(k) == "<":
                k = t.angles(k) or len(t)
                continue
            if t.at(k) == "(":
                k = t.behind(k)
            elif t.at(k) in ("{", "[") or t.kind(k) in ("str", "num", "tpl("):
                k = t.behind(k)
            elif t.is_name(k):
                k = k + 2 if t.at(k) == "import" and t.at(k + 1) == "(" else k + 1
                if t.at(k - 1) == "(":
                    k = t.behind(k - 1)
                while t.at(k) == "." and t.is_name(k + 1):
                    k += 2
                if t.at(k) == "<":
                    k = t.angles(k) or k
            else:
                return k
            while t.at(k) == "[" and not t.new_line(k):
                k = t.behind(k)
            if t.at(k) in ("=>", "is", "|", "&"):
                k += 1
                continue
            if t.at(k) == "extends":
                k = self.type_end(k + 1)
                if t.at(k) == "?":
                    k = self.type_end(k + 1)
                    k = self.type_end(k + 1) if t.at(k) == ":" else k
            return k
        return k

    def expression_end(self, k: int, loop: bool = False) -> int:
        """The token behind the expression that begins at k: a comma, a semicolon, a closing bracket, or one on a new line that can't go on."""
        t, begin = self.t, k
        while k < len(t):
            text = t.at(k)
            if text in (",", ";") or k in t.partner and t.partner[k] < k or loop and text == "of":
                return k
            if k > begin and t.new_line(k):
                before = k - 1
                ended = t.kind(before) in _ENDS and t.at(before) not in BEFORE_EXPRESSION | _JOINS or t.at(before) in (")", "]", "}", "++", "--") or t.at(before) == ">" and t.is_name(k)
                begins = t.kind(k) in ("id", "num", "str", "re") and text not in ("in", "instanceof") or text in ("{", "}", "++", "--", "@", "!", "~")
                if ended and begins:
                    return k
            behind = t.angles(k) if self.ts and text == "<" else None  # type arguments are those that a bracket follows
            k = behind if behind and t.at(behind) == "(" else t.behind(k)
        return k

    # --- heads

    def parameters(self, open_: int, method: bool) -> list[tuple[str, str | None, str | None, bool]]:
        """Name, type, default and question mark of each parameter between the brackets."""
        t, k, end, rows = self.t, open_ + 1, self.t.partner[open_], []
        while k < end:
            while t.at(k) == "@":
                k += 2
                while t.at(k) == ".":
                    k += 2
                k = t.behind(k) if t.at(k) == "(" else k
            while t.at(k) in _MODIFIERS and (t.is_name(k + 1) or t.at(k + 1) in ("{", "[")):
                k += 1
            rest = t.at(k) == "..."
            k += rest
            begin, k = k, t.behind(k)
            name, plain = t.slice(begin, k), t.is_name(begin)
            optional = self.ts and t.at(k) == "?"
            k += optional
            kind = default = None
            if self.ts and t.at(k) == ":":
                begin, k = k + 1, self.type_end(k + 1)
                kind = t.slice(begin, k) or None
            given = t.at(k) == "="
            if given:
                begin, k = k + 1, min(self.expression_end(k + 1), end)
                default = t.slice(begin, k) if self.ts else "has_default"
            if not self.ts and (rest or not plain or method and given):
                name = "unknown"
            rows.append((name, kind, default, optional))
            while k < end and t.at(k) != ",":
                k = t.behind(k)
            k += 1
        return rows

    def add_parameters(self, owner: str, full: str, rows: list) -> None:
        for name, kind, default, optional in rows:
            self.g.add("Parameter", name, f"{full}::{name}", None, owner, "DECLARES", type=kind, default_value=default, is_optional=optional)

    def open_bracket(self, k: int) -> int | None:
        """The bracket of the parameters, behind type parameters if there are any."""
        if self.t.at(k) == "<":
            k = self.t.angles(k) or k
        return k if self.t.at(k) == "(" else None

    def result(self, k: int) -> tuple[str | None, int]:
        """The type behind a bracket of parameters, and the token behind it."""
        if not (self.ts and self.t.at(k) == ":"):
            return None, k
        end = self.type_end(k + 1)
        return self.t.slice(k + 1, end) or None, end

    def body(self, k: int) -> int:
        """The last token of a body, or of a signature, whose head ends before k."""
        t = self.t
        if t.at(k) == "{":
            return t.partner[k]
        return k if t.at(k) == ";" else k - 1

    def heritage(self, k: int, stop: int) -> dict[str, list[str]]:
        """Names behind extends and implements between two tokens, without type arguments."""
        t, found, word = self.t, {"extends": [], "implements": []}, None
        while k < stop:
            if t.at(k) in found:
                word, k = t.at(k), k + 1
                continue
            if word is None or t.at(k) == ",":
                k += 1
                continue
            begin = k
            while k < stop and t.at(k) not in (",", "implements", "extends") and not (t.at(k) == "<" and t.angles(k)):
                k = t.behind(k)
            name = t.slice(begin, k)
            if not self.ts:
                name = re.sub(r"\s", "", name) if all(t.is_name(j) if (j - begin) % 2 == 0 else t.at(j) == "." for j in range(begin, k)) and (k - begin) % 2 else "unknown"
            found[word].append(name)
            if t.at(k) == "<":
                k = t.angles(k)
        return found

    def class_body(self, k: int) -> int | None:
        """The brace of the class or interface whose head goes on at k."""
        t = self.t
        while k < len(t) and t.at(k) != "{":
            if t.at(k) in (";", ")", "}", "]"):
                return None
            behind = t.angles(k) if t.at(k) == "<" else None
            k = behind or t.behind(k)
        return k if k < len(t) else None

    # --- declarations

    def function(self, k: int) -> None:
        t = self.t
        star = t.at(k + 1) == "*"
        name = k + 1 + star
        open_ = self.open_bracket(name + 1) if t.is_name(name) else None
        if open_ is None:
            return
        is_async = t.at(k - 1) == "async"
        rows, behind = self.parameters(open_, False), t.partner[open_] + 1
        kind, behind = self.result(behind)
        last = self.body(behind)
        first = self.first_token(k) if self.ts else k - is_async
        full, names = f"{self.path}::{t.at(name)}", [x for x, *_ in rows]
        more = {} if self.ts else {"is_generator": star}
        own = self.g.add("Function", t.at(name), full, self.span(first, last), self.g.file, "CONTAINS", parameters=names, is_async=is_async, return_type=kind, signature=f"{t.at(name)}({', '.join(names)})", **more)
        self.add_parameters(own, full, rows)
        self.owners.append((behind, last, own))

    def type_declaration(self, k: int) -> None:
        """A class or an interface, if it has a name, with its methods."""
        t, name = self.t, k + 1
        brace = self.class_body(k + 1)
        if brace is None or not t.is_name(name) or t.at(name) in ("extends", "implements"):
            return
        head = name + 1
        if t.at(head) == "<":
            head = t.angles(head) or head
        bases = self.heritage(head, brace)
        first = self.first_token(k) if self.ts else k
        full, span = f"{self.path}::{t.at(name)}", self.span(first, t.partner[brace])
        if t.at(k) == "interface":
            self.g.add("Interface", t.at(name), full, span, self.g.file, "CONTAINS", base_interfaces=bases["extends"])
            return
        abstract = self.ts and "abstract" in [t.at(j) for j in range(first, k)]
        own = self.g.add("Class", t.at(name), full, span, self.g.file, "CONTAINS", is_abstract=abstract, base_classes=bases["extends"], interfaces=bases["implements"])
        self.members(own, full, brace)

    def members(self, owner: str, full: str, brace: int) -> None:
        t, k, end = self.t, brace + 1, self.t.partner[brace]
        while k < end:
            if t.at(k) == ";":
                k += 1
                continue
            first, mods = k, []
            while t.at(k) == "@":
                k += 2
                while t.at(k) == ".":
                    k += 2
                k = t.behind(k) if t.at(k) == "(" else k
            while t.at(k) in _MODIFIERS and (t.kind(k + 1) in ("id", "str", "num") or t.at(k + 1) in ("*", "[", "{")):
                mods.append(t.at(k))
                k += 1
            if t.at(k) == "{":  # static block
                k = t.behind(k)
                continue
            star = t.at(k) == "*"
            k += star
            begin, k = k, t.behind(k)
            plain = t.is_name(begin) or t.at(begin) == "[" and k == begin + 3 and t.is_name(begin + 1)
            name = t.slice(begin, k) if self.ts or t.is_name(begin) else t.at(begin + 1)
            if t.at(k) in ("?", "!"):
                k += 1
            open_ = self.open_bracket(k)
            if open_ is None:
                k = self.field_end(k)
                continue
            rows, behind = self.parameters(open_, True), t.partner[open_] + 1
            kind, behind = self.result(behind)
            last = self.body(behind)
            named = self.ts and name != "constructor" and not {"get", "set"} & set(mods) or not self.ts and plain
            if named:
                name = name if self.ts else name.removeprefix("#")
                names = [x for x, *_ in rows]
                visible = next((x for x in mods if x in ("public", "private", "protected")), None)
                own = self.g.add("Method", name, f"{full}::{name}", self.span(first, last), owner, "DEFINES", is_static="static" in mods, is_abstract="abstract" in mods, is_async="async" in mods, visibility=visible, parameters=names, return_type=kind, signature=f"{name}({', '.join(names)})")
                if self.ts:
                    self.add_parameters(own, f"{full}::{name}", rows)
                self.owners.append((behind, last, own))
            k = last + 1

    def field_end(self, k: int) -> int:
        """The token behind a field whose name ends before k."""
        t = self.t
        if self.ts and t.at(k) == ":":
            k = self.type_end(k + 1)
        if t.at(k) == "=":
            k = self.expression_end(k + 1)
        return k + (t.at(k) == ";")

    def variables(self, k: int) -> None:
        t, loop = self.t, self.t.at(k - 1) == "("
        constant, first = t.at(k) == "const", k + 1
        while True:
            begin, k = first, t.behind(first)
            if t.at(k) == "!":
                k += 1
            kind = value = None
            if self.ts and t.at(k) == ":":
                at, k = k + 1, self.type_end(k + 1)
                kind = t.slice(at, k) or None
            if t.at(k) == "=":
                at, k = k + 1, self.expression_end(k + 1, loop)
                value = t.slice(at, k) if self.ts else "has_initializer"
            if t.is_name(begin):
                where = (t.tokens[begin - 1].end if self.ts else t.tokens[begin].start, t.tokens[k - 1].end)
                self.g.add("Variable", t.at(begin), f"{self.path}::{t.at(begin)}", where, self.g.file, "DECLARES", type=kind, value=value, is_constant=constant)
            if t.at(k) != ",":
                return
            first = k + 1

    def names(self, brace: int, which: int) -> list[str]:
        """Names between braces, before (0) or behind (-1) ``as``."""
        t, k, out = self.t, brace + 1, []
        while k < t.partner[brace]:
            begin = k
            while k < t.partner[brace] and t.at(k) != ",":
                k += 1
            words = [j for j in range(begin, k)]
            if len(words) in (2, 4) and t.at(begin) == "type":
                words = words[1:]
            if words:
                out.append(t.slice(words[which], words[which] + 1))
            k += 1
        return out

    def imported(self, k: int) -> None:
        t, at, names = self.t, k, []
        k += 1
        if t.at(k) == "type" and (t.is_name(k + 1) and t.at(k + 1) != "from" or t.at(k + 1) in ("{", "*")):
            k += 1
        if t.is_name(k):
            if t.at(k + 1) == "=":  # of another kind
                return
            names.append("default")
            k += 2 if t.at(k + 1) == "," else 1
        if t.at(k) == "*":
            names.append("*")
            k += 3
        elif t.at(k) == "{":
            names += self.names(k, -1 if self.ts else 0)
            k = t.behind(k)
        k += t.at(k) == "from"
        if t.kind(k) == "str":
            module = t.tokens[k].text[1:-1]
            self.g.add("Import", f"import from {module}", f"{self.path}::import::{module}", (t.tokens[at].start, t.tokens[k].end), self.g.file, "IMPORTS", module=module, imported_names=names, is_wildcard="*" in names)

    def exported(self, k: int) -> None:
        t, at = self.t, k
        k += 1
        if t.at(k) == "default" or self.ts and t.at(k) == "=":
            follows = t.at(k + 1)
            declares = follows in ("function", "class", "interface") or follows == "abstract" and t.at(k + 2) == "class" or follows == "async" and t.at(k + 2) == "function" or follows == "@"
            if self.ts and declares:
                return
            names, last = ["default"], k
        else:
            k += t.at(k) == "type" and t.at(k + 1) in ("{", "*")
            if t.at(k) == "{":
                names, last = self.names(k, -1), t.partner[k]
            elif t.at(k) == "*":
                if not self.ts:
                    return
                names, last = [], k
            elif self.ts:
                return
            else:
                names, last = [], at
        default = names == ["default"] and t.at(at + 1) != "{"
        shown = "export default" if default else f"export {', '.join(names)}"
        self.g.add("Export", shown, f"{self.path}::export", (t.tokens[at].start, t.tokens[last].end), self.g.file, "EXPORTS", exported_names=names, is_default=default)

    def required(self, k: int) -> None:
        t = self.t
        if t.kind(k + 2) == "str" and t.tokens[k + 2].text[0] != "`" and t.at(k - 1) not in (".", "?.", "new", "function"):
            module, end = t.tokens[k + 2].text[1:-1], t.tokens[t.partner[k + 1]].end
            self.g.add("Import", f"require('{module}')", f"{self.path}::require::{module}", (t.tokens[k].start, end), self.g.file, "IMPORTS", module=module)

    def module_exports(self, k: int) -> None:
        t, behind = self.t, None
        if t.at(k - 1) in (".", "?."):
            return
        if t.at(k) == "module" and t.at(k + 1) == "." and t.at(k + 2) == "exports":
            behind = k + 3
        elif t.at(k) == "exports":
            behind = k + 3 if t.at(k + 1) == "." else t.behind(k + 1) if t.at(k + 1) == "[" else None
        if behind and t.at(behind) in _ASSIGNS:
            self.g.add("Export", "module.exports", f"{self.path}::module.exports", (t.tokens[k].start, t.tokens[behind].end), self.g.file, "EXPORTS", exported_names=["default"], is_default=True)

    def called(self, k: int) -> tuple[str, str] | None:
        """Kind and dotted name of the call or creation whose last name is at k."""
        t = self.t
        behind = k + 1
        if t.at(behind) == "<":
            behind = t.angles(behind) or behind
        if t.at(behind) == "?." and t.at(behind + 1) == "(":
            behind += 1
        if t.at(k) in _NO_CALLS and t.at(k - 1) not in (".", "?."):
            return None
        begin = k
        while t.at(begin - 1) in (".", "?.") and t.is_name(begin - 2):
            begin -= 2
        new = t.at(begin - 1) == "new"
        if t.at(behind) != "(" or t.at(begin - 1) in (".", "?.") and not t.is_name(begin - 2):
            # a method of some value: its name is all there is
            if t.at(behind) != "(":
                return ("new", ".".join(t.at(j) for j in range(begin, k + 1, 2))) if new and t.at(k + 1) != "." else None
            return "call", f"?.{t.at(k)}"
        if t.at(begin - 1) in ("function", "*", "get", "set"):
            return None
        return "new" if new else "call", ".".join(t.at(j) for j in range(begin, k + 1, 2))

    def run(self) -> None:
        t = self.t
        for k in range(len(t)):
            if not t.is_name(k):
                continue
            word, before, follows = t.at(k), t.at(k - 1), t.at(k + 1)
            if before in (".", "?."):
                continue
            if word in ("class", "interface", "enum") and (t.is_name(k + 1) or word == "class" and follows == "{"):
                brace = self.class_body(k + 1)
                if brace is not None:
                    self.bodies.add(brace)
            if word == "function" and self.begins_statement(k - (before == "async")):
                self.function(k)
            elif word == "class" and self.begins_statement(self.first_token(k)) or word == "interface" and self.ts and t.is_name(k + 1) and self.begins_statement(self.first_token(k)):
                self.type_declaration(k)
            elif word in ("const", "let", "var") and (t.is_name(k + 1) and follows not in ("enum", "in", "of", "instanceof") or follows in ("{", "[")):
                loop = before == "(" and t.at(k - 2) in ("for", "await")
                if not self.ts and loop or self.begins_statement(k):
                    self.variables(k)
            elif word == "import" and follows not in ("(", ".") and self.begins_statement(k):
                self.imported(k)
            elif word == "export" and self.begins_statement(k):
                self.exported(k)
            elif self.common and word == "require" and follows == "(":
                self.required(k)
            elif self.common and word in ("module", "exports"):
                self.module_exports(k)

    def references(self) -> list[dict]:
        """Calls and creations within functions and methods, by the innermost one around."""
        t, out, seen = self.t, [], set()
        inner: dict[int, str] = {}
        for first, last, own in self.owners:  # in order of their heads, so that inner ones come later
            inner.update(dict.fromkeys(range(first, last + 1), own))
        for k, own in sorted(inner.items()):
            found = self.called(k) if t.is_name(k) else None
            if found and (own, *found) not in seen:
                seen.add((own, *found))
                out.append({"src": own, "kind": found[0], "name": found[1]})
        return out


def extract_ecma(path: str, text: str, language: str, module_system: str = "esm") -> tuple[list[dict], list[dict], list[dict]]:
    """Nodes, edges and references of a file."""
    p = Parser(path, text, language, module_system)
    p.run()
    return p.g.nodes, p.g.edges, p.references()
