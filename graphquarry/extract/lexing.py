"""Source text to tokens: strings, templates, regular expressions and comments are told apart by a stack, not by a mask.

A token is (kind, text, start, end). Kinds: ``id``, ``num``, ``str``, ``re``, and ``p`` for punctuators. A template without
substitutions is a ``str``; of others the part before the first substitution is a ``tpl(``, that behind the last one a
``tpl)`` and those between are ``tpl``, so that they nest like brackets.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


OPENERS = {"(": ")", "[": "]", "{": "}", "tpl(": "tpl)"}
_SPACE = re.compile(r"\s+|﻿")
_NAME = re.compile(r"[#@]?(?:[^\W\d]|[$_]|\\u\{?[0-9a-fA-F]+\}?)(?:\w|[$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = re.compile(r"\.?\d(?:[eE][+-]?|\.(?!\.)|\w)*")
#: A body's slash ends it outside a class of characters only.
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_QUOTED = re.compile(r"'(?:\\[\s\S]|[^'\\\n])*'|\"(?:\\[\s\S]|[^\"\\\n])*\"")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
#: Longest first; a ``>`` stands alone where it may close type arguments.
_ECMA = re.compile(r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\?\?|\?\.(?!\d)|&&|\|\||\*\*|<<|[^\s\w]")
_CSHARP = re.compile(r"=>|==|!=|<=|>=|\?\?=|\?\?|\?\.|::|->|\+\+|--|&&|\|\||<<|[-+*/%&|^]=|\.\.|[^\s\w]")
#: Words behind which an expression begins.
BEFORE_EXPRESSION = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "extends", "default"}
_HEADS = {"if", "while", "for", "with"}


def fail(text: str, at: int, what: str) -> None:
    raise SyntaxError(f"{what} at line {text.count(chr(10), 0, at) + 1}")


def comment_end(text: str, at: int) -> int:
    """Behind the comment that begins at ``at``; ``at`` itself if none does."""
    if text.startswith("//", at):
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if text.startswith("/*", at):
        end = text.find("*/", at + 2)
        return end + 2 if end >= 0 else fail(text, at, "comment without an end")
    return at


def ecma_tokens(text: str) -> list[Token]:
    """JavaScript and TypeScript."""
    out: list[Token] = []
    open_: list[int] = []  # tokens that opened a bracket or a template
    k, n = 0, len(text)
    if text.startswith("#!"):
        k = text.find("\n") if "\n" in text else n

    def template(at: int, first: bool) -> int:
        stop = _TEMPLATE.match(text, at).end()
        if stop >= n:
            fail(text, at, "template without an end")
        ends = text[stop] == "`"
        kind = ("str" if ends else "tpl(") if first else ("tpl)" if ends else "tpl")
        if kind == "tpl(":
            open_.append(len(out))
        elif kind == "tpl)":
            open_.pop()
        end = stop + (1 if ends else 2)
        out.append(Token(kind, text[at - 1 : end], at - 1, end))
        return end

    def begins_expression() -> bool:
        """Whether an operand, hence a regular expression, may stand here."""
        if not out:
            return True
        t = out[-1]
        if t.kind == "id":
            return t.text in BEFORE_EXPRESSION and not (len(out) > 1 and out[-2].text in (".", "?."))
        if t.kind in ("num", "str", "re", "tpl)"):
            return False
        if t.kind.startswith("tpl"):
            return True
        if t.text == ")":
            opener = closed[len(out) - 1]
            return opener > 0 and out[opener - 1].kind == "id" and out[opener - 1].text in _HEADS
        if t.text == "}":
            return not values[closed[len(out) - 1]]
        return t.text not in ("]", "++", "--", "<")  # </ closes an element

    closed: dict[int, int] = {}  # of a closing token, its opener
    values: dict[int, bool] = {}  # of an opening brace: whether it stands for a value
    while k < n:
        c = text[k]
        if c.isspace() or c == "﻿":
            k = _SPACE.match(text, k).end()
            continue
        if c == "/":
            end = comment_end(text, k)
            if end > k:
                k = end
                continue
            found = _REGEX.match(text, k) if begins_expression() else None
            if found:
                out.append(Token("re", found[0], k, found.end()))
                k = found.end()
                continue
        if c in "'\"":
            found = _QUOTED.match(text, k)
            if found:
                out.append(Token("str", found[0], k, found.end()))
                k = found.end()
                continue
        if c == "`":
            k = template(k + 1, True)
            continue
        if c.isdigit() or c == "." and text[k + 1 : k + 2].isdigit():
            end = _NUMBER.match(text, k).end()
            out.append(Token("num", text[k:end], k, end))
            k = end
            continue
        found = _NAME.match(text, k) if c != "@" else None
        if found:
            out.append(Token("id", found[0], k, found.end()))
            k = found.end()
            continue
        if c == "}" and open_ and out[open_[-1]].kind == "tpl(":
            k = template(k + 1, False)
            continue
        p = _ECMA.match(text, k)[0]
        if p in OPENERS:
            if p == "{":
                values[len(out)] = begins_expression() and bool(out) and out[-1].text not in (";", "{", "}", ")", "=>", "else", "do", ":") and out[-1].kind != "tpl"
            open_.append(len(out))
        elif p in (")", "]", "}"):
            if not open_ or OPENERS.get(out[open_[-1]].text) != p:
                fail(text, k, f"unexpected {p}")
            closed[len(out)] = open_.pop()
        out.append(Token("p", p, k, k + len(p)))
        k += len(p)
    if open_:
        fail(text, out[open_[-1]].start, f"{out[open_[-1]].text[:1]} without an end")
    return out


_REGULAR = re.compile(r'"(?:\\.|[^"\\\n])*"')
_VERBATIM = re.compile(r'(?:[^"]|"")*"')
_CHARACTER = re.compile(r"'(?:\\.[0-9a-fA-F]*|[^'\\\n])'")
_PREFIX = re.compile(r'(\$*)(@?)(\$?)("+)')


def csharp_string_end(text: str, at: int) -> int:
    """Behind the string or character literal at ``at``; ``at`` itself if there is none. Interpolations may hold strings."""
    if text[at] == "'":
        found = _CHARACTER.match(text, at)
        return found.end() if found else at
    found = _PREFIX.match(text, at) or (_PREFIX.match(text[at : at + 2][::-1] + text[at + 2 : at + 9]) if text[at : at + 2] == "@$" else None)
    if not found:
        return at
    dollars, verbatim, quotes = len(found[1]) + len(found[3]), bool(found[2]), len(found[4])
    body = at + len(found[1]) + len(found[2]) + len(found[3])
    raw = quotes >= 3 and not verbatim
    if not raw and not dollars:
        if verbatim:
            end = _VERBATIM.match(text, body + 1)
            return end.end() if end else fail(text, at, "string without an end")
        end = _REGULAR.match(text, body)
        return end.end() if end else fail(text, at, "string without an end")
    k, close = body + (quotes if raw else 1), '"' * (quotes if raw else 1)
    while k < len(text):
        c = text[k]
        if c == '"':
            run = re.compile('"+').match(text, k).end() - k
            if raw:
                if run >= quotes:
                    return k + run
                k += run
            elif verbatim and run > 1:
                k += 2
            else:
                return k + len(close)
        elif c == "\\" and not raw and not verbatim:
            k += 2
        elif c == "{" and dollars:
            run = re.compile(r"\{+").match(text, k).end() - k
            holes = run >= dollars if raw else run % 2 == 1
            k += run
            if holes:
                k = _hole_end(text, k, dollars if raw else 1)
        elif c == "\n" and not raw and not verbatim:
            fail(text, at, "string without an end")
        else:
            k += 1
    return fail(text, at, "string without an end")


def _hole_end(text: str, at: int, braces: int) -> int:
    """Behind the braces that close an interpolation."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c in "\"'$@":
            end = csharp_string_end(text, k)
            k = end if end > k else k + 1
        elif c == "}" and not depth:
            return k + braces
        else:
            depth += (c in "([{") - (c in ")]}")
            k += 1
    return fail(text, at, "interpolation without an end")


def _condition(text: str, defined: set[str]) -> bool:
    """A directive's condition of symbols, !, &&, ||, ==, != and brackets."""
    words = re.findall(r"\w+|&&|\|\||==|!=|!|[()]", text.partition("//")[0])[::-1]

    def one() -> bool:
        word = words.pop() if words else ""
        if word == "!":
            return not one()
        if word == "(":
            value = several(0)
            if words:
                words.pop()
            return value
        return word == "true" or word in defined

    def several(level: int) -> bool:
        signs = (("||",), ("&&",), ("==", "!="))
        if level == len(signs):
            return one()
        value = several(level + 1)
        while words and words[-1] in signs[level]:
            sign, other = words.pop(), several(level + 1)
            value = value or other if sign == "||" else value and other if sign == "&&" else (value == other) == (sign == "==")
        return value

    return several(0)


def csharp_tokens(text: str) -> tuple[list[Token], list[Token]]:
    """The tokens that are compiled, without any symbols but those the file defines, and the comments."""
    out: list[Token] = []
    comments: list[Token] = []
    defined: set[str] = set()
    taken: list[list[bool]] = []  # of each #if around: whether this branch is compiled, whether one has been
    k, n, fresh = 0, len(text), True
    while k < n:
        c = text[k]
        if c.isspace() or c == "﻿":
            end = _SPACE.match(text, k).end()
            fresh = fresh or "\n" in text[k:end]
            k = end
            continue
        line = text.find("\n", k)
        line = n if line < 0 else line
        if c == "#" and fresh:
            word, _, rest = text[k + 1 : line].strip().partition(" ")
            if word == "if":
                now = _condition(rest, defined)
                taken.append([now, now])
            elif word == "elif" and taken:
                now = not taken[-1][1] and _condition(rest, defined)
                taken[-1] = [now, taken[-1][1] or now]
            elif word == "else" and taken:
                taken[-1] = [not taken[-1][1], True]
            elif word == "endif" and taken:
                taken.pop()
            elif word in ("define", "undef"):
                (defined.add if word == "define" else defined.discard)(rest.strip())
            k = line
            continue
        if not all(now for now, _ in taken):
            k = line
            continue
        fresh = False
        if c == "/":
            end = comment_end(text, k)
            if end > k:
                comments.append(Token("comment", text[k:end], k, end))
                k = end
                continue
        if c in "\"'$@":
            end = csharp_string_end(text, k)
            if end > k:
                out.append(Token("str", text[k:end], k, end))
                k = end
                continue
        found = _NUMBER.match(text, k) if c.isdigit() else _NAME.match(text, k) if c != "#" else None
        if found:
            out.append(Token("num" if c.isdigit() else "id", found[0], k, found.end()))
            k = found.end()
            continue
        p = _CSHARP.match(text, k)[0]
        out.append(Token("p", p, k, k + len(p)))
        k += len(p)
    return out, comments


class Tokens:
    """Tokens with the partner of each bracket, and the innermost bracket around each."""

    def __init__(self, text: str, tokens: list[Token]):
        self.text, self.tokens = text, tokens
        self.partner: dict[int, int] = {}
        self.around: list[int] = []
        stack: list[int] = []
        for k, t in enumerate(tokens):
            kind = t.text if t.kind == "p" else t.kind
            if kind in (")", "]", "}", "tpl)"):
                if not stack or OPENERS[self.opener(stack[-1])] != kind:
                    fail(text, t.start, f"unexpected {t.text[:1]}")
                j = stack.pop()
                self.partner[j], self.partner[k] = k, j
            self.around.append(stack[-1] if stack else -1)
            if kind in OPENERS:
                stack.append(k)
        if stack:
            fail(text, tokens[stack[-1]].start, f"{tokens[stack[-1]].text[:1]} without an end")

    def opener(self, k: int) -> str:
        t = self.tokens[k]
        return t.text if t.kind == "p" else t.kind

    def __len__(self) -> int:
        return len(self.tokens)

    def at(self, k: int) -> str:
        """The text of a punctuator or name; of other tokens, and beyond the ends, nothing."""
        if 0 <= k < len(self.tokens):
            t = self.tokens[k]
            return t.text if t.kind in ("p", "id") else ""
        return ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def is_name(self, k: int) -> bool:
        return self.kind(k) == "id"

    def behind(self, k: int) -> int:
        """The token behind this one or, if it opens a bracket, behind the one that closes it."""
        return self.partner[k] + 1 if k in self.partner and self.partner[k] > k else k + 1

    def slice(self, begin: int, end: int) -> str:
        """Source text of the tokens begin to end - 1."""
        return self.text[self.tokens[begin].start : self.tokens[end - 1].end] if end > begin else ""

    def new_line(self, k: int) -> bool:
        """Whether a line ends before this token."""
        return 0 < k < len(self.tokens) and "\n" in self.text[self.tokens[k - 1].end : self.tokens[k].start]

    def angles(self, k: int) -> int | None:
        """The token behind the ``>`` that closes the ``<`` at k; None where none does, as of a comparison."""
        depth = 0
        while k < len(self.tokens):
            t = self.at(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in (";", ")", "]", "}", "&&", "||") or k in self.partner and self.partner[k] < k:
                return None
            k = self.behind(k)
        return None
