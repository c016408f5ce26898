"""What names stand for over several files, and what searches then find on an index's own data."""

import pytest

from graphquarry import extract
from graphquarry import index as indexing
from graphquarry.operators import graph, symbols

FILES = {
    "src/app/main.py": "from .models import User, save as keep\nimport app.util as u\nfrom lib import *\nfrom app import tools\n\nclass Admin(User, Missing):\n    def run(self):\n        self.check()\n        keep(self)\n        u.log('x')\n        tools.mend()\n        star()\n        return User()\n    def check(self):\n        other.check()\n\ndef check(): local()\ndef local(): local()\n",
    "src/app/__init__.py": "",
    "src/app/models.py": "class Base: pass\nclass User(Base):\n    def check(self): pass\ndef save(x): User.check(x)\n",
    "src/app/util.py": "def log(x): pass\ndef star(): pass\n",
    "src/app/tools.py": "def mend(): pass\n",
    "src/lib/__init__.py": "def star(): pass\n",
    "other/models.py": "class User: pass\nclass Base: pass\ndef log(x): pass\n",
    "web/a.ts": "import { Shape, area as A } from './shapes';\nimport * as all from './deep';\nimport { x } from 'package';\nexport class Square extends Shape implements Named {\n  size(): number { this.grow(); all.dig(); return area(new Shape()) }\n  grow() { x(); }\n}\ninterface Named extends Titled {}\n",
    "web/shapes.ts": "export class Shape {}\nexport function area(s: Shape) { return 1 }\n",
    "web/deep/index.ts": "export function dig() {}\nexport interface Titled {}\n",
    "cs/Core.cs": "namespace Acme.Core { public interface INote { void Note(string t); } public class Room { public static Room Make() { return new Room(); } public class Key { } } public class Far { } }\n",
    "cs/Shop.cs": "using Acme.Core;\nnamespace Acme.Shop { public class Shelf : Room, INote { public void Note(string t) { Put(); Room.Make(); Acme.Core.Room.Make(); new Item(); new Room.Key(); } void Put() { } void Put(int n) { } } class Item : Far { } }\n",
    "cs/Other.cs": "namespace Else { public class Room { } public class Item { void M() { new Room(); new Far(); } } }\n",
}
WANT = {
    ("src/app/main.py::Admin", "src/app/models.py::User", "EXTENDS"),
    ("src/app/models.py::User", "src/app/models.py::Base", "EXTENDS"),
    ("src/app/main.py::Admin::run", "src/app/main.py::Admin::check", "CALLS"),
    ("src/app/main.py::Admin::run", "src/app/util.py::log", "CALLS"),
    ("src/app/main.py::Admin::run", "src/app/tools.py::mend", "CALLS"),
    ("src/app/main.py::Admin::run", "src/lib/__init__.py::star", "CALLS"),
    ("src/app/main.py::Admin::run", "src/app/models.py::User", "INSTANTIATES"),
    ("src/app/main.py::check", "src/app/main.py::local", "CALLS"),
    ("src/app/main.py::local", "src/app/main.py::local", "CALLS"),
    ("src/app/models.py::save", "src/app/models.py::User::check", "CALLS"),
    ("web/a.ts::Square", "web/shapes.ts::Shape", "EXTENDS"),
    ("web/a.ts::Square", "web/a.ts::Named", "IMPLEMENTS"),
    ("web/a.ts::Named", "web/deep/index.ts::Titled", "EXTENDS"),
    ("web/a.ts::Square::size", "web/a.ts::Square::grow", "CALLS"),
    ("web/a.ts::Square::size", "web/deep/index.ts::dig", "CALLS"),
    ("web/a.ts::Square::size", "web/shapes.ts::Shape", "INSTANTIATES"),
    ("Acme.Shop.Shelf", "Acme.Core.Room", "EXTENDS"),
    ("Acme.Shop.Shelf", "Acme.Core.INote", "IMPLEMENTS"),
    ("Acme.Shop.Item", "Acme.Core.Far", "EXTENDS"),
    ("Acme.Core.Room.Make()", "Acme.Core.Room", "INSTANTIATES"),
    ("Acme.Shop.Shelf.Note(string)", "Acme.Core.Room.Make()", "CALLS"),
    ("Acme.Shop.Shelf.Note(string)", "Acme.Shop.Item", "INSTANTIATES"),
    ("Acme.Shop.Shelf.Note(string)", "Acme.Core.Room.Key", "INSTANTIATES"),
    ("Else.Item.M()", "Else.Room", "INSTANTIATES"),
}
LANGUAGES = {"py": "python", "ts": "typescript", "cs": "csharp"}
SCHEMA = "path string, absolute_path string, content string, checksum string, size long, extension string, language string"


def files(spark, texts):
    rows = [(p, f"/{p}", t, str(hash(t)), len(t), "." + p.rpartition(".")[2], LANGUAGES[p.rpartition(".")[2]]) for p, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def indexed(spark):
    return indexing.index_files(files(spark, FILES), *indexing.empty(spark))


def named(result, types=("EXTENDS", "IMPLEMENTS", "CALLS", "INSTANTIATES")):
    full = {r["id"]: r["full_name"] for r in result.nodes.select("id", "full_name").collect()}
    return {(full[r["src"]], full[r["dst"]], r["type"]) for r in result.edges.collect() if r["type"] in types}


def test_references_lead_to_what_their_scopes_have(indexed):
    assert indexed.failures.count() == 0
    got = named(indexed)
    put = {x for x in got if "Put" in x[1]}
    assert len(put) == 1 and put <= {("Acme.Shop.Shelf.Note(string)", f"Acme.Shop.Shelf.Put({x})", "CALLS") for x in ("", "int")}
    assert got - put == WANT


def test_hot_names_and_others_agree(indexed, monkeypatch):
    nodes, edges = indexed.nodes, symbols.without_derived(indexed.edges)
    facts = lambda: {(r["src"], r["dst"], r["type"]) for r in symbols.derived_edges(nodes, edges).collect()}
    one = facts()
    monkeypatch.setattr(symbols, "HOT_SHARE", 2.0)
    assert facts() == one and len(one) == len(WANT) + 1


def test_callers_and_ancestors_of_an_index(indexed):
    n, e = indexed.nodes, indexed.edges
    root = lambda name: n.filter(f"full_name = '{name}'").select("id")
    callers = graph.call_hierarchy(root("src/app/models.py::User::check"), n, e, direction="IN")
    assert [r["full_name"] for r in callers.collect()] == ["src/app/models.py::save"]
    up = graph.inheritance_hierarchy(root("src/app/main.py::Admin"), n, e)
    assert sorted((r["full_name"], r["depth"]) for r in up.collect()) == [("src/app/models.py::Base", 2), ("src/app/models.py::User", 1)]


def test_names_are_resolved_anew_when_other_files_change(spark, indexed):
    """A file that stays gets new edges, and loses old ones, as files around it come and go."""
    changed = {k: v for k, v in FILES.items() if k != "src/app/models.py"} | {"web/shapes.ts": "export class Shape {}\nexport function area() {}\nexport class Missing {}\n", "src/app/models.py": "class User: pass\ndef save(x): pass\n"}
    two = indexing.index_files(files(spark, changed), indexed.nodes, indexed.edges)
    got = named(two)
    gone = {x for x in WANT if x[0].startswith("src/app/models.py")}
    assert {x for x in got if "Put" not in x[1]} == WANT - gone
    three = indexing.index_files(files(spark, changed), two.nodes, two.edges)
    assert named(three) == got


def test_edges_that_were_brought_stay(spark, indexed):
    n = {r["full_name"]: r["id"] for r in indexed.nodes.collect()}
    own = spark.createDataFrame([(n["src/app/util.py::log"], n["src/app/util.py::star"], "CALLS", {"by": "hand"})], "src string, dst string, type string, properties map<string,string>")
    again = indexing.index_files(files(spark, FILES), indexed.nodes, indexed.edges.unionByName(own))
    assert ("src/app/util.py::log", "src/app/util.py::star", "CALLS") in named(again)


def test_files_that_do_not_close_are_errors():
    for text, language in (("const a = `x ${b`", "javascript"), ("function f() {", "javascript"), ("/* open", "typescript"), ("x = (1]", "typescript"), ('class A { string s = "open\n; }', "csharp"), ("class A { ", "csharp")):
        with pytest.raises(SyntaxError):
            extract.extract_text("f", text, language)


def test_docstrings_keep_their_lines():
    nodes, _ = extract.extract_text("a.py", 'class A:\n    """  One.\n\n      Two.\n    """\n    def f(self):\n        b"no"\n', "python")
    assert {n["name"]: n.get("docstring") for n in nodes[1:]} == {"A": "One.\n\n      Two.", "f": None, "self": None}


def test_what_functions_call():
    said = lambda text, language: {n["name"]: n.get("properties") for n in extract.extract_text("f", text, language)[0] if n["label"] in ("Function", "Method")}
    assert said("def f():\n    a.b.c(d())[0].e()\n    def g(): h()\n    return lambda: k()\n", "python") == {"f": {"decorators": "", "calls": "?.e,a.b.c,d,k"}, "g": {"decorators": "", "calls": "h"}}
    assert said("function f() { if (a) b.c(d(), new E.F(1)); g`x`; function h() { i?.(); return new K } }", "javascript") == {"f": {"calls": "b.c,d", "creates": "E.F"}, "h": {"calls": "i", "creates": "K"}}
    assert said("class A { void M() { if (x) { B<int>(); new C { X = 1 }; this.D(); E.F(); int G() { return H(); } } } }", "csharp") == {"M": {"calls": "B,this.D,E.F,H", "creates": "C"}}


def test_owners_by_place_are_those_of_joins(spark):
    from graphquarry.plans import storage

    known = storage._WRITTEN.setdefault(spark.sparkContext.applicationId, set())
    before = set(known)
    result = indexing.index_files(files(spark, FILES), *indexing.empty(spark))
    # new files have the owners of their methods by themselves: nothing is joined for them
    assert not {p.rpartition("/")[2].rpartition("-")[0] for p in known - before} & {"owners", "named"}
    found = {(r["src"], r["dst"], r["type"]) for r in result.edges.filter("properties['derived'] = 'true'").collect()}
    joined = symbols.derived_edges(result.nodes, symbols.without_derived(result.edges))
    assert found == {(r["src"], r["dst"], r["type"]) for r in joined.collect()} and len(found) == len(WANT) + 1
    # files of a graph that exists and new ones: both kinds in one lookup
    some = dict(list(FILES.items())[:6])
    half = indexing.index_files(files(spark, some), *indexing.empty(spark))
    whole = indexing.index_files(files(spark, FILES), half.nodes, half.edges)
    assert found == {(r["src"], r["dst"], r["type"]) for r in whole.edges.filter("properties['derived'] = 'true'").collect()}
