"""Sources in each language, with what the extractors must find in them; ``@`` stands for a number that differs by file.

The expected rows were derived by hand from the rules of extraction: label, name, full name, edge
from the parent, the parent's full name, first and last line, and facts (columns that are set, in the order of FACTS).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ("is_abstract", "is_static", "is_sealed", "is_virtual", "is_override", "is_async", "is_generator", "is_constant", "is_readonly", "is_optional", "is_params", "is_wildcard", "is_default")
TEXTS = ("visibility", "modifier", "return_type", "type", "value", "default_value", "module", "alias", "scope", "docstring")
LISTS = ("base_classes", "interfaces", "base_interfaces", "parameters", "imported_names", "exported_names")


def facts() -> Column:
    """The set flags, then the other columns that hold something, as one text."""
    flags = [F.when(F.col(c), F.lit(c)) for c in FLAGS]
    texts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c in TEXTS]
    lists = [F.when(F.size(c) > 0, F.concat(F.lit(f"{c}="), F.array_join(c, ","))) for c in LISTS]
    return F.concat_ws(";", *flags, *texts, *lists)


#: Suffix, module system and text.
SOURCES = {
    "python": ("py", "esm", '''"""Module doc."""
import os as system, sys
from ..pkg.mod import a, b as c
from lib import *

@decorated
class C@(Base, pkg.Mixin, metaclass=M):
    """About C."""

    @staticmethod
    def make(x: int, y=2, *args, k=1, **kw) -> int:
        """Makes."""
        def inner(z):
            yield z
        return x

    async def run(self):
        pass

    class Nested:
        def deep(self): return 1

def gen(n: int = 3):
    yield n

async def top(): return None
'''),
    "javascript": ("js", "cjs", '''import d, { a, b as c } from './m';
import * as ns from "n";
const fs = require('fs');
export default function main@(p, { q }, r = 1, ...s) { return p; }
export { a as x, b };
class K@ extends ns.Base {
  constructor(v) { this.v = v; }
  static async make(u, w = 2) { return u; }
}
async function* walk(t) { yield t; }
let one = 1, two; // let three
export * from './all';
module.exports = { one };
exports.w = walk;
export const last = `function no(x) {}`;
'''),
    "typescript": ("tsx", "esm", '''import type { T as U } from 'types';
import def, * as all from "lib";
/** About A. */
export abstract class A@<T> extends Base<T> implements I1, I2<T> {
  private x: number = 1;
  constructor(public y: string) { super(); }
  public static async load(id: number, name?: string, { size } = { size: 3 }): Promise<void> { }
  protected abstract area(): number;
  get z() { return 1; }
}
export interface S@ extends P, Q<string> {
  go(n: number): void;
}
function* ids(a: string, ...rest: any[]): Generator<number> { yield 1; }
const v: number = 5, w = 'x';
for (let i = 0; i < 3; i++) { }
export { v, w as u };
export * from './all';
export default A@;
'''),
    "csharp": ("cs", "esm", '''using System;
using Text = System.Text;
namespace N.M
{
    /// <summary>A thing.</summary>
    public interface IThing@ : IBase { int Size { get; } void Do(); }

    [Serializable]
    public abstract class Base@ { protected Base@(string name) { } }

    public sealed class C@<T> : Base@, IThing@, IOther
    {
        private readonly int f = 1, g;
        public const string K = "a;b{";
        internal static int Count { get; set; } = 3;
        public int Size { get; }
        public int Twice => Size * 2;
        public event EventHandler Changed;
        public C@(ref int a, out string b, params int[] r) : base("x") { b = ""; }
        ~C@() { }
        /// <summary>Runs.</summary>
        [Obsolete("no")]
        protected override async Task<int> Run(string s = "{", int n = 2) { return 1; }
        public virtual void Do() { }
        public static U Map<U>(U u) => u;
        private class Inner { private protected int h; }
    }

    public struct P@ { public int x; }
}
'''),
}

_F, _C, _M, _R = "f@.cs", "N.M.C@<T>", "N.M.C@<T>.C@(ref int, out string, params int[])", "N.M.C@<T>.Run(string, int)"
EXPECTED = {
    "python": [
        ("File", "f@.py", "f@.py", None, None, None, None, ""),
        ("Import", "import os as system", "f@.py::import::os", "IMPORTS", "f@.py", 2, 2, "module=os;alias=system;imported_names=os"),
        ("Import", "import sys", "f@.py::import::sys", "IMPORTS", "f@.py", 2, 2, "module=sys;imported_names=sys"),
        ("Import", "from ..pkg.mod import a, b", "f@.py::import::..pkg.mod", "IMPORTS", "f@.py", 3, 3, "module=..pkg.mod;imported_names=a,b"),
        ("Import", "from lib import *", "f@.py::import::lib", "IMPORTS", "f@.py", 4, 4, "is_wildcard;module=lib;imported_names=*"),
        ("Class", "C@", "f@.py::C@", "CONTAINS", "f@.py", 6, 21, "docstring=About C.;base_classes=Base,pkg.Mixin"),
        ("Method", "make", "f@.py::C@::make", "DEFINES", "f@.py::C@", 10, 15, "is_static;return_type=int;docstring=Makes.;parameters=x,y"),
        ("Parameter", "x", "f@.py::C@::make::x", "DECLARES", "f@.py::C@::make", 11, 11, "type=int"),
        ("Parameter", "y", "f@.py::C@::make::y", "DECLARES", "f@.py::C@::make", 11, 11, "is_optional;default_value=2"),
        ("Method", "inner", "f@.py::C@::inner", "DEFINES", "f@.py::C@", 13, 14, "parameters=z"),
        ("Parameter", "z", "f@.py::C@::inner::z", "DECLARES", "f@.py::C@::inner", 13, 13, ""),
        ("Method", "run", "f@.py::C@::run", "DEFINES", "f@.py::C@", 17, 18, "is_async;parameters=self"),
        ("Parameter", "self", "f@.py::C@::run::self", "DECLARES", "f@.py::C@::run", 17, 17, ""),
        ("Class", "Nested", "f@.py::Nested", "CONTAINS", "f@.py", 20, 21, ""),
        ("Method", "deep", "f@.py::Nested::deep", "DEFINES", "f@.py::Nested", 21, 21, "parameters=self"),
        ("Parameter", "self", "f@.py::Nested::deep::self", "DECLARES", "f@.py::Nested::deep", 21, 21, ""),
        ("Function", "gen", "f@.py::gen", "CONTAINS", "f@.py", 23, 24, "is_generator;parameters=n"),
        ("Parameter", "n", "f@.py::gen::n", "DECLARES", "f@.py::gen", 23, 23, "is_optional;type=int;default_value=3"),
        ("Function", "top", "f@.py::top", "CONTAINS", "f@.py", 26, 26, "is_async"),
    ],
    "javascript": [
        ("File", "f@.js", "f@.js", None, None, None, None, ""),
        ("Import", "import from ./m", "f@.js::import::./m", "IMPORTS", "f@.js", 1, 1, "module=./m;imported_names=default,a,b"),
        ("Import", "import from n", "f@.js::import::n", "IMPORTS", "f@.js", 2, 2, "is_wildcard;module=n;imported_names=*"),
        ("Variable", "fs", "f@.js::fs", "DECLARES", "f@.js", 3, 3, "is_constant;value=has_initializer"),
        ("Import", "require('fs')", "f@.js::require::fs", "IMPORTS", "f@.js", 3, 3, "module=fs"),
        ("Export", "export default", "f@.js::export", "EXPORTS", "f@.js", 4, 4, "is_default;exported_names=default"),
        ("Function", "main@", "f@.js::main@", "CONTAINS", "f@.js", 4, 4, "parameters=p,unknown,r,unknown"),
        ("Parameter", "p", "f@.js::main@::p", "DECLARES", "f@.js::main@", None, None, ""),
        ("Parameter", "unknown", "f@.js::main@::unknown", "DECLARES", "f@.js::main@", None, None, ""),
        ("Parameter", "r", "f@.js::main@::r", "DECLARES", "f@.js::main@", None, None, "default_value=has_default"),
        ("Parameter", "unknown", "f@.js::main@::unknown", "DECLARES", "f@.js::main@", None, None, ""),
        ("Export", "export x, b", "f@.js::export", "EXPORTS", "f@.js", 5, 5, "exported_names=x,b"),
        ("Class", "K@", "f@.js::K@", "CONTAINS", "f@.js", 6, 9, "base_classes=ns.Base"),
        ("Method", "constructor", "f@.js::K@::constructor", "DEFINES", "f@.js::K@", 7, 7, "parameters=v"),
        ("Method", "make", "f@.js::K@::make", "DEFINES", "f@.js::K@", 8, 8, "is_static;is_async;parameters=u,unknown"),
        ("Function", "walk", "f@.js::walk", "CONTAINS", "f@.js", 10, 10, "is_async;is_generator;parameters=t"),
        ("Parameter", "t", "f@.js::walk::t", "DECLARES", "f@.js::walk", None, None, ""),
        ("Variable", "one", "f@.js::one", "DECLARES", "f@.js", 11, 11, "value=has_initializer"),
        ("Variable", "two", "f@.js::two", "DECLARES", "f@.js", 11, 11, ""),
        ("Export", "module.exports", "f@.js::module.exports", "EXPORTS", "f@.js", 13, 13, "is_default;exported_names=default"),
        ("Export", "module.exports", "f@.js::module.exports", "EXPORTS", "f@.js", 14, 14, "is_default;exported_names=default"),
        ("Export", "export ", "f@.js::export", "EXPORTS", "f@.js", 15, 15, ""),
        ("Variable", "last", "f@.js::last", "DECLARES", "f@.js", 15, 15, "is_constant;value=has_initializer"),
    ],
    "typescript": [
        ("File", "f@.tsx", "f@.tsx", None, None, None, None, ""),
        ("Import", "import from types", "f@.tsx::import::types", "IMPORTS", "f@.tsx", 1, 1, "module=types;imported_names=U"),
        ("Import", "import from lib", "f@.tsx::import::lib", "IMPORTS", "f@.tsx", 2, 2, "is_wildcard;module=lib;imported_names=default,*"),
        ("Class", "A@", "f@.tsx::A@", "CONTAINS", "f@.tsx", 2, 10, "is_abstract;base_classes=Base;interfaces=I1,I2"),
        ("Method", "load", "f@.tsx::A@::load", "DEFINES", "f@.tsx::A@", 6, 7, "is_static;is_async;visibility=public;return_type=Promise<void>;parameters=id,name,{ size }"),
        ("Parameter", "id", "f@.tsx::A@::load::id", "DECLARES", "f@.tsx::A@::load", None, None, "type=number"),
        ("Parameter", "name", "f@.tsx::A@::load::name", "DECLARES", "f@.tsx::A@::load", None, None, "is_optional;type=string"),
        ("Parameter", "{ size }", "f@.tsx::A@::load::{ size }", "DECLARES", "f@.tsx::A@::load", None, None, "default_value={ size: 3 }"),
        ("Method", "area", "f@.tsx::A@::area", "DEFINES", "f@.tsx::A@", 7, 8, "is_abstract;visibility=protected;return_type=number"),
        ("Interface", "S@", "f@.tsx::S@", "CONTAINS", "f@.tsx", 10, 13, "base_interfaces=P,Q"),
        ("Function", "ids", "f@.tsx::ids", "CONTAINS", "f@.tsx", 13, 14, "return_type=Generator<number>;parameters=a,rest"),
        ("Parameter", "a", "f@.tsx::ids::a", "DECLARES", "f@.tsx::ids", None, None, "type=string"),
        ("Parameter", "rest", "f@.tsx::ids::rest", "DECLARES", "f@.tsx::ids", None, None, "type=any[]"),
        ("Variable", "v", "f@.tsx::v", "DECLARES", "f@.tsx", 15, 15, "is_constant;type=number;value=5"),
        ("Variable", "w", "f@.tsx::w", "DECLARES", "f@.tsx", 15, 15, "is_constant;value='x'"),
        ("Export", "export v, u", "f@.tsx::export", "EXPORTS", "f@.tsx", 17, 17, "exported_names=v,u"),
        ("Export", "export ", "f@.tsx::export", "EXPORTS", "f@.tsx", 18, 18, ""),
        ("Export", "export default", "f@.tsx::export", "EXPORTS", "f@.tsx", 19, 19, "is_default;exported_names=default"),
    ],
    "csharp": [
        ("File", _F, _F, None, None, None, None, ""),
        ("Import", "using System", "f@.cs::using::System", "IMPORTS", _F, 1, 1, "module=System"),
        ("Import", "using System.Text", "f@.cs::using::System.Text", "IMPORTS", _F, 2, 2, "module=System.Text;alias=Text"),
        ("Interface", "IThing@", "N.M.IThing@", "CONTAINS", _F, 6, 6, "visibility=public;docstring=<summary>A thing.</summary>;base_interfaces=IBase"),
        ("Variable", "Size", "N.M.IThing@.Size", "HAS_MEMBER", "N.M.IThing@", 6, 6, "is_readonly;visibility=private;type=int;scope=instance"),
        ("Method", "Do", "N.M.IThing@.Do()", "DEFINES", "N.M.IThing@", 6, 6, "visibility=private;return_type=void"),
        ("Class", "Base@", "N.M.Base@", "CONTAINS", _F, 8, 9, "is_abstract;visibility=public"),
        ("Method", "Base@", "N.M.Base@.Base@(string)", "DEFINES", "N.M.Base@", 9, 9, "visibility=protected;return_type=void;parameters=name"),
        ("Parameter", "name", "N.M.Base@.Base@(string)::name", "DECLARES", "N.M.Base@.Base@(string)", None, None, "type=string"),
        ("Class", "C@", _C, "CONTAINS", _F, 11, 27, "is_sealed;visibility=public;base_classes=N.M.Base@;interfaces=N.M.IThing@,IOther"),
        ("Variable", "f", f"{_C}.f", "HAS_MEMBER", _C, 13, 13, "is_readonly;visibility=private;type=int;value=1;scope=instance"),
        ("Variable", "g", f"{_C}.g", "HAS_MEMBER", _C, 13, 13, "is_readonly;visibility=private;type=int;scope=instance"),
        ("Variable", "K", f"{_C}.K", "HAS_MEMBER", _C, 14, 14, 'is_constant;visibility=public;type=string;value="a;b{";scope=instance'),
        ("Variable", "Count", f"{_C}.Count", "HAS_MEMBER", _C, 15, 15, "is_static;visibility=internal;type=int;scope=static"),
        ("Variable", "Size", f"{_C}.Size", "HAS_MEMBER", _C, 16, 16, "is_readonly;visibility=public;type=int;scope=instance"),
        ("Variable", "Twice", f"{_C}.Twice", "HAS_MEMBER", _C, 17, 17, "visibility=public;type=int;scope=instance"),
        ("Method", "C@", _M, "DEFINES", _C, 19, 19, "visibility=public;return_type=void;parameters=a,b,r"),
        ("Parameter", "a", f"{_M}::a", "DECLARES", _M, None, None, "modifier=ref;type=int"),
        ("Parameter", "b", f"{_M}::b", "DECLARES", _M, None, None, "modifier=out;type=string"),
        ("Parameter", "r", f"{_M}::r", "DECLARES", _M, None, None, "is_params;type=int[]"),
        ("Method", "Run", _R, "DEFINES", _C, 22, 23, "is_override;is_async;visibility=protected;return_type=Task<int>;docstring=<summary>Runs.</summary>;parameters=s,n"),
        ("Parameter", "s", f"{_R}::s", "DECLARES", _R, None, None, 'is_optional;type=string;default_value="{"'),
        ("Parameter", "n", f"{_R}::n", "DECLARES", _R, None, None, "is_optional;type=int;default_value=2"),
        ("Method", "Do", f"{_C}.Do()", "DEFINES", _C, 24, 24, "is_virtual;visibility=public;return_type=void"),
        ("Method", "Map", f"{_C}.Map<U>(U)", "DEFINES", _C, 25, 25, "is_static;visibility=public;return_type=U;parameters=u"),
        ("Parameter", "u", f"{_C}.Map<U>(U)::u", "DECLARES", f"{_C}.Map<U>(U)", None, None, "type=U"),
        ("Class", "Inner", f"{_C}.Inner", "CONTAINS", _F, 26, 26, "visibility=private"),
        ("Variable", "h", f"{_C}.Inner.h", "HAS_MEMBER", f"{_C}.Inner", 26, 26, "visibility=private;type=int;scope=instance"),
        ("Variable", "x", "N.M.P@.x", None, None, 29, 29, "visibility=public;type=int;scope=instance"),
    ],
}
COLUMNS = ("label", "name", "full_name", "edge", "parent", "first_line", "last_line", "facts")


def values_sql(language: str) -> str:
    """The expected rows as SQL values."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(lit, row))})" for row in EXPECTED[language])
