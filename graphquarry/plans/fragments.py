"""Pieces of source text that scanners stumble over, with what must be found in them; a file is made of two of them.

``¤`` stands for a number that differs by file, ``%`` for the file's path. The rows were derived by hand from the rules of
extraction: label, name, full name, edge from the parent, the parent's full name, and facts as ``samples.facts`` gives them.
"""

from __future__ import annotations

#: By language: suffix, module system, and pieces with their rows.
FRAGMENTS: dict[str, tuple[str, str, list[tuple[str, list[tuple]]]]] = {
    "javascript": ("js", "esm", [
        ("const a¤ = `x ${`it's ${1 + {b: '}'}.b}`}\n more`; function after¤() {} class B¤ {}", [
            ("Variable", "a¤", "%::a¤", "DECLARES", "%", "is_constant;value=has_initializer"),
            ("Function", "after¤", "%::after¤", "CONTAINS", "%", ""),
            ("Class", "B¤", "%::B¤", "CONTAINS", "%", ""),
        ]),
        ("let s¤ = t.replace(/'/g, `a\n${b}`).split(/[/\"`]/)\nfunction quoted¤(x) { return x / 2 / 3 }", [
            ("Variable", "s¤", "%::s¤", "DECLARES", "%", "value=has_initializer"),
            ("Function", "quoted¤", "%::quoted¤", "CONTAINS", "%", "parameters=x"),
            ("Parameter", "x", "%::quoted¤::x", "DECLARES", "%::quoted¤", ""),
        ]),
        ("if (x) /}'/.test(y); var re¤ = a ? /{/ : b\nclass R¤ { m() { return /[}]/ } }", [
            ("Variable", "re¤", "%::re¤", "DECLARES", "%", "value=has_initializer"),
            ("Class", "R¤", "%::R¤", "CONTAINS", "%", ""),
            ("Method", "m", "%::R¤::m", "DEFINES", "%::R¤", ""),
        ]),
        ("class P¤ extends mix(A, B) { #p = 1; f = () => { function inner¤() {} }; get v() { return 1 } 'q r'() {} [Symbol.iterator]() {} static async *#gen(a, b = 1) {} static { } }", [
            ("Class", "P¤", "%::P¤", "CONTAINS", "%", "base_classes=unknown"),
            ("Method", "v", "%::P¤::v", "DEFINES", "%::P¤", ""),
            ("Method", "gen", "%::P¤::gen", "DEFINES", "%::P¤", "is_static;is_async;parameters=a,unknown"),
            ("Function", "inner¤", "%::inner¤", "CONTAINS", "%", ""),
        ]),
        ("const f¤ = function named() { var deep¤ }; x = { function() {}, class: 1, m() { class In¤ extends a.b.C {} } };", [
            ("Variable", "f¤", "%::f¤", "DECLARES", "%", "is_constant;value=has_initializer"),
            ("Variable", "deep¤", "%::deep¤", "DECLARES", "%", ""),
            ("Class", "In¤", "%::In¤", "CONTAINS", "%", "base_classes=a.b.C"),
        ]),
        ("outer: for (let i¤ = 0, n¤ = 2; i < n; i++) { continue outer }\nfor (const k¤ of ks) {}\nswitch (x) { case 1: function sw¤() {} default: class Dw¤ {} }", [
            ("Variable", "i¤", "%::i¤", "DECLARES", "%", "value=has_initializer"),
            ("Variable", "n¤", "%::n¤", "DECLARES", "%", "value=has_initializer"),
            ("Variable", "k¤", "%::k¤", "DECLARES", "%", "is_constant"),
            ("Function", "sw¤", "%::sw¤", "CONTAINS", "%", ""),
            ("Class", "Dw¤", "%::Dw¤", "CONTAINS", "%", ""),
        ]),
        ("var { a, b: [c] = [] } = o, d¤ = a ? b : function t() {}\nlet e¤\n/* function no() {} */ // class No {}", [
            ("Variable", "d¤", "%::d¤", "DECLARES", "%", "value=has_initializer"),
            ("Variable", "e¤", "%::e¤", "DECLARES", "%", ""),
        ]),
        ("import d¤, * as ns from \"n¤\"\nimport './side¤'\nimport { a as b, default as c } from 'm¤'; import('dyn'); import.meta.url", [
            ("Import", "import from n¤", "%::import::n¤", "IMPORTS", "%", "is_wildcard;module=n¤;imported_names=default,*"),
            ("Import", "import from ./side¤", "%::import::./side¤", "IMPORTS", "%", "module=./side¤"),
            ("Import", "import from m¤", "%::import::m¤", "IMPORTS", "%", "module=m¤;imported_names=a,default"),
        ]),
        ("export default class extends A {}\nexport { p¤ as default, q }\nexport async function* x¤({ a }, [b], ...c) {}", [
            ("Export", "export default", "%::export", "EXPORTS", "%", "is_default;exported_names=default"),
            ("Export", "export default, q", "%::export", "EXPORTS", "%", "exported_names=default,q"),
            ("Export", "export ", "%::export", "EXPORTS", "%", ""),
            ("Function", "x¤", "%::x¤", "CONTAINS", "%", "is_async;is_generator;parameters=unknown,unknown,unknown"),
            ("Parameter", "unknown", "%::x¤::unknown", "DECLARES", "%::x¤", ""),
            ("Parameter", "unknown", "%::x¤::unknown", "DECLARES", "%::x¤", ""),
            ("Parameter", "unknown", "%::x¤::unknown", "DECLARES", "%::x¤", ""),
        ]),
        ("const el¤ = <p class=\"a\">it's {x} 'here</p>;\nfunction behind¤(a = {b: 1}, c) {}", [
            ("Variable", "el¤", "%::el¤", "DECLARES", "%", "is_constant;value=has_initializer"),
            ("Function", "behind¤", "%::behind¤", "CONTAINS", "%", "parameters=a,c"),
            ("Parameter", "a", "%::behind¤::a", "DECLARES", "%::behind¤", "default_value=has_default"),
            ("Parameter", "c", "%::behind¤::c", "DECLARES", "%::behind¤", ""),
        ]),
    ]),
    "typescript": ("ts", "esm", [
        ("@Dec({a: 1}) export class A¤<T extends Record<string, { a: number }>> extends Base<Map<string, number>> implements I<T>, ns.J {\n  private readonly m = new Map<string, Array<number>>();\n  foo<U>(a: U, cb: (x: number, y: string) => void = () => {}): Promise<Map<string, U>> { }\n}", [
            ("Class", "A¤", "%::A¤", "CONTAINS", "%", "base_classes=Base;interfaces=I,ns.J"),
            ("Method", "foo", "%::A¤::foo", "DEFINES", "%::A¤", "return_type=Promise<Map<string, U>>;parameters=a,cb"),
            ("Parameter", "a", "%::A¤::foo::a", "DECLARES", "%::A¤::foo", "type=U"),
            ("Parameter", "cb", "%::A¤::foo::cb", "DECLARES", "%::A¤::foo", "type=(x: number, y: string) => void;default_value=() => {}"),
        ]),
        ("abstract class B¤ { bar(): { a: number } | undefined\n  bar(x?: number): { a: number } | undefined { return }\n  [key: string]: any; handler = async (e: Event): Promise<void> => { let t¤ = 1 }\n  abstract q(this: A, ...rest: string[]): asserts x is string; set w(v: number) {} }", [
            ("Class", "B¤", "%::B¤", "CONTAINS", "%", "is_abstract"),
            ("Method", "bar", "%::B¤::bar", "DEFINES", "%::B¤", "return_type={ a: number } | undefined"),
            ("Method", "bar", "%::B¤::bar", "DEFINES", "%::B¤", "return_type={ a: number } | undefined;parameters=x"),
            ("Parameter", "x", "%::B¤::bar::x", "DECLARES", "%::B¤::bar", "is_optional;type=number"),
            ("Method", "q", "%::B¤::q", "DEFINES", "%::B¤", "is_abstract;return_type=asserts x is string;parameters=this,rest"),
            ("Parameter", "this", "%::B¤::q::this", "DECLARES", "%::B¤::q", "type=A"),
            ("Parameter", "rest", "%::B¤::q::rest", "DECLARES", "%::B¤::q", "type=string[]"),
            ("Variable", "t¤", "%::t¤", "DECLARES", "%", "value=1"),
        ]),
        ("declare function over¤(a: string): string;\nexport function over¤(a: any): any { return a as unknown as X }", [
            ("Function", "over¤", "%::over¤", "CONTAINS", "%", "return_type=string;parameters=a"),
            ("Parameter", "a", "%::over¤::a", "DECLARES", "%::over¤", "type=string"),
            ("Function", "over¤", "%::over¤", "CONTAINS", "%", "return_type=any;parameters=a"),
            ("Parameter", "a", "%::over¤::a", "DECLARES", "%::over¤", "type=any"),
        ]),
        ("namespace N¤ { export const c¤: () => void = () => {}, e¤ = <T,>(x: T) => x; export interface P¤ extends A, B<C> { m(): void; function: number } }", [
            ("Variable", "c¤", "%::c¤", "DECLARES", "%", "is_constant;type=() => void;value=() => {}"),
            ("Variable", "e¤", "%::e¤", "DECLARES", "%", "is_constant;value=<T,>(x: T) => x"),
            ("Interface", "P¤", "%::P¤", "CONTAINS", "%", "base_interfaces=A,B"),
        ]),
        ("type X¤ = { a: number; function: string } | `t${string}`\nenum E¤ { A, B }\nconst enum F¤ { A }\nlet v¤ = a < b, w¤ = c > d", [
            ("Variable", "v¤", "%::v¤", "DECLARES", "%", "value=a < b"),
            ("Variable", "w¤", "%::w¤", "DECLARES", "%", "value=c > d"),
        ]),
        ("import x¤ = require('y'); import type D¤, { type E1, F as G } from './d¤'\nexport type { T1, T2 as T3 } from 'z'; export * as all from 'q'\nexport = x¤", [
            ("Import", "import from ./d¤", "%::import::./d¤", "IMPORTS", "%", "module=./d¤;imported_names=default,E1,G"),
            ("Export", "export T1, T3", "%::export", "EXPORTS", "%", "exported_names=T1,T3"),
            ("Export", "export ", "%::export", "EXPORTS", "%", ""),
            ("Export", "export default", "%::export", "EXPORTS", "%", "is_default;exported_names=default"),
        ]),
        ("for (const k in ks) { const inside¤: Map<string, number[]> = new Map() }\nexport default async () => { class Late¤ {} }", [
            ("Variable", "inside¤", "%::inside¤", "DECLARES", "%", "is_constant;type=Map<string, number[]>;value=new Map()"),
            ("Export", "export default", "%::export", "EXPORTS", "%", "is_default;exported_names=default"),
            ("Class", "Late¤", "%::Late¤", "CONTAINS", "%", ""),
        ]),
        ("const t¤ = `a ${f({ b: `}` })} c`, u¤: typeof t¤ extends string ? 1 : 2 = 1;\nexport abstract class Z¤ { constructor(private a: X, @Inject(T) b?: Y) { } static get z(): number { return /}/.exec('') as any } }", [
            ("Variable", "t¤", "%::t¤", "DECLARES", "%", "is_constant;value=`a ${f({ b: `}` })} c`"),
            ("Variable", "u¤", "%::u¤", "DECLARES", "%", "is_constant;type=typeof t¤ extends string ? 1 : 2;value=1"),
            ("Class", "Z¤", "%::Z¤", "CONTAINS", "%", "is_abstract"),
        ]),
    ]),
    "csharp": ("cs", "esm", [
        ("namespace N1 { public record R¤(int X); public class C¤ { void M() {} } }", [
            ("Class", "C¤", "N1.C¤", "CONTAINS", "%", "visibility=public"),
            ("Method", "M", "N1.C¤.M()", "DEFINES", "N1.C¤", "visibility=private;return_type=void"),
        ]),
        ("namespace N2 { public delegate void D¤(int x); struct S¤ : I1 { public int y; public S¤(int q) { y = q; } } sealed class E¤ { } }", [
            ("Variable", "y", "N2.S¤.y", None, None, "visibility=public;type=int;scope=instance"),
            ("Method", "S¤", "N2.S¤.S¤(int)", None, None, "visibility=public;return_type=void;parameters=q"),
            ("Parameter", "q", "N2.S¤.S¤(int)::q", "DECLARES", "N2.S¤.S¤(int)", "type=int"),
            ("Class", "E¤", "N2.E¤", "CONTAINS", "%", "is_sealed;visibility=private"),
        ]),
        ("namespace N3 { class T¤ { string a = $\"{(x ? \"}\" : \"{\")} \\\" {{\"; string b = @\"a\"\"b { \"; const string Raw = \"\"\"\n  class Fake { }\n  \"\"\"; char c = '\"'; string d = $@\"q{1}\"\"\"; } }", [
            ("Class", "T¤", "N3.T¤", "CONTAINS", "%", "visibility=private"),
            ("Variable", "a", "N3.T¤.a", "HAS_MEMBER", "N3.T¤", "visibility=private;type=string;value=$\"{(x ? \"}\" : \"{\")} \\\" {{\";scope=instance"),
            ("Variable", "b", "N3.T¤.b", "HAS_MEMBER", "N3.T¤", "visibility=private;type=string;value=@\"a\"\"b { \";scope=instance"),
            ("Variable", "Raw", "N3.T¤.Raw", "HAS_MEMBER", "N3.T¤", "is_constant;visibility=private;type=string;value=\"\"\"\n  class Fake { }\n  \"\"\";scope=instance"),
            ("Variable", "c", "N3.T¤.c", "HAS_MEMBER", "N3.T¤", "visibility=private;type=char;value='\"';scope=instance"),
            ("Variable", "d", "N3.T¤.d", "HAS_MEMBER", "N3.T¤", "visibility=private;type=string;value=$@\"q{1}\"\"\";scope=instance"),
        ]),
        ("namespace N4 {\n#if DEBUG\nclass Nope¤ {\n#elif !RELEASE && (true || X)\nclass Yes¤ {\n#else\nclass No¤ {{\n#endif\n} }", [
            ("Class", "Yes¤", "N4.Yes¤", "CONTAINS", "%", "visibility=private"),
        ]),
        ("namespace N5.Deep { internal partial class G¤<TKey, TValue>(int p) : Dictionary<TKey, List<TValue>>(p), IComparable<G¤<TKey, TValue>> where TKey : notnull, new() { private readonly Dictionary<string, List<int>> map = new Dictionary<string, List<int>>(), other = new(); } }", [
            ("Class", "G¤", "N5.Deep.G¤<TKey, TValue>", "CONTAINS", "%", "visibility=internal;base_classes=Dictionary<TKey, List<TValue>>;interfaces=IComparable<G¤<TKey, TValue>>"),
            ("Variable", "map", "N5.Deep.G¤<TKey, TValue>.map", "HAS_MEMBER", "N5.Deep.G¤<TKey, TValue>", "is_readonly;visibility=private;type=Dictionary<string, List<int>>;value=new Dictionary<string, List<int>>();scope=instance"),
            ("Variable", "other", "N5.Deep.G¤<TKey, TValue>.other", "HAS_MEMBER", "N5.Deep.G¤<TKey, TValue>", "is_readonly;visibility=private;type=Dictionary<string, List<int>>;value=new();scope=instance"),
        ]),
        ("namespace N6 { class O¤ { public int this[int i] { get => i; set { } } public static O¤ operator +(O¤ a, O¤ b) => a; public static implicit operator int(O¤ a) => 1; event Action E { add { } remove { } } ~O¤() { } static O¤() { } int IFoo.Bar(int x, params object[] rest) => x; } }", [
            ("Class", "O¤", "N6.O¤", "CONTAINS", "%", "visibility=private"),
            ("Method", "O¤", "N6.O¤.O¤()", "DEFINES", "N6.O¤", "is_static;visibility=private;return_type=void"),
            ("Method", "Bar", "N6.O¤.IFoo.Bar(int, params object[])", "DEFINES", "N6.O¤", "visibility=private;return_type=int;parameters=x,rest"),
            ("Parameter", "x", "N6.O¤.IFoo.Bar(int, params object[])::x", "DECLARES", "N6.O¤.IFoo.Bar(int, params object[])", "type=int"),
            ("Parameter", "rest", "N6.O¤.IFoo.Bar(int, params object[])::rest", "DECLARES", "N6.O¤.IFoo.Bar(int, params object[])", "is_params;type=object[]"),
        ]),
        ("namespace N7 { /** <summary>Doc\n * two</summary> */\n[Attr(\"x]\")] [Other] class D¤ { public required string Name { get; init; } = \"n\"; public int Only { get { return set; } } (int a, string b) tup = (1, \"x\"); int[,] grid; } }", [
            ("Class", "D¤", "N7.D¤", "CONTAINS", "%", "visibility=private;docstring=<summary>Doc\ntwo</summary>"),
            ("Variable", "Name", "N7.D¤.Name", "HAS_MEMBER", "N7.D¤", "visibility=public;type=string;scope=instance"),
            ("Variable", "Only", "N7.D¤.Only", "HAS_MEMBER", "N7.D¤", "is_readonly;visibility=public;type=int;scope=instance"),
            ("Variable", "tup", "N7.D¤.tup", "HAS_MEMBER", "N7.D¤", "visibility=private;type=(int a, string b);value=(1, \"x\");scope=instance"),
            ("Variable", "grid", "N7.D¤.grid", "HAS_MEMBER", "N7.D¤", "visibility=private;type=int[,];scope=instance"),
        ]),
        ("namespace N8 { class M¤ { public async Task<Dictionary<string, int>> Run<T, U>(in int k = 3) where T : class, new() { var x = new Foo<int>(1); void Local(int y) { } return new() { }; } enum Color { Red } interface INested { int P { get; } } } }", [
            ("Class", "M¤", "N8.M¤", "CONTAINS", "%", "visibility=private"),
            ("Method", "Run", "N8.M¤.Run<T, U>(in int)", "DEFINES", "N8.M¤", "is_async;visibility=public;return_type=Task<Dictionary<string, int>>;parameters=k"),
            ("Parameter", "k", "N8.M¤.Run<T, U>(in int)::k", "DECLARES", "N8.M¤.Run<T, U>(in int)", "is_optional;modifier=in;type=int;default_value=3"),
            ("Interface", "INested", "N8.M¤.INested", "CONTAINS", "%", "visibility=private"),
            ("Variable", "P", "N8.M¤.INested.P", "HAS_MEMBER", "N8.M¤.INested", "is_readonly;visibility=private;type=int;scope=instance"),
        ]),
    ]),
}
COLUMNS = ("piece", "label", "name", "full_name", "edge", "parent", "facts")


def rows(language: str) -> list[tuple]:
    """The pieces' rows, each behind the number of its piece."""
    return [(k, *row) for k, (_, found) in enumerate(FRAGMENTS[language][2]) for row in found]


def values_sql(language: str) -> str:
    """The expected rows as SQL values."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(lit, row))})" for row in rows(language))
