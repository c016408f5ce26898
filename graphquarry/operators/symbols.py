"""What names stand for, over all files: a global table of symbols, looked up scope by scope.

A symbol is visible in scopes: a file, a C# namespace or enclosing type, the members of a type. A reference, that is a base, a
call or a creation, is looked for in the scopes of its place, nearest first: members of its own type (for ``self``, ``this`` and
plain C# calls), its file, the files that it imports from, the namespaces around it, the namespaces that it uses. The nearest scope that has the
name decides; of several symbols there, such as overloads, the one with the least id. A receiver whose type only a compiler would know is not resolved.

All lookups are joins by (scope, name) with a table that has one row for each, so no name is joined with all its
namesakes; keys that many references share are looked up by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.extract import placed_nodes
from graphquarry.plans.storage import discard, materialise
from graphquarry.schema import EDGE, packed, unpacked
from graphquarry.sources.store import merge_edges

#: Share of the references from which a key is looked up by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.002
#: What marks an edge that was derived, and is derived anew with every change.
DERIVED = {"derived": "true"}
_SUFFIXES = (".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs")
_OWN = ("self", "this", "cls")
MEMBER, FILE, IMPORTED, AROUND, USED = 1, 2, 3, 4, 5


def _plain(full_name: Column) -> Column:
    """A full name without type arguments, however deep."""
    once = lambda c: F.regexp_replace(c, "<[^<>]*>", "")
    return once(once(once(once(full_name))))


def _before(name: Column, sep: str = ".") -> Column:
    """What stands before the last dot; empty if there is none."""
    return F.when(F.instr(name, sep) > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def _last(name: Column) -> Column:
    return F.regexp_extract(name, r"[^.]*$", 0)


def _in_csharp(path: Column) -> Column:
    return F.lower(path).endswith(".cs")


#: Types of the edges that are derived.
_TYPES = ("EXTENDS", "IMPLEMENTS", "CALLS", "INSTANTIATES")


#: What lookups read of nodes.
_READ = ("id", "label", "name", "full_name", "path", "properties", "base_classes", "interfaces", "base_interfaces", "module", "alias", "imported_names", "is_wildcard")
_CODE = ("Class", "Interface", "Function", "Method")


def placed(extracted: DataFrame) -> DataFrame:
    """The nodes of closed files with their owner, owner_name and owner_full, as ``owners`` has them, by places instead of joins."""
    rows = placed_nodes(extracted, {"id": "owner", "label": "owner_label", "name": "owner_name", "full_name": "owner_full"}, *_READ)
    held = (F.col("edge") == "DEFINES") & F.col("owner_label").isin("Class", "Interface")
    return rows.select(*_READ, F.when(held, packed("owner")).alias("owner"), *[F.when(held, F.col(c)).alias(c) for c in ("owner_name", "owner_full")])


def owners(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, owner, owner_name, owner_full), ids packed, of those of the ``wanted`` (id, packed) that are methods whose type is known."""
    types = nodes.filter(F.col("label").isin("Class", "Interface")).select(packed("id").alias("owner"), F.col("name").alias("owner_name"), F.col("full_name").alias("owner_full"))
    held = edges.filter("type = 'DEFINES'").select(packed("src").alias("owner"), packed("dst").alias("id")).join(wanted, "id", "left_semi")
    return held.dropDuplicates(["id"]).join(types, "owner")


def _spot(scope: Column, name: Column) -> Column:
    """A scope and a name in it, as a digest of 16 bytes."""
    return F.unhex(F.md5(F.encode(F.concat(scope, F.lit("\n"), name), "UTF-8")))


def named(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, packed, label, name, full_name, path) of the symbols whose last name is among ``asked`` (key)."""
    found = nodes.filter(F.col("label").isin(*_CODE)).select(packed("id").alias("id"), "label", "name", "full_name", "path", _last(F.col("name")).alias("key"))
    return found.join(asked, "key", "left_semi").drop("key")


def entries(found: DataFrame) -> DataFrame:
    """(id, label, key, spots): of symbols with their owners, where each is visible by which names, as digests; the key is its last name."""
    found = found.filter("label <> 'Method' or owner is not null")
    space = _before(_plain(F.coalesce("owner_full", "full_name")))
    name = F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner_name", "name")).otherwise(F.col("name"))
    entry = lambda scope, name: F.struct(scope.alias("scope"), name.alias("name"))
    each = F.array(
        entry(F.concat(F.lit("file:"), "path"), name),
        F.when(F.col("owner").isNotNull(), entry(F.concat(F.lit("type:"), F.hex("owner")), F.col("name"))),
        F.when(_in_csharp(F.col("path")), entry(F.concat(F.lit("space:"), space), name)),
    )
    return found.select("id", "label", _last(F.col("name")).alias("key"), F.transform(F.array_compact(each), lambda e: _spot(e["scope"], e["name"])).alias("spots"))


def symbol_table(visible: DataFrame) -> DataFrame:
    """(spot) of a scope and a name with the least id of a function or method, of a class and of an interface that is visible there by that name, of such ``entries``."""
    rows = visible.select("id", "label", F.explode("spots").alias("spot"))
    of = lambda *labels: F.min(F.when(F.col("label").isin(*labels), F.col("id")))
    return rows.filter("spot is not null").groupBy("spot").agg(of("Function", "Method").alias("code"), of("Class").alias("class"), of("Interface").alias("interface"))


#: What references have of the type that owns their source, and whether they had it by places.
_OWNED = ("owner", "owner_full", "placed")


def references(nodes: DataFrame) -> DataFrame:
    """Bases of types, and the calls and creations of functions and methods: (of, nth, src, path, label, full_name, kind, name) and what else ``nodes`` have of _OWNED.

    Those of one source have its number (of) and their own from 0 (nth).
    """
    base = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit("base").alias("kind"), _plain(x).alias("name")))
    said = lambda key, kind: F.transform(F.split(F.coalesce(F.col("properties")[key], F.lit("")), ","), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    bases = F.concat(base("base_classes"), base("interfaces"), base("base_interfaces"))
    uses = F.concat(said("calls", "call"), said("creates", "new"))
    every = F.when(F.col("label").isin("Class", "Interface"), bases).when(F.col("label").isin("Function", "Method"), uses)
    known = F.filter(F.array_distinct(every), lambda r: (r["name"] != "") & ~r["name"].startswith("?"))
    own = ["of", "src", "path", "label", "full_name", *[c for c in _OWNED if c in nodes.columns]]
    rows = nodes.filter(F.col("label").isin(*_CODE)).withColumn("of", F.monotonically_increasing_id()).withColumnRenamed("id", "src")
    return rows.select(*own, F.posexplode(known).alias("nth", "r")).select(*own, "nth", "r.*")


def _normal(path: Column) -> Column:
    """A path without . and .. parts."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    joined = F.aggregate(steps, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x)))
    return F.array_join(joined, "/")


def imported_files(nodes: DataFrame) -> DataFrame:
    """(path, listed, star, alias, target): the files that imports lead to, nearest first, by the names that they list; C# has none.

    Relative modules are looked for from the folder of the file; absolute ones of Python from that folder and each above
    it, the nearest that has them. ``alias`` is the name by which the module itself is known.
    """
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rows = nodes.filter((F.col("label") == "Import") & ~_in_csharp(F.col("path"))).select("path", folder.alias("folder"), "module", "alias", F.coalesce("imported_names", F.array().cast("array<string>")).alias("names"), F.coalesce("is_wildcard", F.lit(False)).alias("star"), "name")
    python = F.lower(F.col("path")).endswith(".py")
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    tail = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
    up = lambda n: F.array_join(F.array_repeat(F.lit(".."), n), "/")
    depth = F.size(F.filter(F.split("folder", "/"), lambda x: x != ""))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.concat_ws("/", "folder", up(n), tail))
    relative = F.array(F.concat_ws("/", "folder", up(dots - 1), tail))
    from_ = F.col("name").startswith("from ")
    places = F.when(python, F.when(dots > 0, relative).otherwise(above)).when(F.col("module").startswith("."), F.array(F.concat_ws("/", "folder", "module")))
    rows = rows.withColumn("places", F.transform(places, _normal)).filter("places is not null")
    # the module's own file, and modules among the names of a Python import
    own = F.transform("places", lambda p, n: F.struct(n.alias("far"), p.alias("at"), F.lit(None).cast("string").alias("module_name")))
    inner = F.when(python & from_, F.flatten(F.transform("places", lambda p, n: F.transform(F.filter("names", lambda x: x != "*"), lambda x: F.struct(n.alias("far"), F.concat_ws("/", p, x).alias("at"), x.alias("module_name")))))).otherwise(F.array().cast("array<struct<far: int, at: string, module_name: string>>"))
    rows = rows.withColumn("p", F.explode(F.concat(own, inner))).select("path", "module", "alias", "names", "star", from_.alias("from_"), python.alias("python"), "p.*")
    files_py = F.array(F.concat("at", F.lit(".py")), F.concat("at", F.lit("/__init__.py")))
    files_js = F.array(F.col("at"), *[F.concat("at", F.lit(s)) for s in _SUFFIXES], *[F.concat("at", F.lit(f"/index{s}")) for s in _SUFFIXES])
    rows = rows.withColumn("t", F.explode(F.transform(F.when(F.col("python"), files_py).otherwise(files_js), lambda x, n: F.struct(n.alias("kind"), x.alias("target"))))).select("*", "t.*").drop("t")
    files = nodes.filter("label = 'File'").select(F.col("path").alias("target")).distinct()
    best = Window.partitionBy("path", "module", "alias", "module_name").orderBy("far", "kind")
    met = rows.join(files, "target").withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    known = F.when(F.col("module_name").isNotNull(), F.col("module_name")).when(F.col("python") & ~F.col("from_"), F.coalesce("alias", "module"))
    listed = F.when(F.col("module_name").isNull() & (F.col("from_") | ~F.col("python")), F.filter("names", lambda x: ~x.isin("*", "default"))).otherwise(F.array().cast("array<string>"))
    # without their local names, default and whole imports of JavaScript may stand for any name
    star = F.col("module_name").isNull() & (F.col("star") | (~F.col("python") & F.array_contains("names", "default")))
    return met.select("path", listed.alias("listed"), star.alias("star"), known.alias("alias"), "target").distinct()


def candidates(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(of, nth, label, kind, rank, near, spot): where each reference, with its owner, may be found, and by which name."""
    cs = _in_csharp(F.col("path"))
    before, last = _before(F.col("name")), _last(F.col("name"))
    own = F.col("owner").isNotNull() & (F.col("kind") == "call") & (before.isin(*_OWN) | (cs & (before == "")))
    # a method is asked for by its type's simple name and its own, everything else by its last name
    short = F.when(F.col("kind").isin("base", "new") | (before == ""), last).otherwise(F.concat_ws(".", _last(before), last))
    spot = lambda rank, near, scope, key: F.struct(F.lit(rank).alias("rank"), near.alias("near"), scope.alias("scope"), key.alias("key"))
    zero = F.lit(0)
    # enclosing types and namespaces, the innermost first; written namespaces go before the name's last part
    home = F.when(F.col("label").isin("Class", "Interface"), _plain(F.col("full_name"))).otherwise(_plain(F.coalesce("owner_full", F.lit(""))))
    parts = F.split(home, r"\.")
    around = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, F.size(parts) - n), "."))
    written = F.when(F.col("kind").isin("base", "new") | (before == ""), before).otherwise(_before(before))
    spaced = lambda outer: F.concat(F.lit("space:"), F.concat_ws(".", F.nullif(outer, F.lit("")), F.nullif(written, F.lit(""))))
    none = F.array().cast("array<struct<rank: int, near: int, scope: string, key: string>>")
    spots = F.concat(
        F.when(own, F.array(spot(MEMBER, zero, F.concat(F.lit("type:"), F.hex("owner")), last))).otherwise(none),
        F.when(~before.isin(*_OWN), F.array(spot(FILE, zero, F.concat(F.lit("file:"), "path"), short))).otherwise(none),
        F.when(cs & ~before.isin(*_OWN), F.transform(around, lambda outer, n: spot(AROUND, n, spaced(outer), short))).otherwise(none),
    )
    own_columns = ["of", "nth", "label", "kind"]
    direct = refs.select(*own_columns, F.explode(spots).alias("s")).select(*own_columns, "s.*")

    used = nodes.filter((F.col("label") == "Import") & _in_csharp(F.col("path")) & F.col("alias").isNull()).select("path", F.col("module").alias("_outer")).distinct()
    by_using = refs.filter(cs & ~before.isin(*_OWN)).join(used, "path").select(*own_columns, F.lit(USED).alias("rank"), zero.alias("near"), spaced(F.col("_outer")).alias("scope"), short.alias("key"))

    found = materialise(imported_files(nodes), "imported_files")
    first = F.regexp_extract("name", r"^[^.]*", 0)
    asked = refs.filter(~cs & ~before.isin(*_OWN)).select("path", *own_columns, first.alias("_first"), short.alias("key"), before.alias("_before"), last.alias("_last"))
    shape = lambda df, near, key: df.select(*own_columns, F.lit(IMPORTED).alias("rank"), F.lit(near).alias("near"), F.concat(F.lit("file:"), "target").alias("scope"), F.col(key).alias("key"))
    listed = asked.join(found.select("path", F.explode("listed").alias("_first"), "target"), ["path", "_first"])
    module = asked.join(found.filter("alias is not null").select("path", F.col("alias").alias("_before"), "target"), ["path", "_before"])
    anything = asked.join(found.filter("star").select("path", "target"), "path")
    out = direct.unionByName(by_using).unionByName(shape(listed, 0, "key")).unionByName(shape(module, 1, "_last"))
    # of what is imported whole, a name behind a qualifier may be a member of the module
    out = out.unionByName(shape(anything, 2, "key")).unionByName(shape(anything.filter("_before <> ''"), 3, "_last"))
    return out.select(*own_columns, "rank", "near", _spot(F.col("scope"), F.col("key")).alias("spot"))


def _looked_up(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (.., spot) with the table's row, if there is one."""
    known = materialise(asked.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).join(table.select("spot").hint("merge"), "spot", "left_semi"), "symbol_uses")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(known.filter(F.col("n") > total * HOT_SHARE).select("spot"))
    often = asked.join(F.broadcast(table.join(hot, "spot", "left_semi")), "spot")
    return often.unionByName(asked.join(hot, "spot", "left_anti").join(table.hint("merge"), "spot").select(*often.columns))


def derived_edges(nodes: DataFrame, edges: DataFrame, by_place: DataFrame | None = None) -> DataFrame:
    """EXTENDS, IMPLEMENTS, CALLS and INSTANTIATES edges (src, dst, type, properties) of all references that can be resolved.

    Of the symbols only those take part whose last name some reference has. References go by numbers, scopes with names by digests.
    ``by_place`` are nodes of more files, which have their owners already (``placed``); ``nodes`` and ``edges`` are then those of the others.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("owner", "binary"), ("owner_name", "string"), ("owner_full", "string"))]
    every, others = nodes.select(*_READ, *none, F.lit(False).alias("placed")), True
    if by_place is not None:
        others = nodes.limit(1).count() > 0
        more = by_place.withColumn("placed", F.lit(True))
        every = every.unionByName(more) if others else more
    refs = materialise(references(every), "references")
    keys = materialise(refs.select(_last(F.col("name")).alias("key")).distinct(), "asked_names")
    if not keys.limit(1).count():
        discard(refs, keys)
        return edges.sparkSession.createDataFrame([], EDGE)
    # not a semi join, which would be done before digests are made of the names
    visible = None if by_place is None else entries(by_place.filter(F.col("label").isin(*_CODE)).withColumn("id", packed("id"))).join(keys, "key").drop("key")
    told, found, held = refs, None, None
    if others:
        found = materialise(named(nodes, keys), "named")
        if by_place is None and not found.limit(1).count():
            discard(refs, keys, found)
            return edges.sparkSession.createDataFrame([], EDGE)
        own = refs.filter("not placed").drop("owner", "owner_full")
        wanted = found.select("id").unionByName(own.select(packed("src").alias("id"))).distinct()
        held = materialise(owners(nodes, edges, wanted), "owners")
        rest = entries(found.join(held, "id", "left")).drop("key")
        visible = rest if visible is None else visible.unionByName(rest)
        by_source = own.withColumn("_id", packed("src")).join(held.select(F.col("id").alias("_id"), "owner", "owner_full"), "_id", "left").select(*refs.columns)
        told = by_source if by_place is None else refs.filter("placed").unionByName(by_source)
    table = materialise(symbol_table(visible), "symbols")
    if not table.limit(1).count():
        discard(refs, keys, found, held, table)
        return edges.sparkSession.createDataFrame([], EDGE)
    asked = materialise(candidates(told, every), "candidates")
    met = _looked_up(asked, table)
    target = F.when(F.col("kind") == "new", F.col("class")).when(F.col("kind") == "call", F.coalesce("code", "class")).when(F.col("label") == "Class", F.coalesce("class", "interface")).otherwise(F.col("interface"))
    kind = F.when(F.col("kind") == "new", "INSTANTIATES").when(F.col("kind") == "call", F.when(F.col("code").isNotNull(), "CALLS").otherwise("INSTANTIATES"))
    kind = F.coalesce(kind, F.when((F.col("label") == "Class") & F.col("class").isNull(), "IMPLEMENTS").otherwise("EXTENDS"))
    # by sources, whose references' edges are told apart where they have met
    sources = refs.filter("nth = 0").select("of", packed("src").alias("src"))
    rows = met.select("of", "nth", "rank", "near", target.alias("dst"), kind.alias("type")).filter("dst is not null").join(sources, "of")
    nearest = rows.filter("dst <> src or type = 'CALLS'").groupBy("of", "nth", "src").agg(F.min(F.struct("rank", "near", "dst", "type")).alias("b"))
    made = nearest.select("of", "src", "b.dst", "b.type").distinct()
    return made.select(unpacked("src").alias("src"), unpacked("dst").alias("dst"), "type", F.create_map(*[F.lit(x) for kv in DERIVED.items() for x in kv]).alias("properties"))


def with_derived(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """Edges that each are there once, merged with derived ones; those of other types stay where they are."""
    same = F.coalesce(F.col("type").isin(*_TYPES), F.lit(False))
    slim = lambda df: df.select(packed("src").alias("src"), packed("dst").alias("dst"), "type", "properties")
    fresh = materialise(slim(derived), "derived")
    held = slim(edges.filter(same))
    both = materialise(merge_edges(held, fresh), "edges_derived") if held.limit(1).count() else fresh
    return edges.filter(~same).select("src", "dst", "type", "properties").unionByName(both.select(unpacked("src").alias("src"), unpacked("dst").alias("dst"), "type", "properties"))


def without_derived(edges: DataFrame) -> DataFrame:
    """The edges that were not derived."""
    key, value = next(iter(DERIVED.items()))
    return edges.filter(~F.coalesce(F.col("properties")[key] == value, F.lit(False)))
