"""Natural-language queries to search intents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide how a query is classified.
PROGRAMMING_TERMS = (
    "class", "method", "function", "variable", "interface", "enum", "constructor", "property", "field", "parameter",
    "return", "public", "private", "protected", "static", "async", "await", "import", "export", "extends",
    "implements", "inherit", "override", "abstract", "virtual", "final", "const", "let", "var", "api", "service",
    "controller", "model", "dto", "entity", "repository", "database", "query", "connection", "client", "http",
    "request", "response", "json", "xml", "rest", "authenticate", "authorize", "login", "logout", "session", "cache",
    "redis", "memory", "storage", "file", "directory", "test", "mock", "stub", "unit", "integration", "e2e",
    "exception", "error", "try", "catch", "throw", "handle", "log", "logger", "debug", "info", "warn",
)
ENTITY_PATTERNS = (
    r"\b[A-Z][a-zA-Z]*(?:Service|Controller|Repository|Manager|Handler|Factory|Builder|Helper|Util|Utils)\b",
    r"\b[A-Z][a-zA-Z]*(?:Entity|Model|DTO|Request|Response|Config|Configuration)\b",
    r"\b[A-Z][a-zA-Z]*(?:Exception|Error)\b",
    r"\b[a-z][a-zA-Z]*(?:Api|HTTP|Rest|GraphQL)\b",
    r"\b[A-Z][a-zA-Z0-9_]*\b",
)
NODE_TYPE_WORDS = {
    "class": "Class", "classes": "Class", "interface": "Interface", "interfaces": "Interface", "method": "Method", "methods": "Method",
    "function": "Function", "functions": "Function", "variable": "Variable", "variables": "Variable", "file": "File", "files": "File",
}
CONTEXT_PHRASES = (
    "calls", "called by", "uses", "used by", "implements", "extends", "inherits", "derived",
    "related", "similar", "dependencies", "hierarchy", "structure", "architecture", "flow", "interaction",
)
STRATEGIES = ("nearest embeddings", "lookup by name", "related nodes")
APPROACHES = {
    "semantic": "by meaning: the nodes whose embeddings are nearest",
    "entity": "by name: the nodes called as the query says",
    "hybrid": "by meaning and by name together",
    "contextual": "by meaning, with the neighbourhood of what is found",
}


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def parsed(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with the intent's columns. Entity names keep duplicates: a name that two patterns match is looked up twice."""
    lower = F.lower(text)
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    lowered = F.transform(words, F.lower)
    types = F.create_map(*[F.lit(x) for kv in NODE_TYPE_WORDS.items() for x in kv])
    known = _strings(sorted({*PROGRAMMING_TERMS, *NODE_TYPE_WORDS}))
    clean = F.transform(lowered, lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    entities = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)) for p in ENTITY_PATTERNS])
    out = queries.withColumns(
        {
            "entity_names": entities,
            "programming_terms": F.filter(lowered, lambda w: F.array_contains(_strings(PROGRAMMING_TERMS), w)),
            "node_types": F.array_sort(F.array_distinct(F.filter(F.transform(lowered, lambda w: types[w]), lambda t: t.isNotNull()))),
            "semantic_terms": F.filter(clean, lambda w: ~F.array_contains(known, w) & (F.length(w) > 2)),
            "expand_context": F.coalesce(F.exists(_strings(CONTEXT_PHRASES), lambda p: F.contains(lower, p)), F.lit(False)),
        }
    )
    entity, programming, semantic = (F.size(c) > 0 for c in ("entity_names", "programming_terms", "semantic_terms"))
    kind = F.when(entity & (semantic | programming), "hybrid").when(entity, "entity").when(programming & semantic, "contextual").otherwise("semantic")
    sure = F.when(entity & semantic, 0.8).when(entity & programming, 0.7).when(entity, 0.9).when(programming & semantic, 0.7).when(semantic, 0.6).otherwise(0.4)
    return out.withColumns({"query_type": kind, "confidence": sure})


def explained(queries: DataFrame, text: str = "text") -> DataFrame:
    """The intent with the strategies that a search would use and its approach in words."""
    p = parsed(queries, text)
    vector = F.col("query_type").isin("semantic", "hybrid", "contextual")
    entity = F.col("query_type").isin("entity", "hybrid")
    used = [F.when(on, F.lit(s)) for on, s in zip((vector, entity, F.col("expand_context")), STRATEGIES, strict=True)]
    words = F.create_map(*[F.lit(x) for kv in APPROACHES.items() for x in kv])
    return p.withColumns({"search_strategy": F.array_compact(F.array(*used)), "estimated_approach": words[F.col("query_type")]})
