"""The test tables seen as a code graph: the same views for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Written in the SQL that Spark and DuckDB share; {table} is where a base table is read.
VIEWS = {
    "nodes": """
        SELECT concat('n', CAST(e.vec_id AS STRING)) AS id, e.vec_id AS vec_id,
               CASE e.label % 6 WHEN 0 THEN 'File' WHEN 1 THEN 'Class' WHEN 2 THEN 'Interface' WHEN 3 THEN 'Method' WHEN 4 THEN 'Function' ELSE 'Variable' END AS label,
               coalesce(p.p_name, concat('node_', CAST(e.vec_id AS STRING))) AS name,
               concat(coalesce(p.p_brand, 'pkg'), '::', coalesce(p.p_name, 'node'), '::', CAST(e.vec_id AS STRING)) AS full_name,
               CASE WHEN e.vec_id % 11 = 0 THEN NULL ELSE d.text END AS raw_code,
               CASE WHEN e.vec_id % 3 = 0 THEN NULL WHEN e.vec_id % 17 = 0 THEN '' ELSE concat(coalesce(p.p_type, 'code'), ' of ', coalesce(p.p_brand, 'pkg'), ' in ', coalesce(d.lang, 'none'), ' from ', coalesce(d.source, 'none')) END AS generated_summary,
               CASE WHEN e.vec_id % 9 = 0 THEN 'PROCESSING' WHEN e.vec_id % 3 <> 0 THEN 'COMPLETED' END AS summary_status,
               concat('src/dir', CAST(e.vec_id % 7 AS STRING), '/file', CAST(e.vec_id % 40 AS STRING), '.py') AS path,
               CASE e.vec_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN '' END AS visibility,
               CAST(e.vec_id % 50 AS INT) AS start_line, CAST(e.vec_id % 50 + e.vec_id % 5 AS INT) AS end_line, e.embedding AS embedding
        FROM {embeddings} e LEFT JOIN {part} p ON p.p_partkey = e.vec_id LEFT JOIN {documents} d ON d.doc_id = e.vec_id""",
    "edges": """
        SELECT concat('n', CAST(v AS STRING)) AS src, concat('n', CAST(w % n AS STRING)) AS dst, type FROM (
            SELECT vec_id AS v, 7 * vec_id + 1 AS w, 'CALLS' AS type, label % 6 AS k, n FROM base WHERE label % 6 IN (3, 4)
            UNION ALL SELECT vec_id, 13 * vec_id + 5, 'CALLS', label % 6, n FROM base WHERE label % 6 = 4
            UNION ALL SELECT vec_id, 11 * vec_id + 3, 'CONTAINS', label % 6, n FROM base WHERE label % 6 = 0
            UNION ALL SELECT vec_id, 3 * vec_id + 2, 'CONTAINS', label % 6, n FROM base WHERE label % 6 = 0
            UNION ALL SELECT vec_id, 2 * vec_id + 9, 'DEFINES', label % 6, n FROM base WHERE label % 6 IN (1, 2)
            UNION ALL SELECT vec_id, 9 * vec_id + 4, 'DECLARES', label % 6, n FROM base WHERE label % 6 IN (3, 4)
            UNION ALL SELECT vec_id, 5 * vec_id + 2, 'EXTENDS', label % 6, n FROM base WHERE label % 6 IN (1, 2)
            UNION ALL SELECT vec_id, 3 * vec_id + 1, 'IMPLEMENTS', label % 6, n FROM base WHERE label % 6 = 1
            UNION ALL SELECT vec_id, 17 * vec_id + 8, 'IMPORTS', label % 6, n FROM base WHERE label % 6 = 0
            UNION ALL SELECT vec_id, 19 * vec_id + 6, 'USES', label % 6, n FROM base WHERE label % 6 = 3
            UNION ALL SELECT vec_id, 23 * vec_id + 2, 'INSTANTIATES', label % 6, n FROM base WHERE label % 6 = 4
            UNION ALL SELECT vec_id, vec_id + 10, 'SCOPES', label % 6, n FROM base WHERE label % 6 = 5) x""",
    "files": """
        SELECT concat(source, '/', lang, '/', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.cs' WHEN 2 THEN '.JS' WHEN 3 THEN '.tsx' WHEN 4 THEN '.mjs' ELSE '.txt' END) AS path,
               doc_id, source, text AS content, n_chars AS size, {sha} AS checksum
        FROM {documents}""",
    "stored": """
        SELECT path, CASE WHEN doc_id % 10 = 1 THEN concat('x', checksum) WHEN doc_id % 10 = 2 THEN '' ELSE checksum END AS checksum FROM files WHERE doc_id % 10 <> 0
        UNION ALL SELECT concat('gone/', CAST(doc_id AS STRING)) AS path, checksum FROM files WHERE doc_id % 25 = 3
        UNION ALL SELECT concat('outside/', CAST(doc_id AS STRING)) AS path, checksum FROM files WHERE doc_id % 25 = 4""",
    "asked": """
        SELECT p_partkey AS query_id, CASE p_partkey % 9
            WHEN 0 THEN concat(p_name, ' class that calls StripeService') WHEN 1 THEN concat(p_name, ' methods') WHEN 2 THEN concat('UserController login function ', p_name)
            WHEN 3 THEN 'database connection configuration' WHEN 4 THEN concat('error handling in api ', p_name) WHEN 5 THEN 'Classes' WHEN 6 THEN 'DB'
            WHEN 7 THEN 'which code causes error' ELSE 'class method' END AS text
        FROM {part}""",
}
NEEDS = {"edges": ("base",), "stored": ("files",)}
BASE = "SELECT vec_id, label, count(*) OVER () AS n FROM {embeddings}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the Parquet tables of ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("embeddings", "part", "documents")} | {"sha": "sha2(text, 256)"}
    if name == "edges":
        # the number of nodes is one row: it needn't be counted by a window over all of them
        n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        base = f"SELECT vec_id, label, CAST({n} AS BIGINT) AS n FROM {tables['embeddings']}"
        return spark.sql(f"WITH base AS ({base}) {VIEWS[name]}")
    if name == "stored":
        return spark.sql(f"WITH files AS ({VIEWS['files'].format(**tables)}) {VIEWS[name]}")
    # what nodes are joined with grows: it isn't sent through the driver, however small its files are packed
    merged = VIEWS[name].replace("SELECT ", "SELECT /*+ MERGE(p, d) */ ", 1) if name == "nodes" else VIEWS[name]
    return spark.sql(merged.format(**tables))


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, with views as common table expressions."""
    tables = {t: t for t in ("embeddings", "part", "documents")} | {"sha": "sha256(text)"}
    parts = []
    for n in names:
        if n == "edges":
            parts.append(f"base AS ({BASE.format(**tables)})")
        parts.append(f"{n} AS ({VIEWS[n].format(**tables).replace('CAST(v AS STRING)', 'CAST(v AS VARCHAR)').replace(' AS STRING)', ' AS VARCHAR)')})")
    return f"WITH RECURSIVE {', '.join(parts)} {sql.replace('WITH ', ', ', 1) if sql.lstrip().startswith('WITH ') else sql}"
