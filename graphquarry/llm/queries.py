"""The queries of this subpackage, with the production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import bpe, collocations, divergence, exact_dedup, language_id, mixing, near_dup, packing, quality, substring_dedup, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = quality.learn(docs, _table(spark, sf_dir, "labels"), remainder(5) != 0)
    return quality.score(docs, network).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("row")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs, remainder(4) != 2))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_quality_classifier, op3_near_dedup, op4_bpe, op5_warc, op6_toxicity, op7_substring_dedup, op8_language_id, op9_exact_dedup, op10_top_k, op11_collocations, op12_source_mix, op13_source_divergence)
}

ORACLES = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
             g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase
                   FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
             f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS first_id FROM g),
             c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first_id < doc_id) GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN c ON w.doc_id = c.doc_id""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY digest) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY digest) AS kept, digest AS text_sha256
        FROM d""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
             t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
             g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(words) >= k),
             f AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
             c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
             x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
             y AS (SELECT x.lang, x.phrase, x.a, cut, l.a AS l, r.a AS r, CAST(2000000 * CAST(x.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
                   FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.words[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.words[cut + 1:], ' ')),
             m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM y) WHERE nth = 1),
             i AS (SELECT lang, a, words, k, unnest(range(2, k)) AS n FROM c WHERE k > 2),
             s AS (SELECT lang, a, words, n, unnest(range(1, k - n + 2)) AS b FROM i),
             z AS (SELECT lang, array_to_string(words[b:b + n - 1], ' ') AS phrase, max(a) AS longer FROM s GROUP BY 1, 2),
             o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, m.phrase) AS rank FROM m LEFT JOIN z ON z.lang = m.lang AND z.phrase = m.phrase WHERE z.longer IS NULL OR 100 * z.longer < 80 * m.a)
        SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
             h AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             b AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM h),
             q AS (SELECT lang, source, term, n, 1 + 1000000000 * CAST(n + 5 AS HUGEINT) // (total + 5 * v) AS p FROM b),
             l AS (SELECT lang, term, 1 + 1000000000 * CAST(n + 5 AS HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS p FROM (SELECT lang, term, sum(n) AS n FROM h GROUP BY 1, 2)),
             f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM q x JOIN q y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
             e AS (SELECT x.lang, x.source, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
             t AS (SELECT q.lang, source, q.term AS item, q.p - l.p AS value, row_number() OVER (PARTITION BY q.lang, source ORDER BY q.p - l.p DESC, q.term) AS rank FROM q JOIN l ON l.lang = q.lang AND l.term = q.term WHERE n > 0 AND q.p > l.p)
        SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
        UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INTEGER) FROM t WHERE rank <= 50""",
}
