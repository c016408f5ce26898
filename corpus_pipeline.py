"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

Defined cases, beside those of the operators: extra columns pass through all stages but the last,
whatever their names; rows without a doc_id stay while their text is the only one of its kind and
lose no words; rows that repeat a doc_id with other texts are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import exact_dedup, language_id, near_dup, packing, substring_dedup
from graphquarry.llm.columns import free_name
from graphquarry.llm.queries import remainder
from graphquarry.plans.storage import new_path

#: Byte-pair encoding isn't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that could be learned (operator 8)."""
    return language_id.keep_identified(docs, language_id.learn(docs, remainder(4) != 2))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts (operator 9)."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each class of near copies (operator 3); rows are told apart by id and text."""
    own, key, mark = (free_name(docs, x) for x in ("_kept", "_row", "_mark"))
    kept = near_dup.near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias(own), F.col("row").alias(key)).distinct()
    marked = docs.filter("doc_id is not null").withColumn(mark, near_dup.row_key("doc_id", "text"))
    found = marked.join(kept, (F.col(mark) == F.col(key)) & (F.col("doc_id") == F.col(own)), "left_semi").drop(mark)
    return found.unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that a document with a smaller id has; other documents stay as they are (operator 7)."""
    own, source, kept = (free_name(docs, x) for x in ("_own", "_source", "_cut"))
    changed = substring_dedup.substring_dedup(docs, texts=True).filter("n_removed > 0").select(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("kept").alias(kept))
    same = (F.col("doc_id") == F.col(own)) & (F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)) == F.col(source))
    joined = docs.join(changed.dropDuplicates([own, source]), same, "left")
    values = {"text": F.coalesce(kept, "text"), "n_chars": F.coalesce(F.length(kept).cast("long"), "n_chars")}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their places in sequences of at most 1024 (operator 1)."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
