"""The property graph as DataFrames: labels, edge types, row schemas and ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("File", "Directory", "Class", "Interface", "Method", "Function", "Variable", "Parameter", "Import", "Export")
EDGE_TYPES = ("CONTAINS", "DEFINES", "DECLARES", "HAS_MEMBER", "CALLS", "INSTANTIATES", "EXTENDS", "IMPLEMENTS", "IMPORTS", "EXPORTS", "SCOPES", "USES", "REFERENCES")
#: Labels whose nodes have embeddings, in the order in which searches go through them.
INDEXED = ("File", "Class", "Interface", "Method", "Function", "Variable")
SUMMARISED = ("Class", "Method", "Function", "Interface")
#: Bottom-up order of summaries.
LEVELS = ("Parameter", "Variable", "Method", "Function", "Class", "Interface", "File", "Directory")
UNKNOWN_LABEL = "Node"

LOCATION = "struct<start_line: int, end_line: int, start_column: int, end_column: int>"
#: One wide row for every label; what a label lacks is null.
NODE = (
    "id string, label string, name string, full_name string, raw_code string, "
    f"location {LOCATION}, properties map<string, string>, path string, absolute_path string, extension string, size bigint, "
    "checksum string, content string, language string, visibility string, is_abstract boolean, is_static boolean, is_sealed boolean, "
    "base_classes array<string>, interfaces array<string>, base_interfaces array<string>, docstring string, is_virtual boolean, "
    "is_override boolean, is_async boolean, is_generator boolean, return_type string, parameters array<string>, signature string, "
    "type string, value string, is_constant boolean, is_readonly boolean, scope string, default_value string, is_optional boolean, "
    "is_variadic boolean, is_params boolean, modifier string, module string, alias string, imported_names array<string>, "
    "is_wildcard boolean, exported_names array<string>, is_default boolean"
)
#: A node as a store has it, with what enrichment adds.
STORED = f"{NODE}, generated_summary string, summary_status string, embedding array<float>"
NODE_FIELDS = tuple(x.split()[0] for x in NODE.replace(LOCATION, "location").replace("map<string, string>", "map").split(", "))
EDGE = "src string, dst string, type string, properties map<string, string>"
#: A document of one extraction run, as it is exchanged.
INTERCHANGE = (
    "language string, version string, processed_files array<string>, "
    f"nodes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in NODE.replace(LOCATION, 'LOCATION').replace('map<string, string>', 'MAP').split(', ')).replace('LOCATION', LOCATION).replace('MAP', 'map<string, string>')}>>, "
    "relationships array<struct<source_id: string, target_id: string, type: string, properties: map<string, string>>>, metadata map<string, string>"
)


def node_id(label: str, path: str, full_name: str, ordinal: int) -> str:
    """The same id for the same element in every run, and different ones in different files."""
    return hashlib.sha256("|".join((label, path, full_name, str(ordinal))).encode()).hexdigest()


def packed(id_: str | Column) -> Column:
    """An id as bytes, half as many where it is a hash; what isn't one gets a head by which no two ids are alike. Such ids sort before hashes."""
    c = F.col(id_) if isinstance(id_, str) else id_
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.unhex(c)).otherwise(F.concat(F.lit(bytes(33)), F.encode(c, "UTF-8")))


def unpacked(key: str | Column) -> Column:
    """The id that ``packed`` made bytes of."""
    c = F.col(key) if isinstance(key, str) else key
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, F.lit(34), F.octet_length(c)), "UTF-8"))


def known_label(label: Column) -> Column:
    return F.when(label.isin(*LABELS), label).otherwise(UNKNOWN_LABEL)


def empty_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODE)


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGE)


def create_tables(spark: SparkSession, database: str) -> None:
    """Empty tables: nodes laid out by label, edges by type. There are no indexes to make."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    rest = ", ".join(x for x in NODE.split(", ") if x)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.nodes ({rest}, generated_summary string, summary_status string, embedding array<float>) USING parquet PARTITIONED BY (label)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.edges ({EDGE}) USING parquet PARTITIONED BY (type)")


def catalogue(spark: SparkSession, database: str) -> DataFrame:
    """The tables of a database and the engine's version."""
    names = [(t.name, spark.version) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(sorted(names), "table_name string, version string")


def flattened(nodes: DataFrame) -> DataFrame:
    """Location as four columns; free properties that clash with no column stay a map."""
    parts = [F.col(f"location.{x}").alias(x) for x in ("start_line", "end_line", "start_column", "end_column")]
    own = F.map_filter("properties", lambda k, _: ~k.isin(*nodes.columns))
    return nodes.select(*[own.alias("properties") if c == "properties" else F.col(c) for c in nodes.columns if c != "location"], *parts)


def location_of(start: str = "start_line", end: str = "end_line") -> Column:
    """Null unless both lines are known and not 0."""
    return F.when((F.col(start) > 0) & (F.col(end) > 0), F.struct(F.col(start).alias("start_line"), F.col(end).alias("end_line")))


def metadata_of(*columns: str) -> Column:
    """A map of those columns that are neither null nor empty."""
    made = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull() & (v != ""))


def duplicates(nodes: DataFrame) -> DataFrame:
    """Violations of uniqueness: (label, key, n) for paths of files and full names of other elements."""
    key = F.when(F.col("label") == "File", F.col("path")).otherwise(F.col("full_name"))
    unique = nodes.filter(F.col("label").isin("File", "Class", "Method", "Function", "Variable", "Interface", "Parameter"))
    return unique.select("label", key.alias("key")).dropna().groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
