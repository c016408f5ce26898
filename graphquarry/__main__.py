"""``python -m graphquarry``: index, summarize, status, reset, search, explain."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from graphquarry import __version__
from graphquarry import index as indexing
from graphquarry.functions.query_parser import explained
from graphquarry.operators import enrich, search


def show(df: DataFrame, as_json: bool, most: int = 200) -> None:
    """At most ``most`` rows, as a table or as one JSON document a line."""
    if as_json:
        for line in df.limit(most).toJSON().collect():
            print(line)
    else:
        df.show(most, truncate=80)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphquarry", description="Index source trees to a graph, and search it.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--json", action="store_true", help="print JSON lines instead of tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("index", "bring a store up to date with a source tree"), ("summarize", "summaries and embeddings of what has none"), ("status", "counts of a store"), ("reset", "unmark work in progress, or remove the store")):
        c = sub.add_parser(name, help=words)
        if name == "index":
            c.add_argument("root")
        c.add_argument("store")
        if name == "reset":
            c.add_argument("--everything", action="store_true", help="remove the store")
    c = sub.add_parser("search", help="answer a query")
    c.add_argument("store")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=30)
    c.add_argument("--similarity", type=float, default=0.6)
    c.add_argument("--no-context", action="store_true")
    c = sub.add_parser("explain", help="how a query would be answered")
    c.add_argument("query")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows that a command shows."""
    if args.command == "explain":
        return explained(spark.createDataFrame([(args.query,)], "text string"))
    if args.command == "index":
        return indexing.index(spark, args.root, args.store).summary
    nodes, edges = indexing.read(spark, args.store)
    if args.command == "search":
        config = search.SearchConfig(max_total_results=args.limit, min_similarity=args.similarity, context_expansion=not args.no_context)
        asked = spark.createDataFrame([(1, args.query)], "query_id long, text string")
        return search.hybrid_search(asked, nodes, edges, config).orderBy("rank")
    if args.command == "summarize":
        after = enrich.enrich(nodes, edges)
        totals = enrich.enrichment_totals(nodes, after).collect()
        indexing.write(after, edges, args.store)
        return spark.createDataFrame(totals, "label string, n long")
    if args.command == "reset":
        if args.everything:
            indexing.reset(spark, args.store)
            nodes, edges = indexing.empty(spark)
        else:
            indexing.write(enrich.reset_status(nodes), edges, args.store)
            nodes, edges = indexing.read(spark, args.store)
    return indexing.graph_summary(nodes, edges).orderBy("kind", "value")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "index" and "://" not in args.root and not os.path.isdir(args.root):
        print(f"no such folder: {args.root}", file=sys.stderr)
        return 2
    if args.command == "search" and not args.query.strip():
        print("the query is empty", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("graphquarry").getOrCreate()
    try:
        show(run(spark, args), args.json)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
