"""Command line: index a source tree, or ask a store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from symgraph import pipeline
from symgraph.operators import graph, paths
from symgraph.operators.ingest import GraphStore


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symgraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index a source tree")
    index.add_argument("--source-root", required=True)
    index.add_argument("--store", required=True)
    index.add_argument("--cpp-triples", help="JSON-line triples of a C++ indexer")
    index.add_argument("--incremental", action="store_true")
    index.add_argument("--clean", action="store_true", help="start from an empty store")
    ask = commands.add_parser("ask", help="query a store")
    ask.add_argument("--store", required=True)
    ask.add_argument("what", choices=["stats", "namespaces", "classes", "methods", "search", "neighbors", "callchain", "inheritance", "narrative"])
    ask.add_argument("argument", nargs="?", default="")
    ask.add_argument("--hops", type=int, default=1)
    ask.add_argument("--depth", type=int, default=3)
    ask.add_argument("--limit", type=int, default=20)
    ask.add_argument("--direction", choices=["both", "callers", "callees"], default="both")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 2 if some files failed, 1 if all did."""
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("symgraph").getOrCreate()
    if a.command == "index":
        summary = pipeline.run(spark, a.source_root, a.store, a.cpp_triples, a.incremental, a.clean)
        print(json.dumps(summary, indent=2))
        return 0 if not summary["failed"] else 2 if summary["parsed"] > summary["failed"] else 1
    store = GraphStore(spark, a.store)
    nodes, edges = store.read("nodes"), store.read("edges")
    if nodes is None:
        print("the store is empty", file=sys.stderr)
        return 1
    if a.what == "narrative":
        print(paths.narrative(nodes, edges, a.argument, a.depth))
        return 0
    tables = {
        "stats": lambda: (graph.stats_nodes(nodes), graph.stats_edges(edges)),
        "namespaces": lambda: (graph.namespaces(nodes),),
        "classes": lambda: (graph.classes(nodes, a.argument),),
        "methods": lambda: (graph.methods(nodes, edges, a.argument),),
        "search": lambda: (graph.search(nodes, a.argument, a.limit),),
        "neighbors": lambda: (graph.to_elements_json(*paths.neighbors(nodes, edges, a.argument, a.hops)),),
        "callchain": lambda: paths.callchain(nodes, edges, a.argument, a.direction, a.depth),
        "inheritance": lambda: paths.inheritance(nodes, edges, a.argument),
    }[a.what]()
    for table in tables:
        for row in table.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
