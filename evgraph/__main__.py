"""Build a graph, and ask it: python -m evgraph FOLDER build SOURCES, then
python -m evgraph FOLDER FUNCTION [ARGUMENT...]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators import ask, traverse
from evgraph.sources import graph_json


def _ids(spark: SparkSession, nodes: DataFrame, name: str) -> DataFrame:
    """The one node of a name; the caller is told when there is none, or several."""
    hits = ask.resolve(nodes, spark.createDataFrame([(name,)], "name string"))
    found = hits.limit(21).collect()
    if len(found) != 1:
        raise SystemExit(f"{name}: " + ("no node" if not found else "several nodes: " + ", ".join(sorted(r["id"] for r in found))))
    return spark.createDataFrame([(found[0]["id"],)], "id string")


def answer(spark: SparkSession, nodes: DataFrame, edges: DataFrame, function: str, args: list[str]) -> DataFrame:
    """One of the query functions as a table."""
    one = lambda i=0: _ids(spark, nodes, args[i])
    number = lambda i, default: max(0, int(args[i])) if len(args) > i else default
    calls = {
        "get_node": lambda: ask.degrees(nodes, edges).join(one(), "id"),
        "get_neighbors": lambda: ask.neighbours(nodes, edges, one(), *args[1:2]),
        "affected": lambda: ask.affected(nodes, edges, one(), depth=number(1, 3)).orderBy("hops", "id"),
        "shortest_path": lambda: traverse.shortest_path(edges, one(), one(1).first()["id"], max(1, number(2, 6))).orderBy("hop"),
        "god_nodes": lambda: ask.god_nodes(nodes, edges, max(1, number(0, 10))),
        "graph_stats": lambda: ask.graph_stats(edges).orderBy("facet", "value"),
        "query_graph": lambda: ask.query_graph(nodes, edges, args[0].lower().split(), number(1, 1), max(50, number(2, 2000)))[0],
    }
    if function not in calls:
        raise SystemExit(f"one of: {', '.join(sorted(calls))}")
    return calls[function]()


def build(spark: SparkSession, folder: str, sources: str) -> int:
    """Saves the graph of a folder of Python files as tables, and prints how many of its
    references were pinned."""
    from evgraph.operators import assemble

    made = assemble.of_folder(spark, sources)
    edges = made.edges.withColumnRenamed("start_line", "line").withColumn("context", F.lit(None).cast("string"))
    graph_json.save(made.nodes, edges, folder)
    for line in made.scorecard().orderBy("kind").toJSON().toLocalIterator():
        print(line)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evgraph", description=__doc__)
    parser.add_argument("folder", help="where nodes and edges were saved, or a graph document")
    parser.add_argument("function")
    parser.add_argument("argument", nargs="*")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("evgraph").getOrCreate()
    if given.function == "build":
        return build(spark, given.folder, given.argument[0])
    nodes, edges = graph_json.read(spark, given.folder) if given.folder.endswith(".json") else graph_json.load(spark, given.folder)
    rows = 0
    for line in answer(spark, nodes, edges, given.function, given.argument).toJSON().toLocalIterator():
        print(line)
        rows += 1
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
