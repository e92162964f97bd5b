"""All registered queries of the graph engine and their SQL."""

from evgraph.plans import assembly_queries, block_queries, graph_queries, text_queries, view_queries  # noqa: F401
from evgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
