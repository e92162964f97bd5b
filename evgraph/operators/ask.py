"""The query surface over a graph: resolve, inspect, rank, search under a budget.

``nodes``: id, kind, label, qualified_name. ``edges``: src, dst, kind, context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions.text import matches, tokens
from evgraph.operators.traverse import reach
from evgraph.storage import stage

TIERS = ("id", "qualified_name", "label")


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Every node that a ``name`` stands for, with the first tier it matched by.

    A name that is an id stands for that node alone; else qualified names and labels
    count together. One equi join per tier, for any number of names at once.
    """
    asked = names.select("name").distinct()
    hits = None
    for rank, tier in enumerate(TIERS):
        found = asked.join(nodes.select("id", F.col(tier).alias("key")), F.col("name") == F.col("key")).select("name", "id", F.lit(rank).alias("rank"))
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("name", "id").agg(F.min("rank").alias("rank"))
    alone = hits.filter("rank = 0").select(F.col("name").alias("exact")).distinct()
    kept = best.join(alone, F.col("name") == F.col("exact"), "left").filter("exact is null or rank = 0")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("rank") + 1)
    return kept.select("name", "id", tier.alias("matched_by"))


def answerable(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``name``, ``hits`` and ``verdict``: one hit answers, none and many don't."""
    hits = resolve(nodes, names).groupBy("name").agg(F.count("*").alias("n"))
    joined = names.select(F.col("name").alias("asked")).distinct().join(hits, F.col("asked") == F.col("name"), "left")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n == 1, "match").when(n == 0, "no node").otherwise("ambiguous")
    return joined.select(F.col("asked").alias("name"), n.alias("hits"), verdict.alias("verdict"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node, 0 where it has no edge."""
    ends = edges.select(F.col("src").alias("end"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("end"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("end").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(sums, F.col("id") == F.col("end"), "left").select(
        "id", "kind", "label", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree")
    )


def god_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(top_n)


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, relation: str | None = None, direction: str = "both") -> DataFrame:
    """Edges of ``ids`` (``id``) with the node at the other end. A relation is a kind
    or a context; without one, ``contains`` stays hidden."""
    hidden = "contains"
    keep = (F.col("kind") != hidden) if relation is None else (F.col("kind") == relation) | (F.col("context") == relation)
    sides = [("out", "src", "dst")] * (direction != "in") + [("in", "dst", "src")] * (direction != "out")
    out = None
    for name, here, there in sides:
        part = (
            edges.filter(keep)
            .join(ids.select(F.col("id").alias("me")), F.col(here) == F.col("me"), "left_semi")
            .select(F.lit(name).alias("direction"), F.col(here).alias("node"), F.col(there).alias("other"), F.col("kind").alias("edge_kind"), "context")
        )
        out = part if out is None else out.unionByName(part)
    return out.join(nodes.select("id", "kind", "label"), F.col("other") == F.col("id")).select(
        "direction", "node", "other", "edge_kind", "context", F.col("kind").alias("other_kind"), "label"
    )


def affected(nodes: DataFrame, edges: DataFrame, start: DataFrame, relation: str | None = None, depth: int = 3) -> DataFrame:
    """What depends on ``start`` (``id``), over incoming edges: ``id``, ``hops``,
    ``via``. Rationale edges don't count unless they are asked for."""
    rationale = (F.coalesce("context", F.lit("")) == "rationale") | (F.col("kind") == "rationale_for")
    keep = F.lit(True) if relation == "rationale" else ~rationale
    if relation is not None:
        keep = keep & ((F.col("kind") == relation) | (F.coalesce("context", F.lit("")) == relation))
    back = edges.filter(keep).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce("context", "kind").alias("via"), F.col("kind").alias("order"))
    back = stage(back, "turned")  # read once a hop
    found = reach(back, start, depth, via="via", order="order").filter("hops > 0")
    return found.join(nodes.select("id", "kind"), "id").select("id", "kind", "hops", "via")


def graph_stats(edges: DataFrame) -> DataFrame:
    """Edge counts by kind, by context and in all, in one pass of grouping sets."""
    name = F.when(F.grouping("kind") == 0, "kind").when(F.grouping("context") == 0, "context").otherwise("total")
    return edges.groupingSets([["kind"], ["context"], []], "kind", "context").agg(F.count("*").alias("n"), name.alias("facet")).select(
        "facet", F.coalesce("kind", "context", F.lit("all")).alias("value"), "n"
    )


def keyword_scores(rows: DataFrame, id_col: str, text: Column, words: list[str]) -> DataFrame:
    """``score``: how many of the words (repeats count) name a token of the text."""
    hits = lambda t: sum((matches(F.lit(w), t, len(w)).cast("int") for w in words), F.lit(0))
    # Bound as a lambda variable, the tokens of a row are made once for all words, and
    # an exploded filter keeps the test for hits from making them again.
    scores = F.filter(F.transform(F.array(F.array_distinct(tokens(text, keep_whole=True))), hits), lambda s: s > 0)
    return rows.select(id_col, F.explode(F.transform(scores, lambda s: s.cast("long"))).alias("score"))


def within_budget(rows: DataFrame, cost: Column, order: list[Column], budget: int) -> DataFrame:
    """The longest prefix by ``order`` whose costs (above 0) sum to the budget at
    most. Rows past the budget in number can't fit, so a top-k bounds the window."""
    first = rows.withColumn("cost", cost).orderBy(*order).limit(budget)
    running = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("spent", running).filter(F.col("spent") <= budget)


def query_graph(nodes: DataFrame, edges: DataFrame, words: list[str], depth: int = 1, budget: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes that hold the words, best first, then what lies around them up to
    ``depth``, and the edges among those shown; nodes take six tenths of the budget
    and edges what is left. Costs are the tokens of each row printed as JSON."""
    from evgraph.functions.text import json_cost

    hay = F.concat_ws(" ", "label", "qualified_name", "id")
    hits = keyword_scores(nodes, "id", hay, words)
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    around = reach(both, hits.select("id"), depth)
    ranked = around.join(hits.withColumnRenamed("id", "hit"), F.col("id") == F.col("hit"), "left").join(nodes, "id")
    cap = budget * 6 // 10
    row = F.struct("id", "kind", "label", "qualified_name", "hops")
    order = [F.col("hops"), F.desc(F.coalesce("score", F.lit(0))), F.col("id")]
    shown = within_budget(ranked.select("id", "kind", "label", "qualified_name", "hops", "score"), json_cost(row), order, cap)
    ends = shown.select(F.col("id").alias("end"))
    inside = edges.join(ends, F.col("src") == F.col("end"), "left_semi").join(ends, F.col("dst") == F.col("end"), "left_semi")
    lines = within_budget(inside.select("src", "dst", "kind", "context"), json_cost(F.struct("src", "dst", "kind", "context")), [F.col("src"), F.col("dst"), F.col("kind")], budget - cap)
    return shown.select("id", "kind", "hops", "cost", "spent"), lines
