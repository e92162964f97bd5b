"""Walks over edges: breadth-first search, closure, components, layers.

Only ``closure`` makes pairs; the others make rows in proportion to the edges.

Loops run on the driver, rows never do: each step joins the frontier to the edges
and is staged in the shared folder, so plans stay short and lost executors reread.
Edges are ``src``, ``dst``; ties break by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.storage import counted, drop, stage


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, via: str | None = None, order: str | None = None) -> DataFrame:
    """``id``, ``hops`` (and ``via``) of all that ``start`` (``id``) reaches along
    edges, least hops first; ``depth`` None goes on until nothing is new.

    ``via`` is the named edge column of the edge that found a node: the first by
    (id it came from, ``order``).
    """
    first = F.lit(None).cast("string")
    seen = start.select("id").distinct().select("id", F.lit(0).alias("hops"), first.alias("via"))
    seen = front = stage(seen, "reach")
    hop, parts = 0, 1
    while depth is None or hop < depth:
        hop += 1
        step = front.select(F.col("id").alias("from")).join(edges, F.col("from") == F.col("src"))
        label = F.min(F.struct("from", F.col(order or "dst").alias("order"), F.col(via or "dst").cast("string").alias("via"))).alias("first")
        found = step.groupBy(F.col("dst").alias("id")).agg(label)
        new = found.join(seen.select(F.col("id").alias("known")), F.col("id") == F.col("known"), "left_anti")
        front, n = counted(new.select("id", F.lit(hop).alias("hops"), F.col("first.via").alias("via")), "reach")
        if not n:
            break
        seen, parts = seen.union(front), parts + 1
        if parts > 8:
            # Else each round would read all rounds before it.
            seen, parts = stage(seen, "reach"), 1
    return seen if via else seen.select("id", "hops")


def closure(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """All pairs (``src``, ``dst``) that a path of one edge or more connects.

    Path doubling: the longest path found doubles each round, so rounds grow with
    the logarithm of the diameter.
    """
    now, size = counted(edges.select("src", "dst").distinct(), "closure")
    for _ in range(rounds):
        longer = now.alias("p").join(now.alias("q"), F.col("p.dst") == F.col("q.src")).select("p.src", "q.dst")
        last, before = now, size
        now, size = counted(now.union(longer).distinct(), "closure")
        drop(last)
        if size == before:
            return now
    raise RuntimeError(f"the closure is not settled after {rounds} rounds")


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that may lie on a cycle, those that go on at both ends, and their number;
    again as long as a fifth goes (what is left over costs a round, no more)."""
    now, size = counted(edges, "live")
    while size:
        entered, left = now.select(F.col("dst").alias("e")).distinct(), now.select(F.col("src").alias("l")).distinct()
        kept = now.join(entered, F.col("src") == F.col("e"), "left_semi").join(left, F.col("dst") == F.col("l"), "left_semi")
        before = size
        now, size = counted(kept, "live")
        if size > 0.8 * before:
            break
    return now, size


def strong_components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (its least id) of the nodes that lie on a cycle.

    Each round trims what no cycle passes, lets every node learn the least id that
    reaches it, and walks back from the nodes that learned their own: what that finds
    is a component whole. The rest goes on within the nodes that learned the same.
    Rows are in proportion to the edges, never to the pairs that reach each other.
    """
    live = stage(edges.select("src", "dst").distinct(), "live")
    out = live.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    live, size = _trimmed(live.filter("src <> dst"))
    while size:
        label = stage(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("least", F.col("id")), "labels")
        front = label
        while True:
            # Only labels that changed are sent on.
            told = front.join(live, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("t")).agg(F.min("least").alias("said"))
            new = label.join(told, F.col("id") == F.col("t"), "left")
            changed = F.coalesce(F.col("said") < F.col("least"), F.lit(False))
            new, n = counted(new.select("id", F.least("least", "said").alias("least"), changed.alias("changed")), "labels", "changed")
            label, front = new.select("id", "least"), new.filter("changed").select("id", "least")
            if not n:
                break
        a, b = (label.select(F.col("id").alias(f"{k}_id"), F.col("least").alias(f"{k}_least")) for k in "ab")
        inner = live.join(a, F.col("src") == F.col("a_id")).join(b, (F.col("dst") == F.col("b_id")) & (F.col("a_least") == F.col("b_least")))
        inner = stage(inner.select("src", "dst", F.col("a_least").alias("least")), "same-label")
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        starts = label.filter("id = least").select("id").join(inner.select(F.col("least").alias("l")).distinct(), F.col("id") == F.col("l"), "left_semi")
        found = reach(back, starts).select("id").join(label.withColumnRenamed("id", "known"), F.col("id") == F.col("known")).select("id", F.col("least").alias("component"))
        done = stage(found, "found")
        sizes = done.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("n")).filter("n > 1").select("c")
        out = out.unionByName(done.join(sizes, F.col("component") == F.col("c"), "left_semi"))
        gone = done.select(F.col("id").alias("g"))
        rest = inner.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti")
        live, size = _trimmed(rest.select("src", "dst"))
    return out.groupBy("id").agg(F.min("component").alias("component"))


def connected(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (its least id) of all ends of ``edges``, taken both ways.

    By contraction: every point merges with the neighbour of the least hash (itself
    included), twice over, and what connects merged points goes on. Hashes change from
    round to round, so rounds grow with the logarithm of the points, not with the length
    of paths, and a point of many edges is a partial minimum a task.
    """
    live = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    live, n = counted(live, "links")
    at = stage(live.select(F.col("src").alias("id")).distinct().withColumn("point", F.col("id")), "points")
    live, turn = live.filter("src <> dst"), 0
    while n:
        turn += 1
        mark = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))
        to = live.groupBy("src").agg(F.min(mark("dst")).alias("m")).select(F.col("src").alias("old"), F.least("m", mark("src"))["id"].alias("to"))
        to = stage(to, "merges")
        on = to.select(F.col("old").alias("mid"), F.col("to").alias("end"))
        to = stage(to.join(on, F.col("to") == F.col("mid")).select("old", F.col("end").alias("to")), "merges")
        at = stage(at.join(to, F.col("point") == F.col("old"), "left").select("id", F.coalesce("to", "point").alias("point")), "points")
        a, b = (to.select(F.col("old").alias(f"{k}_old"), F.col("to").alias(f"{k}_to")) for k in "ab")
        both = live.join(a, F.col("src") == F.col("a_old")).join(b, F.col("dst") == F.col("b_old")).filter("a_to <> b_to")
        live, n = counted(both.select(F.col("a_to").alias("src"), F.col("b_to").alias("dst")).distinct(), "links")
    least = at.groupBy("point").agg(F.min("id").alias("component")).withColumnRenamed("point", "p")
    return at.join(least, F.col("point") == F.col("p")).select("id", "component")


def condensed(edges: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``id``, ``point`` (its component, or itself) of every node, and the edges between
    different points."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    known = (known if known is not None else strong_components(edges)).withColumnRenamed("id", "node")
    at = stage(ids.join(known, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("point")), "points")
    a, b = (at.select(F.col("id").alias(f"{k}_id"), F.col("point").alias(f"{k}_point")) for k in "ab")
    dag = edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).filter("a_point <> b_point")
    return at, stage(dag.select(F.col("a_point").alias("src"), F.col("b_point").alias("dst")).distinct(), "condensed")


def layers(edges: DataFrame) -> DataFrame:
    """``id``, ``layer``: the longest path that leads to a node once cycles are
    condensed to single points; sources are layer 0. A round a layer, in which only
    points that moved send their layer on."""
    at, dag = condensed(stage(edges.select("src", "dst").distinct(), "edges"))
    depth = stage(at.select("point").distinct().withColumn("layer", F.lit(0)), "layers")
    front = depth
    while True:
        deeper = front.join(dag, F.col("point") == F.col("src")).groupBy(F.col("dst").alias("d")).agg((F.max("layer") + 1).alias("up"))
        new = depth.join(deeper, F.col("point") == F.col("d"), "left")
        new, n = counted(new.select("point", F.greatest("layer", "up").alias("layer"), (F.col("up") > F.col("layer")).alias("moved")), "layers", "moved")
        depth, front = new.select("point", "layer"), new.filter("moved").select("point", "layer")
        if not n:
            break
    return at.join(depth, "point").select("id", "layer")


def reached_by_all(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Relational division: ``id`` of the nodes that a path of one edge or more
    connects with every one of ``starts`` (``id``). Walks go on from the starts alone,
    all at once, so rows are the starts times what they reach."""
    seen = front = stage(starts.select(F.col("id").alias("start")).distinct().withColumn("at", F.col("start")), "division").filter("false")
    first = starts.select(F.col("id").alias("start")).distinct()
    step = first.join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("at")).distinct()
    while True:
        new = step.join(seen.toDF("s", "a"), (F.col("start") == F.col("s")) & (F.col("at") == F.col("a")), "left_anti")
        front, n = counted(new, "division")
        if not n:
            break
        seen = seen.union(front)
        step = front.join(edges, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at")).distinct()
    total = first.agg(F.count("*").alias("total"))
    return seen.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("n")).join(total, F.col("n") == F.col("total")).select("id")


def first_paths(edges: DataFrame, start: DataFrame, max_hops: int, undirected: bool = False) -> DataFrame:
    """``id``, ``hops``, ``rank``, ``prev``, ``kind`` of a breadth-first search in
    which nodes are taken in the order found and neighbours by (id, out before in,
    kind): the first to discover a node is its predecessor, on every run.

    The rank of a node is the path of ids that found it, compared as an array, so
    no frontier is ever numbered in one place.
    """
    steps = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(False).alias("incoming"), "kind", "src", "dst")
    if undirected:
        steps = steps.unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(True).alias("incoming"), "kind", "src", "dst"))
    blank = F.lit(None).cast("string")
    seen = stage(start.select("id", F.lit(0).alias("hops"), F.array("id").alias("rank"), blank.alias("prev"), blank.alias("kind")), "paths")
    front = seen
    for hop in range(1, max_hops + 1):
        joined = front.select(F.col("id").alias("at"), F.col("rank").alias("at_rank")).join(steps, F.col("at") == F.col("from"))
        best = F.min(F.struct("at_rank", "incoming", "kind", F.col("at").alias("prev"))).alias("b")
        new = joined.groupBy(F.col("to").alias("id")).agg(best).join(seen.select(F.col("id").alias("known")), F.col("id") == F.col("known"), "left_anti")
        rank = F.concat("b.at_rank", F.array("id")).alias("rank")
        ranked = new.select("id", F.lit(hop).alias("hops"), rank, F.col("b.prev").alias("prev"), F.col("b.kind").alias("kind"))
        front, n = counted(ranked, "paths")
        if not n:
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, start: DataFrame, goal: str, max_hops: int = 6, undirected: bool = False) -> DataFrame:
    """The edges of the path to ``goal`` as ``hop``, ``src``, ``dst``, ``kind``; no
    row where there is none within ``max_hops``."""
    found = stage(first_paths(edges, start, max_hops, undirected), "found")
    path = found.filter(F.col("id") == goal)
    out = path.select("hops", "prev", "id", "kind")
    for _ in range(max_hops - 1):
        path = path.select(F.col("prev").alias("back")).join(found, F.col("back") == F.col("id"))
        out = out.union(path.select("hops", "prev", "id", "kind"))
    return out.filter("prev is not null").select(F.col("hops").alias("hop"), F.col("prev").alias("src"), F.col("id").alias("dst"), "kind")
