"""Checks of drawn views: boxes, routes, bands and labels, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.operators.joins import overlaps, pairs_within, stacked, touching, unstacked
from evgraph.storage import stage

GAP = 4
CELL = 256.0


def box_overlaps(boxes: DataFrame, gap: int = GAP) -> DataFrame:
    """Pairs of boxes (view, id, x1, y1, x2, y2) closer than ``gap``."""
    wide = boxes.select("view", "id", (F.col("x1") - gap + 1).alias("lo"), F.col("x2").alias("hi"), "x1", "x2", "y1", "y2")
    pairs = overlaps(wide, wide, ["view"], "lo", "hi", CELL)
    near = (F.col("a_x1") < F.col("b_x2") + gap) & (F.col("b_x1") < F.col("a_x2") + gap) & (F.col("a_y1") < F.col("b_y2") + gap) & (F.col("b_y1") < F.col("a_y2") + gap)
    return pairs.filter((F.col("a_id") < F.col("b_id")) & near).select(F.col("a_view").alias("view"), F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def route_overlaps(segments: DataFrame) -> DataFrame:
    """Pairs of routes that run along each other: segments (view, route, src, dst,
    x1, y1, x2, y2) on one line that share more than a point, unless the routes share
    an end. An equi join on view, direction and line."""
    flat = F.col("y1") == F.col("y2")
    on_line = segments.filter(flat | (F.col("x1") == F.col("x2"))).select(
        "view", "route", "src", "dst", flat.alias("flat"), F.when(flat, F.col("y1")).otherwise(F.col("x1")).alias("line"),
        F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"), F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"),
    )
    pairs = overlaps(on_line, on_line, ["view", "flat", "line"], "lo", "hi", CELL)
    apart = (F.col("a_src") != F.col("b_src")) & (F.col("a_dst") != F.col("b_dst"))
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    return pairs.filter((F.col("a_route") < F.col("b_route")) & apart & (shared > 0)).groupBy(F.col("a_view").alias("view"), F.col("a_route").alias("a"), F.col("b_route").alias("b")).agg(F.sum(shared).alias("shared"))


def crossings(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Routes that cut through a box that is neither of their ends."""
    lines = segments.select("view", F.col("route").alias("id"), "src", "dst", F.least("x1", "x2").alias("lo"), F.greatest("x1", "x2").alias("hi"), F.least("y1", "y2").alias("top"), F.greatest("y1", "y2").alias("bottom"))
    solid = boxes.select("view", "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("x1").alias("lo"), F.col("x2").alias("hi"), F.col("y1").alias("top"), F.col("y2").alias("bottom"))
    pairs = overlaps(lines, solid, ["view"], "lo", "hi", CELL)
    inside = (F.col("a_lo") < F.col("b_hi")) & (F.col("a_hi") > F.col("b_lo")) & (F.col("a_top") < F.col("b_bottom")) & (F.col("a_bottom") > F.col("b_top"))
    foreign = (F.col("a_src") != F.col("b_id")) & (F.col("a_dst") != F.col("b_id"))
    return pairs.filter(inside & foreign).select(F.col("a_view").alias("view"), F.col("a_id").alias("route"), F.col("b_id").alias("box")).distinct()


def outside(boxes: DataFrame, canvas: DataFrame) -> DataFrame:
    """Boxes that leave their canvas (view, width, height) or have no size."""
    at = canvas.select(F.col("view").alias("c_view"), "width", "height")
    bad = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("width")) | (F.col("y2") > F.col("height")) | (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    return boxes.join(at, F.col("view") == F.col("c_view")).filter(bad).select("view", "id")


def repeated_ids(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("view", "id").agg(F.count("*").alias("n")).filter("n > 1")


def barycentres(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One sweep: each node's mean neighbour position becomes its place in the
    layer, and ties keep their order. ``nodes``: id, layer, place."""
    from pyspark.sql import Window

    seen = edges.select(F.col("dst").alias("n"), F.col("src").alias("m")).union(edges.select("src", "dst"))
    mean = seen.join(nodes.select(F.col("id").alias("m_id"), F.col("place").alias("m_place")), F.col("m") == F.col("m_id")).groupBy("n").agg(F.avg("m_place").alias("mean"))
    joined = nodes.join(mean, F.col("id") == F.col("n"), "left").select("id", "layer", "place", F.coalesce("mean", "place").alias("mean"))
    return joined.select("id", "layer", (F.row_number().over(Window.partitionBy("layer").orderBy("mean", "place", "id")) - 1).alias("place"))


def long_edges(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """Edges turned to run down, with a dummy for every layer they pass over."""
    a, b = layer.toDF("a_id", "a_layer"), layer.toDF("b_id", "b_layer")
    joined = edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    low, high = F.least("a_layer", "b_layer"), F.greatest("a_layer", "b_layer")
    between = F.when(high - low > 1, F.sequence(low + 1, high - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select("src", "dst", (F.col("a_layer") > F.col("b_layer")).alias("turned"), between.alias("dummies"))


def oriented(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """``low``, ``high``, ``src``, ``dst``, ``turned``: every edge between different nodes
    turned to run down by (layer, id). Edges that close a cycle run up or within a layer,
    where ids decide, so no cycle is left, and the real ends say where the arrow points."""
    a, b = (layer.select(F.col("id").alias(f"{k}_id"), F.col("layer").alias(f"{k}_layer")) for k in "ab")
    joined = edges.select("src", "dst").distinct().filter("src <> dst").join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    turned = F.struct("a_layer", "src") > F.struct("b_layer", "dst")
    low, high = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    return joined.select(low.alias("low"), high.alias("high"), "src", "dst", turned.alias("turned"))


def route_faults(routes: DataFrame, points: DataFrame, boxes: DataFrame, canvas: DataFrame, gap: int = GAP) -> DataFrame:
    """``view``, ``route``, ``fault`` of routes (view, route, src, dst) by their ``points`` (view,
    route, nth, x, y): ``no-box`` for an end that is none, and else ``short`` with fewer than
    two points, ``off-canvas``, ``loose`` where the first or last point is not on its box."""
    at = boxes.select(F.col("view").alias("b_view"), F.col("id").alias("b_id"), "x1", "y1", "x2", "y2")
    ends = routes.select("view", "route", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("src").alias("end")), F.struct(F.lit(False).alias("first"), F.col("dst").alias("end")))).alias("e"))
    ends = ends.select("view", "route", "e.first", "e.end").join(at, (F.col("view") == F.col("b_view")) & (F.col("end") == F.col("b_id")), "left")
    lost = ends.filter("b_id is null").select("view", "route").distinct()
    place = F.struct("nth", "x", "y")
    line = points.groupBy(F.col("view").alias("p_view"), F.col("route").alias("p_route")).agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("z"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    sound = routes.select("view", "route").join(lost, ["view", "route"], "left_anti").join(line, (F.col("view") == F.col("p_view")) & (F.col("route") == F.col("p_route")), "left")
    size = canvas.select(F.col("view").alias("c_view"), "width", "height")
    drawn = sound.join(size, F.col("view") == F.col("c_view"), "left")
    short = F.coalesce("n", F.lit(0)) < 2
    off = ~short & ((F.col("left") < 0) | (F.col("top") < 0) | (F.col("right") > F.col("width")) | (F.col("bottom") > F.col("height")))
    tips = ends.filter("b_id is not null").join(drawn.filter(~short).select(F.col("view").alias("d_view"), F.col("route").alias("d_route"), "a", "z"), (F.col("view") == F.col("d_view")) & (F.col("route") == F.col("d_route")))
    tip = lambda c: F.when(F.col("first"), F.col(f"a.{c}")).otherwise(F.col(f"z.{c}"))
    on_box = tip("x").between(F.col("x1") - gap, F.col("x2") + gap) & tip("y").between(F.col("y1") - gap, F.col("y2") + gap)
    said = lambda rows, fault: rows.select("view", "route", F.lit(fault).alias("fault"))
    return said(lost, "no-box").union(said(drawn.filter(short), "short")).union(said(drawn.filter(off), "off-canvas")).union(said(tips.filter(~on_box), "loose")).distinct()


def frame_faults(frames: DataFrame, members: DataFrame, boxes: DataFrame, canvas: DataFrame) -> DataFrame:
    """``view``, ``frame``, ``member``, ``fault`` of frames (view, frame, x1, y1, x2, y2; a band
    has no x) that claim ``members`` (view, frame, member): ``no-box`` for one that is none,
    ``not-inside`` for one the frame does not hold, ``off-canvas`` for the frame itself."""
    held = members.join(boxes.select(F.col("view").alias("b_view"), F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]), (F.col("view") == F.col("b_view")) & (F.col("member") == F.col("b_id")), "left")
    lost = held.filter("b_id is null").select("view", "frame", "member", F.lit("no-box").alias("fault"))
    at = frames.select(F.col("view").alias("f_view"), F.col("frame").alias("f_frame"), "x1", "y1", "x2", "y2")
    both = held.filter("b_id is not null").join(at, (F.col("view") == F.col("f_view")) & (F.col("frame") == F.col("f_frame")))
    out = (F.col("b_y1") < F.col("y1")) | (F.col("b_y2") > F.col("y2")) | F.coalesce((F.col("b_x1") < F.col("x1")) | (F.col("b_x2") > F.col("x2")), F.lit(False))
    outer = both.filter(out).select("view", "frame", "member", F.lit("not-inside").alias("fault"))
    size = canvas.select(F.col("view").alias("c_view"), "width", "height")
    beyond = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("width")) | (F.col("y2") > F.col("height"))
    off = frames.join(size, F.col("view") == F.col("c_view")).filter(beyond & F.col("x1").isNotNull()).select("view", "frame", F.lit(None).cast("string").alias("member"), F.lit("off-canvas").alias("fault"))
    return lost.unionByName(outer).unionByName(off).distinct()


def label_faults(labels: DataFrame, boxes: DataFrame, segments: DataFrame, gap: int = GAP) -> DataFrame:
    """``view``, ``route``, ``on``, ``other``: labels of routes (view, route, x1, y1, x2, y2) that
    lie over a box, over another route's segment, or closer than ``gap`` to another
    label, found by the cells of a grid.

    What lies in one place meets others as one row, and only ids of several places can be
    found twice: pairs of the others, which may be many, go through no exchange."""
    rect = ["x1", "y1", "x2", "y2"]
    on = ["view", "many"]

    def placed(boxes: DataFrame) -> DataFrame:
        own = boxes.distinct()
        several = own.groupBy("view", "id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("view").alias("s_view"), F.col("id").alias("s_id"), F.lit(True).alias("several"))
        known = own.join(several, F.col("view").eqNullSafe(F.col("s_view")) & F.col("id").eqNullSafe(F.col("s_id")), "left")
        return stage(stacked(known.select("view", "id", *rect, F.coalesce("several", F.lit(False)).alias("many")), on), "stacks")

    def told(pairs: DataFrame, mark: str, several: Column) -> DataFrame:
        named = lambda rows: rows.select("view", F.col("a_id").alias("route"), F.lit(mark).alias("on"), F.col("b_id").cast("string").alias("other"))
        return named(pairs.filter(~several)).union(named(pairs.filter(several)).distinct())

    over = (F.col("a_x1") < F.col("b_x2")) & (F.col("a_x2") > F.col("b_x1")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("a_y2") > F.col("b_y1"))
    masks = placed(labels.select("view", F.col("route").alias("id"), *rect))
    view, many = F.col("a_view").alias("view"), F.col("a_many") | F.col("b_many")

    solid = placed(boxes.select("view", "id", *rect))
    met = touching(masks, solid, ["view"], CELL).filter(over).select(view, many.alias("many"), "a_held", "b_held")
    met = met.select("view", "many", "b_held", F.explode("a_held").alias("x")).select("view", "many", "x", F.explode("b_held").alias("y"))
    on_box = told(met.select("view", "many", F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id")), "box", F.col("many"))

    # A route's segments meet places first, which are few where labels lie on each other.
    lines = segments.select("view", F.col("route").alias("id"), F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    place = [*on, *rect]
    spots = stage(masks.select(*place).distinct(), "places")
    hits = touching(spots, lines, ["view"], CELL).filter(over).select(*[F.col(f"a_{c}").alias(f"h_{c}") for c in place], "b_id").distinct()
    crossed = hits.join(masks, [F.col(f"h_{c}") == F.col(c) for c in place]).select("view", "many", "b_id", F.explode("held").alias("x"))
    on_line = told(crossed.select("view", "many", F.col("x.id").alias("a_id"), "b_id").filter("a_id <> b_id"), "route", F.col("many"))

    wide = masks.withColumn("x2", F.col("x2") + gap).withColumn("y2", F.col("y2") + gap)
    near = pairs_within(wide.withColumn("part", F.struct("many", "part")), ["view"], CELL).filter(over)
    near = unstacked(near.withColumn("view", F.col("a_view")).withColumn("many", many), ["view", "many"])
    on_label = told(near, "label", F.col("many"))
    return on_box.union(on_line).union(on_label)
