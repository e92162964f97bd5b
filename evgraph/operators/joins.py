"""Joins that Spark has no operator for, as equi joins with a choice after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column, sep: str = "/") -> Column:
    """All prefixes of a path at segment ends, longest first, the path included."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def first_candidate(rows: DataFrame, key: list[str], candidates: Column, known: DataFrame, known_key: str) -> DataFrame:
    """Priority join: of each row's ordered candidates the first that is known.

    Candidates become rows with their place, meet the known keys in an equi join,
    and the least place wins by aggregation: no sort within a group.
    """
    spread = rows.select(*key, F.posexplode(candidates).alias("place", "candidate"))
    hits = spread.join(known.select(F.col(known_key).alias("__known")), F.col("candidate") == F.col("__known"), "left_semi")
    best = F.min(F.struct("place", "candidate")).alias("best")
    return hits.groupBy(*key).agg(best).select(*key, "best.candidate", "best.place")


def longest_prefix(rows: DataFrame, key: list[str], path: Column, known: DataFrame, known_key: str) -> DataFrame:
    """The longest known prefix of each path, as the first of its shrinking ones:
    one equi join where a theta join would compare all pairs."""
    return first_candidate(rows, key, prefixes(path), known, known_key)


def innermost(points: DataFrame, key: list[str], at: str, spans: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """The narrowest span around each point, ties by name; rows without one keep a null.

    Spans fall into cells of the power of two that is no less than their length, two
    at most, and points into one cell of each size that occurs: an equi join whose
    rows are the points times the sizes of spans, never all pairs. Low and high are
    whole numbers.
    """
    inside = _inside(points, key, at, spans, low, high, name)
    best = inside.groupBy(*key).agg(F.min(F.struct("width", F.col("bound").alias("name"))).alias("best"))
    left = best.select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("best.name").alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in key]
    return points.select(*key).distinct().join(left, on, "left").select(*key, name)


def narrowest(points: DataFrame, key: list[str], at: str, spans: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """What the narrowest span around each point binds, "" where spans of that width
    disagree; points outside all spans are left out."""
    inside = _inside(points, key, at, spans, low, high, name)
    by = inside.groupBy(*key, "width").agg(F.count_distinct("bound").alias("n"), F.min("bound").alias("bound"))
    best = by.groupBy(*key).agg(F.min(F.struct("width", "n", "bound")).alias("b"))
    return best.select(*key, F.when(F.col("b.n") == 1, F.col("b.bound")).otherwise("").alias(name))


def _inside(points: DataFrame, key: list[str], at: str, spans: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """``key``, ``width``, ``bound`` of all spans around each point, by cells."""
    width = F.col(high) - F.col(low)
    level = F.ceil(F.log2(F.greatest(width, F.lit(0)) + 1)).cast("int")
    sized = spans.filter(F.col(low) <= F.col(high)).select(F.col(low).alias("s_low"), F.col(high).alias("s_high"), F.col(name).alias("bound"), width.alias("width"), level.alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    placed = sized.select("*", F.explode(F.sequence(F.floor(F.col("s_low") / size), F.floor(F.col("s_high") / size))).alias("cell"))
    levels = sized.agg(F.collect_set("level").alias("levels"))  # sixty-four at most
    each = points.select(*key, F.col(at).alias("p_at")).crossJoin(F.broadcast(levels)).select(*key, "p_at", F.explode("levels").alias("p_level"))
    each = each.withColumn("p_cell", F.floor(F.col("p_at") / F.pow(F.lit(2.0), F.col("p_level"))))
    met = each.join(placed, (F.col("p_level") == F.col("level")) & (F.col("p_cell") == F.col("cell")) & (F.col("p_at") >= F.col("s_low")) & (F.col("p_at") <= F.col("s_high")))
    return met.select(*key, "width", "bound")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], low: str, high: str, width: float) -> DataFrame:
    """Pairs of intervals [low, high] with equal ``on`` that share a point.

    Each interval is put into the cells of ``width`` it touches, so the join is an
    equi join on the cell; a pair is kept in the cell where its overlap begins.
    """

    def cells(df: DataFrame, tag: str) -> DataFrame:
        span = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns], F.explode(span).alias(f"{tag}_cell"))

    x, y = cells(a, "a"), cells(b, "b")
    equal = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on] + [F.col("a_cell") == F.col("b_cell")]
    meet = (F.col(f"a_{low}") <= F.col(f"b_{high}")) & (F.col(f"b_{low}") <= F.col(f"a_{high}"))
    once = F.col("a_cell") == F.floor(F.greatest(f"a_{low}", f"b_{low}") / width)
    return x.join(y, equal).filter(meet & once).drop("a_cell", "b_cell")


def touching(a: DataFrame, b: DataFrame, on: list[str], size: float) -> DataFrame:
    """Pairs of rectangles (x1, y1, x2, y2) with equal ``on`` that share a point, as columns
    ``a_`` and ``b_``. Each is put into the cells of a grid that it touches, so the join is
    an equi join on the cell; a pair is kept in the one cell where its overlap begins."""

    def cells(df: DataFrame, tag: str) -> DataFrame:
        along = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
        named = df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns], along("x1", "x2").alias("xs"), along("y1", "y2").alias("ys"))
        return named.withColumn(f"{tag}_cx", F.explode("xs")).withColumn(f"{tag}_cy", F.explode("ys")).drop("xs", "ys")

    x, y = cells(a, "a"), cells(b, "b")
    equal = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*on, "cx", "cy")]
    meet = (F.col("a_x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("a_y2"))
    once = (F.col("a_cx") == F.floor(F.greatest("a_x1", "b_x1") / size)) & (F.col("a_cy") == F.floor(F.greatest("a_y1", "b_y1") / size))
    return x.join(y, equal).filter(meet & once).drop("a_cx", "a_cy", "b_cx", "b_cy")


#: Ids that a row of ``stacked`` holds at most, about.
STACK = 1000


def stacked(boxes: DataFrame, on: list[str]) -> DataFrame:
    """Rectangles (id, x1, y1, x2, y2 and ``on``) of one place as rows that hold their ids
    (``held``: structs), each about ``STACK`` at most; ``part`` tells rows of a place apart."""
    place = [*on, "x1", "y1", "x2", "y2"]
    crowded = boxes.groupBy(*place).agg(F.count("*").alias("n")).filter(F.col("n") > STACK)
    crowded = crowded.select(*[F.col(c).alias(f"c_{c}") for c in place], F.ceil(F.col("n") / STACK).alias("parts"))
    known = boxes.join(crowded, [F.col(c) == F.col(f"c_{c}") for c in place], "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part")
    return known.select("id", *place, part).groupBy(*place, "part").agg(F.collect_list(F.struct("id")).alias("held"))


def pairs_within(stacks: DataFrame, on: list[str], size: float) -> DataFrame:
    """Rows of ``stacked`` that touch each other or themselves, each two once, as columns
    ``a_`` and ``b_``; ``same`` where both are one."""
    key = lambda tag: F.struct(*[F.col(f"{tag}_{c}") for c in (*on, "x1", "y1", "x2", "y2", "part")])
    return touching(stacks, stacks, on, size).filter(key("a") <= key("b")).withColumn("same", key("a") == key("b"))


def unstacked(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``a_id``, ``b_id`` with a_id < b_id, and ``keep``, of pairs of rows of ``stacked``:
    ids are dealt out where the rows met, so what is found goes through no exchange."""
    each = pairs.select(*keep, "same", "b_held", F.explode("a_held").alias("x")).select(*keep, "same", "x", F.explode("b_held").alias("y"))
    each = each.filter(F.when(F.col("same"), F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id")))
    return each.select(*keep, F.least("x.id", "y.id").alias("a_id"), F.greatest("x.id", "y.id").alias("b_id"))


def absent_within(rows: DataFrame, key: list[str], at: str, others: DataFrame, other_at: str, ahead: int) -> DataFrame:
    """Rows with no partner of equal ``key`` at ``at`` + 1 to ``at`` + ``ahead``."""
    spread = others.select(*[F.col(k).alias(f"o_{k}") for k in key], F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda d: F.col(other_at) - d)).alias("o_at")).distinct()
    on = [F.col(k) == F.col(f"o_{k}") for k in key] + [F.col(at) == F.col("o_at")]
    return rows.join(spread, on, "left_anti")
