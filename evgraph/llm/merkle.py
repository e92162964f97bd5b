"""Merkle manifests: one digest for a table and a proof for each row, by merging forests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evgraph.llm.common import counted, quoted, stage

#: Children that a node has, but for the last one of its level.
ARITY = 3
#: Fragments that one merge takes.
FAN_IN = 16
#: Leaves that a partition holds, about.
PART_ROWS = 25_000
#: The tree over the roots of all groups; groups have their rank from 0.
TOP = -1

#: A node of a forest: its tree, its level (leaves 0) and its place in the level.
Key = tuple[int, int, int]


def leaf(*fields: Column) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its UTF-8 bytes after their number."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""

    def up(digest: Column, step: Column) -> Column:
        left = F.slice(step.others, F.lit(1), step.place)
        right = F.slice(step.others, step.place + 1, F.size(step.others))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")).cast("binary"), 256)

    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda step: step.others)), "").cast("binary"), 256)


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes at a level of a tree of so many leaves."""
    return -(-leaves // arity**level)


def settle(nodes: dict[Key, str], sizes: dict[int, int], arity: int = ARITY, seen: dict[Key, str] | None = None) -> dict[Key, str]:
    """A forest without runs of siblings that are all there: each has become its parent,
    and a tree that is whole the leaf of its group in the tree over all groups.

    ``sizes`` are the leaves of each tree, so that it is known how many siblings a run
    has. ``seen`` gets every node that was there or was made.
    """
    if seen is not None:
        seen.update(nodes)
    todo = {(tree, level, at // arity) for tree, level, at in nodes}
    while todo:
        tree, level, run = todo.pop()
        here = width(sizes[tree], level, arity)
        if here == 1:
            if tree == TOP:
                continue
            key, digest = (TOP, 0, tree), nodes.pop((tree, level, 0))
        else:
            run_of = [(tree, level, i) for i in range(run * arity, min(here, (run + 1) * arity))]
            if not all(k in nodes for k in run_of):
                continue
            key, digest = (tree, level + 1, run), hashlib.sha256("".join([nodes.pop(k) for k in run_of]).encode()).hexdigest()
        nodes[key] = digest
        if seen is not None:
            seen[key] = digest
        todo.add((key[0], key[1], key[2] // arity))
    return nodes


def merge(fragments: Iterable[dict[Key, str]], sizes: dict[int, int], arity: int = ARITY, seen: dict[Key, str] | None = None) -> dict[Key, str]:
    """The operation of the monoid: what is unresolved in all fragments, settled. It is
    associative, and the empty forest is its neutral element."""
    nodes: dict[Key, str] = {}
    for fragment in fragments:
        nodes |= fragment
    return settle(nodes, sizes, arity, seen)


def outside(spans: list[tuple[int, int, int, int]], groups: int, arity: int = ARITY) -> list[Key]:
    """The nodes that proofs of a partition's leaves can need and that do not follow from
    these leaves alone. ``spans``: group, first leaf, leaves, leaves of the whole group."""
    out: set[Key] = set()

    def along(tree: int, first: int, last: int, have: tuple[int, int], leaves: int) -> None:
        level, step = 0, 1
        while width(leaves, level, arity) > 1:
            for run in {first // step // arity, last // step // arity}:
                for i in range(run * arity, min(width(leaves, level, arity), (run + 1) * arity)):
                    if not (have[0] <= i * step and min(leaves, (i + 1) * step) <= have[1]):
                        out.add((tree, level, i))
            level, step = level + 1, step * arity

    whole = []
    for tree, first, n, leaves in spans:
        along(tree, first, first + n - 1, (first, first + n), leaves)
        if n == leaves:
            whole.append(tree)
    trees = [s[0] for s in spans]
    if trees:
        along(TOP, min(trees), max(trees), (min(whole), max(whole) + 1) if whole else (0, 0), groups)
    return sorted(out)


def _ordered(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` (``g``, ``o``, ``leaf``, ``row``) in order, with the partition and the place
    there; the stretches of groups in partitions; and the number of groups.

    One range exchange sorts. Partitions are counted by group, and places in a group are
    prefix sums over the partitions that hold it, so neither a group nor the table is
    numbered in one place. Only a number a partition reaches the driver.
    """
    held, n = counted(rows.withColumn("tie", F.rand(11)), "leaves")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > part_rows else 1, -(-n // part_rows))
    order = [F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    at = F.monotonically_increasing_id()
    placed = held.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", at)
    part, pos = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")
    placed = placed.select(part, pos, "g", "leaf", "row")
    placed = stage(placed, "ordered")
    spans = placed.groupBy("part", "g").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stage(spans.withColumn("first", before).withColumn("leaves", F.sum("n").over(of_group)), "stretches")
    starts = {r["part"]: r["k"] for r in spans.filter("first = 0").groupBy("part").agg(F.count("*").alias("k")).collect()}
    base = np.cumsum([0, *[k for _, k in sorted(starts.items())]]).tolist()
    bases = spark.createDataFrame(list(zip(sorted(starts), base[:-1], strict=True)), "p long, base long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("g").asc_nulls_first())) - 1
    begun = spans.filter("first = 0").withColumn("r", rank).join(bases, F.col("part") == F.col("p"))
    ranks = begun.select(F.col("g").alias("of"), (F.col("base") + F.col("r")).alias("tree"))
    spans = spans.join(ranks, F.col("g").eqNullSafe(F.col("of"))).select("part", "tree", "pos", "n", "first", "leaves")
    return placed, stage(spans, "spans"), base[-1]


_NODES = "part long, tree long, leaves long, level int, at long, digest string, open boolean"


def _fragment(part: int, nodes: dict[Key, str], still: dict[Key, str], sizes: dict[int, int]) -> pa.Table:
    keys = list(nodes)
    return pa.table({
        "part": pa.array([part] * len(keys), pa.int64()),
        "tree": pa.array([k[0] for k in keys], pa.int64()),
        "leaves": pa.array([sizes[k[0]] for k in keys], pa.int64()),
        "level": pa.array([k[1] for k in keys], pa.int32()),
        "at": pa.array([k[2] for k in keys], pa.int64()),
        "digest": pa.array([nodes[k] for k in keys], pa.string()),
        "open": pa.array([k in still for k in keys], pa.bool_()),
    })


def _leaves_of(rows: pa.Table, spans: list[dict]) -> list[Key | None]:
    """The node that each row of a partition is."""
    by_place: list[Key | None] = [None] * rows.num_rows
    for s in spans:
        for k in range(s["n"]):
            by_place[s["pos"] + k] = (s["tree"], 0, s["first"] + k)
    return [by_place[p] for p in rows["pos"].to_pylist()]


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = ARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``subroot``, ``root`` and ``proof`` to every row, a leaf by its column ``digest``.

    In each group leaves ascend by ``order``; every ``arity`` consecutive nodes (the last
    of a level may be fewer) become the SHA-256 of their hexadecimal digests, until one,
    the ``subroot``, is left. Subroots, in the order of their groups, likewise give
    ``root``. ``proof`` has a step a level up to the root: the node's ``place`` among its
    siblings and the ``others``; ``fold`` gives the root from a leaf and its proof.

    Leaves are sorted by range into partitions, of which each settles its own: what is
    left are the nodes at its two ends, a few a level. Such fragments are merged
    ``FAN_IN`` at a time, in staged rounds of a tree, until one is left; every node
    that was ever unresolved or came of a merge is kept, at most a few dozen a partition
    and round. A partition then joins the nodes it lacks for its proofs by their keys. No
    task holds a group, however large, and the driver only a number a partition.

    Groups and orders may be null, which comes first. Rows of one order ascend by
    their digests, equal rows in any order, which changes no digest. Empty tables give
    empty results, a lone leaf is its own subroot. Columns named like an added one, in
    any case, are replaced; all others pass through, whatever their names.
    """
    added = ("subroot", "root", "proof")
    if digest.lower() in added or not 2 <= arity <= 1000:
        raise ValueError("the digest may not be a column that is added, and runs take 2 to 1000 nodes")
    names = [c for c in rows.columns if c.lower() not in added]
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    narrow = rows.select(quoted(group).cast("string").alias("g"), quoted(order).alias("o"), quoted(digest).alias("leaf"), row.alias("row"))
    placed, spans, groups = _ordered(narrow, part_rows)
    by_part = lambda df: df.groupBy("part")

    def settled(leaves: pa.Table, spans: pa.Table) -> pa.Table:
        at = spans.to_pylist()
        sizes = {s["tree"]: s["leaves"] for s in at} | {TOP: groups}
        nodes = dict(zip(_leaves_of(leaves, at), leaves["leaf"].to_pylist(), strict=True))
        left = settle(nodes, sizes, arity)
        return _fragment(at[0]["part"], left, left, sizes)

    def merged(nodes: pa.Table) -> pa.Table:
        at = nodes.to_pylist()
        sizes = {s["tree"]: s["leaves"] for s in at} | {TOP: groups}
        seen: dict[Key, str] = {}
        left = merge([{(s["tree"], s["level"], s["at"]): s["digest"]} for s in at], sizes, arity, seen)
        return _fragment(at[0]["part"], seen, left, sizes)

    def lacking(spans: pa.Table) -> pa.Table:
        at = spans.to_pylist()
        keys = outside([(s["tree"], s["first"], s["n"], s["leaves"]) for s in at], groups, arity)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
        return pa.table([pa.array([at[0]["part"]] * len(keys), pa.int64()), *columns], names=["part", "t", "l", "a"])

    pieces = by_part(placed.select("part", "pos", "leaf")).cogroup(by_part(spans)).applyInArrow(settled, _NODES)
    rounds = [stage(pieces, "fragments")]
    parts = placed.agg(F.max("part")).first()[0] or 0
    while parts:
        parts //= FAN_IN
        up = F.expr(f"part div {FAN_IN}").alias("part")
        open_ = rounds[-1].filter("open").select(up, "tree", "leaves", "level", "at", "digest", "open")
        rounds.append(stage(by_part(open_).applyInArrow(merged, _NODES), "fragments"))
    known = rounds[0]
    for made in rounds[1:]:
        known = known.union(made)
    known = known.select("tree", "level", "at", "digest").distinct()
    lack = by_part(spans).applyInArrow(lacking, "part long, t long, l int, a long")
    same = (F.col("tree") == F.col("t")) & (F.col("level") == F.col("l")) & (F.col("at") == F.col("a"))
    beside = lack.join(known, same).select("part", "tree", "level", "at", "digest")
    sides = spans.unionByName(beside, allowMissingColumns=True)
    steps = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))

    def proved(leaves: pa.Table, sides: pa.Table) -> pa.Table:
        sides = sides.to_pylist()
        at = [s for s in sides if s["digest"] is None]
        sizes = {s["tree"]: s["leaves"] for s in at} | {TOP: groups}
        keys, seen = _leaves_of(leaves, at), {}
        nodes = {(s["tree"], s["level"], s["at"]): s["digest"] for s in sides if s["digest"] is not None}
        settle(nodes | dict(zip(keys, leaves["leaf"].to_pylist(), strict=True)), sizes, arity, seen)
        top = next(level for level in range(200) if width(groups, level, arity) == 1)
        above: dict[Key, list[dict]] = {}

        def way(key: Key) -> list[dict]:
            tree, level, i = key
            here = width(sizes[tree], level, arity)
            if here == 1:
                return [] if tree == TOP else above_of((TOP, 0, tree))
            run = i // arity
            others = [seen[tree, level, k] for k in range(run * arity, min(here, (run + 1) * arity)) if k != i]
            return [{"place": i - run * arity, "others": others}, *above_of((tree, level + 1, run))]

        def above_of(key: Key) -> list[dict]:
            if key not in above:
                above[key] = way(key)
            return above[key]

        proofs = pa.array([way(k) for k in keys], steps)
        subroot = pa.array([seen[TOP, 0, k[0]] for k in keys], pa.string())
        root = pa.array([seen[TOP, top, 0]] * len(keys), pa.string())
        return pa.table([*leaves.select(["row"]).columns, subroot, root, proofs], names=["row", *added])

    kind = placed.schema["row"].dataType.simpleString()
    schema = f"row {kind}, subroot string, root string, proof array<struct<place: int, others: array<string>>>"
    out = by_part(placed.select("part", "pos", "leaf", "row")).cogroup(by_part(sides)).applyInArrow(proved, schema)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *added)
