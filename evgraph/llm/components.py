"""Connected components of links: forests of partitions, then alternating stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evgraph.llm.common import stage
from evgraph.storage import drop

#: Links that one task holds at once, 16 bytes each.
CHUNK = 500_000


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points at the least of its neighbourhood."""
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the least of these."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    joined = down.join(least, F.col("u") == F.col("w"))
    pulled = joined.filter(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return pulled.union(least.select(F.col("m").alias("a"), F.col("w").alias("b")))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the least of its component, and that least one."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(names))
    while True:
        # Hook the larger of two roots under the smaller, then point at the top.
        p, q = root[x], root[y]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != (up := root[root])).any():
            root = up
    other = root != np.arange(len(names))
    return names[root[other]], names[other]


def _local_stars(chunk: int):
    """What turns the links of a partition into stars, ``chunk`` links at a time."""

    def run(batches):
        held, n = [], 0

        def emit():
            part = pd.concat(held)
            a, b = stars(part["a"].to_numpy(), part["b"].to_numpy())
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= chunk:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    return run


def _observed(df: DataFrame) -> tuple[DataFrame, dict]:
    """``df`` staged, and its count and checksum, taken while it is written."""
    seen = Observation()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n"), mark), "links")
    return out, seen.get


def components(edges: DataFrame, rounds: int = 100, chunk: int = CHUNK) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (two long columns) but the
    least of each component, which is the root of the others.

    Links never leave the cluster. Tasks first turn ``chunk`` links at a time into
    stars, which is all there is to do where one chunk holds all. Then each round is
    two joins and two aggregations on the stars alone, staged in the shared folder;
    rounds grow with the logarithm of the longest chain of chunks, and over
    ``rounds`` of them is an error. Self links and repeated links are allowed; an
    empty table gives an empty result.
    """
    a, b = edges.columns
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")
    links, seen = _observed(pairs)
    chunks = -(-int(seen["n"]) // chunk)
    if not chunks:
        return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    # A little over the mean fits a chunk: what goes beyond starts another one.
    parts = chunks if chunks == 1 else 2 * chunks
    now, state = _observed(links.repartition(parts).mapInPandas(_local_stars(chunk), "a long, b long"))
    drop(links)
    for _ in range(rounds if chunks > 1 else 0):
        last, before = now, state
        now, state = _observed(_small_star(_large_star(now).distinct()).distinct())
        drop(last)
        if state == before:
            break
    else:
        if chunks > 1:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs (x, y) of n points connect: fewer than n."""
    parent, out = np.arange(n), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in range(0, len(x), 4096):
        a, b = x[k : k + 4096], y[k : k + 4096]
        p, q = parent[a], parent[b]
        while (parent[p] != p).any() or (parent[q] != q).any():
            p, q = parent[p], parent[q]
        for i, j in zip(a[p != q].tolist(), b[p != q].tolist(), strict=True):
            u, v = top(i), top(j)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((i, j))
    return out
