"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import mix64, permute, stage, without

#: Counts from which numpy's hypergeometric draw gives way to the one below.
_NUMPY_MOST = 10**9 - 1


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, for any population.

    Beyond numpy's range: the ratio-of-uniforms rejection with a table mountain hat
    around the mode, with log-factorials in double precision.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad <= _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1))) if total > 1 else 0.0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max(int((n + 1) * (good + 1) / (total + 2)), low), high)
    lf = lambda k: math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1)
    at_mode, width = lf(mode), 2 * math.sqrt(2 / math.e) * (sd + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= at_mode - lf(k):
            return k


def multivariate(rng: np.random.Generator, totals: np.ndarray, n: int) -> np.ndarray:
    """Split ``n`` draws without replacement over the categories of ``totals``."""
    if totals.sum() <= _NUMPY_MOST:
        return rng.multivariate_hypergeometric(totals, n, method="marginals")
    out, rest = np.zeros_like(totals), int(totals.sum())
    for j, t in enumerate(totals.tolist()):
        rest -= t
        out[j] = _hypergeometric(rng, t, rest, n)
        n -= int(out[j])
    return out


class SplitTree:
    """The rows of a random matrix with given row and column sums, one at a time.

    Row sums are the sizes of leaves, column sums the totals of categories. Each
    node of a binary tree over the leaves draws how much of every category goes
    left, from a generator seeded by the node; so any task finds the row of its
    leaf, and what earlier leaves took, in log(leaves) draws, and all tasks agree.
    """

    def __init__(self, leaves: np.ndarray, totals: np.ndarray, seed: int):
        self.ends = np.concatenate([[0], np.cumsum(np.asarray(leaves, dtype=np.int64))])
        self.totals, self.seed = np.asarray(totals, dtype=np.int64), seed
        if self.ends[-1] != self.totals.sum():
            raise ValueError(f"leaves hold {self.ends[-1]}, categories {self.totals.sum()}")

    def row(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """What the leaf gets of each category, and what all leaves before it got."""
        low, high = 0, len(self.ends) - 1
        here, before = self.totals.copy(), np.zeros_like(self.totals)
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left = multivariate(rng, here, int(self.ends[middle] - self.ends[low]))
            if leaf < middle:
                here, high = left, middle
            else:
                here, before, low = here - left, before + left, middle
        return here, before


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 20) -> DataFrame:
    """Add ``shard`` and ``slot``: a uniform random order cut into shards whose row
    counts differ by one at most; rows come out grouped by shard, in slot order.

    The input is staged once, which fixes each row's block (its partition) and place.
    Only the row count of every block goes to the driver: one number per partition.
    Every task then draws its block's row of the communication matrix, permutes its
    places by a keyed bijection, sends each to its shard, and permutes the arrivals
    of each shard by another: no sort, no window and one exchange of the rows, into
    partitions of equal row counts, so no source, key or group of copies is hot.

    Nulls, empty and very long texts are rows like any other, and so is each
    repetition of a row. Shards beyond the rows stay empty; an empty table gives an
    empty result. Input columns named ``shard`` or ``slot`` in any case are replaced.
    """
    spark = docs.sparkSession
    at = "__evgraph_at"
    base = without(docs, "shard", "slot", at).withColumn(at, F.monotonically_increasing_id())
    staged = stage(base, "shard")
    counts = staged.groupBy(F.shiftright(at, 33).alias("b")).count().orderBy("b").collect()
    blocks = np.array([r["b"] for r in counts], dtype=np.int64)
    sizes = np.array([r["count"] for r in counts], dtype=np.int64)
    n = int(sizes.sum())
    per, over = divmod(n, n_shards)
    shards = np.array([per + (j < over) for j in range(n_shards)], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(shards)])[:-1]
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))

    @F.pandas_udf("shard int, slot long, part int")
    def place(ids: pd.Series) -> pd.DataFrame:
        ids = ids.to_numpy()
        which = np.searchsorted(blocks, ids >> 33)
        tree = SplitTree(sizes, shards, seed)
        to, slot = np.empty(len(ids), dtype=np.int64), np.empty(len(ids), dtype=np.int64)
        for i in np.unique(which).tolist():
            mine = np.flatnonzero(which == i)
            row, before = tree.row(i)
            local = permute(ids[mine] & ((1 << 33) - 1), sizes[i], mix64(np.array([seed * 2 + 1])) + np.uint64(i))
            ends = np.cumsum(row)
            to[mine] = np.searchsorted(ends, local, side="right")
            slot[mine] = before[to[mine]] + local - (ends - row)[to[mine]]
        slot = permute(slot, shards[to], mix64(np.array([seed * 2])) + to.astype(np.uint64))
        part = (starts[to] + slot) * parts // max(n, 1)
        return pd.DataFrame({"shard": to.astype(np.int32), "slot": slot, "part": part.astype(np.int32)})

    placed = staged.withColumn("__evgraph_to", place(at)).drop(at)
    kept = [c for c in placed.columns if c != "__evgraph_to"]
    dealt = placed.repartitionById(parts, F.col("__evgraph_to.part"))
    out = dealt.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], "__evgraph_to.shard", "__evgraph_to.slot")
    return out.sortWithinPartitions("shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard without rows has no folder, and
    an empty table none at all. Nulls, long texts and repeated rows are written as they
    are; ``shard`` becomes the folder's name."""
    sharded.write.partitionBy("shard").parquet(path)
