"""What the training-data operators share: words, shared storage, permutations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.storage import counted, drop_staged, shared_dir, stage

__all__ = ["SPACE", "WORD", "counted", "drop_staged", "mix64", "permute", "quoted", "read", "shared_dir", "stage", "without", "word_count", "words_of"]

#: The white space that separates words; every other code point is part of one.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names, in any case, an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of [0, n), row by row: a Feistel network on the least even
    number of bits that holds n, walked along its cycle until it lands below n.

    It needs no sort and no other row, so a permutation of any block or shard is
    the same however its rows are spread over tasks.
    """
    x, n, key = (np.asarray(v).astype(np.uint64) for v in np.broadcast_arrays(x, n, key))
    top = np.maximum(n, 2) - np.uint64(1)
    bits = np.frexp(top.astype(np.float64))[1].astype(np.uint64)
    half = np.maximum((bits + np.uint64(1)) >> np.uint64(1), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(5):
            left, right = right, left ^ (mix64(right ^ mix64(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)
