"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import mix64, permute, quoted, stage, without, word_count
from evgraph.llm.sharding import SplitTree

#: Bits of a key that one round of the search for a cut resolves.
_ROUND = 12
_KEY_BITS = 60


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Shares of the sum of all sizes by weight, none above ``most`` times its own
    size: the excess goes to the others by weight until none is above."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    out, capped = np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
    while not capped.all():
        free = ~capped
        left = sizes.sum() - most * sizes[capped].sum()
        out[free] = left * weights[free] / weights[free].sum()
        over = free & (out > most * sizes)
        out[over] = most * sizes[over]
        if not over.any():
            break
        capped |= over
    return out


@dataclass
class _Cut:
    """How far into a source's random order the partial pass goes: all keys below
    ``key`` and, among equal keys, all rows whose tie number is below ``tie``."""

    want: int
    taken: int = 0
    key: int = 0
    tie: int = 0


def _cuts(staged: DataFrame, want: dict[str, int]) -> dict[str, _Cut]:
    """The longest prefix by (key, tie) of each source that holds at most ``want``.

    A weighted quantile by histograms: each round resolves 12 more bits for the one
    bucket per source that straddles its cut. A source's rows are never sorted or
    gathered, only its 2^12 bucket sums are; the driver gets one short row per source
    and round. Rounds end when no straddling bucket holds over one row: two for up to
    millions of rows a source.
    """
    cuts = {s: _Cut(w) for s, w in want.items() if w > 0}
    live, column, shift = set(cuts), "__evgraph_key", _KEY_BITS
    spark = staged.sparkSession
    while live:
        shift -= _ROUND
        if shift < 0:
            if column == "__evgraph_tie":
                break
            column, shift = "__evgraph_tie", _KEY_BITS - _ROUND
        prefix = [(s, cuts[s].key, cuts[s].tie, cuts[s].want - cuts[s].taken) for s in sorted(live)]
        at = spark.createDataFrame(prefix, "s string, k long, t long, gap long")
        mine = (F.col("__evgraph_source") == F.col("s")) if column == "__evgraph_key" else (
            (F.col("__evgraph_source") == F.col("s")) & (F.col("__evgraph_key") == F.col("k"))
        )
        value, base = F.col(column), F.col("k" if column == "__evgraph_key" else "t")
        inside = F.shiftrightunsigned(value, shift + _ROUND) == F.shiftrightunsigned(base, shift + _ROUND)
        bucket = F.shiftrightunsigned(value, shift)
        sums = (
            staged.join(F.broadcast(at), mine)
            .filter(inside)
            .groupBy("s", "gap", bucket.alias("b"))
            .agg(F.sum("__evgraph_size").alias("size"), F.count("*").alias("n"))
        )
        upto = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("s").orderBy("b")))
        fits = F.col("upto") <= F.col("gap")
        found = upto.groupBy("s").agg(
            F.max(F.when(fits, F.col("upto"))).alias("fit"),
            F.min(F.when(~fits, F.struct("b", "n"))).alias("over"),
            F.max("b").alias("last"),
        )
        for row in found.collect():
            cut = cuts[row["s"]]
            cut.taken += row["fit"] or 0
            b = row["over"]["b"] if row["over"] else row["last"] + 1
            if not row["over"] or row["over"]["n"] <= 1:
                live.discard(row["s"])
            if column == "__evgraph_key":
                cut.key = b << shift
            else:
                cut.tie = b << shift
    return cuts


@dataclass
class _Gap:
    """What a source still takes beyond its prefix, for a ``gap`` of missing words.

    ``spans`` are further stretches of the order from (key, tie) to (key, tie), of
    which rows up to a size are taken; ``rows`` are single rows. ``best`` is the least
    miss of ending with one row that is too long: miss, spans and rows kept, row.
    """

    key: int
    tie: int
    gap: int
    spans: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    rows: list[tuple[int, int]] = field(default_factory=list)
    best: tuple[int, int, int, tuple[int, int]] | None = None


def _close(staged: DataFrame, gaps: dict[str, _Gap]) -> None:
    """Fill each gap until no row that is left fits, then take a row too long for it,
    now or at an earlier step, if that misses by less.

    A row that doesn't fit is skipped. While the gap is at least twice the largest
    row that fits, the prefix goes on over all rows that do, by the search of
    ``_cuts``; else the largest that fits is taken. Either more than halves the gap
    or leaves no row that fits, so the rounds are at most its logarithm.
    """
    live, spark = {s for s, g in gaps.items() if g.gap > 0}, staged.sparkSession
    key, tie, size = F.col("__evgraph_key"), F.col("__evgraph_tie"), F.col("__evgraph_size")
    while live:
        at = [(s, (g := gaps[s]).key, g.tie, g.gap, [f"{k}/{t}" for k, t in g.rows]) for s in sorted(live)]
        per = spark.createDataFrame(at, "s string, k long, t long, gap long, had array<string>")
        beyond = (key > F.col("k")) | ((key == F.col("k")) & (tie >= F.col("t")))
        new = ~F.array_contains("had", F.concat_ws("/", key.cast("string"), tie.cast("string")))
        left = staged.join(F.broadcast(per), (F.col("__evgraph_source") == F.col("s")) & beyond & (size > 0) & new)
        row, fits = F.struct(size.alias("z"), key.alias("k"), tie.alias("t")), size <= F.col("gap")
        found = left.groupBy("s").agg(F.max(F.when(fits, row)).alias("fit"), F.min(F.when(~fits, row)).alias("over")).collect()
        live, on = set(), {}
        for r in found:
            g, fit, over = gaps[r["s"]], r["fit"], r["over"]
            if over and (miss := over["z"] - g.gap) < (g.best[0] if g.best else g.gap):
                g.best = (miss, len(g.spans), len(g.rows), (over["k"], over["t"]))
            if not fit:
                continue
            live.add(r["s"])
            if g.gap >= 2 * fit["z"]:
                on[r["s"]] = g.gap
            else:
                g.rows.append((fit["k"], fit["t"]))
                g.gap -= fit["z"]
        if on:
            rest = left.filter(fits & F.col("s").isin(list(on))).select(*staged.columns)
            for s, cut in _cuts(rest, on).items():
                g = gaps[s]
                end = max((cut.key, cut.tie), (g.key, g.tie))
                g.spans.append((g.key, g.tie, *end, g.gap))
                g.key, g.tie = end
                g.gap -= cut.taken
        live = {s for s in live if gaps[s].gap > 0}
    for g in gaps.values():
        if g.best and g.best[0] < g.gap:
            _, n_spans, n_rows, last = g.best
            g.spans, g.rows, g.gap = g.spans[:n_spans], [*g.rows[:n_rows], last], -g.best[0]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    n_shards: int = 32,
    block_rows: int = 256,
    max_sources: int = 100_000,
    seed: int = 11,
) -> DataFrame:
    """All rows of ``docs`` with the ``copies`` the mix takes of them.

    Adds ``size`` (words), ``source_size``, ``target``, ``taken`` (words taken, with
    repeats) and ``copies``, an array of (epoch, shard, order), empty where a row is
    not taken. ``shuffled`` turns that into the mixed shards.

    Sources in code-point order, null last, get the weights of ``cycle`` in turn. A
    source gives whole passes as long as they fit its target, then a prefix of its
    random order, then rows after it until none that is left fits what is missing,
    or one that exceeds it by less. The random order is a hash of id and text, so
    reruns agree; equal rows are told apart by where they were staged.

    The hash order is cut into equal blocks of about ``block_rows`` rows. A tree of
    multivariate-hypergeometric draws splits the exact block quotas of all sources
    among the shards, and a keyed bijection deals each source's blocks, disjointly,
    to the quotas. All this is per source and shard: the driver holds one row per
    source (``max_sources`` at most, else ValueError) and tasks get a table of
    sources x shards. Rows are only ever mapped, never grouped: no hot source.

    Null and empty texts have size 0 and are never taken. Null ids and null sources
    are values like others. Empty tables give an empty result. Input columns named
    like an added one, in any case, are replaced.
    """
    names = ("size", "source_size", "target", "taken", "copies")
    src = F.when(quoted(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), quoted(source).cast("string")))
    top = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 64 - _KEY_BITS)
    base = without(docs, *names, "__evgraph_source", "__evgraph_size", "__evgraph_key", "__evgraph_tie")
    staged = stage(
        base.select(
            "*",
            src.alias("__evgraph_source"),
            word_count(quoted(text)).alias("__evgraph_size"),
            top(quoted(id_col), quoted(text)).alias("__evgraph_key"),
            top(F.monotonically_increasing_id()).alias("__evgraph_tie"),
        ),
        "mix",
    )
    narrow = staged.select("__evgraph_source", "__evgraph_size", "__evgraph_key", "__evgraph_tie")
    stats = narrow.groupBy("__evgraph_source").agg(F.sum("__evgraph_size").alias("size"), F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in stats.limit(max_sources + 1).collect())
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    keys = [r[0] for r in rows]
    sizes, counts = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2))
    goal = targets(sizes, np.array([cycle[i % len(cycle)] for i in range(len(rows))]), most)
    whole = np.where(sizes > 0, np.minimum(np.floor(goal / np.maximum(sizes, 1) + 1e-9), most), 0).astype(np.int64)
    want = np.maximum(np.rint(goal).astype(np.int64) - whole * sizes, 0)
    want[whole >= most] = 0
    cuts = _cuts(narrow, dict(zip(keys, want.tolist(), strict=True)))
    spark = docs.sparkSession
    gaps = {s: _Gap(c.key, c.tie, c.want - c.taken) for s, c in cuts.items() if c.want > c.taken}
    _close(narrow, gaps)
    extra = {s: g.rows for s, g in gaps.items()}
    spans = {s: g.spans for s, g in gaps.items()}
    bits = np.ceil(np.log2(np.maximum(counts / block_rows, 1))).astype(np.int64)
    ends_at = lambda s: spans[s][-1][2] if spans.get(s) else cuts[s].key if s in cuts else 0
    cut_key = np.array([ends_at(s) for s in keys], dtype=np.int64)
    last = np.where(want > 0, np.minimum(cut_key >> (_KEY_BITS - bits), (1 << bits) - 1) + 1, 0)
    # Each row that closes a gap is a block of its own, after the partial pass.
    partial = (whole * (1 << bits) + last).astype(np.int64)
    quota = partial + np.array([len(extra.get(s, ())) for s in keys], dtype=np.int64)
    total = int(quota.sum())
    per, over = divmod(total, n_shards)
    shards = np.array([per + (j < over) for j in range(n_shards)], dtype=np.int64)
    if total:
        tree = SplitTree(shards, quota, seed)
        ends = np.cumsum(np.stack([tree.row(j)[0] for j in range(n_shards)]), axis=0).T.copy()
    else:
        ends = np.zeros((len(keys), n_shards), dtype=np.int64)
    table = [
        (s, i, int(z), float(g), int(w), cuts[s].key if s in cuts else 0, cuts[s].tie if s in cuts else 0, [f"{k}/{t}" for k, t in extra.get(s, ())], spans.get(s, []), int(_KEY_BITS - b), int(1 << b))
        for i, (s, z, g, w, b) in enumerate(zip(keys, sizes, goal, whole, bits, strict=True))
    ]
    per_source = spark.createDataFrame(table, "s string, i long, source_size long, target double, w long, ck long, ct long, extra array<string>, spans array<struct<k:long,t:long,ek:long,et:long,most:long>>, sh long, nb long")

    @F.pandas_udf("array<int>")
    def deal(i: pd.Series, first: pd.Series, blocks: pd.Series, epochs: pd.Series, closes: pd.Series) -> pd.Series:
        n = epochs.to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        epoch = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        who = i.to_numpy()[row]
        at = epoch * blocks.to_numpy()[row] + first.to_numpy()[row]
        nth = closes.to_numpy()[row]
        at = np.where((nth > 0) & (epoch == whole[who]), partial[who] + nth - 1, at)
        at = permute(at, quota[who], mix64(who + np.int64(seed) * 7919))
        to = (at[:, None] >= ends[who]).sum(axis=1) if len(at) else at
        return pd.Series(np.split(to.astype(np.int32), np.cumsum(n)[:-1])) if len(n) else pd.Series([], dtype=object)

    k, t = F.col("__evgraph_key"), F.col("__evgraph_tie")
    # ck = ct = 0 where there is no partial pass, which takes nothing.
    closes = F.array_position("extra", F.concat_ws("/", k.cast("string"), t.cast("string")))
    before = lambda ek, et: (k < ek) | ((k == ek) & (t < et))
    in_span = F.exists("spans", lambda x: ~before(x["k"], x["t"]) & before(x["ek"], x["et"]) & (F.col("__evgraph_size") <= x["most"]))
    part = before(F.col("ck"), F.col("ct")) | in_span | (closes > 0)
    epochs = F.when(F.col("__evgraph_size") > 0, F.col("w") + part.cast("long")).otherwise(F.lit(0))
    joined = staged.join(F.broadcast(per_source), F.col("__evgraph_source") == F.col("s")).withColumn("__evgraph_n", epochs)
    block = F.expr("shiftrightunsigned(__evgraph_key, int(sh))")
    dealt = joined.withColumn("__evgraph_to", deal("i", block, "nb", "__evgraph_n", closes))
    order = lambda to, e: F.xxhash64(F.lit(seed + 1), k, t, e, to)
    copies = F.transform("__evgraph_to", lambda to, e: F.struct(e.cast("int").alias("epoch"), to.alias("shard"), order(to, e).alias("order")))
    kept = [quoted(c) for c in docs.columns if c.lower() not in names]
    return dealt.select(
        *kept,
        F.col("__evgraph_size").alias("size"),
        "source_size",
        "target",
        (F.col("__evgraph_size") * F.size("__evgraph_to")).alias("taken"),
        copies.alias("copies"),
    )


def shuffled(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of every copy with ``epoch`` and ``shard``, dealt
    by shard and random order and sorted by them, so each shard is shuffled.

    Rows that are not taken give none, whatever they hold; nulls and texts of any
    length pass through; copies of equal rows differ by their order. A column named
    like an added one is given twice, as asked. An empty table gives none."""
    rows = mixed.select(*[quoted(c) for c in columns], F.explode("copies").alias("__evgraph_copy"))
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ("__evgraph_copy.shard", "__evgraph_copy.order")
    dealt = rows.repartition(n, F.col(by[0]), F.pmod(F.col(by[1]), F.lit(n))).sortWithinPartitions(*by)
    return dealt.select(*[quoted(c) for c in columns], "__evgraph_copy.epoch", "__evgraph_copy.shard")
