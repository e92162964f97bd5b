"""SimHash near-duplicates: exact pairs by vantage-point trees over fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import mix64, quoted, stage, without
from evgraph.llm.components import components, forest

#: Fingerprints are two halves of 32 bits: where two differ in r bits, they differ in
#: r // 2 at most in one of the halves. Each half has a tree of its own.
HALVES = 2
#: Rows that live in a leaf of the trees, on average. A level more halves the comparisons
#: of a row and adds a quarter to its copies.
LEAF = 4096
#: Rows that one call of a task gets, about.
CALL_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype="<u8", count=n
    )
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Add ``fingerprint`` as a signed long. Null and empty texts have 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(signed(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)))

    return without(docs, "fingerprint").withColumn("fingerprint", of(quoted(text)))


def vantage_points(half: int, count: int) -> np.ndarray:
    """Fixed points of a half's 32-bit space, far apart: splitmix outputs."""
    return mix64(np.arange(count, dtype=np.uint64) + np.uint64(1000 * half)) & np.uint64(0xFFFFFFFF)


def tree_leaves(
    part: np.ndarray, points: np.ndarray, reach: int, width: int = 32, home: np.ndarray | None = None, first: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, leaves and whether the row lives there, in a tree with one vantage point
    a level, of which each splits the numbers ``part`` of ``width`` bits by their distance.
    ``home`` and ``first`` go on below a leaf of ``first`` levels and those who are there.

    A row lives in the leaf of its own distances. By the triangle inequality a
    neighbour within ``reach`` bits has distances within ``reach`` of its own, so the
    sides that these bounds rule out are pruned, and it visits the others. Of two
    neighbours in different leaves, the one on the inner side of the first boundary
    between them visits the other; the outer one need not look inside.
    """
    rows = np.arange(len(part))
    leaf, home = np.zeros(len(part), dtype=np.int64), np.ones(len(part), dtype=bool) if home is None else home
    for level, v in enumerate(points, first):
        cut = width // 2 - 1 + level % 2  # the mean distance is half the width
        far = np.bitwise_count(part[rows] ^ v).astype(np.int64)
        outer = far > cut
        over = np.where(outer, ~home & (far - reach <= cut), far + reach > cut)
        leaf = 2 * leaf + outer
        rows, leaf = np.concatenate([rows, rows[over]]), np.concatenate([leaf, leaf[over] ^ 1])
        home = np.concatenate([home, np.zeros(int(over.sum()), dtype=bool)])
    return rows, leaf, home


def links_in(fps: np.ndarray, home: np.ndarray, radius: int, leaf: int = 2048) -> np.ndarray:
    """A spanning forest of the links between distinct fingerprints of one leaf,
    as pairs; a pair of visitors (not ``home``) is left to the leaf they live in.

    An in-memory vantage-point tree: split at the median distance, hand whatever
    lies within ``radius`` of the boundary to both sides, compare small leaves.
    """
    fps = fps.view(np.uint64)
    order = np.arange(len(fps))
    parent = np.arange(len(fps))

    def roots(at: np.ndarray) -> np.ndarray:
        at = parent[at]
        while len(up := np.flatnonzero(parent[at] != at)):
            at[up] = parent[at[up]]
        return at

    out: list[tuple[int, int]] = []

    def join(i: int, others: np.ndarray) -> None:
        """Link i with one neighbour of every tree that it is not yet part of."""
        tops = roots(others)
        mine = roots(np.array([i]))[0]
        if (tops == mine).all():
            return
        for top, k in zip(*np.unique(tops, return_index=True), strict=True):
            if top != mine:
                out.append((i, int(others[k])))
                parent[max(top, mine)] = mine = min(top, mine)

    def compare(at: np.ndarray) -> None:
        own, step = at[home[at]], max(1, (1 << 20) // max(1, len(at)))
        for i in range(0, len(own), step):
            rows = own[i : i + step]
            near = np.bitwise_count(fps[rows][:, None] ^ fps[at][None, :]) <= radius
            near &= ~home[at][None, :] | (rows[:, None] < at[None, :])
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                join(int(rows[k]), at[near[k]])

    stack = [order]
    while stack:
        at = stack.pop()
        if len(at) * int(home[at].sum()) <= leaf * leaf:
            compare(at)
            continue
        best = None
        for v in fps[at[:: max(1, len(at) // 4)]][:4]:
            d = np.bitwise_count(fps[at] ^ v).astype(np.int64)
            m = int(np.median(d))
            for cut in (m - 1, m):
                inner, outer = int((d <= cut + radius).sum()), int((d >= cut + 1 - radius).sum())
                # Work of the two sides, which must both be smaller than the whole.
                if max(inner, outer) < len(at) and (best is None or inner**2 + outer**2 < best[0]):
                    best = (inner**2 + outer**2, d, cut)
        if best is None or best[0] > 0.9 * len(at) ** 2:
            compare(at)
            continue
        _, d, cut = best
        # A pair within the radius is together inside, or together outside.
        stack += [at[d <= cut + radius], at[d >= cut + 1 - radius]]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def links_of_leaves(fps: np.ndarray, home: np.ndarray, leaf: np.ndarray, radius: int, small: int = 32) -> np.ndarray:
    """Links that connect each of many leaves, whose rows stand together. Leaves of
    up to ``small`` rows are compared at once, row by row at growing distance;
    larger ones are searched by ``links_in``."""
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(leaf)))
    end = np.repeat(starts + sizes, sizes)
    out = [links_in(fps[s : s + n], home[s : s + n], radius) + s for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True)]
    rows, step, bits = np.flatnonzero(np.repeat(sizes <= small, sizes)), 0, fps.view(np.uint64)
    while len(rows := rows[rows + step + 1 < end[rows]]):
        step += 1
        near = (np.bitwise_count(bits[rows] ^ bits[rows + step]) <= radius) & (home[rows] | home[rows + step])
        if near.any():
            out.append(np.stack([rows[near], rows[near] + step], axis=1))
    if not out:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.concatenate(out)
    return np.array(forest(pairs[:, 0], pairs[:, 1], len(fps)), dtype=np.int64).reshape(-1, 2)


def fingerprint_links(fps: DataFrame, radius: int = 3, leaf_rows: int = 50_000, levels: int = 24, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` (distinct longs) within ``radius``.

    Two vantage-point trees, one for each half of the bits, of as many levels as give
    leaves of about ``leaf`` rows. Each row lives in one leaf of a tree and visits those
    that the triangle bounds leave over (``tree_leaves``); neighbours meet in the tree
    of the half in which they differ in ``radius // 2`` bits at most, where a level adds
    about a quarter to the visits. (Over all 64 bits at once, bounds of ``radius``
    would add more than half.)

    Leaves over ``leaf_rows`` (groups of near copies crowd together) are split again by
    distance to one of their own fingerprints in all 64 bits, at the median; rows
    within the radius of a boundary go to both sides. Each leaf then compares all 64
    bits of who lives there and who visits, and yields a spanning forest of its links,
    so a dense group of n gives fewer than n rows, never all pairs.
    """
    distinct = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, distinct) / leaf))))

    def spread(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            for half in range(HALVES):
                part = (fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                at, found, home = tree_leaves(part, vantage_points(half, depth), radius // HALVES)
                yield pd.DataFrame({"fp": fp[at], "leaf": found << 1 | half, "home": home})

    rows = fps.toDF("fp").mapInPandas(spread, "fp long, leaf long, home boolean")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    inside, outside = far <= F.col("cut") + radius, far >= F.col("cut") + 1 - radius
    for _ in range(levels):
        hot = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.min("fp").alias("v")).filter(F.col("n") > leaf_rows)
        at = rows.join(hot, "leaf").groupBy("leaf", "v", "n").agg(F.percentile_approx(far, 0.5).alias("cut"))
        sides = F.greatest(F.sum(inside.cast("long")), F.sum(outside.cast("long")))
        cuts = stage(rows.join(at, "leaf").groupBy("leaf", "v", "n", "cut").agg(sides.alias("most")).filter("most <= 0.8 * n"), "cuts")
        if cuts.isEmpty():
            break
        side = lambda k, near, own: F.when(near, F.struct(F.xxhash64("leaf", F.lit(k)).alias("leaf"), own.alias("in")))
        halves = F.array(side(0, inside, far <= F.col("cut")), side(1, outside, far > F.col("cut")))
        stay = F.array(F.struct(F.col("leaf"), F.lit(True).alias("in")))
        to = F.when(F.col("cut").isNull(), stay).otherwise(F.filter(halves, lambda x: x.isNotNull()))
        split = rows.join(cuts.select("leaf", "v", "cut"), "leaf", "left").select("fp", "home", F.explode(to).alias("to"))
        rows = stage(split.select("fp", F.col("to.leaf").alias("leaf"), (F.col("home") & F.col("to.in")).alias("home")), "leaves")

    # Leaves share a task's call, as many as hold ``CALL_ROWS`` rows; each level adds a
    # quarter to the copies of a row.
    copies = int(HALVES * distinct * 1.25**depth)
    n = max(4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), copies // CALL_ROWS)
    bucket = F.pmod(F.xxhash64("leaf"), F.lit(n)).cast("int").alias("bucket")

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("leaf", kind="stable")
        fp, home = part["fp"].to_numpy(dtype=np.int64), part["home"].to_numpy(dtype=bool)
        found = links_of_leaves(fp, home, part["leaf"].to_numpy(), radius)
        return pd.DataFrame({"a": fp[found[:, 0]], "b": fp[found[:, 1]]})

    return rows.groupBy(bucket).applyInPandas(pairs, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id``: the least id that
    links of at most ``radius`` differing bits reach, the row's own included.

    Rows of one fingerprint become one before any search (partial sums per task, so
    thousands of copies cost one row), and components are found among distinct
    fingerprints; ids meet them again by a join on the fingerprint, which Spark
    splits where it is skewed.

    Null and empty texts have fingerprint zero and link like others. A null id never
    is a component's id, unless all of its ids are null. Texts of any length are
    hashed whole in blocks. Repeated rows get equal results. Input columns named
    like an added one, in any case, are replaced. Empty tables give empty results.
    """
    rest = without(docs, "component_id")
    marked = stage(fingerprints(rest, text, shingle), "fingerprints")
    least = stage(marked.groupBy("fingerprint").agg(F.min(quoted(id_col)).alias("least")), "distinct")
    linked = components(fingerprint_links(least.select("fingerprint"), radius))
    top = least.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    heads = top.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by = stage(top.join(heads, F.col("root") == F.col("r")).select(F.col("fingerprint").alias("f"), "component_id"), "classes")
    out = marked.join(by, F.col("fingerprint") == F.col("f"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return out.select(*[quoted(c) for c in rest.columns if c.lower() != "fingerprint"], hexed, "component_id")


#: Wide fingerprints: words of 64 bits.
WIDE = 4
#: Texts of a Jaccard similarity of 0.8 differ in 39 of 256 bits on average, with a
#: deviation of 6, unrelated ones in 128 with one of 8. Candidates differ in at most:
WIDE_RADIUS = 80
#: Share of the pairs of a similarity of exactly 0.8 that are neighbours in some part.
MET = 0.99
#: Bits in which neighbours in a part of the wide fingerprints differ at most.
REACH = 1
#: Rows that live in a leaf to which the first levels of a part's tree deal, on average.
DEAL = 200_000
#: Rows a call's tree is walked with at once, and those of its leaves, about.
WALK, LAST = 65_536, 128


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, lengths = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, last = (ends - lengths)[: max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), dtype="<u8", count=len(starts)))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """256 majority bits over distinct shingle hashes, as four unsigned words."""
    out = np.zeros(WIDE, dtype=np.uint64)
    for k in range(WIDE):
        counts = np.zeros(64, dtype=np.int64)
        for i in range(0, len(found), 1 << 16):
            part = mix64(found[i : i + (1 << 16)] + np.uint64(k + 1)).astype("<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0]
    return out


def _bands(n: int, reach: int = 0) -> np.ndarray:
    """Which of the 256 bits each part has, for ``n`` texts: so many that few texts
    come within ``reach`` bits in a part by chance, and so many parts that pairs that
    differ in 39 bits come as near in one with a chance of ``MET``."""
    width, p = max(16, int(np.ceil(np.log2(max(1, n)))) - 2), 39 / (64 * WIDE)
    agree = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(reach + 1))
    rng = np.random.default_rng(8)
    return np.stack([rng.permutation(64 * WIDE)[:width] for _ in range(int(np.ceil(np.log(1 - MET) / np.log1p(-agree))))])


def _part(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits ``at`` of wide fingerprints, as one number a row."""
    out = np.zeros(len(wide), dtype=np.uint64)
    for k, bit in enumerate(at.tolist()):
        out |= (wide[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)) << np.uint64(k)
    return out


def _far(wide: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of all bits the rows x and y differ."""
    return np.bitwise_count(wide[x] ^ wide[y]).sum(axis=-1, dtype=np.int64)


def _met(part: np.ndarray, wide: np.ndarray, home: np.ndarray, reach: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect one leaf's neighbours within ``reach`` bits of
    ``part`` and ``WIDE_RADIUS`` of all. Where many rows crowd together they are first
    walked from neighbour to neighbour, each against those not reached yet, so a
    dense group costs little; the others are not its neighbours and are compared."""
    bits, left = part.astype(np.uint32), np.arange(len(part))
    xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def near(i: int, rows: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.bitwise_count(bits[rows] ^ bits[i]) <= reach)
        return at[_far(wide, rows[at], i) <= WIDE_RADIUS]

    while int(home[left].sum()) * len(left) > most:
        tried = left[:: max(1, len(left) // 16)]
        sizes = [len(near(i, left)) for i in tried.tolist()]
        if max(sizes) * 64 < len(left):
            break
        todo = [int(tried[int(np.argmax(sizes))])]
        left = left[left != todo[0]]
        while todo and len(left):
            i = todo.pop()
            at = near(i, left)
            xs.append(np.full(len(at), i))
            ys.append(left[at])
            todo += left[at].tolist()
            left = np.delete(left, at) if len(at) else left
    own, step = left[home[left]], max(1, (1 << 20) // max(1, len(left)))
    for k in range(0, len(own), step):
        cells = np.flatnonzero(np.bitwise_count(bits[own[k : k + step]][:, None] ^ bits[left][None, :]) <= reach)
        x, y = own[k + cells // len(left)], left[cells % len(left)]
        new = (x < y) | ((x != y) & ~home[y])
        x, y = x[new], y[new]
        new = _far(wide, x, y) <= WIDE_RADIUS
        xs.append(x[new])
        ys.append(y[new])
    return np.concatenate(xs), np.concatenate(ys)


def _neighbours(wide: np.ndarray, home: np.ndarray, at: np.ndarray, points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a leaf after ``depth`` levels that connect what ``_met`` asks
    for: its tree is walked on, in pieces that fit, to leaves that are compared."""
    part, found = _part(wide, at), []
    last = depth + max(0, int(np.ceil(np.log2(max(1, len(wide)) / LAST))))
    stack = [(np.arange(len(wide)), home, depth)]
    while stack:
        rows, own, level = stack.pop()
        to = last if len(rows) <= WALK else min(last, level + 1)
        i, leaf, own = tree_leaves(part[rows], points[level:to], REACH, len(at), own, level)
        order = np.argsort(leaf, kind="stable")
        ends = np.flatnonzero(np.diff(leaf[order], append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(rows) else ():
            r, h = rows[i[order[a:b]]], own[order[a:b]]
            if len(r) < 2 or not h.any():
                continue
            if to < last:
                stack.append((r, h, to))
                continue
            x, y = _met(part[r], wide[r], h, REACH)
            if len(x) > len(r):
                x, y = np.array(forest(x, y, len(r)), dtype=np.int64).reshape(-1, 2).T
            if len(x):
                found.append((r[x], r[y]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[y for _, y in found]])


def _candidates(classes: DataFrame, most: int, deal: int = DEAL) -> DataFrame:
    """Pairs (a, b) that connect all classes that differ in ``REACH`` bits at most in a
    part of their wide fingerprints (``_bands``), and in ``WIDE_RADIUS`` in all.

    As in ``fingerprint_links``, each part has a vantage-point tree, in which a row
    lives in one leaf and visits those that the triangle bounds leave over, so no
    neighbour in a part is missed. The first levels deal rows to calls, which walk
    the others. Leaves over ``most`` rows (groups of near copies crowd together) are
    cut into chunks whose pairs are calls of their own; calls give spanning forests,
    never all pairs.
    """
    known = classes.count()
    bands = _bands(known, REACH)
    depth = max(2, int(np.ceil(np.log2(max(1, known) / deal))))
    columns, mask = [f"f{k}" for k in range(WIDE)], np.uint64((1 << bands.shape[1]) - 1)
    points = [vantage_points(b, 64) & mask for b in range(len(bands))]

    def wide_of(part: pd.DataFrame) -> np.ndarray:
        return np.stack([part[c].to_numpy(dtype=np.int64) for c in columns], axis=1).view(np.uint64)

    def leaves(batches):
        for batch in batches:
            wide = wide_of(batch)
            for b, at in enumerate(bands):
                rows, leaf, home = tree_leaves(_part(wide, at), points[b][:depth], REACH, len(at))
                yield batch.iloc[rows].assign(leaf=leaf + (b << depth), home=home)

    fields = ", ".join(f"{c} long" for c in columns)
    rows = classes.select("id", *columns).mapInPandas(leaves, f"id long, {fields}, leaf long, home boolean")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n")).filter(f"n > {most}")
    cut = stage(sizes.select(F.col("leaf").alias("l"), F.ceil(2 * F.col("n") / most).cast("int").alias("c")), "crowded")
    if not cut.isEmpty():
        mine = F.pmod(F.xxhash64("id"), "c").cast("int")
        with_all = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(mine, j) * F.col("c") + F.greatest(mine, j))
        chunk = F.explode(F.coalesce(with_all, F.array(F.lit(0)))).alias("chunk")
        rows = rows.join(cut, F.col("leaf") == F.col("l"), "left").select("id", *columns, "leaf", "home", chunk)
    else:
        rows = rows.withColumn("chunk", F.lit(0))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        b = int(part["leaf"].iloc[0]) >> depth
        names, code = np.unique(part["id"].to_numpy(), return_inverse=True)
        x, y = _neighbours(wide_of(part), part["home"].to_numpy(dtype=bool), bands[b], points[b], depth)
        pairs = np.array(forest(code[x], code[y], len(names)), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return rows.groupBy("leaf", "chunk").applyInPandas(compare, "a long, b long").distinct()


def similar(part: pd.DataFrame, shingle: int, similarity: float) -> pd.DataFrame:
    """Pairs (a, b) that connect rows (``id``, ``text``, ``label``) whose shingle sets
    have a Jaccard similarity of ``similarity`` or more, exactly. Rows of one label
    are known to be connected, and a pair that is connected already is not compared."""
    part = part.drop_duplicates("id").sort_values("id")
    ids, label = part["id"].to_numpy(), np.unique(part["label"].to_numpy(), return_inverse=True)[1]
    sets = [shingles(t, shingle) for t in part["text"]]
    sizes = np.array([len(s) for s in sets])
    wide = np.stack([wide_fingerprint(s) for s in sets])
    out = []
    for i in range(len(ids)):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        # No more than this share of the larger set can be in both.
        rest = rest[np.minimum(sizes[i], sizes[rest]) >= similarity * np.maximum(sizes[i], sizes[rest])]
        far = np.bitwise_count(wide[i] ^ wide[rest]).sum(axis=1, dtype=np.int64)
        for j in rest[np.argsort(far, kind="stable")][: int((far <= WIDE_RADIUS).sum())].tolist():
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    label[label == label[j]] = label[i]
                    out.append((ids[i], ids[j]))
    found = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _verified(texts: DataFrame, shingle: int, similarity: float, most: int, most_bytes: int = 32 << 20, leaders: int = 16) -> DataFrame:
    """Pairs (a, b) that connect the rows of each group (``root``, ``id``, ``text``)
    whose shingle sets have a Jaccard similarity of ``similarity`` or more, exactly.

    Groups over ``most`` rows or ``most_bytes`` of text are cut into chunks. Each chunk
    is compared within itself and with about ``leaders`` rows of its group, chosen by
    hash, which connects a group of near copies whole, however large it is. Only rows
    that are not in the largest part so connected are then compared with all others,
    chunk by chunk: the cost of a group is its rows times those that stay apart.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    chunks = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(size) / most_bytes)).cast("int")
    sizes = texts.groupBy("root").agg(chunks.alias("c"), F.count("*").alias("n")).withColumnRenamed("root", "r")
    marked = texts.join(sizes, F.col("root") == F.col("r")).select("root", "id", "text", "c", "n", F.xxhash64("id").alias("h"))
    marked = marked.withColumn("i", F.pmod("h", "c").cast("int"))
    leads = (F.col("c") > 1) & (F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.floor(F.col("n") / leaders))) == 0)
    to = F.when(leads, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array("i"))
    schema = "a long, b long"
    plain = lambda part: similar(part, shingle, similarity)
    dealt = marked.select("root", "id", "text", F.col("id").alias("label"), F.explode(to).alias("i"))
    # One key for a group's chunk: rows that are dealt by the group alone would stay so.
    first = stage(dealt.groupBy(F.xxhash64("root", "i").alias("deal")).applyInPandas(plain, schema), "similar")
    crowded = stage(sizes.filter("c > 1").select(F.col("r").alias("g"), F.lit(True).alias("hot")), "crowded-groups")
    if crowded.isEmpty():
        return first
    known = components(first)
    hot = texts.select("root", "id").join(crowded, F.col("root") == F.col("g"), "left_semi").join(known.toDF("node", "top"), F.col("id") == F.col("node"), "left")
    hot = stage(hot.select(F.col("root").alias("g"), F.col("id").alias("m"), F.coalesce("top", "id").alias("label")), "labels")
    parts = hot.groupBy("g", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("all"))
    main = main.select(F.col("g").alias("r"), F.col("x.label").alias("main"), (F.col("all") - F.col("x.n")).alias("apart"), "all").filter("apart > 0")
    # Rows in the main part meet each chunk of the others; those meet each other.
    apart = F.col("label") != F.col("main")
    mine = F.when(apart, F.pmod(F.xxhash64("m"), F.ceil(F.col("apart") / most)).cast("int"))
    own = F.pmod(F.xxhash64("m"), F.ceil(F.col("all") / most)).cast("int")
    others = F.sequence(F.lit(0), F.ceil(F.col("apart") / most).cast("int") - 1)
    chunks_of_main = F.sequence(F.lit(0), F.ceil(F.col("all") / most).cast("int") - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(others, lambda j: pair(1, F.least(mine, j), F.greatest(mine, j)))
    across = F.when(apart, F.transform(chunks_of_main, lambda i: pair(0, i, mine))).otherwise(F.transform(others, lambda j: pair(0, own, j)))
    both = F.explode(F.when(apart, F.concat(among, across)).otherwise(across)).alias("to")
    places = hot.join(main, F.col("g") == F.col("r")).select("g", "m", "label", both).select("g", "m", "label", "to.kind", "to.i", "to.j")
    again = texts.join(places, (F.col("root") == F.col("g")) & (F.col("id") == F.col("m"))).select("root", "id", "text", "label", "kind", "i", "j")
    return first.union(again.groupBy(F.xxhash64("root", "kind", "i", "j").alias("deal")).applyInPandas(plain, schema))


def first_of_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 512
) -> DataFrame:
    """One row of each group of near duplicates, that of the least id, with the
    columns of ``docs``: texts link whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more, and groups are what links connect.

    Rows of one shingle set become one class. SimHash fingerprints of 256 bits then
    name candidates, by vantage-point trees over their parts (see ``_candidates``; a
    pair of similarity 0.8 is found with a chance of 99 %, one of 0.9 of over
    99.9 %), candidates are grouped by what they
    connect, and only there are texts brought together and compared exactly
    (``_verified``): nothing below the similarity links.

    Null and empty texts have no shingles and are alike: one of them stays. Rows
    that share the least id are told apart by a number given when they are staged;
    a null id comes after all others. Repeated rows are copies. An empty table gives
    an empty result; other columns are carried along whatever their names.
    """
    n = "__evgraph_row"
    rows = stage(docs.withColumn(n, F.monotonically_increasing_id()), "rows")

    @F.pandas_udf("f0 long, f1 long, f2 long, f3 long, key string")
    def mark(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, shingle) for t in texts]
        wide = np.stack([wide_fingerprint(s) for s in sets]) if len(sets) else np.zeros((0, WIDE), dtype=np.uint64)
        out = pd.DataFrame({f"f{k}": signed(wide[:, k]) for k in range(WIDE)})
        out["key"] = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
        return out

    marked = rows.select(quoted(id_col).alias("low"), F.col(n).alias("row"), mark(quoted(text)).alias("m")).select("low", "row", "m.*")
    order = F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("id"), F.col("row").alias("row"))
    first = F.min(order).alias("first")
    classes = stage(
        marked.groupBy("key").agg(first, *[F.min(f"f{k}").alias(f"f{k}") for k in range(WIDE)]).withColumn("id", F.col("first.row")), "classes"
    )
    near = components(_candidates(classes, 4 * DEAL))
    members = stage(near.select("root", F.col("node").alias("id")).union(near.select("root", F.col("root").alias("id")).distinct()), "members")
    texts = rows.select(F.col(n).alias("id"), quoted(text).alias("text")).join(members, "id")
    roots = components(_verified(texts, shingle, similarity, most))
    heads = classes.join(roots, F.col("id") == F.col("node"), "left").select("first", F.coalesce("root", "id").alias("root"))
    kept = heads.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(n))
    return rows.join(kept, n, "left_semi").drop(n)
