"""Near-duplicate embeddings: E8 lattice hashing, neighbouring cells, exact cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import mix64, quoted, stage, without
from evgraph.llm.components import components, forest


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to every row of 8 numbers, doubled to integers.

    E8 is D8 and its shift by one half; the nearest point of D8 rounds each number
    and, where the sum comes out odd, rounds the worst one the other way.
    """

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        at = np.abs(off[odd]).argmax(axis=1)
        r[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int, blocks: int = 3) -> np.ndarray:
    """Lattice cells of unit vectors, (rows, tables, 1 + probes), as 32-bit hashes.

    A table projects on ``blocks`` times eight random directions and decodes each eight.
    The first cell is the vector's own. The others neighbour it: they are the cells
    over the nearest faces, where the projection, moved on by a short step along one
    of fixed random directions, decodes to another point.
    """
    n, dims = unit.shape
    out = np.empty((n, tables, 1 + probes), dtype=np.uint32)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dims])
        flat = unit @ rng.standard_normal((dims, 8 * blocks)) * scale + rng.random(8 * blocks)
        steps = rng.standard_normal((4 * probes, 8 * blocks))
        steps *= 0.55 / np.linalg.norm(steps, axis=1)[:, None]
        salt = np.uint64(mix64(np.array([t + 1 + seed * 1000]))[0])

        def code(y: np.ndarray, salt=salt) -> np.ndarray:
            points = nearest_e8(y.reshape(-1, 8)).reshape(len(y), -1)
            h = np.full(len(y), salt)
            for j in range(points.shape[1]):
                h = mix64(h ^ points[:, j].astype(np.uint64))
            return h.astype(np.uint32)

        own = code(flat)
        found = np.repeat(own[:, None], 1 + probes, axis=1)
        have = np.ones(n, dtype=np.int64)
        for s in steps:
            todo = np.flatnonzero(have <= probes)
            if not len(todo):
                break
            near = code(flat[todo] + s)
            new = (found[todo] != near[:, None]).all(axis=1)
            todo = todo[new]
            found[todo, have[todo]] = near[new]
            have[todo] += 1
        out[:, t] = found
    return out


def _met_before(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs of cell rows (pairs, tables, 1 + probes) also meet in a table
    before ``table``: one's own cell is the other's own or a probe of it."""
    same = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    return (same & (np.arange(a.shape[1])[None, :] < table[:, None])).any(axis=1)


def _numbers(column: pd.Series, kind: str, width: int) -> np.ndarray:
    """A column of packed rows as a matrix."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), width)


def _close_pairs(group: np.ndarray, home: np.ndarray, unit: np.ndarray, cosine: float, dense: int = 48):
    """Index pairs (x < y) of rows of one group whose cosine reaches ``cosine``, x a
    resident, in batches; rows are sorted by group with residents first. Small groups
    are compared distance by distance along the rows, all groups at once, large ones
    by products of blocks: memory does not follow the pairs."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    end, small = np.repeat(starts + sizes, sizes), np.repeat(sizes <= dense, sizes)
    rows, step = np.flatnonzero(home & small), 0
    while len(rows := rows[rows + step + 1 < end[rows]]):
        step += 1
        for k in range(0, len(rows), 1 << 13):
            x = rows[k : k + (1 << 13)]
            hit = np.einsum("ij,ij->i", unit[x], unit[x + step]) >= cosine
            if hit.any():
                yield x[hit], x[hit] + step
    for s, n in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist(), strict=True):
        lived = int(home[s : s + n].sum())
        for i in range(0, lived, 256):
            top = min(i + 256, lived)
            x, y = np.nonzero(unit[s + i : s + top] @ unit[s + i : s + n].T >= cosine)
            x, y = x[y > x] + s + i, y[y > x] + s + i
            for k in range(0, len(x), 1 << 13):
                yield x[k : k + (1 << 13)], y[k : k + (1 << 13)]


def find_links(
    vectors: DataFrame, cosine: float, tables: int, probes: int, scale: float, seed: int, most: int
) -> tuple[DataFrame, DataFrame]:
    """Links of rows (``id``, ``copies``, ``unit`` of packed doubles): how many vectors
    link to each (``id``, ``n``), and pairs (``a``, ``b``) that connect linked rows.

    Only ids go to the cells: as a resident to the own one of each table, as a guest
    to the probed ones. Cells without a resident or with one row fall away, and what
    is left is joined to the vectors. A cell over ``most`` rows is cut into chunks
    by a hash of the id, and each pair of chunks becomes a group of its own. A pair
    is counted in the first table where it meets, and once there: both rows carry
    the 32-bit hashes of all their cells, by which cells are told apart everywhere,
    so no group needs to hear of another and no list of pairs is made. Tasks give a
    count per row and a spanning forest. Vectors of different lengths share no cell.
    """
    width = 1 + probes

    def locate(batches):
        for batch in batches:
            size = batch["unit"].map(len).to_numpy() // 8
            for dims in np.unique(size).tolist():
                part = batch[size == dims]
                found = cells(_numbers(part["unit"], "<f8", dims), tables, probes, scale, seed)
                yield part.assign(cells=[row.tobytes() for row in found.astype("<u4")])

    def route(batches):
        for batch in batches:
            found = _numbers(batch["cells"], "<u4", tables * width).reshape(-1, tables, width)
            at = np.broadcast_to(np.arange(tables, dtype=np.int64)[:, None] << 32, found.shape[1:])
            home = np.broadcast_to(np.arange(width) == 0, found.shape[1:])
            # Probes that found no other cell repeat the own one.
            real = home[None] | (found != found[:, :, :1])
            who = np.broadcast_to(batch["id"].to_numpy()[:, None, None], found.shape)
            size = np.broadcast_to(batch["dims"].to_numpy(dtype=np.int64)[:, None, None], found.shape)
            cell = (found.astype(np.int64) | at[None])[real]
            yield pd.DataFrame({"id": who[real], "cell": cell, "dims": size[real], "home": np.broadcast_to(home, found.shape)[real]})

    keyed = stage(vectors.select("id", "copies", "dims", "unit").mapInPandas(locate, "id long, copies long, dims int, unit binary, cells binary"), "cells")
    routed = stage(keyed.select("id", "dims", "cells").mapInPandas(route, "id long, cell long, dims int, home boolean"), "routed")
    sizes = routed.groupBy("cell", "dims").agg(F.count("*").alias("n"), F.max("home").alias("lived")).filter("n > 1 and lived")
    sizes = sizes.select(F.col("cell").alias("c"), F.col("dims").alias("d"), F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("mine")
    live = routed.join(sizes, (F.col("cell") == F.col("c")) & (F.col("dims") == F.col("d"))).select("id", "cell", "dims", "home", "chunks", mine)
    pair = lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"))
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), pair)).alias("to")
    groups = live.select("id", "cell", "dims", "home", "mine", to).select("id", "cell", "dims", "home", "mine", "to.i", "to.j")
    dealt = groups.join(keyed.drop("dims"), "id")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Small groups share a task's call; one group has about 2 * most rows at most.
    bucket = F.pmod(F.xxhash64("cell", "dims", "i", "j"), F.lit(4 * n)).cast("int")

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, same in part.groupby("dims", sort=False):
            same = same.sort_values(["cell", "i", "j", "home", "id"], ascending=[True, True, True, False, True], kind="stable")
            key = same[["cell", "i", "j"]].to_numpy(dtype=np.int64)
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            unit, found = _numbers(same["unit"], "<f8", int(dims)), _numbers(same["cells"], "<u4", tables * width).reshape(-1, tables, width)
            ids, copies, mine = same["id"].to_numpy(), same["copies"].to_numpy(), same["mine"].to_numpy()
            across, table, here = key[:, 1] != key[:, 2], key[:, 0] >> 32, key[:, 0] & 0xFFFFFFFF
            names, code = np.unique(ids, return_inverse=True)
            counts, pairs = np.zeros(len(names), dtype=np.int64), []
            for x, y in _close_pairs(group, same["home"].to_numpy(dtype=bool), unit, cosine):
                new = (code[x] != code[y]) & (~across[x] | (mine[x] != mine[y]))
                x, y = x[new], y[new]
                t = table[x]
                new = ~_met_before(found[x], found[y], t)
                # A guest here may in turn have the resident as a guest at home.
                xo, yo = found[x, t, 0], found[y, t, 0]
                both = (xo != yo) & (found[x, t] == yo[:, None]).any(axis=1) & (found[y, t] == xo[:, None]).any(axis=1)
                new &= ~both | (np.minimum(xo, yo) == here[x])
                x, y = x[new], y[new]
                np.add.at(counts, code[x], copies[y])
                np.add.at(counts, code[y], copies[x])
                pairs += forest(code[x], code[y], len(names)) if len(x) else []
            some = np.flatnonzero(counts)
            pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            pairs = np.array(forest(pairs[:, 0], pairs[:, 1], len(names)), dtype=np.int64).reshape(-1, 2)
            out.append(
                pd.DataFrame(
                    {
                        "a": np.concatenate([names[some], names[pairs[:, 0]]]),
                        "b": np.concatenate([np.full(len(some), -1), names[pairs[:, 1]]]),
                        "n": np.concatenate([counts[some], np.zeros(len(pairs), dtype=np.int64)]),
                    }
                )
            )
        return pd.concat(out)

    found = stage(dealt.groupBy(bucket.alias("bucket")).applyInPandas(verify, "a long, b long, n long"), "links")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    return counts, found.filter("n = 0").select("a", "b")


def normal(vector) -> tuple[int | None, str | None, bytes | None]:
    """Length of a vector, a key that equal vectors share, and its direction as packed
    doubles; nothing for one that is null, empty or zero or has a null or non-finite
    number. It is scaled by its largest number first, so none overflows."""
    if vector is None or not len(vector):
        return None, None, None
    # Adding zero makes -0.0 and 0.0 the same number.
    v = np.asarray(vector, dtype=np.float64) + 0.0
    large = np.abs(v).max()
    if not np.isfinite(large) or large == 0:
        return None, None, None
    unit = v / large
    unit /= np.sqrt((unit * unit).sum())
    return len(v), xxhash.xxh3_128_hexdigest(v.tobytes()), unit.astype("<f8").tobytes()


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.95,
    tables: int = 10,
    probes: int = 8,
    scale: float = 0.4,
    seed: int = 5,
    most: int = 512,
) -> DataFrame:
    """Add ``n_links``, ``component_id`` and ``kept`` to every vector.

    Vectors link at a cosine of ``cosine`` or more, in double precision, whatever
    their other columns say; every link is verified, none is guessed. Random
    projections are decoded to points of the E8 lattice in several tables, and each
    vector also looks into neighbouring cells. Links may be missed only where a pair
    meets in no table (recall is measured in the tests).

    Equal vectors become one class first, so thousands of copies cost one row. Crowded
    cells are cut into pairs of chunks (see ``find_links``).

    Null, empty and zero vectors, and those with null or non-finite numbers, link
    with nothing, not even with copies. Vectors of different lengths, of which there
    may be any number, don't link.
    Each repeated row is a vector of its own, and rows that share an id count one by
    one. A null id stays null and is never a component's id, unless it stands alone.
    Input columns named like an added one, in any case, are replaced. An empty table
    gives an empty result.
    """
    rest = without(vectors, "n_links", "component_id", "kept", "__evgraph_class")

    @F.pandas_udf("dims int, key string, unit binary")
    def mark(given: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal(v) for v in given], columns=["dims", "key", "unit"]).astype({"dims": "Int32"})

    numbers = quoted(embedding).cast("array<double>")
    seen = rest.select(quoted(id_col).alias("id"), mark(numbers).alias("m")).select("id", "m.*")
    classes = seen.filter("key is not null").groupBy("dims", "key")
    classes = classes.agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("unit").alias("unit"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    linked, edges = find_links(classes, cosine, tables, probes, scale, seed, most)
    roots = components(edges)
    known = classes.join(roots, F.col("id") == F.col("node"), "left").select("id", "copies", "least", "key", F.coalesce("root", "id").alias("root"))
    heads = known.groupBy("root").agg(F.min("least").alias("head")).withColumnRenamed("root", "r")
    done = (
        known.join(heads, F.col("root") == F.col("r"))
        .join(linked.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
        .select(F.col("key").alias("k"), "head", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    out = rest.withColumn("__evgraph_class", mark(numbers)["key"]).join(done, F.col("__evgraph_class") == F.col("k"), "left")
    head = F.coalesce("head", quoted(id_col))
    return out.select(
        *[quoted(c) for c in rest.columns],
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        head.alias("component_id"),
        (quoted(id_col).eqNullSafe(head)).alias("kept"),
    )
