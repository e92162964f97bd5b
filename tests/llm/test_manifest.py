"""Merkle manifests against a tree built in one place, and odd rows."""

import hashlib
import random

from evgraph.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity=3):
    """All levels of a tree, from its leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def steps(levels, i, arity=3):
    out = []
    for level in levels[:-1]:
        run = i // arity * arity
        out.append((i - run, [level[k] for k in range(run, min(run + arity, len(level))) if k != i]))
        i //= arity
    return out


def expected(rows, arity=3):
    """By (group, order, leaf): subroot, root and proof, of rows without equal ones."""
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in groups}
    trees = {g: tree([r[2] for r in leaves[g]], arity) for g in groups}
    top = tree([trees[g][-1][0] for g in groups], arity)
    out = {}
    for k, g in enumerate(groups):
        for i, r in enumerate(leaves[g]):
            out[r] = (trees[g][-1][0], top[-1][0], steps(trees[g], i, arity) + steps(top, k, arity))
    return out


def found(df):
    return {(r.g, r.o, r.leaf): (r.subroot, r.root, [(s.place, s.others) for s in r.proof]) for r in df.collect()}


def test_manifest_against_one_tree(spark):
    rng = random.Random(3)
    for arity, part_rows in ((3, 7), (3, 40), (2, 11)):
        rows = [("hot", i, h(str(i))) for i in rng.sample(range(1000), 130)]
        rows += [(f"g{k}", i, h(str(k), str(i))) for k in range(25) for i in range(rng.randrange(1, 5))]
        rows += [(None, 5, h("a")), (None, None, h("b")), ("é", 5, h("c")), ("", 1, h("d")), ("z", 9, h("e")), ("z", 9, h("f"))]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, o long, leaf string")
        got = merkle.manifest(df, "g", "o", arity=arity, part_rows=part_rows)
        assert found(got) == expected(rows, arity)
        assert got.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
        assert got.filter(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).isEmpty()


def test_a_fragment_merges_alike_in_any_order():
    sizes = {0: 20, 1: 1, 2: 4, merkle.TOP: 3}
    leaves = [{(t, 0, i): h(str(t), str(i))} for t in (0, 1, 2) for i in range(sizes[t])]
    whole = merkle.merge(leaves, sizes)
    rng = random.Random(1)
    for _ in range(20):
        parts = [dict(x) for x in leaves]
        rng.shuffle(parts)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [merkle.merge(parts[i : i + 2], sizes)]
        assert parts[0] == whole
    assert len(whole) == 1 and merkle.merge([{}, whole], sizes) == whole


def test_a_leaf_tells_null_from_text_and_counts_bytes(spark):
    df = spark.createDataFrame([(None, "é"), (12, None), (12, "-"), (None, "")], "n long, t string")
    got = [r[0] for r in df.select(merkle.leaf(F.col("n"), F.col("t"))).collect()]
    assert got == [h("-", "2:é"), h("2:12", "-"), h("2:12", "1:-"), h("-", "0:")]


def test_odd_tables(spark):
    schema = "g string, o long, leaf string, ROOT string, `Proof` int, `x.y` string"
    empty = merkle.manifest(spark.createDataFrame([], schema), "g", "o")
    assert empty.columns == ["g", "o", "leaf", "x.y", "subroot", "root", "proof"] and empty.count() == 0
    one = merkle.manifest(spark.createDataFrame([("a", 1, h("a"), "r", 1, "q")], schema), "g", "o").collect()
    assert [(r.subroot, r.root, r.proof, r["x.y"]) for r in one] == [(h("a"), h("a"), [], "q")]
    # Equal rows are leaves of their own.
    same = merkle.manifest(spark.createDataFrame([("a", 1, h("a"), None, 1, None)] * 4, schema), "g", "o", part_rows=2).collect()
    levels = tree([h("a")] * 4)
    assert {r.root for r in same} == {levels[-1][0]} and len(same) == 4
    got = sorted(str([(s.place, s.others) for s in r.proof]) for r in same)
    assert got == sorted(str(steps(levels, i)) for i in range(4))


def test_parts_need_few_nodes():
    spans = [(0, 1000, 5000, 100_000), (1, 0, 7, 7), (2, 0, 300, 9000)]
    need = merkle.outside(spans, 3)
    assert len(need) < 120 and (0, 0, 999) in need and (0, 0, 1002) not in need
