"""Repeated blocks against a plain greedy cover, what counts as a line, components."""

import random

import pytest
from evgraph.operators import duplicates, health, traverse
from pyspark.sql import functions as F

SKIPS = ("#", "//", "/*", "*", "import ", "from ", "package ", "using ", "require(")


def plain_lines(text):
    """(number, line) of the lines that count, one after the other."""
    out, closer = [], None
    for n, raw in enumerate((text or "").splitlines(), 1):
        line = " ".join(raw.split())
        if closer:
            closer = None if closer in line else closer
        elif line.startswith("/*") and "*/" not in line[2:]:
            closer = "*/"
        elif line[:3] in ('"""', "'''"):
            closer = line[:3] if line.count(line[:3]) == 1 else None
        elif line.startswith(("import (", "from ")) and line.endswith("("):
            closer = ")"
        elif line.startswith(("import {", "import type {", "export {")) and line.endswith("{"):
            closer = "}"
        elif line and not line.startswith(SKIPS) and any(c.isalnum() for c in line):
            out.append((n, line))
    return out


def plain_blocks(texts, size):
    """A cover of all repeated stretches, window by window in the order of the texts."""
    lines = {i: plain_lines(t) for i, t in sorted(texts.items())}
    key = lambda p, i: tuple(x for _, x in lines[p][i : i + size])
    spots = [(p, i) for p in lines for i in range(len(lines[p]) - size + 1)]
    covered, out = set(), []
    for p, i in spots:
        if (p, i) in covered:
            continue
        places = [s for s in spots if key(*s) == key(p, i) and (s == (p, i) or s[0] != p or abs(s[1] - i) >= size)]
        if len(places) < 2:
            continue
        n = size
        while all(j + n < len(lines[q]) and i + n < len(lines[p]) and lines[q][j + n][1] == lines[p][i + n][1] for q, j in places):
            n += 1
        for q, j in places:
            out.append((p, i, n, len(places), q, lines[q][j][0], lines[q][j + n - 1][0]))
            covered |= {(q, j + k) for k in range(n)}
    return sorted(out)


ODD = [
    "a = 1\n/* open\nhidden\nend */ hidden too\nb = 2", "/* one line */\nx", "/*/ open\nhidden */\ny", '"""doc"""\nx\n"""\nhidden\n"""\ny', "'''\nhidden\n",
    "import (\n a\n b\n)\nx", "from x import (\n  y,\n)\nz", "import {\n a\n} from 'b'\nc", "import type {\na\n}\nq", "export {\na }\nb", "from x import y\nfrom_here = 1",
    "  spaced \t out  \n\n{\n});\n# no\n// no\n * no\nrequire('x')\nyes it is", "one\r\ntwo\rthree\x0bfour\x0cfive six\x85seven", "", None, "é\n١\n—\n''' ''' x\nlast", "import (x\nimport {a}\n/* a */ b",
]


def test_lines_that_count(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    got = {r.id: [(x.n, x.line) for x in r.found] for r in df.select("id", duplicates.counted_lines(F.col("text")).alias("found")).collect()}
    assert got == {i: plain_lines(t) for i, t in enumerate(ODD)}


def test_blocks_stay_open_across_stretches(spark):
    n = 3 * duplicates.STRETCH
    text = "\n".join(["x = 1", "/* open", *[f"hidden {i}" for i in range(n)], "*/", *[f"y{i} = {i}" for i in range(n)]])
    found = spark.createDataFrame([(text,)], "text string").select(F.explode(duplicates.counted_lines(F.col("text"))).alias("x")).select("x.*").collect()
    assert [(r.n, r.line) for r in found] == plain_lines(text) and len(found) == n + 1


def repository(seed, n=14):
    """Files of shared runs, copies, repeated lines and periods, cut at random."""
    rng = random.Random(seed)
    runs = [[f"v{k}_{i} = {i}" for i in range(rng.randrange(3, 14))] for k in range(5)] + [["same"] * 9, ["odd", "even"] * 4]
    texts = {}
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            run = rng.choice(runs)
            a = rng.randrange(0, 3)
            lines += run[a : len(run) - rng.randrange(0, 2)]
            lines += [f"only {i} {rng.random()}"] * rng.randrange(0, 2)
        texts[f"f{i:02}"] = "\n".join(lines)
    for i in range(n, n + 4):
        texts[f"f{i:02}"] = texts[f"f{i - n:02}"]
    return texts


@pytest.mark.parametrize(("seed", "size"), [(1, 3), (4, 5), (6, 2)])
def test_blocks_against_a_plain_cover(spark, seed, size):
    texts = repository(seed)
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = sorted(tuple(r) for r in duplicates.blocks(df, "path", "text", size=size).collect())
    assert got == plain_blocks(texts, size) and len(got) > 10


def test_cover_of_many_copies_is_that_of_two(spark):
    """Copies are two rows of the cover, however many: its work does not grow with them."""
    body = "\n".join(f"line {i}" for i in range(12))
    texts = {f"c{i:03}": body for i in range(60)} | {"a": "line 3\n" + body, "z": "\n".join(["again"] * 25)}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = sorted(tuple(r) for r in duplicates.blocks(df, "path", "text").collect())
    assert got == plain_blocks(texts, 10)
    # Of one repeated line, windows ten lines apart are two places.
    assert len([r for r in got if r[0] == "z"]) == 7 and {r[3] for r in got if r[0] == "a"} == {61}


def test_odd_texts(spark):
    schema = "path string, text string"
    body = "\n".join(f"line {i}" for i in range(12))
    assert duplicates.blocks(spark.createDataFrame([], schema), "path", "text").collect() == []
    df = spark.createDataFrame([(None, body), ("a", body), ("b", None), ("c", ""), ("d", "x")], schema)
    assert duplicates.blocks(df, "path", "text").collect() == []
    found = duplicates.blocks(spark.createDataFrame([("b", "import x\n" + body), ("a", body)], schema), "path", "text")
    checks = health.assess([duplicates.violations(found)], None, health.catalog(spark)).collect()
    assert [(r.check, r.file, r.line, r.value, r.minutes) for r in checks] == [("duplicated-block", "a", 1, 12, 15)]


def test_components_taken_both_ways(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in traverse.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert traverse.connected(spark.createDataFrame([], "src long, dst long")).collect() == []
