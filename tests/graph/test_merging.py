"""Star exports, attributes of merged edges, turned edges, faults of drawings, widths."""

import math
import random
import unicodedata

import pytest
from evgraph.extract import python_facts
from evgraph.functions import width
from evgraph.operators import assemble, build, deploy, joins, layout, resolve, traverse
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# names that files bring


def first_definition(file, name, named, stars, tops, depth):
    """Depth first in the order of imports, as one search after the other."""
    if depth < 0:
        return None
    if (file, name) in tops:
        return (file, name)
    steps = [(line, to, real) for f, n, to, real, line in named if (f, n) == (file, name)] + [(line, to, name) for f, to, line in stars if f == file]
    for _, to, real in sorted(steps):
        if (found := first_definition(to, real, named, stars, tops, depth - 1)) is not None:
            return found
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_star_exports_against_a_search_depth_first(spark, seed):
    rng = random.Random(seed)
    files, names = [f"f{i}" for i in range(14)], [f"n{i}" for i in range(9)]
    line = {f: iter(range(1, 100)) for f in files}
    stars = [(f, rng.choice(files), next(line[f])) for f in files for _ in range(rng.randrange(3))]
    pairs = {(f, rng.choice(names)) for f in files for _ in range(rng.randrange(3))}
    named = [(f, n, rng.choice(files), rng.choice(names), next(line[f])) for f, n in sorted(pairs)]
    tops = sorted({(rng.choice(files), rng.choice(names)) for _ in range(18)})
    asked = [(f, n) for f in files for n in names]
    got = resolve.search_exports(
        spark.createDataFrame(asked, "file string, name string"), spark.createDataFrame(named, "file string, name string, to_file string, to_name string, line int"),
        spark.createDataFrame(stars, "file string, to_file string, line int"), spark.createDataFrame(tops, "path string, name string"), depth=3,
    )
    want = {(f, n): first_definition(f, n, named, stars, set(tops), 3) for f, n in asked}
    assert {(r.file, r.name): (r.at, r["as"]) for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_calls_of_names_that_a_star_brings(spark):
    sources = {
        "a/__init__.py": "from .deep import *\n", "a/deep.py": "from .core import *\nfrom .other import helper\n", "a/core.py": "def build():\n    return 1\n",
        "a/other.py": "def helper():\n    return 2\n", "b/build.py": "def build():\n    return 3\n", "use.py": "from a import *\n\n\ndef go():\n    build()\n    helper()\n    nothing()\n",
    }
    files = spark.createDataFrame([(p, "python", t.count("\n"), t) for p, t in sources.items()], "path string, lang string, line_count int, text string")
    got = assemble.graph(files, python_facts.extract(files))
    calls = {(r.src, r.dst) for r in got.edges.filter("kind = 'calls'").collect()}
    assert calls == {("use.py#use.go", "a/core.py#a.core.build"), ("use.py#use.go", "a/other.py#a.other.helper")}


# attributes and citations


def test_attributes_of_hot_edges_and_others(spark, monkeypatch):
    """Edges of many facts are reduced in parts, the others by one exchange, to the same."""
    rng = random.Random(9)
    rows_ = [("a", f"e{min(rng.randrange(60), 20)}", "k", rng.randrange(40), rng.choice([None, {}, {"type_only": "true"}, {"type_only": "true", "x": rng.choice("pq")}, {"x": None, "sites": "7"}]), "f", rng.randrange(9), 9) for _ in range(400)]
    facts = spark.createDataFrame(rows_, "src string, dst string, kind string, fact int, attrs map<string,string>, file string, start_line int, end_line int")
    said = lambda merged: sorted((r.dst, sorted(r.attrs.items())) for r in merged.collect())
    once = build.merge_attributes(facts)[0]
    want = said(build._merged_in_parts(facts, facts.select("src", "dst", "kind", "file", "start_line", "end_line").distinct()))
    assert said(once) == want
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("Initial Plan")[2].count("Exchange ") == 1
    monkeypatch.setattr(build, "HOT_FACTS", 100)
    assert said(build.merge_attributes(facts)[0]) == want


def test_attributes_by_rule(spark):
    facts = [
        (1, "a", "b", "calls", {"shape": "self", "x": "1"}, "f", 9, 9), (1, "a", "b", "calls", {"shape": "self", "x": "1"}, "e", 2, 2),
        (2, "a", "c", "imports", {"type_only": "true", "shape": "q"}, "f", 1, 1), (3, "a", "c", "imports", {"type_only": "true", "shape": "p", "y": "2"}, "f", 1, 1),
        (4, "a", "d", "imports", {"type_only": "true"}, "f", 1, 1), (5, "a", "d", "imports", {}, "f", 0, 0), (6, "a", "d", "imports", None, "g", 3, 4),
        (7, "z", "z", "calls", {}, "f", 5, 5),
    ]
    df = spark.createDataFrame([(s, d, k, n, m, f, a, b) for n, s, d, k, m, f, a, b in facts], "src string, dst string, kind string, fact int, attrs map<string,string>, file string, start_line int, end_line int")
    merged, cited = build.merge_attributes(df)
    got = {(r.src, r.dst): r.attrs for r in merged.collect()}
    assert got == {
        ("a", "b"): {"shape": "self", "x": "1"}, ("a", "c"): {"type_only": "true", "shape": "p,q", "y": "2", "sites": "1"}, ("a", "d"): {"sites": "3"}, ("z", "z"): {},
    }
    assert [(r.file, r.start_line, r.nth) for r in cited.filter("dst = 'd'").orderBy("nth").collect()] == [("f", 1, 1), ("g", 3, 2), ("f", 0, 3)]
    empty = build.merge_attributes(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_environments_of_services(spark):
    env = spark.createDataFrame([("prod", "filename", "c.prod.yml"), ("prod", "workflow", "ci.yml"), ("dev", "dockerfile", "api/Dockerfile"), ("qa", "workflow", "c.prod.yml")], "name string, source string, file string")
    services = spark.createDataFrame([("s1", "c.prod.yml", None), ("s2", "c.yml", "api/Dockerfile"), ("s3", "c.yml", "c.prod.yml")], "id string, file string, dockerfile string")
    badges, links = deploy.environment_overlays(env, services)
    assert rows(badges) == [("dev", "dockerfile"), ("prod", "filename, workflow"), ("qa", "workflow")]
    assert rows(links) == [("dev", "s2"), ("prod", "s1")]


# drawings


def test_turned_edges_leave_no_cycle(spark):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)})
    df = spark.createDataFrame(edges, "src string, dst string")
    found = layout.oriented(df, traverse.layers(df))
    got = found.collect()
    assert sorted((r.src, r.dst) for r in got) == [e for e in edges if e[0] != e[1]]
    assert all({r.low, r.high} == {r.src, r.dst} and r.turned == (r.low == r.dst) for r in got) and any(r.turned for r in got)
    assert traverse.strong_components(found.select(F.col("low").alias("src"), F.col("high").alias("dst"))).isEmpty()


def test_rectangles_meet_in_one_cell(spark):
    rng = random.Random(5)
    rect = lambda i: (rng.choice("vw"), i, x := rng.randrange(-500, 2000), y := rng.randrange(0, 900), x + rng.randrange(0, 700), y + rng.randrange(0, 400))
    a, b = [rect(i) for i in range(60)], [rect(i) for i in range(60)]
    schema = "view string, id int, x1 int, y1 int, x2 int, y2 int"
    got = joins.touching(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["view"], 100.0)
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted(want)


BOXES = [("v", "a", 0, 0, 40, 20), ("v", "b", 100, 0, 140, 20), ("v", "c", 0, 100, 40, 120)]
BOX = "view string, id string, x1 int, y1 int, x2 int, y2 int"


def test_faults_of_routes(spark):
    boxes, canvas = spark.createDataFrame(BOXES, BOX), spark.createDataFrame([("v", 200, 200)], "view string, width int, height int")
    routes = [("v", "fine", "a", "b"), ("v", "lost", "a", "ghost"), ("v", "short", "a", "c"), ("v", "off", "a", "c"), ("v", "loose", "b", "c"), ("v", "none", "a", "b")]
    points = {"fine": [(42, 10), (98, 10)], "lost": [(40, 10), (60, 10)], "short": [(20, 20)], "off": [(20, 20), (-5, 60), (20, 100)], "loose": [(120, 20), (120, 110), (60, 110)]}
    line = [("v", r, i, x, y) for r, ps in points.items() for i, (x, y) in enumerate(ps)]
    got = layout.route_faults(spark.createDataFrame(routes, "view string, route string, src string, dst string"), spark.createDataFrame(line, "view string, route string, nth int, x int, y int"), boxes, canvas)
    assert rows(got) == [("v", "loose", "loose"), ("v", "lost", "no-box"), ("v", "none", "short"), ("v", "off", "off-canvas"), ("v", "short", "short")]


def test_faults_of_frames_and_labels(spark):
    boxes, canvas = spark.createDataFrame(BOXES, BOX), spark.createDataFrame([("v", 200, 200)], "view string, width int, height int")
    frames = spark.createDataFrame([("v", "top", None, 0, None, 30), ("v", "left", 0, 0, 50, 130), ("v", "big", -1, 0, 50, 300)], "view string, frame string, x1 int, y1 int, x2 int, y2 int")
    members = spark.createDataFrame([("v", "top", "a"), ("v", "top", "b"), ("v", "top", "c"), ("v", "left", "a"), ("v", "left", "b"), ("v", "left", "ghost"), ("v", "big", "c")], "view string, frame string, member string")
    assert rows(layout.frame_faults(frames, members, boxes, canvas)) == [("v", "big", None, "off-canvas"), ("v", "left", "b", "not-inside"), ("v", "left", "ghost", "no-box"), ("v", "top", "c", "not-inside")]
    labels = spark.createDataFrame([("v", "r1", 30, 10, 60, 22), ("v", "r2", 61, 12, 80, 22), ("v", "r3", 60, 60, 90, 72), ("w", "r4", 30, 10, 60, 22)], "view string, route string, x1 int, y1 int, x2 int, y2 int")
    segments = spark.createDataFrame([("v", "r1", 70, 66, 0, 66), ("v", "r3", 70, 66, 200, 66), ("v", "r2", 90, 0, 90, 200)], "view string, route string, x1 int, y1 int, x2 int, y2 int")
    assert rows(layout.label_faults(labels, boxes, segments)) == [("v", "r1", "box", "a"), ("v", "r1", "label", "r2"), ("v", "r3", "route", "r1")]


# widths


def plain_cells(text):
    none = lambda c: unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me")
    return sum(0 if none(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def plain_cut(text, font, most, tail):
    up = lambda t: math.ceil(plain_cells(t) * font * 0.62)
    if up(text) <= most:
        return text
    budget, kept, used = most - up("…"), "", 0.0
    if budget <= 0:
        return ""
    for c in reversed(text) if tail else text:
        if used + plain_cells(c) * font * 0.62 > budget + 1e-9:
            break
        kept, used = (c + kept if tail else kept + c), used + plain_cells(c) * font * 0.62
    while kept and plain_cells(kept[0] if tail else kept[-1]) == 0:
        kept = kept[1:] if tail else kept[:-1]
    return "" if not kept else "…" + kept if tail else kept + "…"


def test_widths_and_cuts(spark):
    rng = random.Random(6)
    alphabet = ["a", "/", "é", "é", "日", "本", "ｆ", "́", "́", "€", "😀", "가", "ᅡ", "―"]
    texts = ["", "src/services/billing/invoice", "日本語/モジュール", "é" * 20, "́́ab"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    cut = [width.truncate(t, size, most, tail).alias(f"c{k}") for k, (size, most, tail) in enumerate([(12, 100, True), (12, 100, False), (10, 7, True), (14, 9, False), (11, 61, True)])]
    got = df.select("t", width.cells(t).alias("cells"), width.advance(t, 12).alias("px"), *cut).collect()
    for r in got:
        assert (r.cells, r.px) == (plain_cells(r.t), math.ceil(plain_cells(r.t) * 12 * 0.62)), r.t
        want = [plain_cut(r.t, *how) for how in [(12, 100, True), (12, 100, False), (10, 7, True), (14, 9, False), (11, 61, True)]]
        assert [r.c0, r.c1, r.c2, r.c3, r.c4] == want, r.t


def test_texts_made_safe_to_draw(spark):
    text = "a\nb\x07<&‮evil ‍­﻿ok"
    got = spark.createDataFrame([(text,)], "t string").select(width.sanitize(F.col("t"))).first()[0]
    assert got == "a�b�<&�evil�‍��ok�"
