"""Graph operators on small hand-built inputs, with the edge cases of each."""

import random

import pytest
from evgraph.functions import classify, text
from evgraph.operators import ask, build, communities, derive, design, findings, health, joins, layout, lock, traverse
from evgraph.schema import module_of, shown_module
from pyspark.sql import functions as F

NODES = [("a.py", "module", "a", "a"), ("a.py#f", "function", "f", "a.f"), ("b.py#f", "function", "f", "b.f"), ("c.py", "module", "a.py", "c"), ("d.py", "module", "d", "d")]
EDGES = [
    ("a.py", "b.py#f", "imports", None), ("a.py#f", "a.py", "contains", None), ("b.py#f", "c.py", "calls", "test"), ("c.py", "d.py", "imports", None),
    ("d.py", "a.py", "rationale_for", "rationale"), ("c.py", "gone.py", "imports", None), ("a.py", "c.py", "calls", None),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, kind string, label string, qualified_name string")
    return nodes, spark.createDataFrame(EDGES, "src string, dst string, kind string, context string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resolve_prefers_an_id_and_tells_ambiguity(spark, graph):
    names = spark.createDataFrame([("a.py",), ("f",), ("b.f",), ("none",)], "name string")
    assert rows(ask.resolve(graph[0], names)) == [("a.py", "a.py", "id"), ("b.f", "b.py#f", "qualified_name"), ("f", "a.py#f", "label"), ("f", "b.py#f", "label")]
    assert rows(ask.answerable(graph[0], names)) == [("a.py", 1, "match"), ("b.f", 1, "match"), ("f", 2, "ambiguous"), ("none", 0, "no node")]


def test_degrees_count_dangling_edges(graph):
    assert rows(ask.degrees(*graph).select("id", "in_degree", "out_degree")) == [("a.py", 2, 2), ("a.py#f", 0, 1), ("b.py#f", 1, 1), ("c.py", 2, 2), ("d.py", 1, 1)]
    assert [r.id for r in ask.god_nodes(*graph, 2).collect()] == ["a.py", "c.py"]


def test_neighbours_hide_contains_and_missing_ends(spark, graph):
    got = ask.neighbours(*graph, ids(spark, "a.py", "c.py"))
    assert rows(got.select("direction", "node", "other")) == [("in", "a.py", "d.py"), ("in", "c.py", "a.py"), ("in", "c.py", "b.py#f"), ("out", "a.py", "b.py#f"), ("out", "a.py", "c.py"), ("out", "c.py", "d.py")]
    assert rows(ask.neighbours(*graph, ids(spark, "a.py"), relation="contains").select("other")) == [("a.py#f",)]
    assert ask.neighbours(*graph, ids(spark, "c.py"), relation="test", direction="out").count() == 0


def test_affected_leaves_rationale_out(spark, graph):
    assert rows(ask.affected(*graph, ids(spark, "d.py"))) == [("a.py", "module", 2, "calls"), ("a.py#f", "function", 3, "contains"), ("b.py#f", "function", 2, "test"), ("c.py", "module", 1, "imports")]
    assert rows(ask.affected(*graph, ids(spark, "a.py"), relation="rationale")) == [("d.py", "module", 1, "rationale")]
    assert ask.affected(*graph, ids(spark, "d.py"), depth=0).count() == 0


def test_shortest_path_is_the_first_found(spark, graph):
    edges = graph[1].filter("kind <> 'rationale_for'").drop("context")
    assert rows(traverse.shortest_path(edges, ids(spark, "a.py#f"), "d.py")) == [(1, "a.py#f", "a.py", "contains"), (2, "a.py", "c.py", "calls"), (3, "c.py", "d.py", "imports")]
    assert traverse.shortest_path(edges, ids(spark, "d.py"), "a.py").count() == 0
    assert traverse.shortest_path(edges, ids(spark, "d.py"), "a.py", undirected=True).count() == 2
    assert traverse.shortest_path(edges, ids(spark, "a.py#f"), "d.py", max_hops=2).count() == 0


def test_closure_components_and_layers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 5), (7, 7)], "src long, dst long")
    pairs = traverse.closure(edges)
    assert (1, 5) in rows(pairs) and (5, 1) not in rows(pairs) and (7, 7) in rows(pairs)
    assert rows(traverse.strong_components(edges)) == [(1, 1), (2, 1), (3, 1), (7, 7)]
    assert dict(rows(traverse.layers(edges))) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 0, 7: 0}


def test_components_and_layers_of_a_random_graph(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(70), rng.randrange(70)) for _ in range(95)}
    after = {n: {b for a, b in edges if a == n} for n in range(70)}
    reach = {}
    for n in range(70):
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        reach[n] = seen
    want = {n: min(m for m in reach[n] | {n} if n in reach[m] and m in reach[n]) for n in range(70) if n in reach[n]}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert dict(rows(traverse.strong_components(frame))) == want and len(set(want.values())) > 1
    point = {n: want.get(n, n) for e in edges for n in e}

    def depth(p):
        return max((1 + depth(point[a]) for a, b in edges if point[b] == p and point[a] != p), default=0)

    assert dict(rows(traverse.layers(frame))) == {n: depth(p) for n, p in point.items()}
    starts = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    assert {r[0] for r in rows(traverse.reached_by_all(frame, starts))} == reach[0] & reach[1] & reach[2]


def test_results_do_not_depend_on_partitions(spark, graph):
    want = rows(ask.affected(*graph, ids(spark, "d.py")))
    for n in (1, 3, 7):
        assert rows(ask.affected(graph[0].repartition(n), graph[1].repartition(n), ids(spark, "d.py"))) == want


def test_merge_edges(spark):
    facts = [("a", "b", "calls", "f", 1, 1, "resolved", 1, True, "p"), ("a", "b", "calls", "f", 1, 1, "candidate", 3, False, "q"), ("c", "d", "calls", "f", 2, 2, "candidate", 2, True, "p"), ("c", "d", "calls", "f", 2, 2, "candidate", 2, True, "p"), ("e", "f", "calls", "f", 2, 2, "candidate", 2, True, "p")]
    frame = spark.createDataFrame(facts, "src string, dst string, kind string, file string, start_line int, end_line int, resolution string, arity int, type_only boolean, producer string")
    got = {r.src: r for r in build.merge_edges(frame).collect()}
    assert (got["a"].resolution, got["a"].producer, got["a"].arity, got["a"].type_only, got["a"].mixed, got["a"].sites) == ("candidate", "q", 3, False, True, 1)
    assert got["a"].dropped and got["c"].dropped and not got["e"].dropped and not got["c"].mixed


@pytest.mark.parametrize(("file", "start", "end", "reason"), [("f", 1, 9, None), ("f", 1, 10, "past-end"), ("f", 3, 2, "bad-range"), ("f", 0, 0, "zero-range"), ("empty", 0, 0, None), ("x", 1, 1, "unknown-file"), ("f", 0, 1, "bad-range")])
def test_evidence(spark, file, start, end, reason):
    files = spark.createDataFrame([("f", 9), ("empty", 0)], "file string, line_count int")
    sites = spark.createDataFrame([(file, start, end)], "file string, start_line int, end_line int")
    assert build.verify_evidence(sites, files).first().reason == reason


def test_nodes_keep_the_first(spark):
    frame = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z"), ("b", 4, "z")], "id string, ord int, label string")
    assert rows(build.dedup_nodes(frame, "ord", ["label"])) == [("a", "x", 2, True), ("b", "z", 2, False)]


def test_multiset_difference_keeps_later_rows(spark):
    head = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, "z"), (5, None)], "n int, key string")
    base = spark.createDataFrame([("k",), (None,)], "key string")
    assert rows(findings.unmatched(head, base, ["key"], ["n"]).select("n")) == [(2,), (3,), (4,)]


def test_moved_findings_need_a_vanished_file(spark):
    new = spark.createDataFrame([(1, "c", "new.py", "m")], "n int, check string, file string, key string")
    old = spark.createDataFrame([(9, "c", "old.py", "m")], "n int, check string, file string, key string")
    gone = spark.createDataFrame([("old.py",)], "file string")
    assert findings.without_moved(new, old, gone, ["check", "key"], ["n"], "file").count() == 0
    assert findings.without_moved(new, old, gone.limit(0), ["check", "key"], ["n"], "file").count() == 1


def test_grades(spark):
    base = spark.createDataFrame([("x", "A"), ("y", "B"), ("z", "C")], "area string, grade string")
    head = spark.createDataFrame([("x", "B"), ("y", "B"), ("w", "A")], "area string, grade string")
    assert sorted(map(str, rows(findings.grade_changes(base, head)))) == ["('w', None, 'A', False)", "('x', 'A', 'B', True)", "('z', 'C', None, False)"]


def test_lock_text(spark):
    fields = ["a\tb", "c\\d", "e\nf\r", "\\t", ""]
    shown = lock.render(spark.createDataFrame([("note", fields)], "kind string, fields array<string>"))
    assert "\n" not in shown.first().value and lock.parse(shown).first().fields == fields
    lines = spark.createDataFrame([("module\tx\r",), ("Bad\tx",), ("module\ta\tb",), ("new_kind\t1\t2\t3",), ("module\ta\\q",), ("module\tx\\",)], "value string")
    assert [r.error for r in lock.parse(lines).collect()] == [None, "L-001", "L-002", None, "L-003", "L-003"]


def test_joins(spark):
    points = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "id int, at int")
    spans = spark.createDataFrame([("wide", 0, 100), ("in", 4, 6), ("as", 4, 6)], "name string, lo int, hi int")
    assert sorted((r.id, r.name or "") for r in joins.innermost(points, ["id"], "at", spans, "lo", "hi", "name").collect()) == [(1, "as"), (2, "wide"), (3, "")]
    paths = spark.createDataFrame([("a/b/c",), ("x/y",)], "path string")
    known = spark.createDataFrame([("a",), ("a/b",), ("a/bb",)], "dir string")
    assert rows(joins.longest_prefix(paths, ["path"], F.col("path"), known, "dir").select("path", "candidate")) == [("a/b/c", "a/b")]
    rng = random.Random(4)
    spans = [(i, rng.randrange(3), lo := rng.randrange(300), lo + rng.randrange(60)) for i in range(120)]
    frame = spark.createDataFrame(spans, "id int, lane int, lo int, hi int")
    got = joins.overlaps(frame, frame, ["lane"], "lo", "hi", 16.0).select("a_id", "b_id")
    assert rows(got) == sorted((a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_windows_and_runs(spark):
    block = [f"line {i}" for i in range(14)]
    texts = [(1, "\n".join(["# skip", *block, "end one"])), (2, "\n".join(["start", "", *block])), (3, "\n".join(block[:9])), (4, None), (5, "import x\n" * 30)]
    found = health.windows(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    assert health.duplicated(found, "id").count() == 5
    assert rows(health.duplicate_runs(found, "id")) == [(1, 0, 14), (2, 1, 14)]


def test_thresholds_are_strict(spark):
    frame = spark.createDataFrame([(1, 10, 5), (2, 11, 6)], "id int, complexity int, params int")
    got = health.exceeded(frame, ["id"], {"complexity": "complex-function", "params": "many-parameters"}, health.catalog(spark))
    assert rows(got.select("id", "check", "minutes")) == [(2, "complex-function", 11), (2, "many-parameters", 5)]
    assert dict(rows(health.area_ratings(got, spark))) == {"maintainability": "C", "performance": "A", "reliability": "A", "security": "A"}
    assert [spark.range(1).select(health.ratio_rating(F.lit(d), F.lit(n))).first()[0] for d, n in ((150, 100), (151, 100), (1501, 100), (0, 0))] == ["A", "B", "E", "A"]


def test_design(spark):
    modules = spark.createDataFrame([("app/api",), ("api/service",), ("app/data",), ("x",)], "module string")
    parts = spark.createDataFrame([("layered", "api", 0, "api"), ("layered", "service", 1, "service"), ("layered", "data", 2, "data")], "style string, part string, rank int, name string")
    assigned = design.assign(modules, "module", parts)
    assert rows(assigned.select("module", "part", "score")) == [("api/service", "service", 3), ("app/api", "api", 3), ("app/data", "data", 3)]
    forbidden = design.forbidden_pairs(spark.createDataFrame([("layered", ["api", "service", "data"])], "style string, parts array<string>"))
    assert rows(forbidden) == [("layered", "data", "api"), ("layered", "data", "service"), ("layered", "service", "api")]
    deps = spark.createDataFrame([("app/data", "app/api"), ("app/api", "app/data")], "src string, dst string")
    assert rows(design.wrong_way(deps, assigned, "module", forbidden).select("src", "dst")) == [("app/data", "app/api")]
    assert rows(design.fit(assigned, deps, "module", F.lit(4), forbidden)) == [("layered", 0.75, 0.5, 0.375)]


def test_communities_find_planted_groups(spark):
    rng = random.Random(1)
    pairs = [(f"m{a:02}", f"m{b:02}", 4.0 if a // 8 == b // 8 else 1.0) for a in range(24) for b in range(a) if a // 8 == b // 8 or rng.random() < 0.03]
    frame = spark.createDataFrame(pairs, "a string, b string, weight double")
    names = spark.createDataFrame([(f"m{i:02}",) for i in range(24)] + [("alone",)], "module string")
    got = communities.communities(names, frame)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.anchor, set()).add(r.module)
    assert sorted(map(sorted, groups.values())) == [["alone"]] + [[f"m{i:02}" for i in range(g, g + 8)] for g in (0, 8, 16)]
    assert rows(got) == rows(communities.communities(names.repartition(5), frame.repartition(3)))


def test_views(spark):
    edges = spark.createDataFrame([("h", "a"), ("a", "b"), ("b", "c"), ("a", "d"), ("d", "a"), ("k", "a")], "src string, dst string")
    flow = derive.data_flow(edges, ids(spark, "h", "k"))
    assert dict(rows(flow.nodes)) == {"h": 0, "k": 0, "a": 1, "b": 2, "d": 2}
    assert ("d", "a", "upstream") in rows(flow.edges) and ("a", "b", "downstream") in rows(flow.edges)
    story = derive.request_flow(edges, ids(spark, "h"), most=1)
    assert {r.id for r in story.nodes.collect()} == {"h", "a", "b"}
    assert rows(derive.through(edges, ids(spark, "h", "c")).select("src", "dst", "via")) == [("h", "c", 2)]
    weighted = edges.withColumn("weight", F.lit(2))
    groups = spark.createDataFrame([("h", "x"), ("k", "x"), ("a", "y"), ("b", "y"), ("c", "z")], "id string, grp string")
    assert rows(derive.architecture(weighted, groups).edges) == [("x", "y", 4, 2), ("y", "z", 2, 1)]
    made, absent = derive.derive_all({"modules": lambda: derive.module_view(weighted), "erd": derive.erd})
    assert set(made) == {"modules"} and set(absent) == {"erd"}
    assert rows(derive.tree(spark.createDataFrame([("a/b",), ("a/c",), ("d",)], "m string"), "m")) == [(1, "a", 2), (1, "d", 1), (2, "a/b", 1), (2, "a/c", 1)]


def test_layout_checks(spark):
    boxes = spark.createDataFrame([("v", "a", 0, 0, 50, 20), ("v", "b", 52, 0, 90, 20), ("v", "c", 300, 0, 320, 20), ("w", "a", 0, 0, 50, 20)], "view string, id string, x1 int, y1 int, x2 int, y2 int")
    assert rows(layout.box_overlaps(boxes)) == [("v", "a", "b")]
    lines = spark.createDataFrame([("v", 1, "a", "c", 50, 10, 300, 10), ("v", 2, "b", "d", 90, 10, 400, 10), ("v", 3, "a", "x", 60, 10, 95, 10), ("v", 4, "q", "r", 10, 50, 10, 90)], "view string, route int, src string, dst string, x1 int, y1 int, x2 int, y2 int")
    assert rows(layout.route_overlaps(lines)) == [("v", 1, 2, 210), ("v", 2, 3, 5)]
    assert rows(layout.crossings(lines, boxes)) == [("v", 1, "b"), ("v", 2, "c"), ("v", 3, "b")]
    canvas = spark.createDataFrame([("v", 310, 100), ("w", 100, 100)], "view string, width int, height int")
    assert rows(layout.outside(boxes, canvas)) == [("v", "c")]
    nodes = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)], "id string, layer int, place int")
    assert ("d", 1, 0) in rows(layout.barycentres(nodes, spark.createDataFrame([("a", "d"), ("b", "c")], "src string, dst string")))
    turned = layout.long_edges(spark.createDataFrame([("d", "a"), ("a", "z")], "src string, dst string"), spark.createDataFrame([("a", 0), ("d", 1), ("z", 3)], "id string, layer int"))
    assert sorted(map(str, rows(turned))) == ["('a', 'z', False, [1, 2])", "('d', 'a', True, [])"]


@pytest.mark.parametrize(
    ("path", "body", "role"),
    [(".github/x.py", "", "tooling"), ("a/vendor/x.py", "", "vendored"), ("db/migrations/1.sql", "", "config"), ("db/migrations/1.py", "", "generated"), ("x_pb2.py", "", "generated"), ("v/1.py", "revision = 1\ndown_revision = 2\n", "generated"), ("tests/x.py", "", "test"), ("a/x_test.go", "", "test"), ("docker-compose.prod.yml", "", "config"), ("a.go", "// Code generated by x. DO NOT EDIT.\n", "generated"), ("a.py", "\n" * 6 + "# @generated\n", "source"), ("src/fixtures/a.py", "", "source")],
)
def test_roles(spark, path, body, role):
    frame = spark.createDataFrame([(path, body)], "path string, text string")
    assert frame.select(classify.role(F.col("path"), F.col("text"))).first()[0] == role


def test_ignore_lines(spark):
    lines = ["# no", "*.log", "!keep.log", "/top", "dir/", "a/**/z.py", "b/*.txt", "bad\\", "q?[0-9].c"]
    paths = ["x/y.log", "x/keep.log", "top/f", "x/top", "dir/f", "x/dir/f", "dir", "a/z.py", "a/b/c/z.py", "b/x.txt", "b/c/x.txt", "qq1.c", "qqa.c"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in frame.filter(classify.is_ignored(F.col("path"), lines)).collect()]
    assert got == ["x/y.log", "top/f", "dir/f", "x/dir/f", "a/z.py", "a/b/c/z.py", "b/x.txt", "qq1.c"]


def test_text_functions(spark):
    frame = spark.createDataFrame([("getThreadHistory of_PostgreSQL the x",)], "t string")
    assert frame.select(text.tokens(F.col("t"))).first()[0] == ["get", "thread", "history", "postgre", "sql"]
    assert "postgresql" in frame.select(text.tokens(F.col("t"), keep_whole=True)).first()[0]
    names = spark.createDataFrame([("Stra\u00dfe",), ("STRASSE",), ("e\u0301",), ("\u00e9",)], "n string")
    assert [r[0] for r in names.select(text.folded("n")).collect()] == ["strasse", "strasse", "\u00e9", "\u00e9"]
    assert frame.select(text.json_cost(F.struct(F.lit(1).alias("a")))).first()[0] == 5
    paths = spark.createDataFrame([("values-prod.yaml",), ("deploy/live/reload.yaml",), ("live.yaml",), ("prod_utils.py",), ("settings/production.py",)], "p string")
    assert [r[0] for r in paths.select(classify.environment_of_path(F.col("p"))).collect()] == ["production", None, "production", None, "production"]
    assert [r[0] for r in paths.select(shown_module(module_of(F.col("p")))).collect()] == [".", "deploy/live", ".", ".", "settings"]
    counts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\n\nb",)], "t string")
    assert [r[0] for r in counts.select(classify.line_count(F.col("t"))).collect()] == [0, 1, 1, 3]


def test_budget_is_a_prefix(spark):
    frame = spark.createDataFrame([(i, 5 + i) for i in range(10)], "id int, size int")
    assert rows(ask.within_budget(frame, F.col("size"), [F.col("id")], 18).select("id", "spent")) == [(0, 5), (1, 11), (2, 18)]


def test_evidence_order_has_every_citation(spark):
    from evgraph import catalog
    from evgraph.sources import star

    path = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["evidence_ordered"](spark, path).collect()
    assert len(rows) == star.edges(spark, path).select("file", "line").distinct().count() > 60
    assert sum(r.n for r in rows) == star.edges(spark, path).count()
    keys = [(r.whole, r.file, r.line) for r in rows]
    assert keys == sorted(keys)


def test_boxes_of_one_place_meet_as_one_row(spark, monkeypatch):
    monkeypatch.setattr(joins, "STACK", 4)
    rng = random.Random(4)
    made = [(i, x := rng.choice((0, 30, 63, 64)), y := rng.choice((0, 64)), x + rng.choice((0, 10)), y + 5) for i in range(40)]
    made += [made[0], (None, 0, 0, 5, 5), (99, None, 0, 5, 5), (1, 0, 0, 10, 5)]
    stacks = joins.stacked(spark.createDataFrame(made, "id int, x1 int, y1 int, x2 int, y2 int"), [])
    assert 1 < max(len(r.held) for r in stacks.collect()) < 20
    got = joins.unstacked(joins.pairs_within(stacks, [], 64.0), [])
    whole = [m for m in made if None not in m]
    want = [(a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]]
    assert rows(got) == sorted(want)
