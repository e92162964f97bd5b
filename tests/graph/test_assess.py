"""Assessment, snapshots and the command line, end to end on small inputs."""

import json
import os

import pytest
from evgraph import __main__ as cli
from evgraph.operators import health, lock
from evgraph.sources import graph_json
from pyspark.sql import functions as F


def test_module_and_class_checks(spark):
    deps = [("a", "b"), ("b", "a"), ("c", "c")] + [(f"s{i}", "hub") for i in range(10)] + [("hub", f"t{i}") for i in range(10)]
    got = health.module_checks(spark.createDataFrame(deps, "src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == [("hub-module", "hub", 10), ("module-cycle", "a", 2)]
    functions = spark.createDataFrame([("f", "A.x", 40), ("f", "A.y", 8), ("f", "B.x", 47), ("f", "top", 99)], "path string, qualified_name string, complexity int")
    assert [tuple(r) for r in health.class_checks(functions).collect()] == [("large-class", "f", "A", 48)]


def test_assess_leaves_exceptions_out(spark):
    found = spark.createDataFrame([("weak-hash", "a", 3, 1), ("weak-hash", "a", 4, 1), ("complex-function", "b", 1, 14), ("debug-enabled", "c", 2, 1)], "check string, file string, line int, value long")
    excepted = spark.createDataFrame([("weak-hash", "a", 3), ("debug-enabled", "c", None)], "check string, file string, line int")
    got = health.assess([found.filter("file = 'a'"), found.filter("file <> 'a'")], excepted, health.catalog(spark))
    assert sorted((r.check, r.line, r.minutes) for r in got.collect()) == [("complex-function", 1, 14), ("weak-hash", 4, 10)]


def test_snapshot_records(spark, tmp_path):
    modules = spark.createDataFrame([("", "root"), ("a/x", "x"), ("b/x", "x")], "module string, label string")
    deps = spark.createDataFrame([("a/x", "b/x"), ("a/x", "gone"), ("", "a/x")], "src string, dst string")
    role = spark.createDataFrame([("role", ["a/x", "api"])], "kind string, fields array<string>")
    records, wrong = lock.build(modules, deps, [role])
    assert sorted(tuple(r.fields) for r in records.filter("kind = 'dep'").collect()) == [(".", "a/x"), ("a/x", "b/x")]
    assert sorted(tuple(r) for r in wrong.collect()) == [("L-004", "x"), ("L-009", "gone")]
    lock.write(records, f"file://{tmp_path}/lock")
    back = lock.read(spark, f"file://{tmp_path}/lock")
    assert back.filter("error is not null").count() == 0 and back.select("kind", "fields").exceptAll(records).count() == 0
    assert [r.code for r in lock.build(modules.limit(0), deps.limit(0), [])[1].collect()] == ["L-010"]


def test_command_line(spark, tmp_path, capsys):
    nodes = spark.createDataFrame([("a", "m", "x", "q.a"), ("b", "m", "x", "q.b"), ("c", "m", "z", "q.c")], "id string, kind string, label string, qualified_name string")
    edges = spark.createDataFrame([("a", "b", "imports", None), ("b", "c", "imports", None)], "src string, dst string, kind string, context string")
    graph_json.save(nodes, edges, f"file://{tmp_path}")
    out = lambda *a: (cli.main([f"file://{tmp_path}", *a]), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])
    assert out("affected", "c") == (0, [{"id": "b", "kind": "m", "hops": 1, "via": "imports"}, {"id": "a", "kind": "m", "hops": 2, "via": "imports"}])
    assert [r["dst"] for r in out("shortest_path", "q.a", "z")[1]] == ["b", "c"]
    assert out("god_nodes", "1")[1][0]["id"] == "b" and out("affected", "a")[0] == 1
    for bad in (("get_node", "x"), ("get_node", "none"), ("nothing",)):
        with pytest.raises(SystemExit):
            cli.main([f"file://{tmp_path}", *bad])


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_queries_match_their_sql(spark):
    import duckdb
    from evgraph import catalog

    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    show = lambda v: str(round(v, 6)) if isinstance(v, float) else str(v)
    for name, make in catalog.QUERIES.items():
        found = make(spark, DATA)
        rows = found.select(*[F.col(f"`{c}`") for c in sorted(found.columns)]).collect()
        if name in catalog.SQL:
            want = db.execute(catalog.SQL[name])
            at = sorted((d[0], i) for i, d in enumerate(want.description))
            assert [c for c, _ in at] == sorted(found.columns), name
            assert sorted(tuple(map(show, r)) for r in rows) == sorted(tuple(show(r[i]) for _, i in at) for r in want.fetchall()), name


def test_path_collisions_and_roles(spark):
    from evgraph.operators import build

    paths = spark.createDataFrame([("é.py",), ("é.py",), ("A.py",), ("a.py",), ("b.py",), ("b.py",)], "path string")
    assert sorted((r.reason, r.key, r.paths) for r in build.path_collisions(paths).collect()) == [("case", "a.py", 2), ("nfc", "é.py", 2)]
    roles = build.module_roles({"api": spark.createDataFrame([("a/x.py",), ("a/y.py",)], "path string"), "worker": spark.createDataFrame([("a/z.py",), ("q.py",)], "path string")})
    assert sorted(tuple(r) for r in roles.collect()) == [("", "worker"), ("a", "api"), ("a", "worker")]


def test_nearest_method_above(spark):
    from evgraph.operators import resolve

    symbols = [("f", "Root", "class", [], "Root", ""), ("f", "go", "method", [], "Root.go", "Root"), ("f", "far", "method", [], "Root.far", "Root"), ("f", "Mid", "class", ["m.Root"], "Mid", ""), ("f", "go", "method", [], "Mid.go", "Mid"), ("g", "Leaf", "class", ["Mid"], "Leaf", ""), ("g", "Loop", "class", ["Loop"], "Loop", "")]
    frame = spark.createDataFrame(symbols, "path string, name string, kind string, bases array<string>, qualified_name string, enclosing_class string")
    assert sorted((r["class"], r.ancestor, len(r.order)) for r in resolve.ancestors(frame).filter("class <> 'Loop'").collect()) == [("Leaf", "Mid", 1), ("Leaf", "Root", 2), ("Mid", "Root", 1)]
    calls = spark.createDataFrame([("g", 1, "self", "self", "go", "Leaf"), ("g", 2, "super", "", "far", "Leaf"), ("g", 3, "self", "self", "none", "Leaf")], "path string, start_line int, shape string, receiver string, name string, enclosing_class string")
    imports = spark.createDataFrame([], "path string, specifier string, target string")
    got = {r.name: (r.target, r.state) for r in resolve.call_targets(calls, frame, imports).collect()}
    assert got == {"go": ("f#Mid.go", "resolved"), "far": ("f#Root.far", "resolved"), "none": (None, "unresolved")}


def test_views_are_validated(spark):
    from evgraph.operators import derive

    nodes = spark.createDataFrame([("top", "a", "inner"), ("top", "a", None), ("inner", "b", "gone"), ("alone", "c", None)], "view string, id string, drill string")
    edges = spark.createDataFrame([("top", "a", "zz"), ("inner", "b", "b")], "view string, src string, dst string")
    assert sorted(tuple(r) for r in derive.validate(nodes, edges, "top").collect()) == [("loose-edge", "top/zz"), ("lost-drill", "inner/b"), ("repeated-id", "top/a"), ("unreached-view", "alone")]


def test_functions_in_sql(spark):
    from evgraph import functions

    assert len(functions.register(spark)) == 3
    assert spark.sql("select evgraph_folded('ÉA') as x").first().x == "éa"
