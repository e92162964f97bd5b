"""Files, facts, resolution, stored graphs and streams."""

import hashlib

import pytest
from evgraph.extract import python_facts
from evgraph.operators import resolve
from evgraph.sources import files, graph_json
from evgraph.streaming import diffs
from pyspark.sql import functions as F

TREE = {
    ".gitignore": "ignored/\n",
    "shop/__init__.py": "",
    "shop/api.py": "from shop.store import save, Store\nfrom . import util\nimport requests\n\n\ndef handle(x):\n    save(x)\n    util.trim(x)\n    return requests.get(x)\n",
    "shop/store.py": "class Base:\n    def put(self, k):\n        return k\n\n\nclass Store(Base):\n    def keep(self, k):\n        self.put(k)\n        self.lost()\n\n\ndef save(x):\n    q = 'select ' + x\n    db.execute(q)\n    for i in x:\n        db.execute('a')\n",
    "shop/util.py": "def trim(s):\n    if s and len(s) > 3:\n        for c in s:\n            try:\n                c()\n            except ValueError:\n                pass\n    elif s:\n        return [x for x in s if x]\n    return s\n",
    "shop/broken.py": "def f(:\n",
    "ignored/x.py": "x = 1\n",
    "node_modules/y.js": "1\n",
    "web/app.ts": "export {}",
    "big.py": "#" * 4000,
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return files.scan(spark, f"file://{root}", max_bytes=3000).cache(), files.skipped(spark, f"file://{root}", 3000)


def test_scan(scanned):
    got = {r.path: r for r in scanned[0].collect()}
    assert set(got) == set(TREE) - {"ignored/x.py", "node_modules/y.js", "big.py"}
    api = got["shop/api.py"]
    assert (api.role, api.lang, api.line_count) == ("source", "python", 9)
    assert api.content_hash == hashlib.sha256(TREE["shop/api.py"].encode()).hexdigest()
    assert got["shop/__init__.py"].line_count == 0 and got["web/app.ts"].lang == "typescript"
    assert [r.path for r in scanned[1].collect()] == ["big.py"]


def test_facts_and_metrics(scanned):
    facts = python_facts.extract(scanned[0]).cache()
    metrics = {r.qualified_name: r for r in python_facts.table(facts, "function").collect()}
    trim = metrics["trim"]
    assert (trim.complexity, trim.params, trim.nesting, trim.lines) == (7, 1, 3, 10)
    assert metrics["Base.put"].params == 1
    assert {(r.kind, r.start_line) for r in python_facts.table(facts, "risk").collect()} == {("no-timeout", 9), ("sql-injection", 14), ("query-in-loop", 16), ("swallowed-error", 6)}
    assert [r.path for r in python_facts.table(facts, "diagnostic").collect()] == ["shop/broken.py"]


def test_resolution(spark, scanned):
    facts = python_facts.extract(scanned[0]).cache()
    declared = spark.createDataFrame([("requests",)], "name string")
    imports = resolve.import_targets(python_facts.table(facts, "import"), scanned[0], declared).cache()
    assert {(r.imported, r.target, r.state) for r in imports.collect()} == {("save", "shop/store.py", "resolved"), ("Store", "shop/store.py", "resolved"), ("util", "shop/util.py", "resolved"), ("", None, "external")}
    calls = resolve.call_targets(python_facts.table(facts, "call"), python_facts.table(facts, "symbol"), imports)
    got = {(r.path, r.name, r.shape): (r.target, r.state) for r in calls.collect()}
    assert got[("shop/api.py", "save", "bare")] == ("shop/store.py#save", "resolved")
    assert got[("shop/store.py", "put", "self")] == ("shop/store.py#Base.put", "resolved")
    assert got[("shop/store.py", "lost", "self")] == (None, "unresolved")
    assert {(r.src, r.dst) for r in resolve.inherits(python_facts.table(facts, "symbol")).collect()} == {("shop/store.py#Store", "shop/store.py#Base")}
    exports = spark.createDataFrame([("a", "n", "b", "m"), ("b", "m", "c", "k")], "file string, name string, to_file string, to_name string")
    names = spark.createDataFrame([("a", "n"), ("z", "q")], "file string, name string")
    assert {tuple(r) for r in resolve.follow_reexports(names, exports).collect()} == {("a", "n", "c", "k"), ("z", "q", "z", "q")}


def test_stored_graph(spark, tmp_path):
    evidence = F.array(F.struct(F.lit("f").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(None).cast("string").alias("rev")))
    nodes = spark.createDataFrame([("b", "module"), ("a", "module")], "id string, kind string").withColumn("evidence", evidence)
    edges = spark.createDataFrame([("b", "a", "imports"), ("a", "b", "imports")], "src string, dst string, kind string")
    (tmp_path / "graph.json").write_text(graph_json.document(nodes, edges))
    back, links = graph_json.read(spark, f"file://{tmp_path}/graph.json")
    assert [(r.id, r.evidence[0].end_line) for r in back.orderBy("id").collect()] == [("a", 2), ("b", 2)]
    assert [(r.ord, r.src) for r in links.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        graph_json.document(nodes, edges, most=1)
    graph_json.save(nodes, edges, f"file://{tmp_path}/tables")
    assert graph_json.load(spark, f"file://{tmp_path}/tables")[1].count() == 2


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 05:00:00"), (1, "2024-01-09 00:00:00")], "user long, ts string").select("user", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = diffs.windowed(diffs.read(spark, f"file://{tmp_path}/events", events.schema), "ts", ["user"], "1 hour")
    query = stream.writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.user, r.n) for r in spark.sql("select * from counted").collect()} >= {(1, 2), (2, 1)}
    for i, ids in enumerate([["a", "b"], ["b", "c"]]):
        spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/snaps")
        diffs.record_diffs(diffs.read(spark, f"file://{tmp_path}/snaps", spark.createDataFrame([], "id string").schema), ["id"], f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
        got = {(r.id, r.op) for r in spark.read.parquet(f"file://{tmp_path}/out/diffs/batch={i}").collect()}
        assert got == ({("a", "added"), ("b", "added")} if i == 0 else {("c", "added"), ("a", "removed")})
