"""From files to a graph: a small shop in Python, and the shapes of calls."""

import pytest
from evgraph.extract import python_facts
from evgraph.operators import assemble, resolve
from pyspark.sql import functions as F

# A repository as input, whose graph must have the counts given for it.
SHOP = {
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = ["fastapi", "requests"]\n',
    "src/shop/__init__.py": "from .orders import Order\n",
    "src/shop/orders.py": "import requests\nfrom shop.db import Session\nfrom .base import Base\n\n\nclass Order(Base):\n    def save(self):\n        self.validate()\n        Session().add(self)\n        requests.post('x')\n",
    "src/shop/base.py": "class Base:\n    def validate(self):\n        return True\n",
    "src/shop/db.py": "class Session:\n    def add(self, obj):\n        return obj\n",
    "src/shop/api.py": "from fastapi import APIRouter\nfrom shop import Order\nfrom . import db\n\nrouter = APIRouter()\n\n\n@router.post('/orders')\ndef create():\n    Order().save()\n    db.Session()\n    missing.call()\n",
    "src/ns/tool/run.py": "from ns.tool import helpers\n\n\ndef go():\n    helpers.assist()\n",
    "src/ns/tool/helpers.py": "def assist():\n    return 1\n",
}


def tables(spark, sources):
    rows = [(p, "python", t.count("\n"), t) for p, t in sources.items() if p.endswith(".py")]
    files = spark.createDataFrame(rows, "path string, lang string, line_count int, text string")
    return files, python_facts.extract(files)


def test_a_shop_becomes_the_graph_that_its_files_say(spark, tmp_path):
    for path, text in SHOP.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = assemble.of_folder(spark, str(tmp_path))
    nodes = {r.id: r for r in got.nodes.collect()}
    assert len(nodes) == 16 and nodes["src/shop/orders.py#src.shop.orders.Order.save"].start_line == 7
    edges = got.edges.collect()
    assert len(edges) == 17 and all(r.resolution == "resolved" for r in edges)
    kinds = {k: sum(r.kind == k for r in edges) for k in ("imports", "calls", "references", "inherits")}
    assert kinds == {"imports": 7, "calls": 5, "references": 4, "inherits": 1}
    assert {r.src for r in edges} | {r.dst for r in edges} <= set(nodes)
    calls = {(r.src.rpartition(".")[2], r.dst.rpartition(".")[2], r.start_line, r.shape) for r in edges if r.kind == "calls"}
    assert calls == {("save", "validate", 8, "self"), ("save", "Session", 9, "bare"), ("create", "Order", 10, "bare"), ("create", "Session", 11, "qualified"), ("go", "assist", 5, "qualified")}
    card = {r.kind: (r.resolved, r.candidate, r.external, r.unresolved, r.pinned_pct) for r in got.scorecard().collect()}
    assert card == {"calls": (5, 0, 2, 3, 62.5), "imports": (6, 0, 2, 0, 100.0), "references": (6, 0, 1, 0, 100.0), "inherits": (1, 0, 0, 0, 100.0)}


SHAPES = {
    "a/__init__.py": "from .store import Store as Shop\n",
    "a/store.py": "class Base:\n    def close(self):\n        pass\n\n\nclass Store(Base):\n    def open(self):\n        super().close()\n\n\nclass Logger:\n    def note(self):\n        pass\n",
    "a/use.py": "from a import Shop\nimport a.tools as tools\nfrom .store import Logger\n\n\nclass User:\n    log: Logger\n\n    def __init__(self, shop: Shop, own: 'Store'):\n        self.own = own\n\n    def run(self, user: User):\n        self.own.open()\n        user.log.note()\n        tools.mend()\n        twice()\n        never()\n        self.log.note()\n        os.getcwd()\n        self.own.close()\n",
    "a/tools.py": "def mend():\n    pass\n",
    "b/one.py": "def twice():\n    pass\n",
    "b/two.py": "def twice():\n    pass\n",
    "b/shadow.py": "from a.tools import mend\n\n\ndef mend():\n    pass\n\n\ndef go(tools: int):\n    mend()\n    tools.mend()\n",
    "b/broken.py": "def (:\n",
    "b/many.py": "".join(f"class C{i}:\n    def f(self):\n        pass\n" for i in range(3)) + "".join("def many():\n    pass\n" for _ in range(2)),
} | {f"m/f{i}.py": "def common():\n    pass\n" for i in range(9)} | {"m/call.py": "common()\n"}


def test_shapes_of_calls(spark):
    files, facts = tables(spark, SHAPES)
    got = assemble.graph(files, facts)
    edges = got.edges.filter("kind = 'calls'").collect()
    by = {(r.file, r.start_line, r.dst) for r in edges if r.resolution == "resolved"}
    use, store = "a/use.py", "a/store.py#a.store."
    assert by == {
        ("a/store.py", 8, store + "Base.close"), (use, 13, store + "Store.open"), (use, 14, store + "Logger.note"), (use, 15, "a/tools.py#a.tools.mend"),
        (use, 18, store + "Logger.note"), (use, 20, store + "Base.close"), ("b/shadow.py", 9, "b/shadow.py#b.shadow.mend"),
    }
    maybe = [r for r in edges if r.resolution == "candidate"]
    assert {(r.dst, r.arity) for r in maybe} == {("b/one.py#b.one.twice", 2), ("b/two.py#b.two.twice", 2)}
    # The call and the definition are both evidence of a candidate.
    assert {(r.file, r.start_line) for r in maybe} == {(use, 16), ("b/one.py", 1), ("b/two.py", 1)}
    nodes = [r.id for r in got.nodes.collect()]
    assert len(nodes) == len(set(nodes)) and "b/broken.py" in nodes and "b/many.py#b.many.many" in nodes
    # Nine files define the name: over eight are no answer.
    assert not [r for r in edges if r.file == "m/call.py"]
    names = {(r.src, r.dst) for r in got.edges.filter("kind = 'references'").collect()}
    assert ("a/use.py", store + "Store") in names and ("a/__init__.py", store + "Store") in names


def test_a_star_is_no_name(spark):
    files, facts = tables(spark, {"a.py": "from b import *\nfrom b import f, gone\n", "b.py": "def f():\n    pass\n"})
    card = {r.kind: (r.resolved, r.unresolved) for r in assemble.graph(files, facts).scorecard().collect()}
    assert card == {"imports": (2, 0), "references": (1, 1)}


def test_an_empty_folder_is_an_empty_graph(spark):
    files, facts = tables(spark, {"x.py": ""})
    got = assemble.graph(files.limit(0), facts.limit(0))
    assert got.nodes.count() == got.edges.count() == got.references.count() == 0
    one = assemble.graph(files, facts)
    assert [(r.id, r.start_line) for r in one.nodes.collect()] == [("x.py", 0)]


@pytest.mark.parametrize(("spec", "level", "path", "want"), [("shop.db", 0, "src/shop/api.py", "src/shop/db.py"), ("", 1, "src/shop/api.py", "src/shop/__init__.py"), ("shop.tool", 2, "src/ns/tool/run.py", None), ("tool.run", 2, "src/ns/tool/run.py", "src/ns/tool/run.py"), ("ns", 0, "src/shop/api.py", None), ("shop", 0, "src/ns/tool/run.py", "src/shop/__init__.py")])
def test_modules_named(spark, spec, level, path, want):
    files, _ = tables(spark, SHOP)
    asked = spark.createDataFrame([(path, spec, level)], "path string, spec string, level int")
    got = [r.target for r in assemble.modules_named(asked, files, resolve.import_tops(files)).collect()]
    assert got == ([want] if want else [])


def test_prefix_of_names(spark):
    from evgraph.schema import qualified_prefix, symbol_id

    rows = spark.createDataFrame([("a/b.py",), ("a/__init__.py",), ("__init__.py",), ("c.py",)], "path string")
    got = rows.select(qualified_prefix(F.col("path")), symbol_id(F.col("path"), F.lit("f"))).collect()
    assert [tuple(r) for r in got] == [("a.b", "a/b.py#a.b.f"), ("a", "a/__init__.py#a.f"), ("", "__init__.py#f"), ("c", "c.py#c.f")]


def test_build_and_ask(spark, tmp_path, capsys):
    from evgraph import __main__ as command

    for path, text in SHOP.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    assert command.main([str(tmp_path / "graph"), "build", str(tmp_path / "src")]) == 0
    assert '"resolved":5' in capsys.readouterr().out
    assert command.main([str(tmp_path / "graph"), "affected", "Base"]) == 0
    assert "Order" in capsys.readouterr().out
