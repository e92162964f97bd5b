"""Deployed systems, views inside modules, and facts of servers and manifests."""

import pytest
from evgraph.extract import web
from evgraph.operators import components, deploy


def test_contexts_and_what_images_hold(spark):
    services = spark.createDataFrame([("deploy/compose.yml#api", "./api"), ("compose.yml#web", "./.web"), ("compose.yml#out", "../x"), ("compose.yml#all", "."), ("compose.yml#img", None)], "id string, build_context string")
    contexts = deploy.build_contexts(services)
    assert {tuple(r) for r in contexts.collect()} == {("deploy/compose.yml#api", "deploy/api"), ("compose.yml#web", ".web"), ("compose.yml#all", "")}
    modules = spark.createDataFrame([("deploy/api",), ("deploy/api/db",), ("deploy/apix",), (".web",), ("",), ("src/a",)], "module string")
    under = {(r.id.rpartition("#")[2], r.module) for r in deploy.modules_under(contexts, modules).collect()}
    assert under == {("api", "deploy/api"), ("api", "deploy/api/db"), ("web", ".web")} | {("all", m.module) for m in modules.collect()}
    files = spark.createDataFrame([("Dockerfile", "FROM x\nCOPY --from=b /y /z\nCOPY src/a deploy/api/db/q.py /app/\nADD [\"gone\", \"/x\"]")], "path string, text string")
    copied = deploy.ships(files)
    assert sorted((r.line, r.source) for r in copied.collect()) == [(3, "deploy/api/db/q.py"), (3, "src/a"), (4, "gone")]
    of = copied.selectExpr("'compose.yml#all' as id", "source", "line")
    known = spark.createDataFrame([("deploy/api/db/q.py",)], "path string")
    held = {(r.id.rpartition("#")[2], r.module, r.line) for r in deploy.modules_shipped(contexts, modules, of, known).collect()}
    assert held == {("api", "deploy/api", None), ("api", "deploy/api/db", None), ("web", ".web", None), ("all", "src/a", 3), ("all", "deploy/api/db", 3)}


def test_system_view(spark):
    nodes = spark.createDataFrame([("a/c.yml#web", "service", "web"), ("b/c.yml#web", "service", "web"), ("a/c.yml#db", "datastore", "db"), ("a/c.yml#q", "queue", "q"), ("x.py", "module", "x")], "id string, kind string, label string")
    edges = spark.createDataFrame([("a/c.yml#web", "a/c.yml#db"), ("x.py", "a/c.yml#db")], "src string, dst string")
    shipped = spark.createDataFrame([("a/c.yml#web", "ui"), ("b/c.yml#web", "api"), ("b/c.yml#web", "lib")], "id string, module string")
    roles = spark.createDataFrame([("ui", "frontend"), ("api", "api"), ("api", "auth")], "module string, role string")
    routes = spark.createDataFrame([("api/r.py",), ("api/r.py",), ("else/r.py",)], "path string")
    deps = spark.createDataFrame([("ui", "api"), ("api", "lib"), ("lib", "none")], "src string, dst string")
    view = deploy.system(nodes, edges, shipped, roles, routes, deps)
    assert {tuple(r) for r in view.nodes.collect()} == {("a/c.yml#web", "web (a)", "frontend", 0), ("b/c.yml#web", "web (b)", "backend", 2), ("a/c.yml#db", "db", "database", 0), ("a/c.yml#q", "q", "messagebus", 0)}
    assert {tuple(r) for r in view.edges.collect()} == {("a/c.yml#web", "a/c.yml#db", "declared"), ("a/c.yml#web", "b/c.yml#web", "code")}


def test_flow_code_and_cards(spark):
    files = spark.createDataFrame([("m/a.py",), ("m/b.py",), ("n/c.py",), ("m/d.py",)], "path string")
    rows = [("m/a.py", "m/b.py", "imports", "m/a.py", 1, 1), ("m/a.py#m.a.f", "m/b.py#m.b.g", "calls", "m/a.py", 4, 4), ("m/a.py#m.a.f", "m/b.py#m.b.g", "calls", "m/a.py", 4, 4), ("m/a.py#m.a.f", "m/a.py#m.a.h", "calls", "m/a.py", 5, 5), ("m/a.py", "n/c.py", "imports", "m/a.py", 2, 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, file string, start_line int, end_line int")
    view = components.flow(files, edges)
    assert {tuple(r) for r in view.edges.collect()} == {("m", "m/a.py", "m/b.py", 2)} and view.nodes.count() == 3
    nodes = spark.createDataFrame([("m/a.py#m.a.f", "function", "f"), ("m/a.py#m.a.h", "function", "h"), ("m/b.py#m.b.g", "function", "g"), ("m/a.py", "module", "a.py"), ("c#db", "datastore", "db")], "id string, kind string, label string")
    inner = components.code(nodes, edges)
    assert {tuple(r) for r in inner.edges.collect()} == {("m/a.py", "m/a.py#m.a.f", "m/a.py#m.a.h", 1)} and inner.nodes.count() == 2
    routes = spark.createDataFrame([("GET", f"/{i}", "api/r.py") for i in range(5)] + [("GET", "/", "r.py")], "method string, route string, path string")
    points = spark.createDataFrame([("tool", "a:main", "python")], "name string, target string, lang string")
    packages = spark.createDataFrame([("database", "PostgreSQL", "psycopg"), ("cloud", "S3", "boto3"), ("other", "x", "y")], "category string, label string, package string")
    states = spark.createDataFrame([("calls", "unresolved"), ("calls", "resolved")], "kind string, resolution string")
    got = {tuple(r) for r in components.cards(routes, points, packages, nodes, states).collect()}
    assert got == {
        ("Entry points", "api: 5 routes · GET /0, GET /1, GET /2 …", 5), ("Entry points", "(repo root): 1 route · GET /", 1), ("Entry points", "tool → a:main (python)", 1),
        ("Data stores", "PostgreSQL via psycopg", 1), ("Data stores", "db (compose)", 1), ("Cloud services", "S3 via boto3", 1), ("Unresolved", "calls: 1 unresolved", 1),
    }


EXPRESS = """import express, { Router } from 'express';
const app = express();
const users = Router();
const inner = express.Router();
const lost = Router();
app.use('/api', users);
users.use('/in', inner);
app.use('/v2', users);
app.use(PREFIX, lost);
users.get('/', list);
inner.post('/x', auth, create);
lost.get('/y', (req, res) => res.send());
app.get('/health', ok);
other.get('/no', ok);
"""


def test_express_and_nest_routes():
    got = {(m, r, h) for _, m, r, h in web.express_routes(EXPRESS)}
    assert got == {("GET", "/api", "list"), ("GET", "/v2", "list"), ("POST", "/api/in/x", "create"), ("POST", "/v2/in/x", "create"), ("GET", "/y", ""), ("GET", "/health", "ok")}
    loop = "const express = require('express')\nconst a = express.Router()\nconst b = express.Router()\na.use('/x', b)\nb.use('/y', a)\na.get('/z', f)\n"
    assert web.express_routes(loop) == [(6, "GET", "/z", "f")]
    assert web.express_routes("const app = express();\napp.get('/x', f)") == []
    nest = "import { Controller, Get } from '@nestjs/common';\n@Controller('users')\nexport class Users {\n  @Get(':id')\n  async one() {}\n  @Post()\n  make() {}\n}\n"
    assert web.nest_routes(nest) == [(4, "GET", "/users/:id", "one"), (6, "POST", "/users", "make")]


@pytest.mark.parametrize(("prefix", "route", "want"), [("", "", "/"), ("/", "/", "/"), ("/a/", "b", "/a/b"), ("/a", "/b", "/a/b"), ("/a", "/", "/a")])
def test_joined(prefix, route, want):
    assert web.joined(prefix, route) == want


def test_tasks_entrypoints_and_environments(spark):
    rows = [
        ("t.py", "python", "from celery import shared_task\n\n@shared_task(\n    name='x')\ndef go():\n    pass\n"), ("u.py", "python", "@task\ndef no():\n    pass\n"),
        ("pyproject.toml", "toml", "[project.scripts]\ntool = 'a.b:main'\n"), ("p/package.json", "json", '{"name": "x",\n "bin": "./cli.js"}'), ("q/package.json", "json", "{broken"),
        ("eas.json", "json", '{"build": {\n "production": {},\n "qa": {}}}'), (".github/workflows/d.yml", "yaml", "jobs:\n  a:\n    environment: prod\n  b:\n    environment:\n      url: x\n      name: staging\n  c:\n    environment: ${{ x }}\n"),
    ]
    files = spark.createDataFrame(rows, "path string, lang string, text string")
    assert [tuple(r) for r in web.tasks(files).collect()] == [("t.py", 3, "go")]
    assert {tuple(r) for r in web.entrypoints(files).collect()} == {("pyproject.toml", 2, "tool", "a.b:main", "python"), ("p/package.json", 2, "x", "./cli.js", "javascript")}
    assert {(r.path, r.line, r.name) for r in web.environments(files).collect()} == {("eas.json", 2, "production"), ("eas.json", 3, "qa"), (".github/workflows/d.yml", 3, "production"), (".github/workflows/d.yml", 7, "staging")}
