"""Styles, parts and rules against a plain reading of the same rules."""

import random

from evgraph.operators import design, joins, layout, lock, styles

DIRS = "api services db features users orders utils core domain shared pages widgets plugins public internal src infra model view Handlers x".split()
TABLE = styles.part_rows()
STYLE_PARTS = {}
for row in TABLE:
    STYLE_PARTS.setdefault(row[0], []).append(row)


def plain_assign(unit, module, style, signals):
    inner = module[len(unit) :].strip("/") if unit else module
    segments = [s.lower() for s in inner.split("/") if s]
    parts = STYLE_PARTS[style]
    if not segments or segments[-1] in styles.NEUTRAL and not any(segments[-1] in p[8] for p in parts):
        return None
    best = None
    for _, _, part, rank, sliced, _, _, _, names, evidence in parts:
        at = [i for i, s in enumerate(segments) if s in names]
        if at:
            score = 3 if at[-1] == len(segments) - 1 else 2
            inside = segments[at[-1] + 1] if sliced and at[-1] < len(segments) - 1 else None
            found = (score, -rank, part, inside, True)
        elif signals.get(module, set()) & set(evidence):
            found = (2, -rank, part, None, False)
        else:
            continue
        if best is None or found[:2] > best[:2]:
            best = found
    return best


def plain_rule(style, a, b, dst):
    order = {p[2]: p for p in STYLE_PARTS[style]}
    src, to = order[a[2]], order[b[2]]
    if (style, a[2], b[2]) in styles.FORBIDDEN or to[3] < src[3]:
        return "layer-direction"
    if a[2] == b[2] and src[5] and a[3] and b[3] and a[3] != b[3]:
        return "part-independence"
    if to[6] and b[3] and (a[2] != b[2] or a[3] != b[3]):
        parts = dst.split("/")
        if dst != "/".join(parts[: [p.lower() for p in parts].index(b[3]) + 1]):
            return "public-entry"
    return None


def test_parts_rules_and_fits_against_plain_python(spark):
    rng = random.Random(9)
    modules = sorted({"/".join(rng.choice(DIRS) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {""})
    owned = [("svc" if i % 3 == 0 else "", ("svc/" + m).rstrip("/") if i % 3 == 0 else m) for i, m in enumerate(modules)]
    names = [m for _, m in owned]
    deps = {(rng.choice(names), rng.choice(names)) for _ in range(400)}
    signals = {m: {rng.choice(["routes", "datastore", "cloud"])} for m in rng.sample(names, 12)}
    frame = spark.createDataFrame(owned, "unit string, module string")
    shown = spark.createDataFrame([(m, s) for m, v in signals.items() for s in v], "module string, signal string")
    parts, forbidden = styles.parts(spark), styles.forbidden(spark)
    assigned = design.placed(frame, parts, shown).cache()
    got = {(r.module, r.style): (r.score, -r["rank"], r.part, r.slice, r.by_name) for r in assigned.collect()}
    want = {(m, s): a for u, m in owned for s in STYLE_PARTS if (a := plain_assign(u, m, s, signals))}
    assert got == want and len(want) > 200
    checked = design.judged(spark.createDataFrame(sorted(deps), "src string, dst string"), assigned, parts, forbidden).cache()
    rules = {(r.style, r.src, r.dst): r.rule for r in checked.collect()}
    unit = dict((m, u) for u, m in owned)
    plain = {(s, a, b): plain_rule(s, want[a, s], want[b, s], b) for s in STYLE_PARTS for a, b in deps if a != b and unit[a] == unit[b] and (a, s) in want and (b, s) in want}
    assert rules == plain and {"layer-direction", "part-independence", "public-entry", None} <= set(plain.values())
    breaches = design.impure(assigned, parts, shown)
    io = {(r.style, r.src) for r in breaches.collect()}
    assert io == {(s, m) for (m, s), a in want.items() if m in signals and next(p for p in STYLE_PARTS[s] if p[2] == a[2])[7]} and io
    fits = {(r.unit, r.style): (r.coverage, r.compliance) for r in design.fits(frame, assigned, checked, breaches, parts).collect()}
    for (u, s), (coverage, compliance) in fits.items():
        of = [(m, want.get((m, s))) for x, m in owned if x == u]
        scored = [m for m, a in of if a or not _neutral(u, m, s)]
        filled = {a[2] for _, a in of if a and a[4]}
        weight = sum(1.0 if a[4] else 0.5 for _, a in of if a)
        assert abs(coverage - (weight / len(scored) if len(filled) >= 2 else 0.0)) < 1e-9
        told = [r for (st, a, _), r in plain.items() if st == s and unit[a] == u] + ["core-purity" for st, m in io if st == s and unit[m] == u]
        assert abs(compliance - ((len(told) - sum(r is not None for r in told)) / len(told) if told else 1.0)) < 1e-9


def _neutral(unit, module, style):
    inner = module[len(unit) :].strip("/") if unit else module
    segments = [s.lower() for s in inner.split("/") if s]
    return not segments or segments[-1] in styles.NEUTRAL and not any(segments[-1] in p[8] for p in STYLE_PARTS[style])


def test_styles_are_seventeen():
    assert len(STYLE_PARTS) == 17 and len({(r[0], r[2]) for r in TABLE}) == len(TABLE)
    assert all({f, t} <= {r[2] for r in STYLE_PARTS[s]} for s, f, t in styles.FORBIDDEN)


def test_units_and_signals(spark):
    files = spark.createDataFrame([("a/package.json", "manifest-npm"), ("a/b/go.mod", "manifest-go"), ("c/x.py", None)], "path string, config_kind string")
    modules = spark.createDataFrame([("a",), ("a/b/c",), ("a/bc",), ("c",), ("",)], "module string")
    assert {(r.unit, r.module) for r in design.units(files, modules).collect()} == {("a", "a"), ("a/b", "a/b/c"), ("a", "a/bc"), ("", "c"), ("", "")}
    routes = spark.createDataFrame([("a/r.py",)], "file string")
    packages = spark.createDataFrame([("a/r.py", "database"), ("b/s.py", "frontend"), ("b/s.py", "other")], "file string, category string")
    assert {tuple(r) for r in design.signals(routes, packages).collect()} == {("a", "routes"), ("a", "datastore"), ("b", "ui")}


def test_lock_facts_and_delta(spark):
    modules = spark.createDataFrame([("",), ("api",), ("db",)], "module string")
    deps = spark.createDataFrame([("api", "db"), ("", "api"), ("api", "db")], "src string, dst string")
    nodes = spark.createDataFrame([("service", "web"), ("queue", "q"), ("class", "no")], "kind string, label string")
    routes = spark.createDataFrame([("GET", "/x", "api/r.py"), ("GET", "/x", "api/s.py")], "method string, route string, path string")
    points = spark.createDataFrame([("tool", "api"), ("lost", "gone")], "name string, module string")
    roles = spark.createDataFrame([("api", "api"), ("gone", "api")], "module string, role string")
    places = spark.createDataFrame([("prod",), ("prod",)], "name string")
    found = lock.facts_of(modules, deps, nodes, routes, points, roles, places)
    assert sorted((r.kind, tuple(r.fields)) for r in found.collect()) == [
        ("dep", (".", "api")), ("dep", ("api", "db")), ("endpoint", ("GET /x", "api")), ("entrypoint", ("tool", "api")), ("environment", ("prod",)),
        ("module", (".",)), ("module", ("api",)), ("module", ("db",)), ("queue", ("q",)), ("role", ("api", "api")), ("service", ("web",)),
    ]
    assert all(r.error is None for r in lock.parse(lock.render(found)).collect())
    head = found.filter("kind <> 'queue'").unionByName(spark.createDataFrame([("new_kind", ["a", "b", "c"])], "kind string, fields array<string>"))
    assert [(r.kind, r.op, r.known) for r in lock.delta(found, head).collect()] == [("new_kind", "added", False), ("queue", "removed", True)]
    assert lock.unversioned({"python": "1", "go": "2"}, {"python": "1.1", "go": "2"}, (1, 6), (1, 7)) == [("L-011", "python 1 -> 1.1"), ("L-013", "6 -> 7")]
    import pytest

    with pytest.raises(ValueError, match="cannot be compared"):
        lock.unversioned({}, {}, (1, 0), (2, 0))


def test_code_modules(spark):
    nodes = spark.createDataFrame([("a/x.py", "python"), ("b/c.yml", "compose"), ("x.py#f", "python")], "id string, lang string")
    paths = spark.createDataFrame([("a/x.py",), ("b/c.yml",), ("x.py",), ("d/y.py",)], "path string")
    assert {r.module for r in lock.code_modules(nodes, paths, ("python",)).collect()} == {"a", ""}


def test_label_faults_against_all_pairs(spark, monkeypatch):
    """Labels in one place, labels and boxes in several, repeated rows."""
    monkeypatch.setattr(joins, "STACK", 4)
    rng = random.Random(6)
    rect = lambda wide, high: (x := rng.randrange(0, 600, 20), y := rng.randrange(0, 600, 20), x + wide, y + high)
    labels = [("v", f"r{i % 50}", *rect(30, 12)) for i in range(70)]
    labels += [("v", f"r{i}", 250, 250, 280, 262) for i in range(60, 80)] + labels[:3]
    boxes = [("v", f"b{i % 30}", *rect(60, 24)) for i in range(40)] + [("w", "b1", 250, 250, 300, 300)]
    lines = [("v", f"r{i % 70}", *rect(200, 0)) for i in range(120)]
    over = lambda a, b: a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3]
    wide = [(*m[:4], m[4] + 4, m[5] + 4) for m in labels]
    want = {("v", a[1], "box", b[1]) for a in labels for b in boxes if over(a, b)}
    want |= {("v", a[1], "route", b[1]) for a in labels for b in lines if a[1] != b[1] and over(a, b)}
    want |= {("v", a[1], "label", b[1]) for a in wide for b in wide if a[1] < b[1] and over(a, b)}
    frame = lambda made, name: spark.createDataFrame(made, f"view string, {name} string, x1 int, y1 int, x2 int, y2 int")
    found = layout.label_faults(frame(labels, "route"), frame(boxes, "id"), frame(lines, "route"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    # Pairs of what lies in one place only go through no exchange after they are found.
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
