"""Routes of JavaScript and TypeScript servers, background tasks, declared entry points
and environments, one file at a time."""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.classify import environment

_MADE = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:await\s+)?(express|express\.Router|Router)\s*\(")
_VERB = re.compile(r"\b(\w+)\s*\.\s*(get|post|put|patch|delete|head|options|all)\s*\(\s*([\"'`])([^\"'`]*)\3\s*,([^\n]*)")
_MOUNT = re.compile(r"\b(\w+)\s*\.\s*use\s*\(([^;\n]*)\)")
_STRING = re.compile(r"^([\"'])([^\"']*)\1$")


def joined(prefix: str, route: str) -> str:
    """A route under a prefix; one slash between them, none at the end."""
    head = prefix.rstrip("/")
    if route in ("", "/"):
        return head or "/"
    return head + (route if route.startswith("/") else "/" + route)


def prefixes_of(text: str, known: dict[str, int]) -> dict[str, list[str] | None]:
    """Where each router of a file is mounted; None if that is not to be told: a prefix
    that is computed, a name that is bound twice, or mounts in a circle."""
    mounts: dict[str, list[tuple[str, str | None]]] = defaultdict(list)
    for host, inner in _MOUNT.findall(text):
        given = [x.strip() for x in inner.split(",")]
        if host not in known:
            continue
        said = _STRING.match(given[0])
        prefix = said[2] if said else "" if given[0] in known else None
        for name in given:
            if name in known and known[name] == 1:
                mounts[name].append((host, prefix if known[host] == 1 else None))
    done: dict[str, list[str] | None] = {}

    def of(name: str, way: tuple[str, ...]) -> list[str] | None:
        if name in done:
            return done[name]
        if name in way:
            return None
        out: set[str] | None = set()
        for host, prefix in mounts.get(name, []):
            above = None if prefix is None or (prefix and not prefix.startswith("/")) else of(host, (*way, name))
            if above is None:
                out = None
                break
            out |= {joined(a, prefix) if a or prefix else "" for a in above}
        done[name] = None if out is None else sorted(out) if mounts.get(name) else [""]
        return done[name]

    return {name: of(name, ()) for name in known}


def express_routes(text: str) -> list[tuple[int, str, str, str]]:
    """(line, method, route, handler) of routers made in a file that imports express;
    what is mounted stands at all its prefixes."""
    if not re.search(r"(?m)(from\s+[\"']express[\"']|require\(\s*[\"']express[\"']\s*\))", text):
        return []
    known: dict[str, int] = defaultdict(int)
    for name, _ in _MADE.findall(text):
        known[name] += 1
    at, out = prefixes_of(text, dict(known)), []
    for m in _VERB.finditer(text):
        if m[1] in known:
            last = re.findall(r"([\w.]+)\s*\)?\s*;?\s*$", m[5])
            handler = last[0] if last and "=>" not in m[5] and "function" not in m[5] else ""
            for prefix in at[m[1]] or [""]:
                out.append((text.count("\n", 0, m.start()) + 1, m[2].upper(), joined(prefix, m[4]) if prefix else m[4], handler))
    return out


def nest_routes(text: str) -> list[tuple[int, str, str, str]]:
    """(line, method, route, handler) of decorated methods of controllers."""
    if not re.search(r"from\s+[\"']@nestjs/common[\"']", text):
        return []
    out, prefix = [], None
    for m in re.finditer(r"@(Controller|Get|Post|Put|Patch|Delete|All|Head|Options)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?[^)]*\)(?:\s*@\w+\([^)]*\))*\s*(?:(?:public|async|private)\s+)*(?:export\s+(?:default\s+)?)?(?:class\s+)?(\w+)?", text):
        if m[1] == "Controller":
            prefix = "/" + (m[2] or "").strip("/") if m[2] else ""
        elif prefix is not None:
            out.append((text.count("\n", 0, m.start()) + 1, m[1].upper(), joined(prefix, m[2] or ""), m[3] or ""))
    return out


def tasks_of(text: str) -> list[tuple[int, str]]:
    """(line, handler) of functions that a task queue runs."""
    if not re.search(r"(?m)^\s*(from|import)\s+(celery|dramatiq|rq|huey)\b", text):
        return []
    found = re.finditer(r"(?m)^[ \t]*@\s*(?:[\w.]*\.)?(?:task|shared_task|actor|job|periodic_task)\b[^\n]*\n(?:[ \t]*(?:@[^\n]*|[^\n]*\))\n)*?[ \t]*(?:async\s+)?def\s+(\w+)", text)
    return [(text.count("\n", 0, m.start()) + 1, m[1]) for m in found]


def entrypoints_of(name: str, text: str) -> list[tuple[int, str, str, str]]:
    """(line, name, target, lang) of what a manifest starts."""
    line = lambda key: next((i + 1 for i, x in enumerate(text.split("\n")) if key in x), 1)
    if name == "pyproject.toml":
        import tomllib

        project = tomllib.loads(text)
        scripts = project.get("project", {}).get("scripts", {}) | project.get("tool", {}).get("poetry", {}).get("scripts", {})
        return [(line(k), k, v, "python") for k, v in scripts.items() if isinstance(v, str)]
    if name == "package.json":
        package = json.loads(text)
        given = package.get("bin", {})
        given = {package.get("name", ""): given} if isinstance(given, str) else given
        out = [(line(v), k, v, "javascript") for k, v in given.items()]
        return out + [(line('"main"'), "main", package["main"], "javascript")] if isinstance(package.get("main"), str) else out
    return []


def environments_of(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, name, source) of the environments that build profiles and workflows name."""
    lines = text.split("\n")
    if path.rsplit("/", 1)[-1] == "eas.json":
        build = json.loads(text).get("build", {})
        at = {k: next((i + 1 for i, x in enumerate(lines) if f'"{k}"' in x), None) for k in build}
        return [(n, k, "profile") for k, n in at.items() if n]
    out = []
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)\.gitlab-ci\.yml$", path):
        for i, x in enumerate(lines):
            m = re.match(r"^(\s+)environment:\s*[\"']?([^\"'#\s]*)", x)
            if m and m[2]:
                out.append((i + 1, m[2], "workflow"))
            elif m:
                for j in range(i + 1, len(lines)):
                    inner = re.match(r"^(\s*)(?:name:\s*[\"']?([^\"'#\s]+))?", lines[j])
                    if lines[j].strip() and len(inner[1]) <= len(m[1]):
                        break
                    if inner[2]:
                        out.append((j + 1, inner[2], "workflow"))
                        break
    return out


def _each(files: DataFrame, schema: str, of) -> DataFrame:
    """Rows (path, ...) of a function of a file's path and text; one that cannot be read
    costs itself."""
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += [(path, *r) for r in of(path, text)]
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, schema)


def server_routes(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``method``, ``route``, ``handler`` of JavaScript servers."""
    scripts = files.filter(F.col("lang").isin("typescript", "javascript"))
    return _each(scripts, "path string, line int, method string, route string, handler string", lambda p, t: express_routes(t) + nest_routes(t))


def tasks(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``handler`` of background tasks."""
    return _each(files.filter("lang = 'python'"), "path string, line int, handler string", lambda p, t: tasks_of(t))


def entrypoints(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``name``, ``target``, ``lang`` of declared entry points."""
    named = files.filter(F.substring_index("path", "/", -1).isin("pyproject.toml", "package.json"))
    return _each(named, "path string, line int, name string, target string, lang string", lambda p, t: entrypoints_of(p.rsplit("/", 1)[-1], t))


def environments(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``name``, ``source``: declared environments, folded to their
    common names; those made at run time are left out."""
    some = files.filter(F.col("path").rlike(r"(^|/)(eas\.json|\.gitlab-ci\.yml|\.github/workflows/[^/]+\.ya?ml)$"))
    found = _each(some, "path string, line int, name string, source string", environments_of)
    return found.withColumn("name", environment(F.col("name"))).filter("name is not null")
