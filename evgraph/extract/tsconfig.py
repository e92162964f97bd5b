"""Path aliases of TypeScript projects, from files that are JSON with comments."""

from __future__ import annotations

import json
import posixpath
import re

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)


def strip_jsonc(text: str) -> str:
    """Plain JSON: comments and trailing commas go, strings stay as they are."""
    bare = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else " ", text, flags=re.S)
    return _TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else "", bare)


def aliases(configs: dict[str, str]) -> list[tuple[str, str, str]]:
    """(scope, pattern, target) of every configuration (path -> text): the directory
    it holds for, what is written, and where that is, from the root. A configuration
    takes what it doesn't say from those it extends; one that can't be read is left
    out. Configurations are few, so this runs on the driver."""
    parsed = {}
    for path, text in configs.items():
        try:
            parsed[path] = json.loads(strip_jsonc(text))
        except ValueError:
            continue

    def options(path: str, seen: tuple[str, ...] = ()) -> tuple[str, dict]:
        """The directory that targets are relative to, and the written paths."""
        here, body = posixpath.dirname(path), parsed.get(path, {})
        own = body.get("compilerOptions", {}) if isinstance(body, dict) else {}
        if "paths" in own:
            return posixpath.normpath(posixpath.join(here, own.get("baseUrl", "."))), own["paths"]
        above = body.get("extends") if isinstance(body, dict) else None
        for parent in [above] if isinstance(above, str) else above or []:
            at = posixpath.normpath(posixpath.join(here, parent))
            at = at if at in parsed else f"{at}.json"
            if at in parsed and at not in seen:
                found = options(at, (*seen, path))
                if found[1]:
                    return found
        return here, {}

    out = []
    for path in sorted(parsed):
        base, paths = options(path)
        for pattern, targets in paths.items():
            out += [(posixpath.dirname(path), pattern, posixpath.normpath(posixpath.join(base, t)).removeprefix("./")) for t in targets]
    return out
