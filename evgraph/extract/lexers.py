"""Symbols and imports of languages without a parser here, by line patterns.

Partial by design: what a pattern can't tell is left out, never guessed. Facts have
the columns of ``python_facts``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.extract.python_facts import COLUMNS, SCHEMA

#: Per language: patterns of comments, and (fact, kind, pattern) with the name, and
#: for imports the specifier, as a group.
_C = r"//[^\n]*|/\*.*?\*/"
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
RULES: dict[str, list[tuple[str, str, str]]] = {
    "typescript": [
        ("import", "", r"^\s*(?:import|export)\b[^;'\"]*?from\s+['\"](?P<spec>[^'\"]+)['\"]"),
        ("import", "", r"^\s*import\s+['\"](?P<spec>[^'\"]+)['\"]"),
        ("import", "", r"\brequire\(\s*['\"](?P<spec>[^'\"]+)['\"]\s*\)"),
        ("symbol", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>[\w$.]+))?"),
        ("symbol", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
        ("symbol", "function", r"^\s*(?:export\s+)?const\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
        ("symbol", "interface", r"^\s*(?:export\s+)?interface\s+(?P<name>[A-Za-z_$][\w$]*)"),
    ],
    "go": [
        ("import", "", r"^\s*import\s+(?:[\w.]+\s+)?\"(?P<spec>[^\"]+)\""),
        ("import", "", r"^\s+(?:[\w.]+\s+)?\"(?P<spec>[\w./~-]+)\"\s*$"),
        ("symbol", "class", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b"),
        ("symbol", "method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("),
        ("symbol", "function", r"^func\s+(?P<name>\w+)\s*[\[(]"),
    ],
    "java": [
        ("import", "", r"^\s*import\s+(?:static\s+)?(?P<spec>[\w.]+(?:\.\*)?)\s*;"),
        ("symbol", "class", r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<base>[\w.]+))?"),
        ("symbol", "method", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s+)?[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"),
    ],
    "csharp": [
        ("import", "", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<spec>[\w.]+)\s*;"),
        ("symbol", "class", r"^\s*(?:(?:public|internal|private|protected|abstract|sealed|static|partial)\s+)*(?:class|interface|struct|record|enum)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<base>[\w.]+))?"),
        ("symbol", "method", r"^\s+(?:(?:public|internal|private|protected|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^;{]*\)\s*(?:where[^{]*)?(?:\{|=>|;|$)"),
    ],
    "rust": [
        ("import", "", r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<spec>[\w:]+)"),
        ("symbol", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)"),
        ("symbol", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)"),
    ],
}
RULES["javascript"] = RULES["typescript"]
_COMPILED = {lang: [(fact, kind, re.compile(p, re.M)) for fact, kind, p in rules] for lang, rules in RULES.items()}
_NOISE = re.compile(f"{_C}|{_STRINGS}", re.S)


def _without_comments(text: str) -> str:
    """Comments blanked, line ends and strings kept, so places stay true."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*")) else m[0], text)


def facts_of(path: str, lang: str, text: str) -> list[dict]:
    out, seen, bare = [], set(), _without_comments(text)
    for fact, kind, pattern in _COMPILED.get(lang, []):
        for m in pattern.finditer(bare):
            name = m.groupdict().get("spec") or m.groupdict().get("name")
            start = bare.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
            if (fact, name, start) in seen:
                continue
            seen.add((fact, name, start))
            row = dict.fromkeys(COLUMNS) | {"path": path, "fact": fact, "start_line": start, "end_line": start + m[0].strip().count("\n")}
            if fact == "import":
                row |= {"specifier": name, "names": [], "level": 0, "name": ""}
            else:
                owner = m.groupdict().get("owner") or ""
                base = m.groupdict().get("base")
                row |= {"name": name, "qualified_name": f"{owner}.{name}" if owner else name, "kind": kind, "enclosing_class": owner, "bases": [base] if base else []}
            out.append(row)
    return sorted(out, key=lambda r: (r["start_line"], r["fact"], str(r["specifier"] or r["name"])))


def extract(files: DataFrame) -> DataFrame:
    """Facts of all files (path, lang, text) in a language that has rules."""

    def run(batches):
        for batch in batches:
            rows = [r for p, lang, t in zip(batch["path"], batch["lang"], batch["text"], strict=True) for r in facts_of(p, lang, t)]
            frame = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("start_line", "end_line", "level", "complexity", "params", "nesting", "lines"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return files.filter(F.col("lang").isin(*RULES)).select("path", "lang", "text").mapInPandas(run, SCHEMA)
