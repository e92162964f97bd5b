"""Facts of Rust files: modules, ``use`` trees, items, fields and calls by shape, with the
inline modules they stand in. A file at a time; facts have the columns of ``python_facts``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.extract.python_facts import COLUMNS, SCHEMA

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\bb?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_TOKEN = re.compile(
    r"(?P<use>(?:\bpub(?:\([^)]*\))?\s+)?\buse\s+(?P<tree>[^;]+);)|\bmod\s+(?P<mod>\w+)\s*(?=[;{])|\b(?:struct|enum|trait|union)\s+(?P<item>\w+)"
    r"|\bimpl\b(?P<impl>[^{;]*)|\bfn\s+(?P<fn>\w+)|(?P<field>\b[a-z_]\w*)\s*:\s*(?!:)(?P<type>[^,;{}()]+)"
    r"|(?P<call>\b[A-Za-z_]\w*(?:\s*(?:::|\.)\s*[A-Za-z_]\w*)*)\s*\(|(?P<brace>[{};])"
)
#: Words before a bracket that call nothing, constructors of the language,
#: and types that wrap another.
_NO_CALLS = frozenset("if while for match return in as loop else move Some Ok Err None".split())
_WRAPPERS = frozenset("Arc Rc Box Option RefCell Cell Mutex RwLock".split())


def leaves(tree: str) -> list[tuple[list[str], str]]:
    """The (path, alias) of each name that a ``use`` tree brings; a star is a name."""
    tree = tree.strip()
    head, brace, rest = tree.partition("{")
    if not brace:
        path, _, alias = tree.partition(" as ")
        parts = [p.strip() for p in path.split("::") if p.strip()]
        if parts[-1:] == ["self"] and len(parts) > 1:
            parts = parts[:-1]
        return [(parts, alias.strip() or parts[-1])] if parts else []
    before = [p.strip() for p in head.split("::") if p.strip()]
    inner, out, start, deep = rest.rpartition("}")[0], [], 0, 0
    for i, c in enumerate(inner + ","):
        deep += (c == "{") - (c == "}")
        if c == "," and not deep:
            for parts, alias in leaves(inner[start:i]):
                own = parts == ["self"]
                out.append((before + ([] if own else parts), before[-1] if own and alias == "self" and before else alias))
            start = i + 1
    return out


def _type(text: str) -> str:
    """The class that a type names, through references and wrappers."""
    found = [n for n in re.findall(r"[A-Za-z_]\w*", re.sub(r"'\w+", "", text)) if n not in ("dyn", "mut", "impl", "pub", "crate", "const")]
    path = re.match(r"(?:[A-Za-z_]\w*\s*::\s*)*([A-Za-z_]\w*)", " ".join(found[:1]) if "::" not in text else text.strip().lstrip("&").strip())
    name = path[1] if path else ""
    inner = re.search(r"<(.+)>", text, re.S)
    return _type(inner[1]) if name in _WRAPPERS and inner else name


def facts_of(path: str, text: str) -> list[dict]:
    bare = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    rows: list[dict] = []
    scopes: list[tuple[str, str]] = []
    waiting = ("", "")
    line, seen = 1, 0

    def add(fact: str, name: str, **more) -> None:
        rows.append(dict.fromkeys(COLUMNS) | {"path": path, "fact": fact, "name": name, "start_line": line, "end_line": line} | more)

    for m in _TOKEN.finditer(bare):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        line, seen = line + bare.count("\n", seen, start), start
        mods = [n for k, n in scopes if k == "mod"]
        owner = next((n for k, n in reversed(scopes) if k in ("impl", "trait")), "")
        body = next((n for k, n in reversed(scopes) if k == "fn"), "")
        if m["use"]:
            for parts, alias in leaves(m["tree"]):
                base = parts[:-1] if len(parts) > 1 else parts
                names = {"names": [parts[-1]], "aliases": [alias]} if len(parts) > 1 else {"names": [], "aliases": []}
                add("import", "" if len(parts) > 1 else alias, specifier=".".join(base), kind="use", tag="pub" if m["use"].startswith("pub") else "", detail=".".join(mods), level=0, **names)
        elif m["mod"]:
            if bare[m.end() : m.end() + 1] == ";":
                add("import", m["mod"], specifier="self." + m["mod"], kind="mod", tag="", detail=".".join(mods), level=0, names=[], aliases=[])
            else:
                waiting = ("mod", m["mod"])
        elif m["item"]:
            waiting = ("trait" if m[0].startswith("trait") else "struct" if m[0].startswith("struct") else "item", m["item"])
            if not mods and not body:
                add("symbol", m["item"], qualified_name=m["item"], kind="class", enclosing="", enclosing_class="", bases=[])
        elif m["impl"] is not None:
            head = re.sub(r"^\s*<[^{]*?>(?=\s)", "", re.split(r"\bwhere\b", m["impl"])[0])
            waiting = ("impl", _type(re.split(r"\bfor\b", head)[-1]))
        elif m["fn"]:
            name = f"{owner}.{m['fn']}" if owner else m["fn"]
            waiting = ("fn", name)
            if not mods and not body:
                add("symbol", m["fn"], qualified_name=name, kind="method" if owner else "function", enclosing=owner, enclosing_class=owner, bases=[])
        elif m["field"]:
            if scopes and scopes[-1][0] == "struct" and not mods:
                add("field", m["field"], enclosing_class=scopes[-1][1], type_name=_type(m["type"]))
        elif m["call"]:
            parts = re.split(r"\s*(?:::|\.)\s*", m["call"])
            if waiting[0] == "fn" or not body or mods or parts[0] in _NO_CALLS or parts[-1] in _NO_CALLS:
                continue
            receiver = ".".join(parts[:-1])
            if parts[0] == "self" and len(parts) < 4:
                shape = ("", "self", "self", "self_field")[len(parts)]
            else:
                shape = "bare" if len(parts) == 1 else "qualified" if "::" in m["call"] and "." not in m["call"] else "member"
            if parts[0] == "Self" and len(parts) == 2:
                shape = "self"
            add("call", parts[-1], shape=shape, receiver=receiver, enclosing=body, enclosing_class=owner)
        elif m["brace"] == "{":
            scopes.append(waiting)
            waiting = ("", "")
        elif m["brace"] == "}":
            if scopes:
                scopes.pop()
        else:
            waiting = ("", "")
    return rows


def extract(files: DataFrame) -> DataFrame:
    """All facts of the Rust files among ``files`` (path, lang, text). What no pattern can
    tell (macros, types of locals) is left out, never guessed."""

    def run(batches):
        for batch in batches:
            frame = pd.DataFrame([r for p, t in zip(batch["path"], batch["text"], strict=True) for r in facts_of(p, t or "")], columns=COLUMNS)
            for c in ("start_line", "end_line", "level", "complexity", "params", "nesting", "lines"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return files.filter(F.col("lang") == "rust").select("path", "text").mapInPandas(run, SCHEMA)
