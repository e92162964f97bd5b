"""Facts of Python files, one file at a time: symbols, imports, calls, functions,
risks. A file that can't be parsed costs itself alone and leaves a diagnostic."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row per fact; columns that a kind doesn't have are null.
SCHEMA = (
    "path string, fact string, name string, qualified_name string, kind string, start_line int, end_line int, enclosing string, "
    "enclosing_class string, bases array<string>, specifier string, names array<string>, level int, shape string, receiver string, "
    "complexity int, params int, nesting int, lines int, tag string, detail string, aliases array<string>, type_name string"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Calls whose argument runs as SQL, as a command or as code; calls of
#: the network and of blocking waits.
SQL_CALLS, CODE_CALLS = {"execute", "executemany", "raw"}, {"eval", "exec"}
COMMAND_CALLS = {"os.system", "os.popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output"}
OUTBOUND = {f"requests.{m}" for m in ("get", "post", "put", "patch", "delete", "head", "request")}
BLOCKING = OUTBOUND | {"time.sleep", "subprocess.run", "os.system"}


def dotted(node: ast.AST) -> str:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def annotated(node: ast.AST | None) -> str:
    """The class that an annotation names; "" if it names none."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value if node.value.replace(".", "").isidentifier() else ""
    return dotted(node) if node is not None else ""


def measure(f: ast.AST) -> tuple[int, int, int]:
    """Branches, boolean operators and depth of a function without nested ones; an
    ``elif`` is a branch that doesn't nest."""
    complexity, deepest = 1, 0
    stack = [(c, 0) for c in ast.iter_child_nodes(f)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, (*_DEFS, ast.ClassDef, ast.Lambda)):
            continue
        complexity += isinstance(node, _BRANCHES)
        if isinstance(node, ast.BoolOp):
            complexity += len(node.values) - 1
        inner = depth + isinstance(node, _NESTS)
        deepest = max(deepest, inner)
        chained = node.orelse[0] if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) else None
        stack += [(c, depth if c is chained else inner) for c in ast.iter_child_nodes(node)]
    args = f.args
    params = [a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs)] + [a.arg for a in (args.vararg, args.kwarg) if a]
    return complexity, len([p for p in params[:1] if p not in ("self", "cls")] + params[1:]), deepest


def is_built(node: ast.AST, built: set[str]) -> bool:
    """A string put together from parts, here or in a variable before."""
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
        return not (isinstance(node.left, ast.Constant) and isinstance(node.right, ast.Constant))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        return True
    return isinstance(node, ast.Name) and node.id in built


class _Reader:
    def __init__(self, path: str):
        self.path, self.rows = path, []
        self.scope: list[tuple[str, str]] = []  # (kind, name)

    def add(self, fact: str, node: ast.AST | None, **values) -> None:
        row = dict.fromkeys(COLUMNS)
        row |= {"path": self.path, "fact": fact} | values
        if node is not None:
            row |= {"start_line": node.lineno, "end_line": node.end_lineno}
        self.rows.append(row)

    def where(self) -> dict[str, str]:
        names = [n for _, n in self.scope]
        cls = next((n for k, n in reversed(self.scope) if k == "class"), "")
        return {"enclosing": ".".join(names), "enclosing_class": cls}

    def read(self, tree: ast.Module) -> None:
        self.body(tree.body, set(), None)

    def body(self, nodes: list[ast.stmt], built: set[str], function: ast.AST | None, loops: int = 0) -> None:
        for node in nodes:
            self.statement(node, built, function, loops)

    def statement(self, node: ast.stmt, built: set[str], function: ast.AST | None, loops: int) -> None:
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            self.definition(node)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                self.add("import", node, specifier=a.name, name=a.asname or a.name.split(".")[0], names=[], level=0)
        elif isinstance(node, ast.ImportFrom):
            self.add("import", node, specifier=node.module or "", names=[a.name for a in node.names], aliases=[a.asname or a.name for a in node.names], level=node.level, name="")
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            self.binding(node, function)
        elif isinstance(node, ast.ExceptHandler) or isinstance(node, ast.Try):
            for h in getattr(node, "handlers", []):
                if all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in h.body):
                    self.risk("swallowed-error", "pass", h, "")
        for field, value in ast.iter_fields(node):
            parts = value if isinstance(value, list) else [value]
            for child in parts:
                inside = loops + (isinstance(node, (ast.For, ast.AsyncFor, ast.While)) and field == "body")
                if isinstance(child, ast.stmt):
                    self.statement(child, built, function, inside)
                elif isinstance(child, (ast.ExceptHandler, ast.match_case)):
                    self.body(child.body, built, function, inside)
                elif isinstance(child, ast.AST):
                    self.calls(child, built, function, loops)
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            (built.add if is_built(node.value, built) else built.discard)(node.targets[0].id)

    def definition(self, node) -> None:
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if self.scope and self.scope[-1][0] == "class" else "function"
        here = self.where()
        qualified = ".".join([n for _, n in self.scope] + [node.name])
        bases = [dotted(b) for b in getattr(node, "bases", []) if dotted(b)]
        self.add("symbol", node, name=node.name, qualified_name=qualified, kind=kind, bases=bases, **here)
        for d in node.decorator_list:
            # The decorator's own call is how the definition is marked, not a call.
            for part in [*d.args, *(k.value for k in d.keywords)] if isinstance(d, ast.Call) else []:
                self.calls(part, set(), None, 0)
        self.scope.append(("class" if kind == "class" else "function", node.name))
        if kind != "class":
            complexity, params, nesting = measure(node)
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                if a.arg not in ("self", "cls"):
                    self.add("local", node, name=a.arg, type_name=annotated(a.annotation), **self.where())
            self.add("function", node, name=node.name, qualified_name=qualified, complexity=complexity, params=params, nesting=nesting, lines=node.end_lineno - node.lineno + 1)
        self.body(node.body, set(), node if kind != "class" else None)
        self.scope.pop()

    def binding(self, node: ast.Assign | ast.AnnAssign, function: ast.AST | None) -> None:
        """The declared types of locals and fields; one without a type hides others."""
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        declared = annotated(node.annotation) if isinstance(node, ast.AnnAssign) else ""
        for t in targets:
            if isinstance(t, ast.Name) and function is not None:
                self.add("local", function, name=t.id, type_name=declared, **self.where())
            elif isinstance(t, ast.Name) and declared and self.scope and self.scope[-1][0] == "class":
                self.add("field", node, name=t.id, type_name=declared, **self.where())
            elif isinstance(t, ast.Attribute) and dotted(t.value) == "self" and function is not None:
                given = {a.arg: annotated(a.annotation) for a in (*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs)}
                known = declared or (given.get(node.value.id, "") if isinstance(node.value, ast.Name) else "")
                self.add("field", node, name=t.attr, type_name=known, **self.where())

    def risk(self, kind: str, tag: str, node: ast.AST, detail: str) -> None:
        self.add("risk", node, kind=kind, tag=tag, detail=detail, **self.where())

    def calls(self, node: ast.AST, built: set[str], function: ast.AST | None, loops: int) -> None:
        for call in (n for n in ast.walk(node) if isinstance(n, ast.Call)):
            name, f = dotted(call.func), call.func
            if isinstance(f, ast.Name):
                shape, receiver, called = "bare", "", f.id
            elif isinstance(f, ast.Attribute):
                receiver, called = dotted(f.value), f.attr
                parts = receiver.split(".")
                is_super = isinstance(f.value, ast.Call) and dotted(f.value.func) == "super"
                shape = "super" if is_super else "self" if receiver in ("self", "cls") else "self_field" if parts[0] in ("self", "cls") else "member" if len(parts) > 1 or not receiver else "qualified"
            else:
                continue
            self.add("call", call, name=called, shape=shape, receiver=receiver, **self.where())
            first, keys = (call.args[0] if call.args else None), {k.arg: k.value for k in call.keywords}
            shell = isinstance(keys.get("shell"), ast.Constant) and keys["shell"].value is True
            bad = first is not None and is_built(first, built)
            if called in SQL_CALLS and bad:
                self.risk("sql-injection", called, call, name)
            if name in COMMAND_CALLS and bad and (shell or name.startswith("os.")):
                self.risk("command-injection", name, call, name)
            if name in CODE_CALLS and first is not None and not isinstance(first, ast.Constant):
                self.risk("code-injection", name, call, name)
            if name in ("pickle.loads", "pickle.load", "yaml.load", "marshal.loads") and "Loader" not in keys:
                self.risk("unsafe-deserialize", name, call, name)
            if name in ("hashlib.md5", "hashlib.sha1"):
                self.risk("weak-hash", name, call, name)
            if isinstance(keys.get("verify"), ast.Constant) and keys["verify"].value is False:
                self.risk("tls-verify-off", "verify", call, name)
            if isinstance(keys.get("debug"), ast.Constant) and keys["debug"].value is True and called == "run":
                self.risk("debug-enabled", "debug", call, name)
            if name in OUTBOUND and "timeout" not in keys:
                self.risk("no-timeout", name, call, name)
            if called in SQL_CALLS and loops and function is not None:
                self.risk("query-in-loop", called, call, name)
            if name in BLOCKING and isinstance(function, ast.AsyncFunctionDef):
                self.risk("blocking-in-async", name, call, name)


def facts_of(path: str, text: str) -> list[dict]:
    reader = _Reader(path)
    try:
        reader.read(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError) as e:
        reader.rows = []
        reader.add("diagnostic", None, kind="unparsed", detail=f"{type(e).__name__}", start_line=getattr(e, "lineno", None) or 0)
    return reader.rows


def extract(files: DataFrame) -> DataFrame:
    """All facts of the Python files among ``files`` (path, lang, text)."""

    def run(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in facts_of(p, t)]
            frame = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("start_line", "end_line", "level", "complexity", "params", "nesting", "lines"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return files.filter(F.col("lang") == "python").select("path", "text").mapInPandas(run, SCHEMA)


def table(facts: DataFrame, fact: str) -> DataFrame:
    return facts.filter(F.col("fact") == fact)
