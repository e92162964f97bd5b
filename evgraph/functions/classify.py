"""What a file is, from its path and bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension; kind of structured files by name or pattern.
LANGUAGES = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust",
    "java": "java", "cs": "csharp", "sql": "sql",
}
CONFIG_NAMES = {
    "package.json": "manifest-npm", "pyproject.toml": "manifest-python", "go.mod": "manifest-go", "Cargo.toml": "manifest-cargo",
    "pom.xml": "manifest-maven", "build.gradle": "manifest-gradle", "build.gradle.kts": "manifest-gradle",
    "libs.versions.toml": "manifest-gradle", "Directory.Packages.props": "manifest-nuget", "requirements.txt": "manifest-python",
    "pnpm-workspace.yaml": "workspace-pnpm", "go.work": "workspace-go",
}
CONFIG_PATTERNS = (
    (r"(^|/)(docker-)?compose(\.[A-Za-z0-9_-]+)?\.ya?ml$", "compose"),
    (r"(^|/)(openapi|swagger)\.(ya?ml|json)$", "openapi"),
    (r"\.tf$", "terraform"),
    (r"\.csproj$", "manifest-nuget"),
    (r"^\.github/workflows/.*\.ya?ml$", "ci-github"),
    (r"(^|/)\.gitlab-ci\.ya?ml$", "ci-gitlab"),
)
#: Directories that give a role, and patterns of file names.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "e2e", "testing")
TEST_FILE = r"(^test_|_test\.|\.test\.|\.spec\.|_spec\.|^conftest\.py$|Test\.java$|Tests\.java$)"
GENERATED_DIRS = ("__generated__", "generated", "gen", "migrations", "protogen")
GENERATED_FILE = r"(_pb2\.pyi?$|_pb2_grpc\.py$|\.pb\.go$|_generated\.|\.generated\.|\.g\.dart$|_gen\.go$|\.designer\.cs$)"
VENDOR_DIRS = ("vendor", "third_party", "thirdparty", "external", "extern")
BANNER = (
    r"(?im)(@generated\b|@auto-generated\b|^[^\n]{0,20}Code generated .{0,60}DO NOT EDIT"
    r"|^[^\n]{0,20}DO NOT EDIT[.!]?\s*$|^[^\n]{0,20}This file was automatically generated)"
)
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".tox", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".terraform", ".gradle", ".idea", ".vscode",
    "site-packages", ".turbo", "coverage", ".coverage", "htmlcov", ".cache", ".parcel-cache",
)
ROLES_OF_ARCHITECTURE = ("source", "config")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _any_dir(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_dirs(path), F.array(*[F.lit(n) for n in names]))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    return _map(LANGUAGES)[F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)]


def config_kind(path: Column) -> Column:
    kind = _map(CONFIG_NAMES)[name_of(path)]
    for pattern, value in CONFIG_PATTERNS:
        kind = F.coalesce(kind, F.when(path.rlike(pattern), value))
    return kind


def line_count(text: Column) -> Column:
    """Lines of a text, a last one without its end included; 0 if empty."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def is_excluded(path: Column) -> Column:
    return _any_dir(path, EXCLUDED_DIRS)


def role(path: Column, text: Column) -> Column:
    """The first rule that fits: top-level hidden directories are tooling; vendored;
    SQL among generated files is config; generated by place or name; a database
    migration; tests; config; generated by its banner; else source."""
    lang, name, head = language(path), name_of(path), F.substring_index(text, "\n", 5)
    migration = text.rlike(r"(?m)^revision\s*(:[^=\n]*)?=") & text.rlike(r"(?m)^down_revision\s*(:[^=\n]*)?=")
    return (
        F.when(path.rlike(r"^\.[^/]*/"), "tooling")
        .when(_any_dir(path, VENDOR_DIRS), "vendored")
        .when((lang == "sql") & _any_dir(path, GENERATED_DIRS), "config")
        .when(_any_dir(path, GENERATED_DIRS) | name.rlike(GENERATED_FILE), "generated")
        .when((lang == "python") & migration, "generated")
        .when(_any_dir(path, TEST_DIRS) | name.rlike(TEST_FILE), "test")
        .when(config_kind(path).isNotNull(), "config")
        .when(lang.isNotNull() & head.rlike(BANNER), "generated")
        .otherwise("source")
    )


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """One line of an ignore file as (regular expression over a path, negated), or
    None for blanks, comments and what can't be read. A path is matched with all of
    its directories, so a pattern that names one also matches what lies in it."""
    line = line.rstrip("\n").strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if not line or line.endswith("\\"):
        return None
    directory, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            step = 2 if line[i] == "\\" else 1
            out, i = out + "\\" + line[i + step - 1] if not line[i + step - 1].isalnum() else out + line[i + step - 1], i + step
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$"), negated


def is_ignored(path: Column, lines: list[str]) -> Column:
    """The last pattern that matches decides, as one expression of the path."""
    verdict = F.lit(False)
    for found in map(ignore_pattern, lines):
        if found:
            verdict = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(verdict)
    return verdict


#: Names that stand for a deploy environment.
ENVIRONMENTS = {
    "dev": "development", "local": "development", "qa": "qa", "stage": "staging", "uat": "staging", "preprod": "staging",
    "preview": "staging", "prod": "production", "live": "production",
}


def environment(token: Column) -> Column:
    """A name folded to its environment; others stay as they are, and values made at
    run time name none."""
    return F.when(~token.rlike(r"\$|\{\{"), F.coalesce(_map(ENVIRONMENTS)[F.lower(token)], token))


def environment_of_path(path: Column) -> Column:
    """The environment a configuration file's name or place claims."""
    config = path.rlike(r"\.(yaml|yml|json|toml)$") | (path.rlike(r"\.py$") & _any_dir(path, ("settings", "config", "configs", "environments", "overlays")))
    strong = F.regexp_extract(path, r"(?i)(?:^|[./_-])(dev|development|qa|staging|stage|uat|preprod|preview|prod|production)(?:[./_-]|$)", 1)
    weak = F.regexp_extract(F.regexp_replace(name_of(path), r"\.[^.]*$", ""), r"(?i)^(?:.+[._-])?(live|local)$", 1)
    token = F.when(strong != "", strong).when(weak != "", weak)
    return F.when(config, environment(token))
