"""Fact records as text: escape, render, parse strictly, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions.text import bad_escape, escape_field, unescape_field
from evgraph.schema import module_of, path_of

#: Fields that each known record kind has.
ARITIES = {"module": 1, "dep": 2, "endpoint": 2, "datastore": 1, "service": 1, "queue": 1, "surface": 2, "entrypoint": 2, "role": 2, "environment": 1}


def render(records: DataFrame) -> DataFrame:
    """``kind``, ``fields`` as one line each: tab between fields, escapes within."""
    shown = F.transform("fields", escape_field)
    return records.select(F.concat_ws("\t", F.col("kind"), shown).alias("value"))


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as ``kind``, ``fields`` and ``error`` (null where well formed): L-001 for
    a kind that isn't lower-case letters and underscores, L-003 for an unknown escape, L-002 for a
    known kind with another number of fields. One carriage return at the end is
    dropped; unknown well-formed kinds stay."""
    bare = F.regexp_replace(F.col(value), "\r$", "")
    raw = F.slice(F.split(bare, "\t"), 2, F.greatest(F.size(F.split(bare, "\t")) - 1, F.lit(0)))
    kind = F.split(bare, "\t")[0]
    arity = F.create_map(*[x for k, n in ARITIES.items() for x in (F.lit(k), F.lit(n))])[kind]
    error = (
        F.when(~kind.rlike("^[a-z_]+$"), "L-001")
        .when(F.exists(raw, bad_escape), "L-003")
        .when(arity.isNotNull() & (arity != F.size(raw)), "L-002")
    )
    return lines.select(kind.alias("kind"), F.transform(raw, unescape_field).alias("fields"), error.alias("error"))


def write(records: DataFrame, path: str) -> None:
    """Records as text files in the order of kind and fields."""
    render(records.orderBy("kind", "fields")).write.text(path)


def read(spark, path: str) -> DataFrame:
    return parse(spark.read.text(path, lineSep="\n"))


def _spelled(module: Column) -> Column:
    """The root's id is empty, and a line may not end in a tab."""
    return F.when(module == "", ".").otherwise(module)


def facts_of(
    modules: DataFrame, deps: DataFrame, nodes: DataFrame | None = None, routes: DataFrame | None = None, entrypoints: DataFrame | None = None,
    roles: DataFrame | None = None, environments: DataFrame | None = None,
) -> DataFrame:
    """Records (``kind``, ``fields``) of a graph, each once: modules and deps; services,
    datastores and queues among ``nodes`` (kind, label); endpoints of ``routes`` (method,
    route, path), by the handler's module and not its name; ``entrypoints`` (name,
    module), ``roles`` (module, role) of known modules; ``environments`` (name)."""
    record = lambda rows, kind, *fields: rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.array(*fields).alias("fields"))
    known = modules.select(F.col("module").alias("m")).distinct()
    among = lambda rows: rows.join(known, F.col("module") == F.col("m"), "left_semi")
    out = record(modules, "module", _spelled(F.col("module"))).unionByName(record(deps, "dep", _spelled(F.col("src")), _spelled(F.col("dst"))))
    if nodes is not None:
        out = out.unionByName(record(nodes.filter("kind in ('service', 'datastore', 'queue')"), F.col("kind"), F.col("label")))
    if routes is not None:
        out = out.unionByName(record(routes, "endpoint", F.concat_ws(" ", "method", "route"), _spelled(module_of(F.col("path")))))
    if entrypoints is not None:
        out = out.unionByName(record(among(entrypoints), "entrypoint", F.col("name"), _spelled(F.col("module"))))
    if roles is not None:
        out = out.unionByName(record(among(roles), "role", _spelled(F.col("module")), F.col("role")))
    if environments is not None:
        out = out.unionByName(record(environments, "environment", F.col("name")))
    return out.distinct()


def code_modules(nodes: DataFrame, paths: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """``module``: directories with a file of ``paths`` (path) that holds a node
    (id, lang) of a language this build reads. A directory of settings is none."""
    held = nodes.filter(F.col("lang").isin(*languages)).select(path_of(F.col("id")).alias("held")).distinct()
    return paths.join(held, F.col("path") == F.col("held"), "left_semi").select(module_of(F.col("path")).alias("module")).distinct()


def unversioned(base: dict[str, str], head: dict[str, str], base_schema: tuple[int, int], head_schema: tuple[int, int]) -> list[tuple[str, str]]:
    """What two snapshots' headers say before they are compared: refused (ValueError)
    across a major schema, L-011 where a grammar's version moved, L-013 where the
    minor schema did."""
    if base_schema[0] != head_schema[0]:
        raise ValueError(f"schema {base_schema[0]} cannot be compared with {head_schema[0]}")
    moved = sorted(f"{lang} {base[lang]} -> {v}" for lang, v in head.items() if base.get(lang, v) != v)
    out = [("L-011", "; ".join(moved))] if moved else []
    return [*out, ("L-013", f"{base_schema[1]} -> {head_schema[1]}")] if base_schema[1] != head_schema[1] else out


def delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """``kind``, ``fields``, ``op``, ``known`` of records that only one snapshot has, in
    the order a reader wants: by kind, removals first. Kinds this build does not know
    are compared as they stand."""
    one = lambda a, b, op: a.select("kind", "fields").distinct().exceptAll(b.select("kind", "fields").distinct()).withColumn("op", F.lit(op))
    both = one(base, head, "removed").unionByName(one(head, base, "added"))
    return both.withColumn("known", F.col("kind").isin(*ARITIES)).orderBy("kind", F.desc("op"), "fields")


def build(modules: DataFrame, deps: DataFrame, more: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Records of a snapshot and what is wrong with it.

    ``modules``: module, label; ``deps``: src, dst; ``more``: records (kind, fields).
    Diagnostics: L-004 for a label that several modules share, L-009 for a dependency
    on no module, L-010 for a snapshot without records.
    """
    known = modules.select(F.col("module").alias("m"))
    sound = deps.join(known, F.col("src") == F.col("m"), "left_semi").join(known, F.col("dst") == F.col("m"), "left_semi")
    records = facts_of(modules, sound)
    for part in more:
        records = records.unionByName(part.select("kind", "fields"))
    records = records.distinct()
    shared = modules.groupBy("label").agg(F.count_distinct("module").alias("n")).filter("n > 1")
    lost = deps.join(known, F.col("dst") == F.col("m"), "left_anti")
    found = shared.select(F.lit("L-004").alias("code"), F.col("label").alias("subject")).unionByName(lost.select(F.lit("L-009").alias("code"), F.col("dst").alias("subject")).distinct())
    empty = records.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("L-010").alias("code"), F.lit("").alias("subject"))
    return records, found.unionByName(empty)
