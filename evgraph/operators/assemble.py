"""From the facts of Python and Rust files to a graph: nodes, and edges with evidence.

Every reference ends in one state, and references of each kind and state are counted.
All steps are equi joins on facts; nothing is gathered but what a small fixed table
holds. Definitions are counted by name before any join, so a name that a thousand
files define costs one row a call and not a thousand.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators import build, resolve
from evgraph.schema import qualified_prefix, symbol_id
from evgraph.storage import stage

#: One citation of an edge a row.
EDGE = ("src", "dst", "kind", "file", "start_line", "end_line", "resolution", "arity", "shape", "producer")
#: Classes that need no import.
BUILT_IN = ("object", "type", "str", "int", "float", "bytes", "bool", "list", "dict", "set", "tuple", "frozenset", "property")


@dataclass
class Graph:
    """``nodes``; ``edges`` by citation; ``references`` by kind and state."""

    nodes: DataFrame
    edges: DataFrame
    references: DataFrame

    def scorecard(self) -> DataFrame:
        return build.scorecard(self.references, ["lang", "kind"])


def node_rows(files: DataFrame, symbols: DataFrame, lang: str = "python") -> DataFrame:
    """A node for each file, cited by its first line (0 if it has none), and one for
    each symbol; of symbols with one id the first by line."""
    line = F.when(F.col("line_count") > 0, 1).otherwise(0)
    whole = files.select(
        F.col("path").alias("id"), F.lit("module").alias("kind"), F.substring_index("path", "/", -1).alias("label"), F.col("path").alias("qualified_name"),
        F.col("path").alias("file"), line.alias("start_line"), line.alias("end_line"), F.lit("").alias("class"), F.lit(f"{lang}.module").alias("producer"),
    )
    first = symbols.groupBy("id").agg(F.min(F.struct("start_line", "end_line", "kind", "name", "path", "qualified_name", "enclosing_class")).alias("s"))
    named = first.select(
        "id", "s.kind", F.col("s.name").alias("label"), F.concat_ws(".", F.nullif(qualified_prefix(F.col("s.path")), F.lit("")), "s.qualified_name").alias("qualified_name"),
        F.col("s.path").alias("file"), "s.start_line", "s.end_line", F.col("s.enclosing_class").alias("class"), F.lit(f"{lang}.symbols").alias("producer"),
    )
    return whole.unionByName(named)


def modules_named(asked: DataFrame, files: DataFrame, tops: DataFrame) -> DataFrame:
    """``path``, ``spec``, ``level``, ``target``: the file that a specifier in a file
    names, as a module before as a package, the longest root first; nothing if none."""
    key = ["path", "spec", "level"]
    asked = asked.select(*key).distinct()
    rest = F.replace("spec", F.lit("."), F.lit("/"))
    up = F.expr("array_join(slice(split(path, '/'), 1, greatest(size(split(path, '/')) - level, 0)), '/')")
    near = asked.filter("level > 0").select(*key, up.alias("root"))
    far = asked.filter("level = 0 and spec <> ''").join(tops, F.substring_index("spec", ".", 1) == F.col("first")).select(*key, "root")
    blank = lambda c: F.nullif(c, F.lit(""))
    stem = F.concat_ws("/", blank(F.col("root")), blank(rest))
    as_file = F.when(F.col("spec") != "", F.concat(stem, F.lit(".py")))
    as_package = F.concat_ws("/", blank(stem), F.lit("__init__.py"))
    tried = near.unionByName(far).select(*key, (-F.length("root")).alias("far"), F.explode(F.array(F.struct(F.lit(0).alias("as"), as_file.alias("file")), F.struct(F.lit(1).alias("as"), as_package.alias("file")))).alias("c"))
    hits = tried.join(files.select(F.col("path").alias("known")), F.col("c.file") == F.col("known"), "left_semi")
    return hits.groupBy(*key).agg(F.min(F.struct("far", "c.as", "c.file")).alias("b")).select(*key, F.col("b.file").alias("target"))


def _found(frame: DataFrame, names: DataFrame, spec: Column, target: str) -> DataFrame:
    """``frame`` with the file that ``spec`` names there as ``target``."""
    t = names.select(F.col("path").alias("t_path"), F.col("spec").alias("t_spec"), F.col("level").alias("t_level"), F.col("target").alias(target))
    return frame.join(t, (F.col("path") == F.col("t_path")) & (spec == F.col("t_spec")) & (F.col("level") == F.col("t_level")), "left").drop("t_path", "t_spec", "t_level")


def import_facts(imports: DataFrame, files: DataFrame, declared: DataFrame | None) -> DataFrame:
    """One row per imported name (or imported module): ``target`` its module's file,
    ``sibling`` the file that the name itself is, ``external`` if its package is of
    the language or declared."""
    spark = imports.sparkSession
    each = F.explode_outer(F.when(F.col("name") == "", F.arrays_zip("names", "aliases"))).alias("z")
    rows = imports.select("path", "start_line", "end_line", F.col("specifier").alias("base"), "level", F.col("name").alias("plain"), each)
    rows = rows.select("path", "start_line", "end_line", "base", "level", (F.col("plain") == "").alias("is_from"), F.coalesce("z.names", F.lit("")).alias("real"), F.coalesce("z.aliases", "plain").alias("alias"))
    whole = F.concat_ws(".", F.nullif("base", F.lit("")), "real")
    spec = F.when(F.col("is_from"), whole).otherwise(F.lit(None).cast("string"))
    rows = stage(rows.withColumn("whole", spec), "imports")
    asked = rows.select("path", F.explode(F.array("base", "whole")).alias("spec"), "level").filter("spec is not null")
    names = stage(modules_named(asked, files, resolve.import_tops(files)), "modules")
    out = _found(_found(rows, names, F.col("base"), "target"), names, F.col("whole"), "sibling")
    known = spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "package string")
    if declared is not None:
        known = known.union(declared.select(F.regexp_replace(F.lower("name"), "-", "_"))).distinct()
    root = F.substring_index("base", ".", 1)
    return out.join(known, F.lower(root) == F.col("package"), "left").withColumn("external", (F.col("level") == 0) & F.col("package").isNotNull()).drop("package")


def find_symbols(asked: DataFrame, imports: DataFrame, tops: DataFrame, depth: int = 4) -> DataFrame:
    """``file``, ``name``, ``id``: the top-level symbol that a name stands for in a file, by
    way of at most ``depth`` imports of that name, or of all names, where the file does
    not define it."""
    given = imports.filter("is_from and target is not null and target <> path")
    named = given.filter("real <> '*'").groupBy(F.col("path").alias("file"), F.col("alias").alias("name")).agg(F.max(F.struct("start_line", "target", "real")).alias("e"))
    named = stage(named.select("file", "name", F.col("e.target").alias("to_file"), F.col("e.real").alias("to_name"), F.col("e.start_line").alias("line")), "exports")
    stars = given.filter("real = '*'").groupBy(F.col("path").alias("file"), F.col("target").alias("to_file")).agg(F.min("start_line").alias("line"))
    found = resolve.search_exports(asked, named, stage(stars, "stars"), tops, depth)
    hits = found.join(tops.select("path", F.col("name").alias("s_name"), "id", "start_line"), (F.col("at") == F.col("path")) & (F.col("as") == F.col("s_name")))
    return hits.groupBy("file", "name").agg(F.min(F.struct("start_line", "id")).alias("f")).select("file", "name", "f.id")


def _import_edges(rows: DataFrame, found: DataFrame, lang: str = "python") -> tuple[DataFrame, DataFrame]:
    """Edges and states of imports, and of the names they bring."""
    known = found.select(F.col("file").alias("k_file"), F.col("name").alias("k_name"), F.col("id").alias("symbol"))
    rows = rows.join(known, (F.col("target") == F.col("k_file")) & (F.col("real") == F.col("k_name")), "left")
    other = F.col("sibling").isNotNull() & (F.col("sibling") != F.col("path")) & ~F.col("sibling").eqNullSafe(F.col("target"))
    own = F.col("target").eqNullSafe(F.col("path"))
    rows = stage(rows.filter(~own).withColumn("is_module", other), "named")
    place = [F.col("path").alias("file"), "start_line", "end_line"]
    edge = lambda df, dst, kind: df.select(F.col("path").alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), *place)
    edges = edge(rows.filter("target is not null"), "target", "imports").distinct()
    edges = edges.union(edge(rows.filter("is_module"), "sibling", "imports")).union(edge(rows.filter("not is_module and symbol is not null"), "symbol", "references")).distinct()
    out = edges.select("src", "dst", "kind", "file", "start_line", "end_line", F.lit("resolved").alias("resolution"), F.lit(1).alias("arity"), F.lit(None).cast("string").alias("shape"), F.lit(f"{lang}.imports").alias("producer"))
    missed = F.when(F.col("external"), "external").otherwise("unresolved")
    statement = rows.groupBy("path", "start_line", "base", "level", "is_from").agg(F.bool_or(F.col("target").isNotNull() | F.col("is_module")).alias("hit"), F.bool_or("external").alias("external"))
    states = statement.select(F.lit("imports").alias("kind"), F.when(F.col("hit"), "resolved").otherwise(missed).alias("resolution"))
    found_one = F.col("is_module") | F.col("symbol").isNotNull()
    # A star brings names, it is none.
    name = rows.filter("is_from and real <> '*'").select(F.lit("references").alias("kind"), F.when(found_one, "resolved").when(F.col("target").isNull(), missed).otherwise("unresolved").alias("resolution"))
    return out, states.unionByName(name)


def _class_of(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """``path``, ``type_name``, ``c_path``, ``c_name``: the class that a name stands
    for in a file: the file's own, else the one of that name."""
    classes = symbols.filter("kind = 'class'")
    here = classes.select(F.col("path").alias("h_path"), F.col("name").alias("h_name")).distinct()
    alone = classes.groupBy(F.col("name").alias("u_name")).agg(F.count("*").alias("n"), F.min("path").alias("u_path")).filter("n = 1")
    want = asked.select("path", "type_name").distinct().withColumn("last", F.substring_index("type_name", ".", -1)).filter("last <> ''")
    both = want.join(here, (F.col("path") == F.col("h_path")) & (F.col("last") == F.col("h_name")), "left").join(alone, F.col("last") == F.col("u_name"), "left")
    return both.select("path", "type_name", F.coalesce("h_path", "u_path").alias("c_path"), F.col("last").alias("c_name")).filter("c_path is not null")


def _methods(symbols: DataFrame, asked: DataFrame, line: DataFrame, own: bool = True) -> DataFrame:
    """``c_path``, ``c_name``, ``method``, ``id``: of the classes of a class's line, the
    nearest that defines the method."""
    want = asked.select("c_path", "c_name", "method").distinct()
    line = line.select(F.col("path").alias("l_path"), F.col("class").alias("l_class"), "a_path", "ancestor", "order")
    chain = want.join(line, (F.col("c_path") == F.col("l_path")) & (F.col("c_name") == F.col("l_class"))).select("c_path", "c_name", "method", "a_path", "ancestor", "order")
    if own:
        chain = chain.unionByName(want.select("*", F.col("c_path").alias("a_path"), F.col("c_name").alias("ancestor"), F.array().cast("array<int>").alias("order")))
    of = symbols.filter("kind = 'method'").select("path", F.col("enclosing_class").alias("m_class"), F.col("name").alias("m_name"), "id")
    hits = chain.join(of, (F.col("a_path") == F.col("path")) & (F.col("ancestor") == F.col("m_class")) & (F.col("method") == F.col("m_name")))
    return hits.groupBy("c_path", "c_name", "method").agg(F.min(F.struct("order", "id")).alias("f")).select("c_path", "c_name", "method", "f.id")


def _typed(calls: DataFrame, symbols: DataFrame, line: DataFrame, type_name: str, where: str = "path") -> DataFrame:
    """Hits of calls whose receiver has the type ``type_name``, as the file ``where`` has it."""
    asked = calls.select("call", "name", F.col(where).alias("path"), F.col(type_name).alias("type_name"))
    classes = _class_of(symbols, asked).withColumnRenamed("path", "k_path").withColumnRenamed("type_name", "k_type")
    at = asked.join(classes, (F.col("path") == F.col("k_path")) & (F.col("type_name") == F.col("k_type"))).withColumn("method", F.col("name"))
    of = _methods(symbols, at, line).toDF("f_path", "f_class", "f_method", "hit")
    return at.join(of, (F.col("c_path") == F.col("f_path")) & (F.col("c_name") == F.col("f_class")) & (F.col("method") == F.col("f_method"))).select("call", "hit")


def _call_edges(calls: DataFrame, facts: DataFrame, symbols: DataFrame, rows: DataFrame, most: int, lang: str = "python") -> tuple[DataFrame, DataFrame]:
    """Edges and states of calls, by their shape. A hit resolves a call, several are
    candidates with the call and each definition as evidence, over ``most`` none."""
    calls = stage(calls.withColumn("call", F.monotonically_increasing_id()), "calls")
    tops = symbols.filter("enclosing = ''")
    line = stage(resolve.ancestors(symbols), "lines")
    of = lambda fact: facts.filter(F.col("fact") == fact)
    in_scope = rows.groupBy(F.col("path").alias("i_path"), "alias").agg(F.max_by(F.struct("target", "sibling", "real", "is_from", "external", "base", "level"), "start_line").alias("i"))
    scoped = calls.join(in_scope, (F.col("path") == F.col("i_path")) & (F.when(F.col("shape") == "bare", F.col("name")).otherwise(F.col("receiver")) == F.col("alias")), "left")
    typed_at = of("local").groupBy(F.col("path").alias("l_path"), F.col("enclosing").alias("l_in"), F.col("name").alias("local")).agg(F.count_distinct("type_name").alias("types"), F.max("type_name").alias("declared"))
    typed_at = typed_at.withColumn("declared", F.when(F.col("types") == 1, F.col("declared")).otherwise(F.lit("")))
    first = F.substring_index("receiver", ".", 1)
    scoped = stage(scoped.join(typed_at, (F.col("path") == F.col("l_path")) & (F.col("enclosing") == F.col("l_in")) & (first == F.col("local")) & (F.col("shape").isin("qualified", "member")), "left").drop("l_path", "l_in", "local"), "scoped")

    # Bare names: of the file, else imported, else of that name anywhere.
    by_file = tops.groupBy(F.col("path").alias("s_path"), F.col("name").alias("s_name")).agg(F.count_distinct("id").alias("n"))
    bare = scoped.filter("shape = 'bare'").join(by_file, (F.col("path") == F.col("s_path")) & (F.col("name") == F.col("s_name")), "left").drop("s_path", "s_name")
    here = bare.filter("n is not null").join(tops.select(F.col("path").alias("p"), F.col("name").alias("m"), F.col("id").alias("hit")), (F.col("path") == F.col("p")) & (F.col("name") == F.col("m"))).select("call", "hit")
    brought = bare.filter("n is null and i.target is not null").select("call", F.col("i.target").alias("file"), F.col("i.real").alias("name"))
    # Qualified names: of a typed local, of an imported module, else of a class.
    dotted = scoped.filter("shape = 'qualified'")
    through = dotted.filter("declared is null and i is not null")
    modules = through.select("call", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("i.target").alias("file")), F.struct(F.lit(1).alias("way"), F.col("i.sibling").alias("file")))).alias("w"), "name").select("call", "w.way", "w.file", "name").filter("file is not null")
    # A name that no import names may come by one that brings all names of a file.
    stars = rows.filter("is_from and real = '*' and target is not null and target <> path").select(F.col("path").alias("star")).distinct()
    starred = bare.filter("n is null and i is null").join(stars, F.col("path") == F.col("star"), "left_semi").select("call", F.lit(0).alias("way"), F.col("path").alias("file"), "name")
    looked = stage(modules.unionByName(brought.withColumn("way", F.lit(0))).unionByName(starred), "looked")
    ids = find_symbols(looked, rows, tops).toDF("k_file", "k_name", "hit")
    by_import = looked.join(ids, (F.col("file") == F.col("k_file")) & (F.col("name") == F.col("k_name"))).groupBy("call").agg(F.min(F.struct("way", "hit")).alias("b")).select("call", "b.hit")
    everywhere = tops.groupBy(F.col("name").alias("s_name")).agg(F.count_distinct("id").alias("all")).filter(F.col("all") <= most)
    told = by_import.select(F.col("call").alias("told"))
    anywhere = bare.filter("n is null and i is null").join(told, F.col("call") == F.col("told"), "left_anti").join(everywhere, F.col("name") == F.col("s_name"), "left_semi").join(tops.select(F.col("name").alias("m"), F.col("id").alias("hit")), F.col("name") == F.col("m")).select("call", "hit")
    by_local = _typed(dotted.filter("declared <> ''"), symbols, line, "declared")
    by_class = _typed(dotted.filter("declared is null and i is null"), symbols, line, "receiver")
    # Calls on oneself, on one's bases, on a typed field, on a field of a typed local.
    oneself = calls.filter("shape in ('self', 'super') and enclosing_class <> ''")
    classes = _class_of(symbols, oneself.withColumn("type_name", F.col("enclosing_class"))).toDF("k_path", "k_type", "c_path", "c_name")
    oneself = oneself.join(classes, (F.col("path") == F.col("k_path")) & (F.col("enclosing_class") == F.col("k_type"))).withColumn("method", F.col("name"))
    over = []
    for shape in ("self", "super"):
        mine = oneself.filter(F.col("shape") == shape)
        near = _methods(symbols, mine, line, own=shape == "self").toDF("f_path", "f_class", "f_method", "hit")
        over.append(mine.join(near, (F.col("c_path") == F.col("f_path")) & (F.col("c_name") == F.col("f_class")) & (F.col("method") == F.col("f_method"))).select("call", "hit"))
    held = of("field").filter("type_name <> ''").groupBy(F.col("path").alias("d_path"), F.col("enclosing_class").alias("d_class"), F.col("name").alias("field")).agg(F.count_distinct("type_name").alias("types"), F.max("type_name").alias("held"))
    held = held.filter("types = 1").drop("types")
    second = F.expr("substring_index(substring_index(receiver, '.', 2), '.', -1)")
    field = calls.filter("shape = 'self_field'").join(held, (F.col("path") == F.col("d_path")) & (F.col("enclosing_class") == F.col("d_class")) & (second == F.col("field")))
    by_field = _typed(field.filter("size(split(receiver, '[.]')) = 2"), symbols, line, "held")
    chained = scoped.filter("shape = 'member' and declared <> '' and size(split(receiver, '[.]')) = 2")
    owners = _class_of(symbols, chained.withColumn("type_name", F.col("declared"))).toDF("k_path", "k_type", "c_path", "c_name")
    chained = chained.join(owners, (F.col("path") == F.col("k_path")) & (F.col("declared") == F.col("k_type"))).join(held, (F.col("c_path") == F.col("d_path")) & (F.col("c_name") == F.col("d_class")) & (second == F.col("field")))
    by_member = _typed(chained, symbols, line, "held", "c_path")

    hits = here
    for more in (by_import, anywhere, by_local, by_class, *over, by_field, by_member):
        hits = hits.union(more)
    hits = stage(hits.distinct(), "hits")
    count = hits.groupBy(F.col("call").alias("c")).agg(F.count("*").alias("n"))
    outside = scoped.filter("shape in ('bare', 'qualified') and declared is null and i.external and i.target is null and i.sibling is null").select(F.col("call").alias("x"))
    local = bare.filter("n is not null").select(F.col("call").alias("y"))
    outside = outside.join(local, F.col("x") == F.col("y"), "left_anti").distinct()
    judged = calls.join(count, F.col("call") == F.col("c"), "left").join(outside, F.col("call") == F.col("x"), "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 1, "resolved").when((n > 1) & (n <= most), "candidate").when((n == 0) & F.col("x").isNotNull(), "external").otherwise("unresolved")
    judged = stage(judged.select("call", "path", "start_line", "end_line", "shape", "enclosing", n.cast("int").alias("arity"), state.alias("resolution")), "judged")
    sure = judged.filter("resolution in ('resolved', 'candidate')").join(hits.withColumnRenamed("call", "h"), F.col("call") == F.col("h"))
    src = symbol_id(F.col("path"), F.col("enclosing")).alias("src")
    tail = ["resolution", "arity", "shape", F.lit(f"{lang}.calls").alias("producer")]
    edges = sure.select(src, F.col("hit").alias("dst"), F.lit("calls").alias("kind"), F.col("path").alias("file"), "start_line", "end_line", *tail)
    places = symbols.groupBy(F.col("id").alias("s_id")).agg(F.min(F.struct("path", "start_line", "end_line")).alias("s"))
    shown = sure.filter("resolution = 'candidate'").drop("start_line", "end_line").join(places, F.col("hit") == F.col("s_id"))
    shown = shown.select(src, F.col("hit").alias("dst"), F.lit("calls").alias("kind"), F.col("s.path").alias("file"), F.col("s.start_line"), F.col("s.end_line"), *tail)
    return edges.union(shown), judged.select(F.lit("calls").alias("kind"), "resolution")


def _inherit_edges(symbols: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and states of bases: external where the language or an external import
    gives them."""
    asked = symbols.filter("kind = 'class'").select("path", "id", "start_line", "end_line", F.explode("bases").alias("type_name"))
    classes = _class_of(symbols, asked).toDF("k_path", "k_type", "c_path", "c_name")
    ids = symbols.filter("kind = 'class'").groupBy(F.col("path").alias("b_path"), F.col("name").alias("b_name")).agg(F.min_by("id", "start_line").alias("dst"))
    hit = asked.join(classes, (F.col("path") == F.col("k_path")) & (F.col("type_name") == F.col("k_type")), "left").join(ids, (F.col("c_path") == F.col("b_path")) & (F.col("c_name") == F.col("b_name")), "left")
    outside = rows.filter("external").select(F.col("path").alias("x_path"), F.col("alias").alias("x_name")).distinct()
    hit = hit.join(outside, (F.col("path") == F.col("x_path")) & (F.substring_index("type_name", ".", 1) == F.col("x_name")), "left")
    last = F.substring_index("type_name", ".", -1)
    built_in = last.isin(*BUILT_IN) | last.rlike("(Error|Exception|Warning)$")
    state = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("x_name").isNotNull() | built_in, "external").otherwise("unresolved")
    hit = stage(hit.withColumn("resolution", state), "bases-found")
    edges = hit.filter("dst is not null").select(F.col("id").alias("src"), "dst", F.lit("inherits").alias("kind"), F.col("path").alias("file"), "start_line", "end_line", "resolution", F.lit(1).alias("arity"), F.lit(None).cast("string").alias("shape"), F.lit("python.inherits").alias("producer"))
    return edges, hit.select(F.lit("inherits").alias("kind"), "resolution")


def graph(files: DataFrame, facts: DataFrame, declared: DataFrame | None = None, most: int = resolve.MOST_CANDIDATES) -> Graph:
    """The graph of Python files (``path``, ``lang``, ``line_count``) from their
    ``facts`` (``python_facts``) and the packages they declare (``name``).

    Names without a match are unresolved or external, never guessed. Files that could
    not be parsed are nodes without symbols; an empty table gives an empty graph.
    """
    sources = stage(files.filter("lang = 'python'").select("path", "line_count"), "sources")
    of = lambda fact: facts.filter(F.col("fact") == fact)
    kept = ["path", "name", "qualified_name", "kind", "start_line", "end_line", "enclosing", "enclosing_class", "bases"]
    symbols = stage(of("symbol").select(*kept, symbol_id(F.col("path"), F.col("qualified_name")).alias("id")), "symbols")
    rows = stage(import_facts(of("import"), sources, declared), "import-facts")
    asked = rows.filter("is_from and target is not null").select(F.col("target").alias("file"), F.col("real").alias("name"))
    found = find_symbols(asked, rows, symbols.filter("enclosing = ''"))
    parts = [_import_edges(rows, found), _call_edges(of("call").select("path", "start_line", "end_line", "name", "shape", "receiver", "enclosing", "enclosing_class"), facts, symbols, rows, most), _inherit_edges(symbols, rows)]
    edges, states = parts[0]
    for e, s in parts[1:]:
        edges, states = edges.unionByName(e), states.unionByName(s)
    return Graph(node_rows(sources, symbols), stage(edges.select(*EDGE), "edges"), stage(states.withColumn("lang", F.lit("python")), "states"))


def rust_graph(files: DataFrame, facts: DataFrame, declared: DataFrame | None = None, most: int = resolve.MOST_CANDIDATES) -> Graph:
    """The graph of Rust files among ``files`` (path, lang, line_count, text) from their
    ``facts`` (``rust_facts``); manifests among them say which crates there are.

    Paths of ``use`` and ``mod`` are looked up in the trees of modules (``crates``), calls
    by shape like those of any language. A path into a declared package or the standard
    library is external, another without a file unresolved.
    """
    from evgraph.operators import crates

    sources = stage(files.filter("lang = 'rust'").select("path", "line_count"), "sources")
    of = lambda fact: facts.filter(F.col("fact") == fact)
    kept = ["path", "name", "qualified_name", "kind", "start_line", "end_line", "enclosing", "enclosing_class", "bases"]
    symbols = stage(of("symbol").select(*kept, symbol_id(F.col("path"), F.col("qualified_name")).alias("id")), "symbols")
    known = stage(crates.packages(files), "packages")
    found, _ = crates.resolved(of("import"), sources, symbols, known)
    outside = sources.sparkSession.createDataFrame([(n,) for n in crates.STANDARD], "package string")
    if declared is not None:
        outside = outside.union(declared.select(F.regexp_replace("name", "-", "_"))).distinct()
    outside = outside.join(known, F.col("package") == F.col("crate"), "left_anti")
    head = F.element_at("parts", 1)
    rows = found.join(outside, head == F.col("package"), "left").withColumn("external", F.col("package").isNotNull() & F.col("target").isNull())
    rows = stage(rows.withColumn("is_from", F.col("real") != "").withColumn("level", F.lit(0)).withColumn("sibling", F.lit(None).cast("string")), "import-facts")
    here = rows.filter("target is null or target <> path")
    edges = here.filter("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"), F.col("path").alias("file"), "start_line", "end_line").distinct()
    blank = F.lit(None).cast("string")
    imports = edges.select("src", "dst", F.lit("imports").alias("kind"), "file", "start_line", "end_line", F.lit("resolved").alias("resolution"), F.lit(1).alias("arity"), blank.alias("shape"), F.lit("rust.imports").alias("producer"))
    state = F.when(F.col("target").isNotNull(), "resolved").when(F.col("external"), "external").otherwise("unresolved")
    states = here.select(F.lit("imports").alias("kind"), state.alias("resolution"))
    calls = of("call").select("path", "start_line", "end_line", "name", "shape", "receiver", "enclosing", "enclosing_class")
    called, told = _call_edges(calls, facts, symbols, rows, most, "rust")
    return Graph(node_rows(sources, symbols, "rust"), stage(imports.unionByName(called).select(*EDGE), "edges"), stage(states.unionByName(told).withColumn("lang", F.lit("rust")), "states"))


def of_folder(spark: SparkSession, root: str) -> Graph:
    """From a folder of source files to its graph, Python and Rust in one."""
    from evgraph.extract import manifests, python_facts, rust_facts
    from evgraph.sources.files import scan

    files = stage(scan(spark, root), "files")
    declared = manifests.dependencies(files).select("name").distinct()
    found = graph(files, stage(python_facts.extract(files), "facts"), declared)
    if files.filter("lang = 'rust'").isEmpty():
        return found
    more = rust_graph(files, stage(rust_facts.extract(files), "facts"), declared)
    return Graph(found.nodes.unionByName(more.nodes), found.edges.unionByName(more.edges), found.references.unionByName(more.references))


__all__ = ["Graph", "find_symbols", "graph", "import_facts", "modules_named", "node_rows", "of_folder", "rust_graph"]
