"""Name resolution over fact tables: imports to files, calls to definitions.

Every reference ends in one state: resolved, candidate, external or unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.schema import module_of
from evgraph.storage import stage

#: More definitions than this are no answer.
MOST_CANDIDATES = 8


def source_roots(files: DataFrame) -> DataFrame:
    """Directories that imports start from: the parents of top-level packages, and
    the root itself."""
    packages = files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(module_of(F.col("path")).alias("dir")).distinct()
    inner = packages.select(F.col("dir").alias("known"))
    tops = packages.join(inner, module_of(F.col("dir")) == F.col("known"), "left_anti")
    return tops.select(module_of(F.col("dir")).alias("root")).union(files.sparkSession.createDataFrame([("",)], "root string")).distinct()


def import_tops(files: DataFrame) -> DataFrame:
    """``root``, ``first``: under which directories a first name of an import is found."""
    parts = F.split("path", "/")
    places = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), F.regexp_replace(F.get(parts, i), r"\.py$", "").alias("first")))
    under = files.select(F.explode(places).alias("p")).select("p.dir", "p.first").distinct()
    return under.join(source_roots(files), F.col("dir") == F.col("root")).select("root", "first")


def import_targets(imports: DataFrame, files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``path``, ``start_line``, ``specifier``, ``imported``, ``target``, ``state`` of each
    imported name (empty where a module itself is imported).

    Candidates, best first: for every source root (longest first) the module as a
    file, then as a package, then the same for shorter prefixes of the specifier;
    relative imports start at their own directory. Candidates become rows, meet the
    files in an equi join, and the least place wins.
    """
    key = ["path", "start_line", "specifier", "imported"]
    each = F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("")))).alias("imported")
    asked = imports.select("path", "start_line", "specifier", "level", each)
    spec = F.concat_ws(".", F.when(F.col("specifier") != "", F.col("specifier")), F.when(F.col("imported") != "", F.col("imported")))
    up = F.expr("array_join(slice(split(path, '/'), 1, greatest(size(split(path, '/')) - level, 0)), '/')")
    relative = asked.filter("level > 0").select(*key, spec.alias("spec"), up.alias("root"))
    # A root is tried only where a file or directory under it has the first name.
    first = F.substring_index(F.col("spec"), ".", 1)
    absolute = asked.filter("level = 0").select(*key, spec.alias("spec")).join(import_tops(files), first == F.col("first")).select(*key, "spec", "root")
    spread = relative.unionByName(absolute)
    parts = F.split(F.regexp_replace("spec", r"\.", "/"), "/")
    stems = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    named = spread.select(*key, "root", F.size(parts).alias("n"), F.posexplode(stems).alias("cut", "stem"))
    place = F.struct((-F.length("root")).alias("root"), (F.col("cut") - F.col("n")).alias("short"))
    joined = F.when(F.col("root") == "", F.col("stem")).otherwise(F.concat_ws("/", "root", F.when(F.col("stem") != "", F.col("stem"))))
    tried = named.select(*key, place.alias("place"), F.explode(F.array(F.struct(F.lit(0).alias("as"), F.concat(joined, F.lit(".py")).alias("file")), F.struct(F.lit(1).alias("as"), F.concat(joined, F.lit("/__init__.py")).alias("file")))).alias("c"))
    hits = tried.join(files.select(F.col("path").alias("known")), F.col("c.file") == F.col("known"), "left_semi")
    best = hits.groupBy(*key).agg(F.min(F.struct("place", "c.as", "c.file")).alias("b")).select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("b.file").alias("target"))
    on = [F.col(k) == F.col(f"b_{k}") for k in key]
    out = asked.join(best, on, "left").select(*key, "level", "target")
    root = F.substring_index("specifier", ".", 1)
    if declared is not None:
        out = out.join(declared.select(F.col("name").alias("dep")).distinct(), root == F.col("dep"), "left")
    else:
        out = out.withColumn("dep", F.lit(None).cast("string"))
    state = F.when(F.col("target").isNotNull(), "resolved").when((F.col("level") == 0) & F.col("dep").isNotNull(), "external").otherwise("unresolved")
    return out.select(*key, "target", state.alias("state"))


def follow_reexports(names: DataFrame, exports: DataFrame, depth: int = 4) -> DataFrame:
    """``file``, ``name`` chased through re-exports (``file``, ``name``, ``to_file``,
    ``to_name``) at most ``depth`` times: one join per step."""
    now = names.select("file", "name", F.col("file").alias("at"), F.col("name").alias("as"))
    step = exports.select(F.col("file").alias("e_file"), F.col("name").alias("e_name"), "to_file", "to_name")
    for _ in range(depth):
        joined = now.join(step, (F.col("at") == F.col("e_file")) & (F.col("as") == F.col("e_name")), "left")
        now = joined.select("file", "name", F.coalesce("to_file", "at").alias("at"), F.coalesce("to_name", "as").alias("as"))
    return now


def search_exports(asked: DataFrame, named: DataFrame, stars: DataFrame, tops: DataFrame, depth: int = 4) -> DataFrame:
    """``file``, ``name``, ``at``, ``as``: the first definition of a name that a file has or
    brings, depth first in the order of its imports, ``depth`` imports away at most.

    ``named``: file, name, to_file, to_name, line; ``stars`` (all names of a file): file,
    to_file, line; ``tops``: path, name. A file's own definition ends its search. All
    searches take a step at once; the lines of the imports on the way, compared as an
    array, are the order depth-first search would go in, so the least is what it finds. A
    step has a row for each file that a search is at, however many ways lead there.
    """
    blank = F.array().cast("array<int>")
    front = asked.select("file", "name").distinct().select("file", "name", F.col("file").alias("at"), F.col("name").alias("as"), blank.alias("way"))
    known = tops.select(F.col("path").alias("k_path"), F.col("name").alias("k_name")).distinct()
    by_name = named.select(F.col("file").alias("n_file"), F.col("name").alias("n_name"), "to_file", "to_name", F.col("line").alias("n_line"))
    by_star = stars.select(F.col("file").alias("s_file"), F.col("to_file").alias("s_to"), F.col("line").alias("s_line"))
    here = (F.col("at") == F.col("k_path")) & (F.col("as") == F.col("k_name"))
    hits = None
    for k in range(depth + 1):
        found = front.join(known, here, "left_semi")
        hits = found if hits is None else hits.unionByName(found)
        if k == depth:
            break
        open_ = front.join(known, here, "left_anti")
        on = lambda line: F.concat("way", F.array(line.cast("int"))).alias("way")
        one = open_.join(by_name, (F.col("at") == F.col("n_file")) & (F.col("as") == F.col("n_name"))).select("file", "name", F.col("to_file").alias("at"), F.col("to_name").alias("as"), on(F.col("n_line")))
        all_ = open_.join(by_star, F.col("at") == F.col("s_file")).select("file", "name", F.col("s_to").alias("at"), "as", on(F.col("s_line")))
        front = stage(one.unionByName(all_).groupBy("file", "name", "at", "as").agg(F.min("way").alias("way")), "search")
    best = hits.groupBy("file", "name").agg(F.min(F.struct("way", "at", "as")).alias("b"))
    return best.select("file", "name", "b.at", "b.as")


def ancestors(symbols: DataFrame) -> DataFrame:
    """``path``, ``class``, ``a_path``, ``ancestor``, ``order`` of all classes above a
    class, nearest first in the order bases are written. A base is the class of its
    last name in the same file, else the one class of that name anywhere; a class
    met again ends its chain. One join per level, until nothing is new."""
    classes = symbols.filter("kind = 'class'").select("path", F.col("name").alias("class"), "bases")
    bases = classes.select("path", "class", F.posexplode("bases").alias("nth", "base")).withColumn("base", F.substring_index("base", ".", -1))
    alone = classes.groupBy(F.col("class").alias("u_class")).agg(F.count("*").alias("n"), F.min("path").alias("u_path")).filter("n = 1")
    here = classes.select(F.col("path").alias("h_path"), F.col("class").alias("h_class")).distinct()
    found = bases.join(here, (F.col("path") == F.col("h_path")) & (F.col("base") == F.col("h_class")), "left").join(alone, F.col("base") == F.col("u_class"), "left")
    up = stage(found.select("path", "class", "nth", F.coalesce("h_path", "u_path").alias("b_path"), "base").filter("b_path is not null"), "bases")
    now = up.select("path", "class", F.col("b_path").alias("a_path"), F.col("base").alias("ancestor"), F.array("nth").alias("order"))
    every = now
    while True:
        step = up.select(F.col("path").alias("s_path"), F.col("class").alias("s_class"), "nth", "b_path", "base")
        now = now.join(step, (F.col("a_path") == F.col("s_path")) & (F.col("ancestor") == F.col("s_class"))).select("path", "class", F.col("b_path").alias("a_path"), F.col("base").alias("ancestor"), F.concat("order", F.array("nth")).alias("order"))
        met = every.select(F.col("path").alias("e_path"), F.col("class").alias("e_class"), F.col("a_path").alias("e_a"), F.col("ancestor").alias("e_an"))
        again = (F.col("path") == F.col("e_path")) & (F.col("class") == F.col("e_class")) & (F.col("a_path") == F.col("e_a")) & (F.col("ancestor") == F.col("e_an"))
        now = stage(now.filter("not (path = a_path and class = ancestor)").join(met, again, "left_anti"), "ancestors")
        if now.isEmpty():
            break
        every = every.unionByName(now)
    return every.groupBy("path", "class", "a_path", "ancestor").agg(F.min("order").alias("order"))


def call_targets(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``path``, ``start_line``, ``name``, ``targets``, ``state`` of each call.

    Bare names: the same file, else what the file imports, else the one definition
    of that name in all files; ``self`` calls: the enclosing class, then the nearest
    class above it that has a method of that name. Tiers are left joins, each counted on its own, and the
    first tier with hits answers; up to eight hits are candidates.
    """
    key = ["path", "start_line", "shape", "receiver", "name", "enclosing_class"]
    asked = stage(calls.select(*key).distinct(), "calls")
    ids = symbols.select(F.col("path").alias("s_path"), F.col("name").alias("s_name"), F.col("enclosing_class").alias("s_class"), F.concat_ws("#", "path", "qualified_name").alias("id"), "kind")
    tops = ids.filter("s_class = '' ")
    bare = asked.filter("shape = 'bare'")
    same = bare.join(tops, (F.col("path") == F.col("s_path")) & (F.col("name") == F.col("s_name"))).select(*key, F.lit(0).alias("tier"), "id")
    brought = imports.filter("target is not null").select(F.col("path").alias("i_path"), "target").distinct()
    via = bare.join(brought, F.col("path") == F.col("i_path")).join(tops, (F.col("target") == F.col("s_path")) & (F.col("name") == F.col("s_name"))).select(*key, F.lit(1).alias("tier"), "id")
    # A name that too many files define is no answer: counted before any join.
    few = tops.groupBy(F.col("s_name").alias("f_name")).agg(F.count("*").alias("f")).filter(F.col("f") <= MOST_CANDIDATES).select("f_name")
    sparse = tops.join(few, F.col("s_name") == F.col("f_name"), "left_semi")
    anywhere = bare.join(sparse, F.col("name") == F.col("s_name")).select(*key, F.lit(2).alias("tier"), "id")
    own = asked.filter("shape in ('self', 'super')")
    methods = ids.filter("kind = 'method'")
    mine = own.filter("shape = 'self'").join(methods, (F.col("path") == F.col("s_path")) & (F.col("name") == F.col("s_name")) & (F.col("enclosing_class") == F.col("s_class"))).select(*key, F.lit(0).alias("tier"), "id")
    line = ancestors(symbols).select(F.col("path").alias("c_path"), F.col("class").alias("c_name"), "a_path", "ancestor", "order")
    over = own.join(line, (F.col("path") == F.col("c_path")) & (F.col("enclosing_class") == F.col("c_name")))
    over = over.join(methods, (F.col("a_path") == F.col("s_path")) & (F.col("ancestor") == F.col("s_class")) & (F.col("name") == F.col("s_name")))
    above = over.groupBy(*key).agg(F.min(F.struct("order", "id")).alias("near")).select(*key, F.lit(1).alias("tier"), F.col("near.id").alias("id"))
    modules = imports.filter("target is not null").select(F.col("path").alias("m_path"), F.substring_index("specifier", ".", -1).alias("alias"), "target").distinct()
    dotted = asked.filter("shape = 'qualified'").join(modules, (F.col("path") == F.col("m_path")) & (F.col("receiver") == F.col("alias"))).join(tops, (F.col("target") == F.col("s_path")) & (F.col("name") == F.col("s_name"))).select(*key, F.lit(0).alias("tier"), "id")
    hits = same.union(via).union(anywhere).union(mine).union(above).union(dotted).distinct()
    # The answer needs the first tier and at most nine of its hits, not all.
    by_tier = hits.groupBy(*key, "tier").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = by_tier.groupBy(*key).agg(F.min(F.struct("tier", "n", "id")).alias("b")).select(*[F.col(k).alias(f"b_{k}") for k in key], "b.*")
    joined = asked.join(best, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in key], "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 1, "resolved").when((n > 1) & (n <= MOST_CANDIDATES), "candidate").otherwise("unresolved")
    return joined.select("path", "start_line", "shape", "receiver", "name", n.alias("targets"), F.when(n == 1, F.col("id")).alias("target"), state.alias("state"))


def inherits(symbols: DataFrame) -> DataFrame:
    """Class to base, where one class of the base's last name is known."""
    classes = symbols.filter("kind = 'class'")
    asked = classes.select(F.concat_ws("#", "path", "qualified_name").alias("src"), F.explode("bases").alias("base"))
    known = classes.groupBy(F.col("name").alias("b_name")).agg(F.count("*").alias("n"), F.min(F.concat_ws("#", "path", "qualified_name")).alias("dst"))
    joined = asked.join(known, F.substring_index("base", ".", -1) == F.col("b_name"), "left")
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "candidate").otherwise("external")
    return joined.select("src", "base", F.when(F.col("n") == 1, F.col("dst")).alias("dst"), state.alias("state"))


#: What a TypeScript specifier may stand for, best first.
SUFFIXES = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..``; null where it would leave the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok")),
        lambda a, p: F.when((p == "..") & (F.size(a.kept) == 0), F.struct(a.kept.alias("kept"), F.lit(False).alias("ok")))
        .when(p == "..", F.struct(F.slice(a.kept, 1, F.size(a.kept) - 1).alias("kept"), a.ok.alias("ok")))
        .otherwise(F.struct(F.concat(a.kept, F.array(p)).alias("kept"), a.ok.alias("ok"))),
    )
    return F.when(up.ok, F.array_join(up.kept, "/"))


def ts_targets(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``path``, ``start_line``, ``specifier``, ``target`` of TypeScript imports.

    Relative specifiers start at their file; others go through the aliases
    (``scope``, ``pattern``, ``target``) of the innermost directory around the file.
    ``.js`` also stands for ``.ts``. Each stem is tried with every suffix, in order.
    """
    key = ["path", "start_line", "specifier"]
    relative = F.col("specifier").startswith(".")
    near = imports.filter(relative).select(*key, F.lit(0).alias("way"), normal_path(F.concat(module_of(F.col("path")), F.lit("/"), F.col("specifier"))).alias("stem"))
    star = F.instr("pattern", "*") > 0
    head = F.substring_index("pattern", "*", 1)
    # Aliases are a few rows of configuration, so the theta join is with a dimension.
    inside = (F.col("scope") == "") | F.col("path").startswith(F.concat("scope", F.lit("/")))
    fits = F.when(star, F.col("specifier").startswith(head)).otherwise(F.col("specifier") == F.col("pattern"))
    rest = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1)")
    written = F.when(star, F.replace("target", F.lit("*"), rest)).otherwise(F.col("target"))
    far = imports.filter(~relative).join(F.broadcast(aliases), inside & fits).select(*key, (-F.length("scope") * 1000 - F.length("pattern")).alias("way"), normal_path(written).alias("stem"))
    bare = F.regexp_replace("stem", r"\.(m|c)?jsx?$", "")
    ends = F.array(*[F.struct(F.lit(i).alias("n"), F.concat(F.when(F.lit(i < 5), bare).otherwise(F.col("stem")), F.lit(s)).alias("file")) for i, s in enumerate(SUFFIXES)])
    tried = near.unionByName(far).filter("stem is not null").select(*key, "way", F.explode(ends).alias("c"))
    hits = tried.join(files.select(F.col("path").alias("known")), F.col("c.file") == F.col("known"), "left_semi")
    best = hits.groupBy(*key).agg(F.min(F.struct("way", "c.n", "c.file")).alias("b")).select(*[F.col(k).alias(f"b_{k}") for k in key], F.col("b.file").alias("target"))
    return imports.select(*key).join(best, [F.col(k) == F.col(f"b_{k}") for k in key], "left").select(*key, "target")


def package_targets(imports: DataFrame, packages: DataFrame, separator: str = r"\.") -> DataFrame:
    """All files of the package that each import names, for languages whose imports
    name packages and not files. ``packages``: package, path. The longest known prefix
    of the specifier is the package; a type named after it narrows the files to those
    called like it, where there are such."""
    key = ["path", "start_line", "specifier"]
    mark = "." if separator == r"\." else separator
    parts = F.split(F.regexp_replace("specifier", r"[.]\*$", ""), separator)
    tries = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), mark).alias("package"), F.get(parts, n).alias("type")))
    spread = imports.select(*key, F.posexplode(tries).alias("place", "t")).select(*key, "place", F.col("t.package").alias("try"), "t.type")
    known = packages.select("package").distinct()
    hits = spread.join(known, F.col("try") == F.col("package"), "left_semi")
    best = hits.groupBy(*key).agg(F.min(F.struct("place", "try", "type")).alias("b")).select(*key, F.col("b.try").alias("named"), F.col("b.type").alias("type"))
    files = packages.select(F.col("package").alias("p"), F.col("path").alias("target"))
    stem = F.regexp_replace(F.substring_index("target", "/", -1), r"\.[^.]*$", "")
    every = best.join(files, F.col("named") == F.col("p")).filter(F.col("target") != F.col("path")).withColumn("exact", F.coalesce(stem == F.col("type"), F.lit(False)))
    some = every.groupBy(*[F.col(k).alias(f"s_{k}") for k in key]).agg(F.bool_or("exact").alias("narrow"))
    joined = every.join(some, [F.col(k) == F.col(f"s_{k}") for k in key])
    return joined.filter("exact or not narrow").select(*key, "target")
