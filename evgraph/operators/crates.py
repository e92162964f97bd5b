"""Rust paths: a tree of modules for each crate root, and what ``use`` paths name in it."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.storage import counted, stage

#: Crates that come with the language.
STANDARD = ("std", "core", "alloc", "proc_macro", "test")


def packages(files: DataFrame) -> DataFrame:
    """``crate``, ``dir`` of every package among ``files`` (path, text); of one name the
    first directory. Manifests that can't be read name none."""

    def names(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    name = tomllib.loads(text or "").get("package", {}).get("name")
                except tomllib.TOMLDecodeError:
                    continue
                if isinstance(name, str):
                    rows.append((name.replace("-", "_"), path.rpartition("/")[0]))
            yield pd.DataFrame(rows, columns=["crate", "dir"])

    found = files.filter(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("path", "text").mapInPandas(names, "crate string, dir string")
    return found.groupBy("crate").agg(F.min("dir").alias("dir"))


def places(files: DataFrame, crates: DataFrame) -> DataFrame:
    """``path``, ``tree``, ``module`` of Rust files (path): the crate root they belong to, and
    the names from there. ``src`` of a known crate comes before any other ``src``; a binary
    below ``src/bin`` and a file outside of ``src`` are roots of their own."""
    parts = F.split("path", "/")
    names = files.filter(F.col("path").endswith(".rs")).select("path", parts.alias("parts")).distinct()
    at = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (F.element_at("parts", i) == "src") & (i < F.size("parts")))
    tries = names.select("path", F.explode(at).alias("i"), "parts").withColumn("of", F.array_join(F.expr("slice(parts, 1, i - 1)"), "/"))
    known = crates.select(F.col("dir").alias("k")).distinct()
    first = tries.join(known, F.col("of") == F.col("k"), "left").groupBy("path").agg(F.min(F.struct(F.col("k").isNull().alias("guess"), F.col("i"))).alias("b"))
    placed = names.join(first.select(F.col("path").alias("p"), F.col("b.i").alias("i")), F.col("path") == F.col("p"), "left").drop("p")
    base = F.array_join(F.expr("slice(parts, 1, i)"), "/")
    rest = F.expr("slice(parts, i + 1, size(parts))")
    own = placed.withColumn("base", base).withColumn("rest", rest).withColumn("bin", F.col("i").isNotNull() & (F.element_at("rest", 1) == "bin") & (F.size("rest") > 1))
    bare = lambda c: F.regexp_replace(c, r"\.rs$", "")
    left = F.when(F.col("bin"), F.expr("slice(rest, 3, size(rest))")).otherwise(F.col("rest"))
    named = F.transform(left, bare)
    root = (F.try_element_at(named, F.lit(-1)) == "mod") | ((F.size(named) == 1) & F.element_at(named, 1).isin("lib", "main"))
    module = F.when(F.size(named) == 0, named).when(root, F.expr("slice(named, 1, size(named) - 1)")).otherwise(F.col("named"))
    tree = F.when(F.col("i").isNull(), F.col("path")).when(F.col("bin"), F.concat(F.col("base"), F.lit("/bin/"), bare(F.element_at("rest", 2)))).otherwise(F.col("base"))
    alone = F.col("i").isNull()
    return own.withColumn("named", named).select("path", tree.alias("tree"), F.when(alone, F.array().cast("array<string>")).otherwise(module).alias("module"))


def _targets(asked: DataFrame, placed: DataFrame, crates: DataFrame, declared: DataFrame) -> DataFrame:
    """``ask``, ``target``: the file that a path names. ``asked``: ask, path, parts, inline
    (names of the inline modules it stands in), star; ``declared``: file, name.

    ``crate`` begins at the root, ``self`` in the module, each ``super`` one further up, a
    crate's name at the root of its library, and another name at a module below. All but
    the last part must be modules; the last is one or, but for a star, an item that the
    module declares.
    """
    here = placed.select(F.col("path").alias("h"), "tree", "module")
    rows = asked.join(here, F.col("path") == F.col("h")).withColumn("base", F.concat("module", "inline"))
    lead = F.when(F.element_at("parts", 1) == "self", F.expr("slice(parts, 2, size(parts))")).otherwise(F.col("parts"))
    ups = F.expr("size(filter(lead, (x, i) -> forall(slice(lead, 1, i + 1), y -> y = 'super')))")
    rows = rows.withColumn("head", F.element_at("parts", 1)).withColumn("lead", lead).withColumn("ups", ups)
    skipped = F.when(F.col("head") == "crate", 1).otherwise(F.size("parts") - F.size("lead") + F.col("ups"))
    libs = placed.filter(F.col("path") == F.concat(F.col("tree"), F.lit("/lib.rs"))).select(F.col("tree").alias("lib"))
    known = crates.select("crate", F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit("src")).alias("c_tree"))
    known = known.join(libs, F.col("c_tree") == F.col("lib"), "left_semi")
    rows = rows.join(known, F.col("head") == F.col("crate"), "left")
    relative = F.col("head").isin("crate", "self", "super")
    entered = ~relative & F.col("c_tree").isNotNull()
    start = F.when(F.col("head") == "crate", F.array().cast("array<string>")).when(relative, F.expr("slice(base, 1, greatest(size(base) - ups, 0))")).when(entered, F.array().cast("array<string>")).otherwise(F.col("base"))
    tail = F.expr("slice(parts, skip + 1, size(parts))")
    rows = rows.withColumn("skip", F.when(relative, skipped).when(entered, 1).otherwise(0)).withColumn("start", start).withColumn("tail", tail)
    rows = rows.filter(~relative | (F.col("head") == "crate") | (F.col("ups") <= F.size("base"))).filter(~F.col("head").isin(*STANDARD) | entered)
    tried = F.when(F.col("star") | (F.size("tail") == 0), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    where = F.when(entered, F.col("c_tree")).otherwise(F.col("tree"))
    rows = rows.select("ask", "path", where.alias("in_tree"), relative.alias("relative"), (~relative & ~entered).alias("child"), "start", "tail", F.explode(tried).alias("short"))
    full = F.array_join(F.concat("start", F.expr("slice(tail, 1, size(tail) - short)")), "::")
    rows = rows.select("ask", "path", "in_tree", "relative", "child", "short", full.alias("full"), F.when(F.col("short") == 1, F.try_element_at("tail", F.lit(-1))).alias("item"))
    # The library's file stands for a root that a main file has too, but not in that file.
    rank = F.when(F.col("path").endswith("/lib.rs"), 0).otherwise(1)
    whole = placed.groupBy("tree", F.array_join("module", "::").alias("key")).agg(F.min(F.struct(rank.alias("r"), F.col("path"))).alias("f")).select(F.col("tree").alias("m_tree"), "key", F.col("f.path").alias("m_file"))
    hits = rows.join(whole, (F.col("in_tree") == F.col("m_tree")) & (F.col("full") == F.col("key")))
    main = F.col("relative") & (F.col("full") == "") & F.col("path").endswith("/src/main.rs")
    hits = hits.withColumn("file", F.when(main, F.col("path")).otherwise(F.col("m_file"))).filter(~F.col("child") | (F.col("file") != F.col("path")))
    names = declared.select(F.col("file").alias("d_file"), F.col("name").alias("d_name")).distinct()
    hits = hits.join(names, (F.col("file") == F.col("d_file")) & (F.col("item") == F.col("d_name")), "left").filter("item is null or d_name is not null")
    return hits.groupBy("ask").agg(F.min(F.struct("short", "file")).alias("b")).select("ask", F.col("b.file").alias("target"))


def asks(imports: DataFrame) -> DataFrame:
    """Imports of ``rust_facts`` as paths to look up, one row each."""
    none = F.array().cast("array<string>")
    parts = F.split("specifier", r"\.")
    item = F.try_element_at("names", F.lit(1))
    star = F.coalesce(item == "*", F.lit(False))
    whole = F.when(item.isNull() | star, parts).otherwise(F.concat(parts, F.array(item)))
    inline = F.when(F.col("detail") == "", none).otherwise(F.split("detail", r"\."))
    return imports.select(
        F.monotonically_increasing_id().alias("ask"), "path", "start_line", "end_line", F.col("specifier").alias("base"), "kind", "tag",
        whole.alias("parts"), inline.alias("inline"), star.alias("star"), F.coalesce(item, F.lit("")).alias("real"),
        F.when(item.isNull(), F.col("name")).otherwise(F.element_at("aliases", 1)).alias("alias"),
    )


def resolved(imports: DataFrame, files: DataFrame, symbols: DataFrame, crates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports with their ``target``, and what each file declares (``file``, ``name``).

    A module also declares what it exports again (``pub use``), by name or all of another
    module: rounds add names whose origin is known by now until none is new, so chains of
    any length and cycles end. Names of other packages add nothing.
    """
    placed = stage(places(files, crates), "places")
    rows = stage(asks(imports), "uses")
    declared = symbols.filter("kind <> 'method'").select(F.col("path").alias("file"), "name").distinct()
    declared, n = counted(declared, "declared")
    again = rows.filter("tag = 'pub'")
    while True:
        # A name counts by its module; whether that declares it is asked below.
        parent = again.withColumn("parts", F.when(F.col("star") | (F.size("parts") == 1), F.col("parts")).otherwise(F.expr("slice(parts, 1, size(parts) - 1)")))
        at = _targets(again, placed, crates, declared).withColumnRenamed("ask", "a")
        over = _targets(parent.withColumn("star", F.lit(True)), placed, crates, declared).withColumnRenamed("ask", "a")
        of = lambda df: again.join(df, F.col("ask") == F.col("a")).filter("target <> path and size(inline) = 0")
        names = declared.select(F.col("file").alias("d_file"), F.col("name").alias("d_name"))
        stars = of(at).filter("star").join(names, F.col("target") == F.col("d_file")).select(F.col("path").alias("file"), F.col("d_name").alias("name"))
        named = of(over).filter("not star").join(names, (F.col("target") == F.col("d_file")) & (F.col("real") == F.col("d_name")), "left_semi").select(F.col("path").alias("file"), F.col("alias").alias("name"))
        before = n
        declared, n = counted(declared.union(stars).union(named).distinct(), "declared")
        if n == before:
            break
    found = _targets(rows, placed, crates, declared).withColumnRenamed("ask", "a")
    return rows.join(found, F.col("ask") == F.col("a"), "left").drop("a"), declared
