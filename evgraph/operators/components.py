"""Views inside modules, of all modules at once: files and their flow, symbols and their
calls, and the cards that sum a repository up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.derive import View
from evgraph.schema import module_of, path_of


def flow(files: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("imports", "calls", "inherits", "references")) -> View:
    """Components of every module with two files or more (``files``: path), and edges
    between files of one module with their ``weight``, the distinct citations of what
    leads from one to the other. ``edges``: src, dst, kind, file, start_line, end_line."""
    placed = files.select("path", module_of(F.col("path")).alias("module")).distinct()
    large = placed.groupBy(F.col("module").alias("m")).agg(F.count("*").alias("n")).filter("n > 1").select("m")
    inside = placed.join(large, F.col("module") == F.col("m"), "left_semi")
    a, b = inside.toDF("a_path", "a_module"), inside.toDF("b_path", "b_module")
    told = edges.filter(F.col("kind").isin(*kinds)).select(path_of(F.col("src")).alias("from"), path_of(F.col("dst")).alias("to"), "file", "start_line", "end_line").filter("from <> to")
    both = told.join(a, F.col("from") == F.col("a_path")).join(b, (F.col("to") == F.col("b_path")) & (F.col("a_module") == F.col("b_module")))
    weights = both.groupBy(F.col("a_module").alias("module"), F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.count_distinct("file", "start_line", "end_line").alias("weight"))
    label = F.substring_index("path", "/", -1)
    return View(inside.select("module", F.col("path").alias("id"), label.alias("label")), weights)


def code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("calls", "inherits", "references")) -> View:
    """Symbols of every file that defines two or more, and edges between symbols of one
    file with their ``weight``."""
    symbols = nodes.filter(F.instr("id", "#") > 0).select("id", path_of(F.col("id")).alias("path"), "kind", "label")
    large = symbols.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n")).filter("n > 1").select("p")
    inside = symbols.join(large, F.col("path") == F.col("p"), "left_semi")
    own = edges.filter(F.col("kind").isin(*kinds) & (path_of(F.col("src")) == path_of(F.col("dst"))) & (F.col("src") != F.col("dst")))
    ids = inside.select(F.col("id").alias("i"))
    own = own.join(ids, F.col("src") == F.col("i"), "left_semi").join(ids, F.col("dst") == F.col("i"), "left_semi")
    weights = own.groupBy(path_of(F.col("src")).alias("path"), "src", "dst").agg(F.count_distinct("file", "start_line", "end_line").alias("weight"))
    return View(inside, weights)


def cards(routes: DataFrame, entrypoints: DataFrame, externals: DataFrame, nodes: DataFrame, references: DataFrame, shown: int = 3) -> DataFrame:
    """``card``, ``item``, ``n``: entry points (modules with their first routes, and declared
    ones), data stores, cloud services, and what stayed unresolved.

    ``routes``: method, route, path; ``entrypoints``: name, target, lang; ``externals``:
    category, label, package; ``nodes``: kind, label; ``references``: kind, resolution. A
    module's routes are ranked and cut at ``shown``, never gathered whole.
    """
    from pyspark.sql import Window

    by = routes.select(module_of(F.col("path")).alias("module"), F.concat_ws(" ", "method", "route").alias("said"))
    counts = by.groupBy("module").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("module").orderBy("said"))
    first = by.distinct().withColumn("nth", nth)
    some = first.filter(F.col("nth") <= shown).groupBy(F.col("module").alias("f")).agg(F.array_join(F.array_sort(F.collect_list("said")), ", ").alias("some"))
    more = first.groupBy(F.col("module").alias("g")).agg((F.max("nth") > shown).alias("more"))
    name = F.when(F.col("module") == "", "(repo root)").otherwise(F.col("module"))
    item = F.concat(name, F.lit(": "), F.col("n").cast("string"), F.when(F.col("n") == 1, " route").otherwise(" routes"), F.lit(" · "), "some", F.when(F.col("more"), " …").otherwise(""))
    entry = counts.join(some, F.col("module") == F.col("f")).join(more, F.col("module") == F.col("g")).select(F.lit("Entry points").alias("card"), item.alias("item"), "n")
    one = F.lit(1).cast("long").alias("n")
    declared = entrypoints.select(F.lit("Entry points").alias("card"), F.concat("name", F.lit(" → "), "target", F.lit(" ("), "lang", F.lit(")")).alias("item"), one)
    via = lambda of, card: externals.filter(F.col("category").isin(*of)).groupBy(F.concat("label", F.lit(" via "), "package").alias("item")).agg(F.count("*").alias("n")).select(F.lit(card).alias("card"), "item", "n")
    composed = nodes.filter("kind in ('datastore', 'queue')").select(F.lit("Data stores").alias("card"), F.concat("label", F.lit(" (compose)")).alias("item"), one)
    open_ends = references.filter("resolution = 'unresolved'").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("Unresolved").alias("card"), F.concat("kind", F.lit(": "), F.col("n").cast("string"), F.lit(" unresolved")).alias("item"), "n")
    out = entry
    for part in (declared, via(("database", "messagebus"), "Data stores"), composed, via(("cloud",), "Cloud services"), open_ends):
        out = out.unionByName(part)
    return out
