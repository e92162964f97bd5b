"""Design styles: which part a module plays, and imports that go the wrong way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.operators.styles import IO_SIGNALS, NEUTRAL
from evgraph.schema import module_of


def assign(modules: DataFrame, module: str, parts: DataFrame) -> DataFrame:
    """The part each module plays in each style: a name in its last directory counts
    3, in an inner one 2; the best score wins, then the part of least rank.

    ``parts``: style, part, rank, name. Segments become rows, so this is an equi
    join with a small dimension and an aggregation.
    """
    segments = F.split(F.col(module), "/")
    spread = modules.select(module, F.size(segments).alias("n"), F.posexplode(segments).alias("place", "segment"))
    hits = spread.join(F.broadcast(parts), F.lower("segment") == F.col("name"))
    score = F.when(F.col("place") == F.col("n") - 1, 3).otherwise(2)
    best = F.max(F.struct(score.alias("score"), (-F.col("rank")).alias("rank"), F.col("part"))).alias("best")
    return hits.groupBy(module, "style").agg(best).select(module, "style", "best.part", "best.score")


def forbidden_pairs(orders: DataFrame) -> DataFrame:
    """From an order top to bottom (``style``, ``parts``): lower parts may not import
    higher ones. A self join of the places."""
    places = orders.select("style", F.posexplode("parts").alias("place", "part"))
    a, b = places.toDF("style", "hi_place", "hi"), places.toDF("low_style", "low_place", "low")
    return a.join(b, (F.col("style") == F.col("low_style")) & (F.col("low_place") > F.col("hi_place"))).select("style", F.col("low").alias("from"), F.col("hi").alias("to"))


def wrong_way(deps: DataFrame, assigned: DataFrame, module: str, forbidden: DataFrame) -> DataFrame:
    """Dependencies (``src``, ``dst``) whose parts are a forbidden pair."""
    a = assigned.select(F.col(module).alias("src"), "style", F.col("part").alias("from"))
    b = assigned.select(F.col(module).alias("dst"), F.col("style").alias("b_style"), F.col("part").alias("to"))
    both = deps.join(a, "src").join(b, "dst").filter("style = b_style").drop("b_style")
    return both.join(F.broadcast(forbidden), ["style", "from", "to"], "left_semi")


def fit(assigned: DataFrame, deps: DataFrame, module: str, total: Column, forbidden: DataFrame) -> DataFrame:
    """Per style: the share of modules that play a part, the share of dependencies
    between parts that go the right way, and their product."""
    cover = assigned.groupBy("style").agg((F.count("*") / total).alias("coverage"))
    a = assigned.select(F.col(module).alias("src"), "style", F.col("part").alias("from"))
    b = assigned.select(F.col(module).alias("dst"), F.col("style").alias("b_style"), F.col("part").alias("to"))
    judged = deps.join(a, "src").join(b, "dst").filter("style = b_style and `from` <> `to`")
    bad = F.broadcast(forbidden.withColumn("bad", F.lit(True)))
    rated = judged.join(bad, ["style", "from", "to"], "left").groupBy("style").agg((1 - F.count("bad") / F.count("*")).alias("compliance"))
    whole = cover.join(rated, "style", "left").withColumn("compliance", F.coalesce("compliance", F.lit(1.0)))
    return whole.select("style", F.bround("coverage", 4).alias("coverage"), F.bround("compliance", 4).alias("compliance"), F.bround(F.col("coverage") * F.col("compliance"), 4).alias("fit"))


def _neutral(modules: DataFrame, parts: DataFrame) -> DataFrame:
    """``unit``, ``module``, ``style`` of modules that a style does not judge: the root of
    a unit, and directories every style has unless one of its parts is called so."""
    styles = parts.select("style").distinct()
    last = modules.select("unit", "module", F.try_element_at("segments", F.lit(-1)).alias("last"), (F.size("segments") == 0).alias("root"))
    plain = last.filter(F.col("root") | F.col("last").isin(*NEUTRAL)).join(F.broadcast(styles))
    named = F.broadcast(parts.select(F.col("style").alias("n_style"), F.explode("names").alias("name")).distinct())
    return plain.join(named, ~F.col("root") & (F.col("style") == F.col("n_style")) & (F.col("last") == F.col("name")), "left_anti").select("unit", "module", "style")


def placed(modules: DataFrame, parts: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """``unit``, ``module``, ``style``, ``part``, ``rank``, ``score``, ``slice``, ``by_name`` of
    modules (``unit``, ``module``; a unit is a directory or the root) in each style.

    The last directory's name counts 3, an inner one or evidence (``signals``: module,
    signal) 2; the best score wins, then the part of least rank. ``parts`` is the fixed
    dimension of ``styles.parts``; its names meet the segments in an equi join.
    """
    inner = F.when(F.col("unit") == "", F.col("module")).otherwise(F.expr("substring(module, length(unit) + 2)"))
    segments = F.filter(F.split(F.lower(inner), "/"), lambda s: s != "")
    modules = modules.select("unit", "module", segments.alias("segments"))
    names = F.broadcast(parts.select("style", "part", "rank", "sliced", F.explode("names").alias("name")))
    spread = modules.select("unit", "module", "segments", F.posexplode("segments").alias("place", "segment"))
    hits = spread.join(names, F.col("segment") == F.col("name")).groupBy("unit", "module", "segments", "style", "part", "rank", "sliced").agg(F.max("place").alias("at"))
    score = F.when(F.col("at") == F.size("segments") - 1, 3).otherwise(2)
    inside = F.when(F.col("sliced"), F.get("segments", F.col("at") + 1))
    found = hits.select("unit", "module", "style", "part", "rank", score.alias("score"), inside.alias("slice"), F.lit(True).alias("by_name"))
    if signals is not None:
        shown = F.broadcast(parts.select("style", "part", "rank", F.explode("evidence").alias("proof")))
        proven = modules.join(signals.select(F.col("module").alias("m"), "signal").distinct(), F.col("module") == F.col("m")).join(shown, F.col("signal") == F.col("proof"))
        proven = proven.select("unit", "module", "style", "part", "rank", F.lit(2).alias("score"), F.lit(None).cast("string").alias("slice"), F.lit(False).alias("by_name")).distinct()
        found = found.unionByName(proven)
    order = F.struct("score", -F.col("rank"), "by_name")
    best = found.groupBy("unit", "module", "style").agg(F.max_by(F.struct("part", "rank", "score", "slice", "by_name"), order).alias("b"))
    skip = _neutral(modules, parts).toDF("k_unit", "k_module", "k_style")
    kept = best.join(skip, (F.col("unit") == F.col("k_unit")) & (F.col("module") == F.col("k_module")) & (F.col("style") == F.col("k_style")), "left_anti")
    return kept.select("unit", "module", "style", "b.*")


def judged(deps: DataFrame, assigned: DataFrame, parts: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``unit``, ``style``, ``src``, ``dst``, ``rule`` of the dependencies between placed
    modules of a unit; ``rule`` is null where nothing is wrong: layer-direction before
    part-independence before public-entry."""
    rules = parts.select("style", "part", "independent", "public_entry")
    a = assigned.join(F.broadcast(rules), ["style", "part"]).select("unit", "style", F.col("module").alias("src"), F.col("part").alias("from"), F.col("slice").alias("from_slice"), "independent")
    b = assigned.join(F.broadcast(rules), ["style", "part"]).select(F.col("unit").alias("b_unit"), F.col("style").alias("b_style"), F.col("module").alias("dst"), F.col("part").alias("to"), F.col("slice").alias("to_slice"), "public_entry")
    pairs = deps.filter("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("unit = b_unit and style = b_style")
    bad = F.broadcast(forbidden.select(F.col("style").alias("f_style"), F.col("from").alias("f_from"), F.col("to").alias("f_to"), F.lit(True).alias("bad")))
    pairs = pairs.join(bad, (F.col("style") == F.col("f_style")) & (F.col("from") == F.col("f_from")) & (F.col("to") == F.col("f_to")), "left")
    apart = (F.col("from") == F.col("to")) & F.col("independent") & (F.col("from_slice") != F.col("to_slice"))
    parts_of = F.split("dst", "/")
    root = F.array_join(F.slice(parts_of, 1, F.greatest(F.array_position(F.transform(parts_of, F.lower), F.col("to_slice")).cast("int"), F.lit(1))), "/")
    foreign = (F.col("from") != F.col("to")) | ~F.col("from_slice").eqNullSafe(F.col("to_slice"))
    entered = F.col("public_entry") & F.col("to_slice").isNotNull() & foreign & (F.col("dst") != root)
    rule = F.when(F.col("bad"), "layer-direction").when(apart, "part-independence").when(entered, "public-entry")
    return pairs.select("unit", "style", "src", "dst", rule.alias("rule"))


def impure(assigned: DataFrame, parts: DataFrame, signals: DataFrame) -> DataFrame:
    """``unit``, ``style``, ``src``, ``rule`` of modules in pure parts with signals of input
    or output."""
    pure = F.broadcast(parts.filter("pure").select("style", "part"))
    io = signals.filter(F.col("signal").isin(*IO_SIGNALS)).select(F.col("module").alias("m")).distinct()
    found = assigned.join(pure, ["style", "part"], "left_semi").join(io, F.col("module") == F.col("m"), "left_semi")
    return found.select("unit", "style", F.col("module").alias("src"), F.lit("core-purity").alias("rule"))


def fits(modules: DataFrame, assigned: DataFrame, checked: DataFrame, breaches: DataFrame | None, parts: DataFrame) -> DataFrame:
    """``unit``, ``style``, ``coverage``, ``compliance``, ``fit``: the share of judged modules
    that play a part (by evidence alone: half), the share of dependencies and pure
    modules without a breach, and their product. A style of which fewer than two parts
    are named in the code covers nothing."""
    names = assigned.groupBy("unit", "style").agg(
        F.sum(F.when(F.col("by_name"), 1.0).otherwise(0.5)).alias("weight"), F.count_distinct(F.when(F.col("by_name"), F.col("part"))).alias("filled"), F.count("*").alias("n")
    )
    segments = F.filter(F.split(F.lower(F.when(F.col("unit") == "", F.col("module")).otherwise(F.expr("substring(module, length(unit) + 2)"))), "/"), lambda s: s != "")
    skipped = _neutral(modules.select("unit", "module", segments.alias("segments")), parts).groupBy("unit", "style").agg(F.count("*").alias("neutral")).toDF("s_unit", "s_style", "neutral")
    total = modules.groupBy(F.col("unit").alias("t_unit")).agg(F.count("*").alias("total"))
    whole = names.join(total, F.col("unit") == F.col("t_unit")).join(skipped, (F.col("unit") == F.col("s_unit")) & (F.col("style") == F.col("s_style")), "left")
    scored = F.col("total") - F.coalesce("neutral", F.lit(0))
    covered = F.when((F.col("filled") >= 2) & (scored > 0), F.col("weight") / scored).otherwise(F.lit(0.0))
    told = checked.select("unit", "style", "rule")
    if breaches is not None:
        told = told.unionByName(breaches.select("unit", "style", "rule"))
    kept = told.groupBy(F.col("unit").alias("k_unit"), F.col("style").alias("k_style")).agg((1 - F.count("rule") / F.count("*")).alias("kept"))
    out = whole.join(kept, (F.col("unit") == F.col("k_unit")) & (F.col("style") == F.col("k_style")), "left")
    compliance = F.coalesce("kept", F.lit(1.0))
    return out.select("unit", "style", covered.alias("coverage"), compliance.alias("compliance"), (covered * compliance).alias("fit"))


def units(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``unit``, ``module``: each module's nearest directory above with a manifest
    (``files``: path, config_kind), the root where there is none."""
    from evgraph.operators.joins import first_candidate, prefixes

    known = files.filter(F.col("config_kind").startswith("manifest-")).select(module_of(F.col("path")).alias("dir")).distinct()
    near = first_candidate(modules, ["module"], prefixes(F.col("module")), known, "dir").select(F.col("module").alias("m"), F.col("candidate").alias("unit"))
    return modules.join(near, F.col("module") == F.col("m"), "left").select(F.coalesce("unit", F.lit("")).alias("unit"), "module")


def signals(routes: DataFrame, externals: DataFrame) -> DataFrame:
    """``module``, ``signal``: what the routes (file) and external packages (file,
    category) of a module prove."""
    category = F.col("category")
    named = F.when(category == "database", "datastore").when(category == "frontend", "ui").when(category.isin("messagebus", "cloud"), category)
    proven = externals.select(module_of(F.col("file")).alias("module"), named.alias("signal")).filter("signal is not null")
    return routes.select(module_of(F.col("file")).alias("module"), F.lit("routes").alias("signal")).unionByName(proven).distinct()
