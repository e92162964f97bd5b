"""Building a graph from facts: evidence checks, merging, modules, scorecards.

Facts come one citation per row, so nothing here collects a group: evidence stays
a table (``sites``), and edges carry counts and reduced columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.schema import resolution_name, resolution_rank
from evgraph.storage import stage

KEY = ("src", "dst", "kind")


def evidence_verdict(file_lines: Column, start: Column, end: Column) -> Column:
    """Why a citation is not valid, or null: the file must be known, lines lie in it
    in order from 1, and (0, 0) stands for an empty file only."""
    return (
        F.when(file_lines.isNull(), "unknown-file")
        .when((start == 0) & (end == 0), F.when(file_lines == 0, F.lit(None)).otherwise("zero-range"))
        .when((start < 1) | (end < start), "bad-range")
        .when(end > file_lines, "past-end")
    )


def verify_evidence(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with ``reason`` (null where valid). ``sites``: file, start_line,
    end_line and others; ``files``: file, line_count. An equi join on the file."""
    known = files.select(F.col("file").alias("known_file"), F.col("line_count").cast("long").alias("known_lines"))
    joined = sites.join(known, F.col("file") == F.col("known_file"), "left")
    return joined.withColumn("reason", evidence_verdict(F.col("known_lines"), F.col("start_line"), F.col("end_line"))).drop(
        "known_file", "known_lines"
    )


def supported(elements: DataFrame, key: list[str]) -> DataFrame:
    """Keys all of whose citations are valid: evidence fails closed."""
    return elements.groupBy(*key).agg(F.bool_and(F.col("reason").isNull()).alias("ok")).filter("ok").drop("ok")


def merge_edges(facts: DataFrame) -> DataFrame:
    """One row per (src, dst, kind) from facts with ``file``, ``start_line``,
    ``end_line``, ``resolution``, ``arity``, ``type_only`` and ``producer``.

    The least confident resolution wins, with the least producer among its facts;
    arity is the largest; an edge is type-only if all facts are. ``sites`` counts
    distinct citations. Candidates with fewer than two are ``dropped``; mixed
    resolutions are ``mixed``. Partial aggregation bears hot edges.
    """
    rank = resolution_rank(F.col("resolution"))
    # Producers are a few names. As numbers in order they stay in hash aggregations, which
    # can't hold a least string.
    names = facts.select("producer").distinct()
    order = F.row_number().over(Window.orderBy(F.col("producer").asc_nulls_first()))
    names = stage(names.select(F.col("producer").alias("p"), order.cast("long").alias("code")), "producers")
    coded = facts.withColumn("rank", rank).join(names, F.col("producer").eqNullSafe(F.col("p")))
    merged = coded.groupBy(*KEY).agg(
        F.count("*").alias("facts"),
        F.count_distinct("file", "start_line", "end_line").alias("sites"),
        F.min(F.shiftleft(F.col("rank").cast("long"), 32) + F.col("code")).alias("base"),
        F.max("rank").alias("top"),
        F.max("arity").alias("arity"),
        F.bool_and("type_only").alias("type_only"),
    )
    low = F.shiftright("base", 32).cast("int")
    named = merged.withColumn("low", low).join(names.select("code", F.col("p").alias("producer")), F.col("base").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("code"))
    return named.select(
        *KEY,
        "facts",
        "sites",
        resolution_name(F.col("low")).alias("resolution"),
        "producer",
        "arity",
        "type_only",
        (F.col("low") != F.col("top")).alias("mixed"),
        ((resolution_name(F.col("low")) == "candidate") & (F.col("facts") > 1) & (F.col("sites") < 2)).alias("dropped"),
    )


def dangling(edges: DataFrame, nodes: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges an end of which is no node, with the ``end`` that is missing."""
    missing = [edges.join(nodes.select(F.col("id").alias("node_id")), F.col(e) == F.col("node_id"), "left_anti").withColumn("end", F.lit(e)) for e in ends]
    out = missing[0]
    for more in missing[1:]:
        out = out.unionByName(more)
    return out


def eligible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes: two semi joins."""
    ids = nodes.select(F.col("id").alias("node_id"))
    return edges.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")


def dedup_nodes(nodes: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """The first node of each id by ``order``; ``conflict`` if others differ."""
    same = F.xxhash64(*columns)
    first = F.min_by(F.struct(*columns), order).alias("first")
    return nodes.groupBy("id").agg(first, F.count("*").alias("copies"), (F.min(same) != F.max(same)).alias("conflict")).select(
        "id", *[F.col(f"first.{c}").alias(c) for c in columns], "copies", "conflict"
    )


def collisions(names: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that stand for more than one distinct name, with least and greatest."""
    return (
        names.groupBy(key.alias("key"))
        .agg(F.count_distinct(name).alias("names"), F.min(name).alias("first"), F.max(name).alias("last"))
        .filter("names > 1")
    )


def modules(files: DataFrame, module: Column) -> DataFrame:
    return files.groupBy(module.alias("module")).agg(F.count("*").alias("file_count"))


def module_deps(edges: DataFrame, src: Column, dst: Column) -> DataFrame:
    """Distinct pairs of different modules."""
    return edges.select(src.alias("src_module"), dst.alias("dst_module")).filter("src_module <> dst_module").distinct()


def module_records(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """``module``, ``deps``: every module with what it depends on, sorted. Modules depend
    on few others; a list is as long as a module's own imports."""
    lists = deps.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("list"))
    return modules.select("module").join(lists, F.col("module") == F.col("src"), "left").select("module", F.coalesce("list", F.lit("")).alias("deps"))


def runtime_edges(facts: DataFrame, keep: Column, site: Column) -> DataFrame:
    """Weight of a pair: its distinct sites among the facts that count at run time."""
    return facts.filter(keep).groupBy("src", "dst").agg(F.count_distinct(site).alias("weight"))


#: Buckets into which edges are counted, and what makes one hot: so many facts and so many
#: times the mean.
BUCKETS, HOT_FACTS, HOT_TIMES = 1 << 16, 1_000_000, 8


def _ruled(held: DataFrame) -> DataFrame:
    """``attrs`` of edges (KEY, facts, sites, held: their values by name) by the rules."""
    sites = F.create_map(F.lit("sites"), F.col("sites").cast("string"))
    rest = F.map_filter("held", lambda k, v: k != "sites")
    return held.select(*KEY, F.when(F.col("facts") == 1, F.col("held")).otherwise(F.map_concat(rest, sites)).alias("attrs"))


def _merged_at_once(facts: DataFrame) -> DataFrame:
    """Edges of few facts each: what they say is brought together by one exchange."""
    entries = F.coalesce(F.map_entries("attrs"), F.array().cast("array<struct<key:string,value:string>>")).alias("entries")
    dealt = facts.select(*KEY, "fact", "file", "start_line", "end_line", entries).repartition(*KEY)
    runs = F.exists("entries", lambda e: (e.key == "type_only") & (e.value == "true"))
    lists = dealt.groupBy(*KEY).agg(
        F.size(F.collect_set("fact")).cast("long").alias("facts"), F.size(F.collect_set(F.struct("file", "start_line", "end_line"))).cast("long").alias("sites"),
        F.size(F.collect_set(F.when(runs, F.col("fact")))).cast("long").alias("true"), F.array_distinct(F.flatten(F.collect_set("entries"))).alias("said"),
    )
    names = F.array_sort(F.array_distinct(F.transform("said", lambda e: e.key)))
    kept = F.filter(names, lambda k: (k != "type_only") | (F.col("facts") == 1) | (F.col("true") == F.col("facts")))
    values = lambda k: F.transform(F.filter("said", lambda e: (e.key == k) & e.value.isNotNull()), lambda e: e.value)
    value = lambda k: F.array_join(F.array_sort(values(k)), ",")
    return _ruled(lists.select(*KEY, "facts", "sites", F.map_from_entries(F.transform(kept, lambda k: F.struct(k, value(k)))).alias("held")))


def _merged_in_parts(facts: DataFrame, cited: DataFrame) -> DataFrame:
    """Edges of any number of facts: values are reduced by edge and name before any list."""
    sizes = facts.groupBy(*KEY).agg(F.count_distinct("fact").alias("facts")).join(cited.groupBy(*KEY).agg(F.count("*").alias("sites")), list(KEY))
    said = facts.select(*KEY, "fact", F.explode("attrs").alias("name", "value")).distinct()
    each = said.groupBy(*KEY, "name").agg(F.count_distinct(F.when(F.col("value") == "true", F.col("fact"))).alias("true"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value"))
    ruled = each.join(sizes, list(KEY)).filter((F.col("name") != "type_only") | (F.col("facts") == 1) | (F.col("true") == F.col("facts")))
    lists = ruled.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("held"))
    return _ruled(sizes.join(lists, list(KEY), "left").select(*KEY, "facts", "sites", F.coalesce("held", F.create_map().cast("map<string,string>")).alias("held")))


def merge_attributes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What facts (``src``, ``dst``, ``kind``, ``fact`` (its number), ``attrs`` (a map)) say of each
    edge, and their citations (``file``, ``start_line``, ``end_line``; a row each).

    One fact's attributes stay as they are. Of several, a value that all who name it share
    stays, different ones are joined in order, and ``type_only`` holds only if every fact
    says so: one that runs makes the edge run. ``sites`` then counts citations. Edges are
    counted in ``BUCKETS``: facts of those in hot ones are reduced in parts, and the others,
    of which none has many, pass one exchange. The second table has the
    distinct citations with their place (``nth`` from 1) in canonical order.
    """
    cited = facts.select(*KEY, "file", "start_line", "end_line").distinct()
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
    counts = facts.groupBy(bucket.alias("hot")).agg(F.count("*").alias("n"))
    hot = stage(counts.filter(F.col("n") >= HOT_FACTS).crossJoin(counts.agg(F.sum("n").alias("all"))).filter(F.col("n") * BUCKETS >= F.col("all") * HOT_TIMES).select("hot"), "hot-edges")
    if hot.isEmpty():
        merged = _merged_at_once(facts)
    else:
        few, many = (facts.join(F.broadcast(hot), bucket == F.col("hot"), how) for how in ("left_anti", "left_semi"))
        merged = _merged_at_once(few).union(_merged_in_parts(many, many.select(*KEY, "file", "start_line", "end_line").distinct()))
    order = Window.partitionBy(*KEY).orderBy(F.col("start_line") == 0, "file", "start_line", "end_line")
    return merged, cited.withColumn("nth", F.row_number().over(order))


def weighted_pairs(edges: DataFrame, weight: Column) -> DataFrame:
    """Undirected pairs with summed weights; loops fall away."""
    return (
        edges.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum(weight).alias("weight"))
    )


def scorecard(facts: DataFrame, group: list[str]) -> DataFrame:
    """Counts by resolution and the pinned share: external facts don't count."""
    n = lambda r: F.count_if(F.col("resolution") == r).alias(r)
    counted = facts.groupBy(*group).agg(n("resolved"), n("candidate"), n("external"), n("unresolved"))
    pinned, judged = F.col("resolved") + F.col("candidate"), F.col("resolved") + F.col("candidate") + F.col("unresolved")
    return counted.withColumn("pinned_pct", F.when(judged > 0, F.bround(pinned * 100.0 / judged, 6)).otherwise(F.lit(0.0)))


def path_collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that become one by normal form (``nfc``), and those that then become one
    by case (``case``) and weren't told already: ``reason``, ``key``, ``paths``."""
    from evgraph.functions.text import folded, nfc_path

    keyed = paths.select(F.col(path).alias("raw")).distinct().select("raw", nfc_path("raw").alias("nfc")).withColumn("case", folded("nfc"))
    by_form = keyed.groupBy("nfc").agg(F.count("*").alias("paths")).filter("paths > 1")
    told = by_form.select(F.col("nfc").alias("t"))
    rest = keyed.join(told, F.col("nfc") == F.col("t"), "left_anti")
    by_case = rest.groupBy("case").agg(F.count("*").alias("paths")).filter("paths > 1")
    return by_form.select(F.lit("nfc").alias("reason"), F.col("nfc").alias("key"), "paths").unionByName(by_case.select(F.lit("case").alias("reason"), F.col("case").alias("key"), "paths"))


def module_roles(facts: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """``module``, ``role`` from tables of facts by role (routes say api, tasks say
    worker, ...): a union and a distinct, so no list of facts is gathered."""
    from evgraph.schema import module_of

    out = None
    for role, table in facts.items():
        part = table.select(module_of(F.col(path)).alias("module"), F.lit(role).alias("role"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
