"""Views of a graph as tables: architecture, module dependencies, flows, drill trees.

Each view is ``view_nodes`` and ``view_edges`` rows; a view that can't be made is
named as absent and costs no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators.traverse import layers
from evgraph.storage import counted, stage

#: Boxes at the top, in a stage and in a drilled component.
TOP_BOXES, STAGE_BOXES, COMPONENT_BOXES, DOMAIN_DEPTH = 12, 12, 24, 2


@dataclass
class View:
    nodes: DataFrame
    edges: DataFrame


def group_edges(deps: DataFrame, groups: DataFrame) -> DataFrame:
    """Weights between groups: ``deps`` (src, dst, weight), ``groups`` (id, grp)."""
    a, b = groups.toDF("a_id", "src_group"), groups.toDF("b_id", "dst_group")
    joined = deps.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    return joined.filter("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.sum("weight").alias("weight"), F.count("*").alias("pairs"))


def capped(nodes: DataFrame, by: list[str], degree: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` boxes of highest degree in each group, ties by id, and how many
    stay out. Ranks are computed per group; groups are stages of a view."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(degree), "id"))
    ranked = nodes.withColumn("nth", nth)
    rest = ranked.filter(F.col("nth") > most).groupBy(*by).agg(F.count("*").alias("more"))
    return ranked.filter(F.col("nth") <= most).drop("nth"), rest


def architecture(deps: DataFrame, groups: DataFrame) -> View:
    """One box per group of modules, with its size, and summed weights between."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("modules")).select(F.col("grp").alias("id"), "modules")
    return View(sizes, group_edges(deps, groups))


def module_view(deps: DataFrame) -> View:
    """All modules with their layer (longest path over condensed cycles)."""
    return View(layers(deps), deps.select("src", "dst", "weight"))


def spread(edges: DataFrame, handlers: DataFrame, depth: int = DOMAIN_DEPTH) -> DataFrame:
    """``handler``, ``id``, ``hops``: what each handler reaches, all handlers at once.

    A frontier of (handler, node) pairs: one join per hop, any number of handlers.
    """
    seen = front = stage(handlers.select(F.col("id").alias("handler"), "id", F.lit(0).alias("hops")), "spread")
    for hop in range(1, depth + 1):
        found = front.select("handler", F.col("id").alias("at")).join(edges.select("src", "dst"), F.col("at") == F.col("src")).select("handler", F.col("dst").alias("id")).distinct()
        known = seen.select(F.col("handler").alias("k_handler"), F.col("id").alias("k_id"))
        front = stage(found.join(known, (F.col("handler") == F.col("k_handler")) & (F.col("id") == F.col("k_id")), "left_anti").withColumn("hops", F.lit(hop)), "spread")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def data_flow(edges: DataFrame, handlers: DataFrame, depth: int = DOMAIN_DEPTH) -> View:
    """What handlers reach by stages, least hops first; edges go downstream, lateral
    or upstream as their hops compare. Caps come after, so none hides a path."""
    at = stage(spread(edges, handlers, depth).groupBy("id").agg(F.min("hops").alias("hops")), "hops")
    a, b = at.toDF("a_id", "a_hops"), at.toDF("b_id", "b_hops")
    inside = edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    kind = F.when(F.col("a_hops") < F.col("b_hops"), "downstream").when(F.col("a_hops") == F.col("b_hops"), "lateral").otherwise("upstream")
    return View(at, inside.select("src", "dst", kind.alias("direction")).distinct())


def request_flow(edges: DataFrame, handlers: DataFrame, most: int = STAGE_BOXES) -> View:
    """Per handler, what it reaches; a box at hop n stays only if one kept at hop
    n - 1 leads to it, and each hop keeps its first ``most`` boxes by degree."""
    degree = edges.select(F.col("src").alias("end")).union(edges.select("dst")).groupBy("end").agg(F.count("*").alias("degree"))
    every = stage(spread(edges, handlers).join(degree, F.col("id") == F.col("end"), "left").select("handler", "id", "hops", F.coalesce("degree", F.lit(0)).alias("degree")), "flows")
    kept, last = every.filter("hops = 0"), every.filter("hops = 0")
    for hop in range(1, DOMAIN_DEPTH + 1):
        led = last.select("handler", F.col("id").alias("at")).join(edges.select("src", "dst"), F.col("at") == F.col("src")).select(F.col("handler").alias("l_handler"), F.col("dst").alias("l_id")).distinct()
        here = every.filter(F.col("hops") == hop).join(led, (F.col("handler") == F.col("l_handler")) & (F.col("id") == F.col("l_id")), "left_semi")
        last, _ = capped(here, ["handler"], "degree", most)
        last = stage(last, "flow")
        kept = kept.unionByName(last)
    ends = kept.select(F.col("handler").alias("h"), F.col("id").alias("n"))
    story = edges.select("src", "dst").distinct().join(ends, F.col("src") == F.col("n")).drop("n").join(ends.toDF("h2", "n2"), (F.col("dst") == F.col("n2")) & (F.col("h") == F.col("h2"))).select(F.col("h").alias("handler"), "src", "dst")
    return View(kept, story)


def through(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between members once everything else is walked through, however much lies
    between: ``src``, ``dst``, ``via`` (how many others lie between, at least)."""
    inside = members.select(F.col("id").alias("m"))
    direct = edges.select("src", "dst").distinct()
    front = stage(direct.join(inside, F.col("src") == F.col("m"), "left_semi").withColumn("via", F.lit(0)), "through")
    seen, hop = front, 0
    while True:
        hop += 1
        open_ends = front.join(inside, F.col("dst") == F.col("m"), "left_anti").select(F.col("src").alias("from"), F.col("dst").alias("mid"))
        more = open_ends.join(direct, F.col("mid") == F.col("src")).select(F.col("from").alias("src"), "dst").distinct()
        known = seen.select(F.col("src").alias("k_src"), F.col("dst").alias("k_dst"))
        front = stage(more.join(known, (F.col("src") == F.col("k_src")) & (F.col("dst") == F.col("k_dst")), "left_anti").withColumn("via", F.lit(hop)), "through")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(inside, F.col("dst") == F.col("m"), "left_semi").filter("src <> dst")


def tree(modules: DataFrame, module: str, levels: int | None = None) -> DataFrame:
    """Drill tree: how many modules lie under each directory of each level, down to
    ``levels`` or to the end."""
    parts = F.split(F.col(module), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) if levels is None else F.least(F.size(parts), F.lit(levels))), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    return modules.select(F.inline(prefixes)).groupBy("level", "dir").agg(F.count("*").alias("modules"))


def labels(modules: DataFrame, module: str = "module") -> DataFrame:
    """``module``, ``label``: the last segment of a path, or its last two where that is
    shared. The count is a shuffle of segments, joined back, so no label is hot."""
    last = modules.select(F.col(module).alias("module")).distinct().withColumn("last", F.substring_index("module", "/", -1))
    shared = last.groupBy("last").agg(F.count("*").alias("same")).filter("same > 1").select(F.col("last").alias("s"))
    joined = last.join(shared, F.col("last") == F.col("s"), "left")
    return joined.select("module", F.when(F.col("s").isNotNull(), F.substring_index("module", "/", -2)).otherwise(F.col("last")).alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    """``end``, ``degree``: how many edges a node is an end of."""
    return edges.select(F.col("src").alias("end")).union(edges.select("dst")).groupBy("end").agg(F.count("*").alias("degree"))


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp``, ``members``, ``internal``, ``cohesion``: pairs of a group (``id``, ``grp``) that
    an edge connects, over all it could have; a group of one holds together."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    p, q = groups.select("id", "grp").toDF("p_id", "p_grp"), groups.select("id", "grp").toDF("q_id", "q_grp")
    inside = pairs.join(p, F.col("a") == F.col("p_id")).join(q, (F.col("b") == F.col("q_id")) & (F.col("q_grp") == F.col("p_grp")))
    counts = inside.groupBy("p_grp").agg(F.count("*").alias("e"))
    e, n = F.coalesce("e", F.lit(0)), F.col("members")
    ratio = F.when(n < 2, F.lit(1.0)).otherwise(F.bround(e / (n * (n - 1) / 2), 4))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"))
    return sizes.join(counts, F.col("grp") == F.col("p_grp"), "left").select("grp", "members", e.alias("internal"), ratio.alias("cohesion"))


def anchors(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp``, ``anchor``: the member of most connections in each group, ties by id."""
    joined = groups.join(degrees(edges), F.col("id") == F.col("end"), "left")
    most = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("id"))
    return joined.groupBy("grp").agg(F.min(most).alias("x")).select("grp", F.col("x.id").alias("anchor"))


def cited(facts: DataFrame, key: str, place: str, most: int = 6) -> DataFrame:
    """``key``, ``cited``: the first ``most`` distinct places of each key, a top-k: places
    are ranked, never gathered whole."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(place))
    first = facts.select(key, place).distinct().withColumn("nth", nth).filter(F.col("nth") <= most)
    return first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(place)), "|").alias("cited"))


def top_groups(groups: DataFrame, edges: DataFrame, most: int = TOP_BOXES) -> DataFrame:
    """``module``, ``anchor``, ``how`` for at most ``most`` groups (``anchor``, ``module``) and
    those that fit none of them. ``edges``: src, dst between modules.

    The ``most`` largest groups are kept, ties by anchor. In the same order each further one
    joins the kept group that its modules have most connections with (``connected``), what
    joined before it included; without any, the one that holds the module of the longest
    common path (``near``); else it stays alone. Ties go to the least anchor.

    A group looks only at those before it. All are decided at once from what the last round
    decided, again until nothing changes: by then each has seen the final places of all
    before it, so the result is that of going one by one, in as many rounds as one decision
    hangs on another. Paths meet by equal prefixes, of which each kept group counts once.
    """
    sizes = groups.groupBy("anchor").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("less"), F.col("anchor").alias("name")).alias("turn")
    ranked = stage(groups.join(sizes.select(F.col("anchor").alias("of"), "n"), F.col("anchor") == F.col("of")).select("module", "anchor", order), "turns")
    first = stage(ranked.select("anchor", "turn").distinct().orderBy("turn").limit(most).select(F.col("anchor").alias("kept")), "kept")
    rest = ranked.join(first, F.col("anchor") == F.col("kept"), "left_anti")
    whole = ranked.select(F.col("module").alias("m"), F.col("anchor").alias("g"), F.col("turn").alias("t"))
    pairs = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = rest.join(pairs, F.col("module") == F.col("src")).join(whole, F.col("dst") == F.col("m")).filter("t < turn")
    near = stage(near.groupBy("anchor", "g").agg(F.count("*").alias("n")), "connections")
    parts = F.split("module", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("deep"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))
    dirs = stage(ranked.select("anchor", "turn", F.inline(prefixes)).distinct(), "prefixes")
    asks = dirs.join(first, F.col("anchor") == F.col("kept"), "left_anti")
    known = dirs.select(F.col("prefix").alias("p"), F.col("anchor").alias("g"), F.col("turn").alias("t"))
    own = first.select(F.col("kept").alias("from"), F.col("kept").alias("to"))
    place, before = own, -1
    while True:
        at = place.select(F.col("from").alias("f"), "to")
        linked = near.join(at, F.col("g") == F.col("f")).groupBy("anchor", "to").agg(F.sum("n").alias("n"))
        linked = linked.groupBy("anchor").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("to"))).alias("x")).select("anchor", F.col("x.to").alias("to"), F.lit("connected").alias("how"))
        # Of each kept group, when its first module below a prefix came.
        held = known.join(at, F.col("g") == F.col("f")).groupBy("p", "to").agg(F.min("t").alias("t"))
        below = asks.join(linked.select(F.col("anchor").alias("done")), F.col("anchor") == F.col("done"), "left_anti").join(held, (F.col("prefix") == F.col("p")) & (F.col("t") < F.col("turn")))
        below = below.groupBy("anchor").agg(F.min(F.struct((-F.col("deep")).alias("less"), F.col("to"))).alias("x")).select("anchor", F.col("x.to").alias("to"), F.lit("near").alias("how"))
        new, n = counted(linked.unionByName(below), "places")
        same = 0 if n != before else new.join(place.select(F.col("from").alias("f"), F.col("to").alias("old")), (F.col("anchor") == F.col("f")) & (F.col("to") == F.col("old")), "left_semi").count()
        place, unchanged, before = own.unionByName(new.select(F.col("anchor").alias("from"), "to")), n == before and same == n, n
        if unchanged:
            break
    told = new.select(F.col("anchor").alias("f"), "to", "how")
    out = ranked.join(told, F.col("anchor") == F.col("f"), "left").join(first, F.col("anchor") == F.col("kept"), "left")
    how = F.when(F.col("kept").isNotNull(), "kept").otherwise(F.coalesce("how", F.lit("alone")))
    return out.select("module", F.coalesce("to", "anchor").alias("anchor"), how.alias("how"))


def derive_all(views: dict[str, Callable[[], View]]) -> tuple[dict[str, View], dict[str, str]]:
    """All views, and why those that failed are absent."""
    made, absent = {}, {}
    for name, make in views.items():
        try:
            made[name] = make()
        except Exception as e:  # one view must not cost another
            absent[name] = f"{type(e).__name__}: {e}"
    return made, absent


def erd() -> View:
    """Entity diagrams need a schema extractor, which there is none of."""
    raise LookupError("no schema facts")


def validate(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """What is wrong with a set of views: ``code``, ``subject``. ``nodes``: view, id,
    drill (a view or null); ``edges``: view, src, dst. Ids repeat in a view, edges end
    nowhere, boxes open no view, and views that the root does not lead to."""
    from evgraph.operators.traverse import reach

    views = nodes.select("view").distinct()
    said = lambda code, rows, subject: rows.select(F.lit(code).alias("code"), subject.alias("subject"))
    doubled = nodes.groupBy("view", "id").agg(F.count("*").alias("n")).filter("n > 1")
    at = nodes.select(F.col("view").alias("n_view"), F.col("id").alias("n_id")).distinct()
    ends = edges.select("view", F.explode(F.array("src", "dst")).alias("end")).distinct()
    loose = ends.join(at, (F.col("view") == F.col("n_view")) & (F.col("end") == F.col("n_id")), "left_anti")
    opened = nodes.filter("drill is not null").select("view", "id", "drill")
    lost = opened.join(views.select(F.col("view").alias("v")), F.col("drill") == F.col("v"), "left_anti")
    links = opened.select(F.col("view").alias("src"), F.col("drill").alias("dst")).distinct()
    led = reach(links, nodes.sparkSession.createDataFrame([(root,)], "id string")).select(F.col("id").alias("led"))
    unreached = views.join(led, F.col("view") == F.col("led"), "left_anti")
    pair = lambda a, b: F.concat_ws("/", a, b)
    parts = [said("repeated-id", doubled, pair("view", "id")), said("loose-edge", loose, pair("view", "end")), said("lost-drill", lost, pair("view", "id")), said("unreached-view", unreached, F.col("view"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
