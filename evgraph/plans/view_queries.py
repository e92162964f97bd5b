"""Views of the star schema: architecture, flows, drill trees, labels, drawing checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.operators import build, communities, derive, joins, layout
from evgraph.plans.registry import query
from evgraph.sources import star
from evgraph.sources.star import HANDOVERS_SQL, PATHS_SQL, TRADE_SQL


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "nation").select(star.node_id("nation", "n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"))


@query(f"""
with {TRADE_SQL}, m as (select 'nation:' || n_nationkey as id, n_regionkey as grp from nation)
select a.grp as src_group, b.grp as dst_group, sum(weight)::bigint as weight, count(*)::bigint as pairs
from t join m a on a.id = src join m b on b.id = dst where a.grp <> b.grp group by 1, 2
""")
def architecture_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.architecture(star.trade(spark, sf_dir), _regions(spark, sf_dir)).edges


def _handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).filter("grp = 0").select("id")


_SPREAD = f"""
with recursive {TRADE_SQL}, s(handler, id, hops) as (
  select 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 from nation where n_regionkey = 0
  union select handler, t.dst, hops + 1 from s join t on t.src = s.id where hops < 2),
r as (select handler, id, min(hops) as hops from s group by 1, 2)"""


@query(f"{_SPREAD} select handler, id, hops::int as hops from r")
def handler_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each handler reaches within two hops, all handlers at once."""
    return derive.spread(star.trade(spark, sf_dir), _handlers(spark, sf_dir))


@query(f"""
{_SPREAD}, h as (select id, min(hops) as hops from r group by 1)
select distinct src, dst, case when a.hops < b.hops then 'downstream' when a.hops = b.hops then 'lateral' else 'upstream' end as direction
from t join h a on a.id = src join h b on b.id = dst
""")
def data_flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.data_flow(star.trade(spark, sf_dir), _handlers(spark, sf_dir)).edges


@query(f"""
with recursive {TRADE_SQL}, m as (select 'nation:' || n_nationkey as id from nation where n_regionkey <= 1), e as (select distinct src, dst from t),
w(src, dst, via) as (select src, dst, 0 from e where src in (select id from m)
  union select w.src, e.dst, via + 1 from w join e on e.src = w.dst where w.dst not in (select id from m) and via < 20)
select src, dst, min(via)::int as via from w where dst in (select id from m) and src <> dst group by 1, 2
""")
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between members, other nations being walked through."""
    members = _regions(spark, sf_dir).filter("grp <= 1").select("id")
    return derive.through(star.trade(spark, sf_dir), members)


@query(f"""
with {PATHS_SQL}, s as (select string_split(path, '/') as w from p), x as (select w, unnest(range(1, least(len(w), 6) + 1)) as level from s)
select level::int as level, array_to_string(w[1:level], '/') as dir, count(*)::bigint as modules from x group by 1, 2
""")
def drill_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.tree(star.paths(spark, sf_dir), "path", levels=6)


@query(f"""
with {PATHS_SQL}, m as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as module from p),
l as (select module, string_split(module, '/') as w, count(*) over (partition by string_split(module, '/')[-1]) as same from m)
select module, case when same > 1 then array_to_string(w[greatest(len(w) - 1, 1):len(w)], '/') else w[-1] end as label from l
""")
def view_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last segment of a module's path, or its last two where that is shared."""
    return derive.labels(star.paths(spark, sf_dir).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("module")))


def communities_T(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nations by trade; a search, so SQL has no word for it."""
    nations = _regions(spark, sf_dir).select(F.col("id").alias("module"))
    return communities.communities(nations, build.weighted_pairs(star.trade(spark, sf_dir), F.col("weight")))


query()(communities_T)


def communities_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the part graph, whose points grow with the parts; a search, like the last."""
    steps = star.handovers(spark, sf_dir).withColumn("weight", F.lit(1))
    parts = star.table(spark, sf_dir, "part").select(star.node_id("part", "p_partkey").alias("module"))
    return communities.communities(parts, build.weighted_pairs(steps, F.col("weight")))


query()(communities_parts)


@query(f"""
with recursive {HANDOVERS_SQL}, m as (
  select 'part:' || p_partkey as id, p_brand || '/' || p_type || '/' || p_partkey as path, p_brand || p_type[1] || p_size as key from part
), a as (
  select key, min(path) as anchor, count(*) as n from m group by key
), o as (
  select *, row_number() over (order by n desc, anchor) as turn from a
), p as (
  select path, id, o.anchor, turn from m join o using (key)
), e as (
  select distinct x.turn as a, y.turn as b, x.path as pa, y.path as pb from (select src, dst from h union select dst, src from h) t
  join p x on x.id = t.src join p y on y.id = t.dst
), adj as (
  select a, list({{'h': b, 'c': c}}) as adj from (select a, b, count(*) as c from e where b < a group by 1, 2) group by a
), dirs as (
  select distinct turn, deep, array_to_string(string_split(path, '/')[1 : deep], '/') as dir from (select *, unnest([1, 2, 3]) as deep from p)
), pre as (
  select a, list({{'h': b, 'd': d}}) as pre from (
    select x.turn as a, y.turn as b, max(x.deep) as d from dirs x join dirs y on x.dir = y.dir and y.turn < x.turn where x.turn > 12 group by 1, 2) group by a
), g as (
  select o.turn, coalesce(adj, []) as adj, coalesce(pre, []) as pre from o left join adj on adj.a = o.turn left join pre on pre.a = o.turn
), ks as (
  select list(turn order by anchor) as ks from o where turn <= 12
), s as (
  select least(12, (select count(*) from o)) as turn, list_transform(range(1, 13), lambda x: x) as put from ks
  union all
  select turn, list_append(put, case when list_max(cs) > 0 then ks[list_position(cs, list_max(cs))] when list_max(ds) > 0 then ks[list_position(ds, list_max(ds))] else 0 end)
  from (
    select g.turn, s.put, ks.ks,
      list_transform(ks.ks, lambda t: coalesce(list_sum(list_transform(list_filter(g.adj, lambda x: s.put[x.h] = t), lambda x: x.c)), 0)::bigint) as cs,
      list_transform(ks.ks, lambda t: coalesce(list_max(list_transform(list_filter(g.pre, lambda x: s.put[x.h] = t), lambda x: x.d)), 0)::bigint) as ds
    from s join g on g.turn = s.turn + 1, ks)
), last as (
  select put from s order by turn desc limit 1
)
select path as module, coalesce(k.anchor, p.anchor) as anchor,
  case when p.turn <= 12 then 'kept' when k.turn is null then 'alone'
       when list_max(list_transform(coalesce(g.adj, []), lambda x: (put[x.h] > 0)::int)) > 0 then 'connected' else 'near' end as how
from p join g on g.turn = p.turn, last left join o k on k.turn = nullif(put[p.turn], 0)
""")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in groups, merged to a dozen by how they follow each other, then by path."""
    part = star.table(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string"))
    key = F.concat("p_brand", F.substring("p_type", 1, 1), F.col("p_size").cast("string"))
    modules = part.select(star.node_id("part", "p_partkey").alias("id"), path.alias("module"), key.alias("key"))
    anchors = modules.groupBy("key").agg(F.min("module").alias("anchor")).withColumnRenamed("key", "of")
    groups = modules.join(anchors, F.col("key") == F.col("of")).select("anchor", "module")
    a, b = (modules.select(F.col("id").alias(f"{k}_id"), F.col("module").alias(k)) for k in ("src_module", "dst_module"))
    steps = star.handovers(spark, sf_dir).join(a, F.col("src") == F.col("src_module_id")).join(b, F.col("dst") == F.col("dst_module_id"))
    return derive.top_groups(groups, steps.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")))

_CANVAS = """
b as (select 'v' || (p_partkey // 300) as view, 'b' || p_partkey as id, (p_partkey * 37 % 2000)::int as x1, (p_partkey * 37 % 2000 + p_size)::int as x2,
  (p_partkey * 91 % 1000)::int as y1, (p_partkey * 91 % 1000 + 20)::int as y2 from part),
s as (select 'v' || (l_partkey // 300) as view, (l_orderkey * 10 + l_linenumber)::bigint as route, 'b' || l_partkey as src, 'b' || (l_partkey + 35) as dst,
  (l_partkey * 37 % 2000)::int as x1, ((l_partkey + 35) * 37 % 2000)::int as x2, (l_partkey * 91 % 1000 + 10)::int as y1, (l_partkey * 91 % 1000 + 10)::int as y2
  from lineitem)"""


def _canvas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def at(k):
        return (k * 37 % 2000).cast("int"), (k * 91 % 1000).cast("int")

    k = F.col("p_partkey")
    x, y = at(k)
    boxes = star.table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), F.floor(k / 300).cast("string")).alias("view"), F.concat(F.lit("b"), k.cast("string")).alias("id"),
        x.alias("x1"), (x + F.col("p_size")).alias("x2"), y.alias("y1"), (y + 20).alias("y2"),
    )
    k = F.col("l_partkey")
    x, y = at(k)
    routes = star.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("v"), F.floor(k / 300).cast("string")).alias("view"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("route"),
        F.concat(F.lit("b"), k.cast("string")).alias("src"), F.concat(F.lit("b"), (k + 35).cast("string")).alias("dst"),
        x.alias("x1"), at(k + 35)[0].alias("x2"), (y + 10).alias("y1"), (y + 10).alias("y2"),
    )
    return boxes, routes


@query(f"""
with {_CANVAS}, g as (select distinct view, src, dst, x1, x2, y1 from s)
select view, src, dst, count(*)::bigint as boxes from (
  select distinct g.view, g.src, g.dst, b.id from g join b on b.view = g.view and b.id <> g.src and b.id <> g.dst
  and least(g.x1, g.x2) < b.x2 and greatest(g.x1, g.x2) > b.x1 and g.y1 > b.y1 and g.y1 < b.y2) group by 1, 2, 3
""")
def route_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes each connection cuts through that are not its ends."""
    boxes, routes = _canvas(spark, sf_dir)
    lines = routes.drop("route").distinct().withColumn("route", F.concat_ws(">", "src", "dst"))
    found = layout.crossings(lines, boxes).groupBy("view", "route").agg(F.count("*").alias("boxes"))
    return found.select("view", F.substring_index("route", ">", 1).alias("src"), F.substring_index("route", ">", -1).alias("dst"), "boxes")


@query(f"""
with {_CANVAS}
select a.view, a.id as a, c.id as b from b a join b c on a.view = c.view and a.id < c.id and a.x1 < c.x2 + 4 and c.x1 < a.x2 + 4 and a.y1 < c.y2 + 4 and c.y1 < a.y2 + 4
""")
def layout_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.box_overlaps(_canvas(spark, sf_dir)[0])


@query(f"""
with {TRADE_SQL}, n as (select 'nation:' || n_nationkey as id, n_regionkey as layer, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as place from nation),
e as (select dst as n, src as m from t union all select src, dst from t), a as (select e.n as id, avg(n.place) as mean from e join n on n.id = e.m group by 1)
select id, layer, (row_number() over (partition by layer order by coalesce(mean, place), place, id) - 1)::int as place from n left join a using (id)
""")
def barycentre_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nodes = star.table(spark, sf_dir, "nation").select(star.node_id("nation", "n_nationkey").alias("id"), F.col("n_regionkey").alias("layer"), first.alias("place"))
    return layout.barycentres(nodes, star.trade(spark, sf_dir))


_BINDS = "(values ('Gold', 1, 4), ('Silver', 3, 6), ('Bronze', 2, 5), ('Iron', 1, 9)) b(kind, lo, hi)"


@query(f"""
with c as (select conv_id, turn, kind, rank() over (partition by conv_id, turn order by hi - lo) as r from (select distinct conv_id, turn from conversations) join {_BINDS} on turn between lo and hi)
select conv_id, turn, case when count(distinct kind) = 1 then min(kind) else '' end as kind from c where r = 1 group by 1, 2
""")
def local_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type bound in the narrowest scope around a line; none where scopes of that
    width disagree."""
    binds = spark.createDataFrame([("Gold", 1, 4), ("Silver", 3, 6), ("Bronze", 2, 5), ("Iron", 1, 9)], "kind string, lo long, hi long")
    places = star.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return joins.narrowest(places, ["conv_id", "turn"], "turn", binds, "lo", "hi", "kind")


@query("""
with b as (select 'v' || (p_partkey % 5) as view, 'b' || p_partkey as id, p_partkey * 7919 % 20000 as x1, p_partkey * 6101 % 20000 as y1, p_partkey * 7919 % 20000 + 40 + p_size as x2, p_partkey * 6101 % 20000 + 24 as y2 from part),
m as (select 'v' || (o_orderkey % 5) as view, 'r' || o_orderkey as route, o_orderkey * 3571 % 20000 as x1, o_orderkey * 2969 % 20000 as y1, o_orderkey * 3571 % 20000 + 30 as x2, o_orderkey * 2969 % 20000 + 12 as y2 from orders),
s as (select 'v' || (l_orderkey % 5) as view, 'r' || l_orderkey as route, (l_orderkey * 3571 + l_linenumber * 50) % 20000 as x1, l_partkey * 4337 % 20000 as y1, (l_orderkey * 3571 + l_linenumber * 50) % 20000 + 200 as x2 from lineitem)
select m.view, m.route, 'box' as "on", b.id as other from m join b on m.view = b.view and m.x1 < b.x2 and m.x2 > b.x1 and m.y1 < b.y2 and m.y2 > b.y1
union select m.view, m.route, 'route', s.route from m join s on m.view = s.view and m.route <> s.route and m.x1 < s.x2 and m.x2 > s.x1 and m.y1 < s.y1 and m.y2 > s.y1
union select m.view, m.route, 'label', n.route from m join m n on m.view = n.view and m.route < n.route and m.x1 < n.x2 + 4 and m.x2 + 4 > n.x1 and m.y1 < n.y2 + 4 and m.y2 + 4 > n.y1
""")
def label_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of orders that lie over boxes of parts, over other orders' lines or labels."""
    t = lambda name: star.table(spark, sf_dir, name)
    view = lambda key: F.concat(F.lit("v"), (F.col(key) % 5).cast("string")).alias("view")
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    at = lambda key, by: F.col(key) * by % 20_000

    def rect(df: DataFrame, key: str, mark: str, to: str, across: int, down: int, wide: Column, high: int) -> DataFrame:
        x, y = at(key, across), at(key, down)
        return df.select(view(key), name(mark, key).alias(to), x.alias("x1"), y.alias("y1"), (x + wide).alias("x2"), (y + high).alias("y2"))

    boxes = rect(t("part"), "p_partkey", "b", "id", 7919, 6101, F.col("p_size") + 40, 24)
    labels = rect(t("orders"), "o_orderkey", "r", "route", 3571, 2969, F.lit(30), 12)
    x, y = (F.col("l_orderkey") * 3571 + F.col("l_linenumber") * 50) % 20_000, at("l_partkey", 4337)
    lines = t("lineitem").select(view("l_orderkey"), name("r", "l_orderkey").alias("route"), x.alias("x1"), y.alias("y1"), (x + 200).alias("x2"), y.alias("y2"))
    return layout.label_faults(labels, boxes, lines)


@query(f"""
with {_CANVAS}, f as (
  select view, 'band' || (y1 // 100) as frame, (y1 // 100) * 100 as low, (y1 // 100) * 100 + 110 as high, id from b
), g as (select distinct view, frame, low, high from f),
q as (select view, frame, id as member from f union all select view, frame, 'ghost' from g where low = 300)
select q.view, q.frame, member, case when b.id is null then 'no-box' else 'not-inside' end as fault
from q join g on g.view = q.view and g.frame = q.frame left join b on b.view = q.view and b.id = q.member
where b.id is null or b.y1 < low or b.y2 > high
""")
def band_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that reach out of the band that claims them, and claims of what is no box."""
    boxes, _ = _canvas(spark, sf_dir)
    low = F.expr("(y1 div 100) * 100").cast("int")
    held = boxes.select("view", F.concat(F.lit("band"), F.expr("y1 div 100").cast("string")).alias("frame"), low.alias("low"), "id")
    none = F.lit(None).cast("int")
    frames = held.select("view", "frame", none.alias("x1"), F.col("low").alias("y1"), none.alias("x2"), (F.col("low") + 110).alias("y2")).distinct()
    members = held.select("view", "frame", F.col("id").alias("member")).union(frames.filter("y1 = 300").select("view", "frame", F.lit("ghost")))
    canvas = boxes.select("view", F.lit(4000).alias("width"), F.lit(4000).alias("height")).distinct()
    return layout.frame_faults(frames, members, boxes, canvas)
