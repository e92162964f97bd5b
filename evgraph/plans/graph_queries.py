"""Graph queries over the star schema: building, asking, walking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators import ask, build, derive, health, traverse
from evgraph.plans.registry import query
from evgraph.schema import evidence_order
from evgraph.sources import star
from evgraph.sources.star import EDGES_SQL, FACTS_SQL, HANDOVERS_SQL, NODES_SQL, PATHS_SQL, TRADE_SQL


def _supply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return star.table(spark, sf_dir, "lineitem").select(
        star.node_id("supplier", "l_suppkey").alias("src"),
        star.node_id("part", "l_partkey").alias("dst"),
        F.lit("calls").alias("kind"),
        F.concat(F.lit("lineitem/"), F.col("l_orderkey").cast("string")).alias("file"),
        F.col("l_linenumber").alias("start_line"),
        F.col("l_linenumber").alias("end_line"),
        F.when(flag == "A", "resolved").when(flag == "N", "candidate").otherwise("unresolved").alias("resolution"),
        F.col("l_quantity").cast("int").alias("arity"),
        (F.col("l_linestatus") == "F").alias("type_only"),
        flag.alias("producer"),
    )


@query("""
with f as (
  select 'supplier:' || l_suppkey as src, 'part:' || l_partkey as dst, l_orderkey, l_linenumber,
         case l_returnflag when 'A' then 3 when 'N' then 2 else 0 end as r, l_returnflag as producer,
         l_quantity::int as arity, l_linestatus = 'F' as type_only from lineitem
), g as (
  select src, dst, count(*) as facts, count(distinct (l_orderkey, l_linenumber)) as sites, min(r) as low, max(r) as top,
         max(arity) as arity, bool_and(type_only) as type_only from f group by src, dst
)
select g.src, g.dst, 'calls' as kind, g.facts, g.sites,
       case low when 0 then 'unresolved' when 1 then 'external' when 2 then 'candidate' else 'resolved' end as resolution,
       (select min(producer) from f where f.src = g.src and f.dst = g.dst and f.r = g.low) as producer,
       arity, type_only, low <> top as mixed, (low = 2 and facts > 1 and sites < 2) as dropped
from g
""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.merge_edges(_supply_facts(spark, sf_dir))


@query("""
select 'orders:' || o_orderkey as src, 'customer:' || o_custkey as dst from orders
where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal >= 0)
""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star.edges(spark, sf_dir, lines=False).filter("kind = 'references'")
    active = star.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(star.node_id("customer", "c_custkey").alias("id"))
    return build.dangling(edges, active, ends=("dst",)).select("src", "dst")


@query("""
select 'orders:' || o_orderkey as src, 'customer:' || o_custkey as dst from orders
where exists (select 1 from customer where c_custkey = o_custkey and c_acctbal >= 0) and o_totalprice > 100000
""")
def eligible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star.edges(spark, sf_dir, lines=False).filter("kind = 'references'")
    customers = star.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(star.node_id("customer", "c_custkey").alias("id"))
    orders = star.table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(star.node_id("orders", "o_orderkey").alias("id"))
    return build.eligible_edges(edges, customers.union(orders)).select("src", "dst")


@query("""
select lower(split_part(url, '/', 3)) as key, count(distinct url)::bigint as names, min(url) as first, max(url) as last
from pages group by 1 having count(distinct url) > 1
""")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.table(spark, sf_dir, "pages").select("url")
    return build.collisions(pages, F.lower(F.split_part("url", F.lit("/"), F.lit(3))), "url")


@query("""
select l_orderkey, count(*)::bigint as copies, min(l_linenumber) as first_line, count(distinct l_partkey) > 1 as conflict
from lineitem group by l_orderkey
""")
def node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    first = rows.groupBy("id").agg(F.min("l_linenumber").alias("first_line"))
    found = build.dedup_nodes(rows, "l_linenumber", ["l_partkey"])
    return found.join(first, "id").select(F.col("id").alias("l_orderkey"), "copies", "first_line", "conflict")


@query("""
with files as (select l_orderkey as file, count(*) as line_count from lineitem where l_returnflag <> 'R' group by 1)
select l_orderkey, l_linenumber, case when line_count is null then 'unknown-file' when l_linenumber < 1 then 'bad-range'
       when l_linenumber > line_count then 'past-end' end as reason, count(*)::bigint as n
from lineitem left join files on file = l_orderkey group by all
""")
def verify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star.table(spark, sf_dir, "lineitem")
    files = items.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("line_count"))
    line = F.col("l_linenumber")
    sites = items.select(F.col("l_orderkey").alias("file"), line, line.alias("start_line"), line.alias("end_line"))
    checked = build.verify_evidence(sites, files)
    return checked.groupBy(F.col("file").alias("l_orderkey"), "l_linenumber", "reason").agg(F.count("*").alias("n"))


@query("""
with files as (select l_orderkey as file, count(*) as line_count from lineitem where l_returnflag <> 'R' group by 1)
select l_suppkey, l_partkey from lineitem left join files on file = l_orderkey group by all
having bool_and(line_count is not null and l_linenumber between 1 and line_count)
""")
def supported_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star.table(spark, sf_dir, "lineitem")
    files = items.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("line_count"))
    line = F.col("l_linenumber")
    sites = items.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("file"), line.alias("start_line"), line.alias("end_line"))
    return build.supported(build.verify_evidence(sites, files), ["l_suppkey", "l_partkey"])


@query(f"with {PATHS_SQL} select regexp_extract(path, '^(.*)/[^/]*$', 1) as module, count(*)::bigint as file_count from p group by 1")
def module_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evgraph.schema import module_of

    return build.modules(star.paths(spark, sf_dir), module_of(F.col("path")))


@query("""
with e as (select 'customer/' || c_mktsegment || '/' || c_nationkey as s, 'supplier/' || (l_suppkey % 7) || '/' || l_suppkey as d
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)
select distinct regexp_extract(s, '^(.*)/[^/]*$', 1) as src_module, regexp_extract(d, '^(.*)/[^/]*$', 1) as dst_module from e
""")
def module_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evgraph.schema import module_of

    t = lambda n, *c: star.table(spark, sf_dir, n).select(*c)
    joined = t("lineitem", "l_orderkey", "l_suppkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("customer", "c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = joined.select(
        F.concat_ws("/", F.lit("customer"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("src"),
        F.concat_ws("/", F.lit("supplier"), (F.col("l_suppkey") % 7).cast("string"), F.col("l_suppkey").cast("string")).alias("dst"),
    )
    return build.module_deps(edges, module_of(F.col("src")), module_of(F.col("dst")))


@query(f"""
with {TRADE_SQL}
select a.id as module, coalesce(string_agg(distinct t.dst, '|' order by t.dst), '') as deps
from (select 'nation:' || n_nationkey as id from nation) a left join t on t.src = a.id group by 1
""")
def module_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with their sorted dependencies, none of which is left out for having
    no dependency. A source has three of them at most, so the lists are bounded."""
    every = star.table(spark, sf_dir, "nation").select(star.node_id("nation", "n_nationkey").alias("module"))
    return build.module_records(every, star.trade(spark, sf_dir))


@query(f"""
with {FACTS_SQL}
select src, dst, count(distinct (l_orderkey, l_linenumber))::bigint as weight from facts where l_returnflag <> 'R' group by 1, 2
""")
def runtime_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = star.trade_facts(spark, sf_dir)
    return build.runtime_edges(facts, F.col("l_returnflag") != "R", F.struct("l_orderkey", "l_linenumber"))


@query(f"""
with {TRADE_SQL}
select least(src, dst) as a, greatest(src, dst) as b, sum(weight)::bigint as weight from t where src <> dst group by 1, 2
""")
def weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.weighted_pairs(star.trade(spark, sf_dir), F.col("weight"))


@query("""
with f as (
  select user_id % 10 as bucket, case event_type when 'click' then 'resolved' when 'view' then 'candidate'
         when 'purchase' then 'external' else 'unresolved' end as r from events
), c as (
  select bucket, count(*) filter (r = 'resolved') as resolved, count(*) filter (r = 'candidate') as candidate,
         count(*) filter (r = 'external') as external, count(*) filter (r = 'unresolved') as unresolved from f group by 1
)
select *, case when resolved + candidate + unresolved > 0
  then round_even((resolved + candidate) * 100.0::double / (resolved + candidate + unresolved), 6) else 0 end::double as pinned_pct from c
""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "click", "resolved").when(kind == "view", "candidate").when(kind == "purchase", "external").otherwise("unresolved")
    facts = star.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("bucket"), outcome.alias("resolution"))
    return build.scorecard(facts, ["bucket"])


_NAMES = ("region:1", "ASIA", "nation.FRANCE", "BUILDING", "1-URGENT", "supplier:3", "nowhere")
_RESOLVED = f"""
with {NODES_SQL}, asked as (select unnest({list(_NAMES)}) as name), hits as (
  select name, id, 0 as r from asked join nodes on id = name
  union all select name, id, 1 from asked join nodes on kind || '.' || label = name
  union all select name, id, 2 from asked join nodes on label = name
), best as (select name, id, min(r) as r from hits group by 1, 2),
kept as (select * from best b where r = 0 or not exists (select 1 from hits h where h.name = b.name and h.r = 0))"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by their region."""
    return star.table(spark, sf_dir, "nation").select(star.node_id("nation", "n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string")


@query(f"{_RESOLVED} select name, id, ['id', 'qualified_name', 'label'][r + 1] as matched_by from kept")
def resolve_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.resolve(star.nodes(spark, sf_dir), _names(spark))


@query(f"""
{_RESOLVED}
select name, count(id)::bigint as hits, case count(id) when 1 then 'match' when 0 then 'no node' else 'ambiguous' end as verdict
from asked left join kept using (name) group by name
""")
def answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.answerable(star.nodes(spark, sf_dir), _names(spark))


_DEGREES = f"""
with {NODES_SQL}, {EDGES_SQL},
o as (select src as id, count(*) as n from edges group by 1), i as (select dst as id, count(*) as n from edges group by 1),
d as (select nodes.*, coalesce(i.n, 0)::bigint as in_degree, coalesce(o.n, 0)::bigint as out_degree,
      (coalesce(i.n, 0) + coalesce(o.n, 0))::bigint as degree from nodes left join i using (id) left join o using (id))"""


@query(f"{_DEGREES} select * from d")
def get_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its degrees: what a lookup of one node reads."""
    return ask.degrees(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))


@query(f"{_DEGREES} select * from d order by degree desc, id limit 10")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.god_nodes(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), 10)


@query(f"""
with {NODES_SQL}, {EDGES_SQL}, r as (
  select 'out' as direction, src as node, dst as other, kind, context from edges where src like 'nation:%' and kind = 'contains'
  union all select 'in', dst, src, kind, context from edges where dst like 'nation:%' and kind = 'contains')
select direction, node, other, r.kind as edge_kind, context, nodes.kind as other_kind, label from r join nodes on nodes.id = other
""")
def get_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star.nodes(spark, sf_dir)
    return ask.neighbours(nodes, star.edges(spark, sf_dir), nodes.filter("kind = 'nation'"), relation="contains")


@query(f"""
with {NODES_SQL}, {EDGES_SQL}, r as (
  select 'in' as direction, dst as node, src as other, kind, context from edges where dst like 'customer:%')
select direction, node, other, r.kind as edge_kind, context, nodes.kind as other_kind, label from r join nodes on nodes.id = other
where r.kind <> 'contains'
""")
def get_neighbors_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star.nodes(spark, sf_dir)
    return ask.neighbours(nodes, star.edges(spark, sf_dir), nodes.filter("kind = 'customer'"), direction="in")


@query(f"""
with {EDGES_SQL}, {NODES_SQL}, e as (select src, dst, kind, coalesce(context, kind) as via from edges),
h1 as (select src as id, min(via) as via from e where dst = 'region:1' group by 1),
h2 as (select src as id, min_by(via, (dst, kind)) as via from e where dst in (select id from h1)
       and src <> 'region:1' and src not in (select id from h1) group by 1),
h3 as (select src as id, min_by(via, (dst, kind)) as via from e where dst in (select id from h2)
       and src <> 'region:1' and src not in (select id from h1) and src not in (select id from h2) group by 1),
a as (select id, 1 as hops, via from h1 union all select id, 2, via from h2 union all select id, 3, via from h3)
select id, kind, hops, via from a join nodes using (id)
""")
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("region:1",)], "id string")
    return ask.affected(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), start, depth=3)


@query(f"""
with {EDGES_SQL}
select 'kind' as facet, kind as value, count(*)::bigint as n from edges group by 2
union all select 'context', context, count(*) from edges group by 2 union all select 'total', 'all', count(*) from edges
""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.graph_stats(star.edges(spark, sf_dir))


_FROM = "nation:0"


@query(f"""
with recursive {TRADE_SQL}, walk(id, hops) as (
  select '{_FROM}', 0 union select t.dst, hops + 1 from walk join t on t.src = id where hops < 6)
select id, min(hops)::int as hops from walk group by 1
""")
def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([(_FROM,)], "id string")
    return traverse.reach(star.trade(spark, sf_dir), start, depth=6)


@query(f"""
with recursive {TRADE_SQL}, walk as (
  select '{_FROM}' as id, 0 as hops, ['{_FROM}'] as rank
  union all select t.dst, hops + 1, list_append(rank, t.dst) from walk join t on t.src = id where hops < 4 and not list_contains(rank, t.dst)
), best as (select id, min((hops, rank)) as b from walk group by 1)
select id, b[1]::int as hops, list_aggregate(b[2], 'string_agg', '>') as path from best
""")
def shortest_path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path by which a breadth-first search first found each node."""
    start = spark.createDataFrame([(_FROM,)], "id string")
    edges = star.trade(spark, sf_dir).withColumn("kind", F.lit("depends_on"))
    return traverse.first_paths(edges, start, 4).select("id", "hops", F.array_join("rank", ">").alias("path"))


_CLOSURE = f"""
with recursive {TRADE_SQL}, c(src, dst) as (select src, dst from t union select c.src, t.dst from c join t on t.src = c.dst)"""


@query(f"{_CLOSURE} select src, dst from c")
def closure_T(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.closure(star.trade(spark, sf_dir))


@query(f"{_CLOSURE} select p.src as id, min(least(p.src, p.dst)) as component from c p join c q on p.src = q.dst and p.dst = q.src group by 1")
def scc_T(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.strong_components(star.trade(spark, sf_dir))


@query(f"""
{_CLOSURE}, k as (select p.src as id, min(least(p.src, p.dst)) as point from c p join c q on p.src = q.dst and p.dst = q.src group by 1),
ids as (select src as id from t union select dst from t),
m as (select id, coalesce(point, id) as point from ids left join k using (id)),
d as (select distinct a.point as src, b.point as dst from t join m a on t.src = a.id join m b on t.dst = b.id where a.point <> b.point),
w(point, depth) as (select point, 0 from m union select d.dst, depth + 1 from w join d on d.src = w.point)
select id, max(depth)::int as layer from m join w using (point) group by 1
""")
def layers_T(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layers(star.trade(spark, sf_dir))


@query(f"{_CLOSURE} select src as id from c where src = dst")
def cyclic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.strong_components(star.trade(spark, sf_dir)).select("id")


#: Which parts reach which; enough for DuckDB at small scales, not how Spark does it.
_HANDED = f"""
with recursive {HANDOVERS_SQL}, c(src, dst) as (select src, dst from h union select c.src, h.dst from c join h on h.src = c.dst),
k as (select p.src as id, min(least(p.src, p.dst)) as point from c p join c q on p.src = q.dst and p.dst = q.src group by 1)"""


@query(f"{_HANDED} select id, point as component from k")
def scc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of a graph that has a node for every part."""
    return traverse.strong_components(star.handovers(spark, sf_dir))


#: The layer of each part, as common table expressions.
LAYERS_SQL = f"""
{_HANDED}, ids as (select src as id from h union select dst from h),
m as (select id, coalesce(point, id) as point from ids left join k using (id)),
d as (select distinct a.point as src, b.point as dst from h join m a on h.src = a.id join m b on h.dst = b.id where a.point <> b.point),
w(point, depth) as (select point, 0 from m union select d.dst, depth + 1 from w join d on d.src = w.point),
lay as (select id, max(depth)::int as layer from m join w using (point) group by 1)"""


@query(f"{LAYERS_SQL} select id, layer from lay")
def layers_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.layers(star.handovers(spark, sf_dir))


@query(f"""
with recursive {HANDOVERS_SQL}, s as (select 'part:' || p_partkey as id from part where p_size = 1),
walk as (select id, 0 as hops from s where id in (select src from h) or id in (select dst from h)
  union select h.dst, hops + 1 from walk join h on h.src = id where hops < 6)
select id, min(hops)::int as hops from walk group by 1
""")
def reach_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the smallest parts, many starts at once."""
    edges = star.handovers(spark, sf_dir)
    smallest = star.table(spark, sf_dir, "part").filter("p_size = 1").select(star.node_id("part", "p_partkey").alias("id"))
    ids = edges.select(F.col("src").alias("known")).union(edges.select("dst"))
    return traverse.reach(edges, smallest.join(ids, F.col("id") == F.col("known"), "left_semi"), depth=6)


@query(f"""
with {FACTS_SQL}, e as (select distinct src, dst from facts)
select id, i::bigint as fan_in, o::bigint as fan_out from (select dst as id, count(*) as i from e group by 1)
join (select src as id, count(*) as o from e group by 1) using (id) where i > 9 and o > 9
""")
def hub_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.hubs(star.trade(spark, sf_dir))


@query(f"""
{_CLOSURE}, starts as (select 'nation:' || n_nationkey as src from nation where n_regionkey = 1)
select dst as id from c join starts using (src) group by 1 having count(distinct src) = (select count(*) from starts)
""")
def on_every_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: what every nation of a region reaches."""
    starts = star.table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(star.node_id("nation", "n_nationkey").alias("id"))
    return traverse.reached_by_all(star.trade(spark, sf_dir), starts)


@query(f"""
with {TRADE_SQL}, m as (select 'nation:' || n_nationkey as id, n_regionkey as grp from nation),
n as (select grp, count(*) as n from m group by 1),
e as (select grp, count(*) as e from (select distinct least(src, dst) as a, greatest(src, dst) as b from t where src <> dst) x
  join m p on p.id = a join m q on q.id = b and q.grp = p.grp group by all)
select n.grp as region, n.n::bigint as members, coalesce(e, 0)::bigint as internal,
  case when n < 2 then 1 else round_even(coalesce(e, 0)::double / (n * (n - 1) / 2), 4) end::double as cohesion
from n left join (select grp, e from (select p.grp as grp, count(*) as e from (select distinct least(src, dst) as a, greatest(src, dst) as b from t where src <> dst) x
  join m p on p.id = a join m q on q.id = b and q.grp = p.grp group by 1)) e using (grp)
""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal edges of a group over all that it could have."""
    return derive.cohesion(star.trade(spark, sf_dir), _grouped(spark, sf_dir)).withColumnRenamed("grp", "region")


@query(f"""
with {TRADE_SQL}, d as (select id, count(*) as degree from (select src as id from t union all select dst from t) group by 1)
select n_regionkey as region, min_by('nation:' || n_nationkey, (-coalesce(degree, 0), 'nation:' || n_nationkey)) as anchor
from nation left join d on id = 'nation:' || n_nationkey group by 1
""")
def anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of most connections in each group, ties by id."""
    return derive.anchors(star.trade(spark, sf_dir), _grouped(spark, sf_dir)).withColumnRenamed("grp", "region")


@query(f"""
with {EDGES_SQL}
select file, line, count(*)::bigint as n, line = 1 as whole from edges group by file, line order by whole, file, line
""")
def evidence_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation of the graph in the order that puts whole files last (line 1 stands
    in for a whole file here), by ``whole``, ``file`` and ``line``: a range sort, so no
    task holds all rows."""
    sites = star.edges(spark, sf_dir).groupBy("file", "line").agg(F.count("*").alias("n"))
    start = F.when(F.col("line") == 1, 0).otherwise(F.col("line"))
    key = evidence_order(F.struct(F.col("file"), start.alias("start_line"), F.col("line").alias("end_line"), F.lit(None).cast("string").alias("rev")))
    return sites.orderBy(key).select("file", "line", "n", (F.col("line") == 1).alias("whole"))
