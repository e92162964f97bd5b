"""Resolution, design and snapshot operators over the star schema: its rows stand for
files, definitions, calls and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.extract import python_facts
from evgraph.operators import assemble, components, deploy, design, lock, resolve, styles
from evgraph.plans.registry import query
from evgraph.schema import module_of
from evgraph.sources import star
from evgraph.sources.star import FACTS_SQL, PATHS_SQL
from evgraph.storage import stage

_PLACES = """
place as (select n_nationkey, replace(lower(r_name), ' ', '_') as pack, replace(lower(n_name), ' ', '_') as name from nation join region on n_regionkey = r_regionkey),
packed as (select pack || '/__init__.py' as path from place union select pack || '/' || name || '.py' from place),
asked as (
  select distinct 'shop/s' || s_suppkey || '.py' as path, a.pack || '.' || b.name as spec, 0 as level from lineitem join supplier on l_suppkey = s_suppkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join place a on a.n_nationkey = s_nationkey join place b on b.n_nationkey = c_nationkey
  union select a.pack || '/c' || c_custkey || '.py', b.name, 1 from customer join place a on a.n_nationkey = c_nationkey join place b on b.n_nationkey = c_custkey % 25
  union select a.pack || '/c' || c_custkey || '.py', '', 1 from customer join place a on a.n_nationkey = c_nationkey)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    regions = star.table(spark, sf_dir, "region").select("r_regionkey", plain("r_name").alias("pack"))
    return star.table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "pack", plain("n_name").alias("name"))


@query(f"""
with {_PLACES}, tried as (
  select *, case when level = 0 then replace(spec, '.', '/') else regexp_extract(path, '^(.*)/[^/]*$', 1) || case when spec = '' then '' else '/' || spec end end as stem from asked)
select t.path, spec, level::int as level, coalesce(f.path, p.path) as target from tried t left join packed f on f.path = stem || '.py' and spec <> '' left join packed p on p.path = stem || '/__init__.py'
where f.path is not null or p.path is not null
""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import the nations of those who buy from them, as modules of their own
    region; customers import beside themselves."""
    place = _places(spark, sf_dir)
    files = place.select(F.concat("pack", F.lit("/__init__.py")).alias("path")).union(place.select(F.concat("pack", F.lit("/"), "name", F.lit(".py")))).distinct()
    sold = star.trade_facts(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("dst"))
    items = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_suppkey")
    of = sold.join(items, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") == F.col("n"))).select("l_suppkey", F.col("dst").alias("buyer")).distinct()
    suppliers = star.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    a, b = place.select(F.col("n_nationkey").alias("a_key"), F.col("pack").alias("a_pack")), place.select(star.node_id("nation", "n_nationkey").alias("b_id"), F.col("name").alias("b_name"))
    far = of.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(a, F.col("s_nationkey") == F.col("a_key")).join(b, F.col("buyer") == F.col("b_id"))
    far = far.select(F.concat(F.lit("shop/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.concat_ws(".", "a_pack", "b_name").alias("spec"), F.lit(0).alias("level"))
    customers = star.table(spark, sf_dir, "customer").join(a, F.col("c_nationkey") == F.col("a_key"))
    own = F.concat("a_pack", F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path")
    other = place.select(F.col("n_nationkey").alias("o_key"), F.col("name").alias("o_name"))
    near = customers.join(other, F.col("c_custkey") % 25 == F.col("o_key")).select(own, F.col("o_name").alias("spec"), F.lit(1).alias("level"))
    whole = customers.select(own, F.lit("").alias("spec"), F.lit(1).alias("level"))
    asked = far.unionByName(near).unionByName(whole).distinct()
    return assemble.modules_named(asked, files, resolve.import_tops(files))


def _facts(rows: DataFrame, fact: str, **given: Column) -> DataFrame:
    """Rows as facts, null where a fact says nothing."""
    kinds = dict(c.strip().split(" ") for c in python_facts.SCHEMA.split(","))
    given = {"fact": F.lit(fact)} | given
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in python_facts.COLUMNS])


_CALLS = """
parts as (select p_partkey, replace(p_brand, '#', '') || '_' || p_size as name from part),
defs as (select 'lib/p' || p_partkey || '.py' as path, name, 'lib/p' || p_partkey || '.py#lib.p' || p_partkey || '.' || name as id from parts
  union all select 'shop/s' || s_suppkey || '.py', name, 'shop/s' || s_suppkey || '.py#shop.s' || s_suppkey || '.' || name from supplier join parts on p_partkey = s_suppkey),
calls as (select distinct 'shop/s' || l_suppkey || '.py' as src, name from lineitem join parts on l_partkey = p_partkey),
n as (select name, count(*) as n from defs group by 1)"""


@query(f"""
with {_CALLS}, own as (select src, c.name, id from calls c join defs d on d.path = c.src and d.name = c.name)
select src, id as dst, 'resolved' as resolution, 1::int as arity from own
union all select src, id, case when n = 1 then 'resolved' else 'candidate' end, n::int from calls c join n using (name) join defs d using (name)
where n <= 8 and not exists (select 1 from own where own.src = c.src and own.name = c.name)
""")
def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls of what their parts define: in the file itself, else the one
    definition of the name, else up to eight candidates."""
    name = F.concat_ws("_", F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string"))
    parts = star.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    path = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"), F.lit(".py"))
    own = star.table(spark, sf_dir, "supplier").join(parts, F.col("s_suppkey") == F.col("p_partkey")).select(path("shop/s", "s_suppkey").alias("path"), "name")
    defined = parts.select(path("lib/p", "p_partkey").alias("path"), "name").unionByName(own)
    called = star.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(path("shop/s", "l_suppkey").alias("path"), "name", F.col("l_linenumber").alias("line"))
    blank, one = F.lit(""), F.lit(1)
    symbols = _facts(defined, "symbol", path=F.col("path"), name=F.col("name"), qualified_name=F.col("name"), kind=F.lit("function"), start_line=one, end_line=one, enclosing=blank, enclosing_class=blank)
    calls = _facts(called, "call", path=F.col("path"), name=F.col("name"), shape=F.lit("bare"), receiver=blank, start_line=F.col("line"), end_line=F.col("line"), enclosing=blank, enclosing_class=blank)
    files = defined.select("path").union(called.select("path")).distinct().select("path", F.lit("python").alias("lang"), one.alias("line_count"))
    made = assemble.graph(files, symbols.unionByName(calls))
    return made.edges.filter("kind = 'calls'").select("src", "dst", "resolution", "arity").distinct()


_MODULES = """
om as (select o_orderkey, 'n' || (c_nationkey % 6) || '/' || case o_orderpriority when '1-URGENT' then 'api' when '2-HIGH' then 'services/x' || (o_custkey % 3)
  when '3-MEDIUM' then 'db' when '4-NOT SPECIFIED' then 'Features/f' || (o_custkey % 4) else 'utils' end as module from orders join customer on o_custkey = c_custkey),
ms as (select distinct module from om),
dep as (select distinct a.module as src, b.module as dst from om a join om b on b.o_orderkey = a.o_orderkey + 1 where a.module <> b.module)"""
_quoted = lambda x: "'" + x + "'"
_PARTS_SQL = ", ".join(f"('{s}', '{p}', {rank}, {sliced}, {alone}, {entry}, [{', '.join(map(_quoted, names))}])" for s, _, p, rank, sliced, alone, entry, _, names, _ in styles.part_rows())
_PLACED = f"""
{_MODULES}, part_of(style, part, rank, sliced, alone, entry, names) as (values {_PARTS_SQL}),
nm as (select style, part, rank, sliced, unnest(names) as name from part_of),
seg as (select module, string_split(lower(module), '/') as s from ms), sp as (select module, s, unnest(range(1, len(s) + 1)) as i from seg),
ht as (select module, s, style, part, rank, sliced, max(i) as loc from sp join nm on s[i] = name group by all),
neutral as (select module, style from seg, (select distinct style from nm) z where s[len(s)] in ({', '.join(map(_quoted, styles.NEUTRAL))}) and not exists (select 1 from nm where nm.style = z.style and name = s[len(s)])),
asg as (select module, style, max_by({{'part': part, 'rank': rank, 'slice': case when sliced and loc < len(s) then s[loc + 1] end}}, (case when loc = len(s) then 3 else 2 end, -rank)) as b
  from ht where not exists (select 1 from neutral k where k.module = ht.module and k.style = ht.style) group by 1, 2),
pr as (select x.style, src, dst, x.b as a, y.b as b, p.alone, q.entry, string_split(dst, '/') as d from dep join asg x on x.module = src join asg y on y.module = dst and y.style = x.style
  join part_of p on p.style = x.style and p.part = x.b.part join part_of q on q.style = y.style and q.part = y.b.part),
jd as (select style, src, dst, case
  when b.rank < a.rank or (style, a.part, b.part) in ({', '.join(map(str, styles.FORBIDDEN))}) then 'layer-direction'
  when a.part = b.part and alone and a.slice <> b.slice then 'part-independence'
  when entry and b.slice is not null and (a.part <> b.part or a.slice is distinct from b.slice)
    and dst <> array_to_string(d[1:list_position(list_transform(d, lambda z: lower(z)), b.slice)], '/') then 'public-entry' end as rule from pr)"""


def _design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Modules, where they are placed, judged dependencies, and the parts."""
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = star.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    text = lambda c: c.cast("string")
    inner = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "api")
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("services/x"), text(F.col("o_custkey") % 3)))
        .when(F.col("o_orderpriority") == "3-MEDIUM", "db")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("Features/f"), text(F.col("o_custkey") % 4)))
        .otherwise("utils")
    )
    at = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("n"), text(F.col("c_nationkey") % 6), F.lit("/"), inner).alias("module"))
    at = stage(at, "order-modules")
    after = at.select((F.col("o_orderkey") - 1).alias("k"), F.col("module").alias("dst"))
    deps = at.join(after, F.col("o_orderkey") == F.col("k")).select(F.col("module").alias("src"), "dst").filter("src <> dst").distinct()
    modules = stage(at.select(F.lit("").alias("unit"), "module").distinct(), "modules")
    parts = styles.parts(spark)
    assigned = stage(design.placed(modules, parts), "placed")
    return modules, assigned, stage(design.judged(deps, assigned, parts, styles.forbidden(spark)), "judged"), parts


@query(f"with {_PLACED} select style, module, b.part as part, b.slice as slice from asg")
def style_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(spark, sf_dir)[1].select("style", "module", "part", "slice")


@query(f"with {_PLACED} select style, src, dst, rule from jd where rule is not null")
def design_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(spark, sf_dir)[2].filter("rule is not null").select("style", "src", "dst", "rule")


@query(f"""
with {_PLACED}, cv as (select a.style, count(*) as weight, count(distinct b.part) as filled, (select count(*) from ms) - (select count(*) from neutral k where k.style = a.style) as scored from asg a group by 1),
cp as (select style, 1 - count(rule)::double / count(*) as compliance from jd group by 1)
select style, round(case when filled >= 2 then weight::double / scored else 0 end, 6) as coverage, round(coalesce(compliance, 1), 6) as compliance from cv left join cp using (style)
""")
def design_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, assigned, checked, parts = _design(spark, sf_dir)
    return design.fits(modules, assigned, checked, None, parts).select("style", F.round("coverage", 6).alias("coverage"), F.round("compliance", 6).alias("compliance"))


@query("""
with r as (
  select 'module' as kind, 'nation/' || n_name as fields from nation
  union select 'dep', 'nation/' || n_name || chr(9) || 'segment/' || c_mktsegment from customer join nation on c_nationkey = n_nationkey
  union select 'service', s_name from supplier
  union select 'endpoint', p_brand || ' /' || p_name || chr(9) || 'part/' || p_size from part
  union select 'entrypoint', c_name || chr(9) || 'nation/' || n_name from customer join nation on c_nationkey = n_nationkey where c_custkey % 25 < 20
  union select 'role', 'nation/' || n_name || chr(9) || lower(r_name) from nation join region on n_regionkey = r_regionkey
  union select 'environment', event_type from events)
select kind, kind || chr(9) || fields as line from r
""")
def lock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of seven kinds as the lines of a snapshot."""
    t = lambda n: star.table(spark, sf_dir, n)
    nations = t("nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("nation/"), "n_name").alias("module"))
    bought = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    deps = bought.select(F.col("module").alias("src"), F.concat(F.lit("segment/"), "c_mktsegment").alias("dst"))
    nodes = t("supplier").select(F.lit("service").alias("kind"), F.col("s_name").alias("label"))
    routes = t("part").select(F.col("p_brand").alias("method"), F.concat(F.lit("/"), "p_name").alias("route"), F.concat(F.lit("part/"), F.col("p_size").cast("string"), F.lit("/r.py")).alias("path"))
    points = bought.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 25 < 20, F.col("module")).otherwise("no/where").alias("module"))
    roles = nations.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("module", F.lower("r_name").alias("role"))
    found = lock.facts_of(nations.select("module"), deps, nodes, routes, points, roles, t("events").select(F.col("event_type").alias("name")))
    return lock.render(found).select(F.substring_index("value", "\t", 1).alias("kind"), F.col("value").alias("line"))


@query(f"""
with {PATHS_SQL}, m as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as module from p),
c as (select distinct array_to_string(string_split(module, '/')[1:1], '/') as context from m union select '')
select context as id, module from c join m on context = '' or module = context or starts_with(module, context || '/')
""")
def modules_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories inside what is built: every host, and the root."""
    modules = star.paths(spark, sf_dir).select(module_of(F.col("path")).alias("module")).distinct()
    hosts = modules.select(F.substring_index("module", "/", 1).alias("context")).union(spark.createDataFrame([("",)], "context string")).distinct()
    return deploy.modules_under(hosts.select(F.col("context").alias("id"), "context"), modules)


@query(f"""
with {FACTS_SQL}, g as (select 'nation:' || n_nationkey as id, n_regionkey as r from nation)
select 'r' || a.r as module, 'r' || a.r || '/' || src as src, 'r' || b.r || '/' || dst as dst, count(distinct (l_orderkey, l_linenumber))::bigint as weight
from facts join g a on a.id = src join g b on b.id = dst where a.r = b.r and src <> dst group by 1, 2, 3
""")
def component_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of their regions, line items as calls between them."""
    nations = star.table(spark, sf_dir, "nation").select(star.node_id("nation", "n_nationkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"))
    named = nations.select("id", F.concat_ws("/", "r", "id").alias("path"))
    a, b = named.toDF("a_id", "src"), named.toDF("b_id", "dst")
    facts = star.trade_facts(spark, sf_dir).withColumnsRenamed({"src": "s", "dst": "d"}).join(a, F.col("s") == F.col("a_id")).join(b, F.col("d") == F.col("b_id"))
    edges = facts.select("src", "dst", F.lit("calls").alias("kind"), F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    return components.flow(named.select("path"), edges).edges


@query("""
with r as (select 'part/' || p_size as module, p_brand || ' /' || p_name as said from part),
d as (select module, said, row_number() over (partition by module order by said) as nth, count(*) over (partition by module) as k from (select distinct module, said from r)),
f as (select module, string_agg(said, ', ' order by said) as few, max(k) > 3 as further from d where nth <= 3 group by 1),
c as (select module, count(*) as n from r group by 1)
select 'Entry points' as card, c.module || ': ' || n || case when n = 1 then ' route' else ' routes' end || ' · ' || few || case when further then ' …' else '' end as item, n::bigint as n from c join f using (module)
union all select 'Data stores', c_mktsegment || ' via ' || n_name, count(*)::bigint from customer join nation on c_nationkey = n_nationkey group by 2
union all select 'Data stores', s_name || ' (compose)', 1::bigint from supplier
union all select 'Unresolved', event_type || ': ' || count(*) || ' unresolved', count(*)::bigint from events group by event_type
""")
def repository_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repository is, summed up: parts as routes, segments and suppliers as stores."""
    t = lambda n: star.table(spark, sf_dir, n)
    routes = t("part").select(F.col("p_brand").alias("method"), F.concat(F.lit("/"), "p_name").alias("route"), F.concat(F.lit("part/"), F.col("p_size").cast("string"), F.lit("/r.py")).alias("path"))
    bought = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    stores = bought.select(F.lit("database").alias("category"), F.col("c_mktsegment").alias("label"), F.col("n_name").alias("package"))
    nodes = t("supplier").select(F.lit("datastore").alias("kind"), F.col("s_name").alias("label"))
    states = t("events").select(F.col("event_type").alias("kind"), F.lit("unresolved").alias("resolution"))
    none = spark.createDataFrame([], "name string, target string, lang string")
    return components.cards(routes, none, stores, nodes, states)


__all__ = ["call_targets", "component_flow", "design_breaches", "design_fits", "import_targets", "lock_facts", "modules_under", "repository_cards", "style_parts"]
