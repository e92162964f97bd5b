"""Registered queries over lines, exports, attributes, drawings and widths of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions import width
from evgraph.operators import build, deploy, duplicates, layout, resolve, traverse
from evgraph.plans.graph_queries import LAYERS_SQL
from evgraph.plans.registry import query
from evgraph.sources import star
from evgraph.sources.star import LINES_SQL, LISTINGS_SQL

_OPENS = """
case when starts_with(line, '/*') then case when not contains(line[3:], '*/') then '*/' end
     when line[:3] in ('\"\"\"', repeat(chr(39), 3)) then case when len(line) - len(replace(line, line[:3], '')) = 3 then line[:3] end
     when (starts_with(line, 'import (') or starts_with(line, 'from ')) and ends_with(line, '(') then ')'
     when (starts_with(line, 'import {') or starts_with(line, 'import type {') or starts_with(line, 'export {')) and ends_with(line, '{') then '}' end"""
_COUNTS = r"""
not regexp_matches(line, '^(#|//|/\*|\*|import |from |package |using |require\()') and regexp_matches(line, '[\p{L}\p{N}]')
and line[:3] not in ('""" + '"""' + r"""', repeat(chr(39), 3))"""


@query(f"""
with recursive {LISTINGS_SQL}, l as (
  select path, i, line, {_OPENS} as opens, {_COUNTS} as counts
  from (select path, i, w[i] as line from (select *, unnest(range(1, len(w) + 1)) as i from files))
), s as (
  select path, 0::bigint as i, null::varchar as closer, false as kept from files
  union all
  select l.path, l.i, case when s.closer is null then l.opens when not contains(l.line, s.closer) then s.closer end, s.closer is null and l.counts
  from s join l on l.path = s.path and l.i = s.i + 1
)
select path, i::int as n, line from s join l using (path, i) where kept
""")
def counted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside comments, docstrings and imports, by a fold over each file."""
    found = star.listings(spark, sf_dir).select("path", F.explode(duplicates.counted_lines(F.col("text"))).alias("x"))
    return found.select("path", "x.n", "x.line")


@query(rf"""
with recursive {LINES_SQL}, c as (
  select *, row_number() over (partition by doc_id order by n) - 1 as i from (
    select doc_id, n + 1 as n, trim(regexp_replace(line, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g')) as line from l)
  where {_COUNTS} and {_OPENS} is null
), win as (
  select doc_id, i, n, lead(n, 9) over w as last, case when lead(n, 9) over w is not null then string_agg(line, chr(10)) over (w rows between current row and 9 following) end as body
  from c window w as (partition by doc_id order by i)
), r as (
  select row_number() over (order by doc_id, i) as k, * from (select *, count(*) over (partition by body) as times from win where body is not null) where times > 1
), same as (  -- windows that are alike, and how far each pair goes on alike
  select a.k, a.i, b.k as k2, b.doc_id as d2, b.i as i2, a.doc_id as d, b.i - a.i as gap
  from r a join r b on a.body = b.body where a.k = b.k or a.doc_id <> b.doc_id or abs(a.i - b.i) >= 10
), runs as (
  select *, i - row_number() over (partition by d, d2, gap order by i) as run from same
), far as (
  select *, max(i) over (partition by d, d2, gap, run) - i as more from runs
), lead as (
  select k, any_value(d) as d, any_value(i) as i, count(*) as places, min(more) + 10 as length, list(k2) as at from far group by k having count(*) > 1
), spread as (  -- the windows that a block would cover
  select f.k, list(distinct r.k) as covers from far f join lead using (k) join r on r.doc_id = f.d2 and r.i >= f.i2 and r.i < f.i2 + lead.length group by f.k
), g as (
  select row_number() over (order by k) as step, * from lead join spread using (k)
), s as (
  select 0::bigint as step, []::bigint[] as covered, false as leads
  union all
  select g.step, case when list_contains(s.covered, g.k) then s.covered else list_concat(s.covered, g.covers) end, not list_contains(s.covered, g.k)
  from s join g on g.step = s.step + 1
)
select g.d as leader, g.i::int as leader_i, g.length::int as length, g.places::bigint as places, a.doc_id as id, a.n::int as start_line, b.last::int as end_line
from s join g using (step) join far f on f.k = g.k join r a on a.k = f.k2 join r b on b.doc_id = a.doc_id and b.i = a.i + g.length - 10
where leads
""")
def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated blocks of ten lines or more in all texts, greedily grown and covered."""
    return duplicates.blocks(star.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
with recursive files as (
  select 'nation/' || n_nationkey as file, n_regionkey as r, n_nationkey as n from nation
), stars as (  -- each nation brings all names of two others, and one of each customer segment by name
  select a.file, 'nation/' || ((a.n * 7 + 3) % 25) as to_file, 10 as line from files a
  union all select file, 'nation/' || ((n * 3 + 1) % 25), 20 from files where n % 2 = 0
), named as (
  select file, 'S' || (n % 4) as name, 'nation/' || ((n + 5) % 25) as to_file, 'S' || ((n + 1) % 4) as to_name, 15 as line from files where n % 3 = 0
), tops as (
  select distinct 'nation/' || s_nationkey as path, 'S' || (s_suppkey % 50) as name from supplier
), w as (
  select distinct 'nation/' || c_nationkey as file, 'S' || (c_custkey % 50) as name from customer
), steps as (
  select file, name, to_file, to_name, line from named union all select file, null, to_file, null, line from stars
), s as (
  select file, name, file as here, name as as_, []::int[] as way, 0 as deep from w
  union all
  select s.file, s.name, e.to_file, coalesce(e.to_name, as_), list_append(way, e.line), deep + 1
  from s join steps e on e.file = s.here and (e.name is null or e.name = as_)
  where deep < 4 and (s.here, as_) not in (select path, name from tops)
)
select file, name, b[2] as "at", b[3] as "as" from (
  select file, s.name as name, min((way, here, as_)) as b from s join tops on path = here and tops.name = as_ group by 1, 2)
""")
def star_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that customers ask for, looked up through files that bring all names of others."""
    t = lambda name: star.table(spark, sf_dir, name)
    file = lambda key: F.concat(F.lit("nation/"), key.cast("string"))
    named = lambda key: F.concat(F.lit("S"), key.cast("string"))
    n = F.col("n_nationkey")
    nations = t("nation").select(file(n).alias("file"), "n_nationkey")
    first = nations.select("file", file((n * 7 + 3) % 25).alias("to_file"), F.lit(10).alias("line"))
    stars = first.unionByName(nations.filter(n % 2 == 0).select("file", file((n * 3 + 1) % 25).alias("to_file"), F.lit(20).alias("line")))
    by_name = nations.filter(n % 3 == 0).select("file", named(n % 4).alias("name"), file((n + 5) % 25).alias("to_file"), named((n + 1) % 4).alias("to_name"), F.lit(15).alias("line"))
    tops = t("supplier").select(file(F.col("s_nationkey")).alias("path"), named(F.col("s_suppkey") % 50).alias("name")).distinct()
    asked = t("customer").select(file(F.col("c_nationkey")).alias("file"), named(F.col("c_custkey") % 50).alias("name"))
    return resolve.search_exports(asked, by_name, stars, tops)


@query(f"""
{LAYERS_SQL}
select case when turned then dst else src end as low, case when turned then src else dst end as high, src, dst, turned from (
  select src, dst, (a.layer, src) > (b.layer, dst) as turned from h join lay a on a.id = src join lay b on b.id = dst where src <> dst)
""")
def turned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the part graph turned to run down its layers, those of cycles by id."""
    steps = star.handovers(spark, sf_dir)
    return layout.oriented(steps, traverse.layers(steps))


_ATTRIBUTES = """
f as (
  select 'part:' || l_partkey as src, 'supplier:' || l_suppkey as dst, 'supply' as kind, l_orderkey * 10 + l_linenumber as fact,
    'orders/' || l_orderkey as file, l_linenumber::int as start_line, l_linenumber::int as end_line,
    l_returnflag as flag, case when l_tax < 0.06 then 'true' else 'false' end as type_only, case when l_discount > 0.05 then l_linestatus end as status from lineitem
), c as (
  select src, dst, kind, count(distinct fact) as facts, count(distinct (file, start_line, end_line)) as sites, string_agg(distinct flag, ',' order by flag) as flag,
    string_agg(distinct status, ',' order by status) as status, bool_and(type_only = 'true') as type_only, min(type_only) as own from f group by 1, 2, 3
)"""


def _supply_facts(spark: SparkSession, sf_dir: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Line items as facts that a part comes from a supplier, with attributes of theirs.
    ``keys`` names columns whose numbers stand for ``src``, ``dst`` and ``file``."""
    items = star.table(spark, sf_dir, "lineitem")
    pairs = F.array(
        F.struct(F.lit("flag").alias("k"), F.col("l_returnflag").alias("v")),
        F.struct(F.lit("type_only").alias("k"), F.when(F.col("l_tax") < 0.06, "true").otherwise("false").alias("v")),
        F.when(F.col("l_discount") > 0.05, F.struct(F.lit("status").alias("k"), F.col("l_linestatus").alias("v"))),
    )
    attrs = F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))
    line = F.col("l_linenumber").cast("int")
    named = {"src": star.node_id("part", "l_partkey"), "dst": star.node_id("supplier", "l_suppkey"), "file": F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"))}
    named |= {to: F.col(key) for to, key in (keys or {}).items()}
    return items.select(
        named["src"].alias("src"), named["dst"].alias("dst"), F.lit("supply").alias("kind"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), named["file"].alias("file"),
        line.alias("start_line"), line.alias("end_line"), attrs.alias("attrs"),
    )


@query(f"""
with {_ATTRIBUTES}
select src, dst, kind, case when facts = 1 then 'flag=' || flag || coalesce(';status=' || status, '') || ';type_only=' || own
  else 'flag=' || flag || ';sites=' || sites || coalesce(';status=' || status, '') || case when type_only then ';type_only=true' else '' end end as attrs
from c
""")
def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all facts of an edge say of it, by a rule for each attribute."""
    # Keys stay numbers until edges are merged, so less is exchanged.
    keys = {"src": "l_partkey", "dst": "l_suppkey", "file": "l_orderkey"}
    facts = _supply_facts(spark, sf_dir, keys)
    merged = build.merge_attributes(facts)[0].withColumns({"src": star.node_id("part", "src"), "dst": star.node_id("supplier", "dst")})
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    return merged.select("src", "dst", "kind", shown.alias("attrs"))


@query(f"""
with {_ATTRIBUTES}
select src, dst, kind, file, start_line, end_line, (row_number() over (partition by src, dst, kind order by start_line = 0, file, start_line, end_line))::int as nth
from (select distinct src, dst, kind, file, start_line, end_line from f)
""")
def merged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation of an edge once, in canonical order."""
    return build.merge_attributes(_supply_facts(spark, sf_dir))[1]


@query("""
with e as (select distinct c_mktsegment || (c_custkey % 40) as name, case when c_acctbal > 9000 then 'filename' when c_acctbal > 8500 then 'dockerfile' else 'workflow' end as source, 'nation/' || c_nationkey as file from customer),
s as (select 'supplier:' || s_suppkey as id, 'nation/' || s_nationkey as file, case when s_acctbal > 0 then 'nation/' || ((s_nationkey + 1) % 25) end as dockerfile from supplier)
select distinct name, id as service from e join s on (source = 'filename' and e.file = s.file) or (source = 'dockerfile' and e.file = s.dockerfile)
""")
def environment_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that an environment's files define or that images of them are built from."""
    nation = lambda key: F.concat(F.lit("nation/"), key.cast("string"))
    balance = F.col("c_acctbal")
    source = F.when(balance > 9000, "filename").when(balance > 8500, "dockerfile").otherwise("workflow")
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    environments = star.table(spark, sf_dir, "customer").select(name.alias("name"), source.alias("source"), nation(F.col("c_nationkey")).alias("file"))
    built = F.when(F.col("s_acctbal") > 0, nation((F.col("s_nationkey") + 1) % 25))
    services = star.table(spark, sf_dir, "supplier").select(star.node_id("supplier", "s_suppkey").alias("id"), nation(F.col("s_nationkey")).alias("file"), built.alias("dockerfile"))
    return deploy.environment_overlays(environments, services)[1]


_NONE, _TWO = width.classes()


@query(rf"""
with t as (select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title from pages), c as (
  select *, length(regexp_replace(title, '{_NONE}', '', 'g')) + length(title) - length(regexp_replace(title, '{_TWO}', '', 'g')) as cells from t
), w as (
  select *, ceil((cells * 12)::double * 0.62::double)::int as advance from c
)
select page_id, cells::int as cells, advance, case when advance <= 160 then title else '…' || right(title, floor((160 - 8) / (12 * 0.62))::int) end as shown
from w
""")
def label_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and pixels of page titles, and the end of those that are too wide."""
    titles = star.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    title = F.col("title")
    return titles.select("page_id", width.cells(title).alias("cells"), width.advance(title, 12).alias("advance"), width.truncate(title, 12, 160).alias("shown"))
