"""Checks, joins, differences and searches over texts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evgraph.functions import classify
from evgraph.functions import text as fn
from evgraph.operators import ask, derive, design, findings, health, joins, lock, semantics, traverse
from evgraph.plans.registry import query
from evgraph.sources import star
from evgraph.sources.star import FACTS_SQL, LINES_SQL, PATHS_SQL, TRADE_SQL

_SIZES = """
m as (select doc_id, lang, length(text) as chars, len(string_split(text, chr(10))) as lines,
  len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) as words,
  list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) as longest from documents),
v as (
  select doc_id, lang, 'large-file' as "check", chars as value, 30 as minutes, 'minor' as severity from m where chars > 1000
  union all select doc_id, lang, 'long-function', lines, 10, 'minor' from m where lines > 50
  union all select doc_id, lang, 'large-class', words, 60, 'major' from m where words > 47
  union all select doc_id, lang, 'complex-function', longest, 10 + longest - 10, 'major' from m where longest > 10)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return star.table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.char_length("text").alias("chars"),
        F.size(lines).alias("lines"),
        F.regexp_count("text", F.lit("[^ \t\r\n]+")).alias("words"),
        F.array_max(F.transform(lines, F.char_length)).alias("longest"),
    )


_METRICS = {"chars": "large-file", "lines": "long-function", "words": "large-class", "longest": "complex-function"}


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.exceeded(_sizes(spark, sf_dir), ["doc_id", "lang"], _METRICS, health.catalog(spark))


@query(f'with {_SIZES} select doc_id, "check", value::bigint as value, minutes::bigint as minutes, severity from v')
def function_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics of each text against the thresholds of four checks."""
    return _violations(spark, sf_dir).select("doc_id", "check", "value", "minutes", "severity")


@query(f"""
with {_SIZES} select v."check", count(*)::bigint as n, sum(minutes)::bigint as minutes, max(value)::bigint as worst from v group by 1
""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).groupBy("check").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"), F.max("value").alias("worst"))


_NCLOC = r"""
c as (select lang, sum(len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(replace(x, chr(9), ' '))),
  lambda x: x <> '' and not (starts_with(x, '#') or starts_with(x, '//') or starts_with(x, '/*') or starts_with(x, '*') or starts_with(x, '--'))))) as ncloc
  from documents group by 1)"""


@query(f"with {_NCLOC} select lang, ncloc::bigint as ncloc from c")
def ncloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum(health.code_lines(F.col("text")).cast("long")).alias("ncloc"))


@query(f"""
with {_SIZES}, {_NCLOC}, d as (select lang, sum(minutes) as debt from v group by 1)
select lang, ncloc::bigint as ncloc, debt::bigint as debt, case when r <= 0.05 then 'A' when r <= 0.1 then 'B' when r <= 0.2 then 'C'
  when r <= 0.5 then 'D' else 'E' end as rating
from (select lang, ncloc, coalesce(debt, 0) as debt, coalesce(debt, 0)::double / (ncloc * 30) as r from c left join d using (lang))
""")
def debt_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = _violations(spark, sf_dir).groupBy("lang").agg(F.sum("minutes").alias("d")).withColumnRenamed("lang", "l")
    joined = ncloc(spark, sf_dir).join(debt, F.col("lang") == F.col("l"), "left").select("lang", "ncloc", F.coalesce("d", F.lit(0)).alias("debt"))
    return joined.withColumn("rating", health.ratio_rating(F.col("debt"), F.col("ncloc")))


_SECRET = r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)[a-z_]*[ ]*[:=][ ]*[^ \t\n]{4,}"


_RULES = " union all ".join(f"select '{rule}' as rule, $r${pattern}$r$ as pattern" for rule, pattern in semantics.SECRETS)


@query(rf"""
with {LINES_SQL}, r as ({_RULES}),
f as (select doc_id, n, rule, regexp_extract(line, pattern, 1) as value from l, r where regexp_matches(line, pattern))
select doc_id, (n + 1)::int as line, rule from f where not regexp_matches(value, $p${semantics.PLACEHOLDER}$p$)
""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a secret, by rule; the value is never part of the result."""
    docs = star.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.lit("source").alias("role"))
    return semantics.secrets(docs).select(F.col("path").cast("long").alias("doc_id"), "line", "rule")


@query(rf"""
with {_SIZES}, s as (select doc_id from documents where regexp_matches(text, '{_SECRET}')), w as (
  select 'maintainability' as area, max(case severity when 'info' then 1 when 'minor' then 2 when 'major' then 3 when 'critical' then 4 else 5 end) as r from v
  union all select 'security', case when count(*) > 0 then 5 end from s)
select area, ['A', 'B', 'C', 'D', 'E'][coalesce(r, 1)] as grade
from (values ('maintainability'), ('reliability'), ('security'), ('performance')) a(area) left join w using (area)
""")
def area_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = star.table(spark, sf_dir, "documents").filter(F.col("text").rlike(_SECRET)).select(F.lit("security").alias("area"), F.lit("blocker").alias("severity"))
    return health.area_ratings(_violations(spark, sf_dir).select("area", "severity").unionByName(secrets), spark)


@query("""
select l_suppkey, l_partkey, sum(l_quantity::bigint)::bigint as wmc from lineitem group by 1, 2 having sum(l_quantity::bigint) > 47
""")
def class_wmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of an owner's members, summed, over the limit."""
    items = star.table(spark, sf_dir, "lineitem")
    return health.heavy(items, ["l_suppkey", "l_partkey"], F.col("l_quantity").cast("long")).withColumnRenamed("value", "wmc")


_WINDOWS = rf"""
{LINES_SQL}, g as (
  select doc_id, n, trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g')) as line from l
), k as (
  select doc_id, n, line, row_number() over (partition by doc_id order by n) - 1 as i from g
  where regexp_matches(line, '[\p{{L}}\p{{N}}]') and not regexp_matches(line, '^(#|//|/\*|\*|import |from |package |using |require\()')
), w as (
  select doc_id, i, md5(string_agg(line, chr(10)) over (partition by doc_id order by i rows between current row and 9 following)) as hash,
    count(*) over (partition by doc_id order by i rows between current row and 9 following) as c from k
), win as (select doc_id, i, hash from w where c = 10)"""


@query(f"""
with {_WINDOWS}
select hash, count(*)::bigint as places, count(distinct doc_id)::bigint as texts, min((doc_id, i))[1] as first_doc_id, min((doc_id, i))[2]::int as first_i
from win group by 1 having count(*) > 1
""")
def duplicated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.duplicated(health.windows(star.table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"""
with {_WINDOWS}, d as (select *, i - row_number() over (partition by doc_id order by i) as island from win
  where hash in (select hash from win group by 1 having count(*) > 1))
select doc_id, min(i)::int as start, (count(*) + 9)::bigint as length from d group by doc_id, island
""")
def duplicate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.duplicate_runs(health.windows(star.table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query("""
select l_partkey, count(distinct s_nationkey)::bigint as owners from lineitem join supplier on l_suppkey = s_suppkey
group by 1 having count(distinct s_nationkey) > 17
""")
def shared_datastore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources that more owners share than they should."""
    items, suppliers = (star.table(spark, sf_dir, t) for t in ("lineitem", "supplier"))
    used = items.select("l_partkey", "l_suppkey").join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return health.shared(used, "l_partkey", "s_nationkey", 17)


@query("""
select conv_id, turn from conversations u where role = 'user' and not exists (
  select 1 from conversations a where a.conv_id = u.conv_id and a.role = 'assistant' and a.turn between u.turn + 1 and u.turn + 2)
""")
def auth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with no marker in the lines that follow them."""
    turns = star.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    asked, told = turns.filter("role = 'user'"), turns.filter("role = 'assistant'")
    return joins.absent_within(asked, ["conv_id"], "turn", told, "turn", 2).select("conv_id", "turn")


@query(rf"with {LINES_SQL} select doc_id, n::int as n, regexp_extract(line, '(?i)^[ \t]*(licensed?|copyright)\b[ :]*(.*)$', 1) as kind, left(regexp_extract(line, '(?i)^[ \t]*(licensed?|copyright)\b[ :]*(.*)$', 2), 200) as said from l where regexp_matches(line, '(?i)^[ \t]*(licensed?|copyright)\b')")
def rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a marker opens; the markers are a parameter of the pattern."""
    return fn.marked(star.lines(spark, sf_dir), ["doc_id", "n"], "line", "licensed?|copyright")


_BANDS = [("all", 0, 10_000_000), ("low", 0, 50_000), ("mid", 50_001, 250_000), ("core", 100_000, 200_000), ("peak", 149_000, 151_000)]
_BANDS_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in _BANDS)


@query(f"""
with b(band, lo, hi) as (values {_BANDS_SQL})
select o_orderkey, arg_min(band, (hi - lo, band)) as band from orders left join b on o_totalprice between lo and hi group by 1
""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "band string, lo long, hi long")
    return joins.innermost(star.table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice", bands, "lo", "hi", "band")


_PREFIXES = f"""
{PATHS_SQL}, pre as (
  select page_id, len(s) - k as place, array_to_string(s[1:k], '/') as candidate from (
    select page_id, s, unnest(range(1, len(s) + 1)) as k from (select page_id, string_split(path, '/') as s from p))
)"""


@query(f"""
with {_PREFIXES}, known as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from p)
select page_id, min((place, candidate))[2] as candidate, min(place)::int as place from pre where candidate in (select dir from known) group by 1
""")
def priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a row's candidates, its shrinking prefixes, that exists."""
    paths = star.paths(spark, sf_dir)
    known = paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).distinct()
    return joins.first_candidate(paths, ["page_id"], joins.prefixes(F.col("path")), known, "dir")


@query(f"""
with {_PREFIXES}, known as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as dir from p)
select page_id, max((length(candidate), candidate))[2] as prefix from pre where candidate in (select dir from known) group by 1
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = star.paths(spark, sf_dir)
    known = paths.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("dir")).distinct()
    return joins.longest_prefix(paths, ["page_id"], F.col("path"), known, "dir").select("page_id", F.col("candidate").alias("prefix"))


#: Made-up places of parts as files, and what a few of them begin with.
_DIRS = ("src", "vendor/lib", "app/tests", "generated", ".github", "src/migrations", "app/__tests__", "lib/core", "docs", "third_party")
_NAMES = ("main.py", "view.ts", "table.sql", "package.json", "run_test.go", "api_pb2.py", "Cargo.toml", "lib.rs", "notes.txt", "deploy.tf", "settings-prod.yaml", "compose.yml")
_TEXTS = ("", "x = 1\ny = 2\n", "# Code generated by a tool. DO NOT EDIT.\nx = 1", "revision = 'a'\ndown_revision = 'b'\n", "no end")


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FILES = f"""
files as (
  select p_partkey, {_listed(_DIRS)}[p_size % {len(_DIRS)} + 1] || '/' || p_partkey || '/' || {_listed(_NAMES)}[p_partkey % {len(_NAMES)} + 1] as path,
    replace({_listed(tuple(t.replace(chr(10), '@') for t in _TEXTS))}[(p_partkey // 7) % {len(_TEXTS)} + 1], '@', chr(10)) as text from part
), g as (
  select *, string_split(path, '/')[:-2] as dirs, string_split(path, '/')[-1] as name, regexp_extract(path, '\\.([A-Za-z]+)$', 1) as ext,
    array_to_string(string_split(text, chr(10))[:5], chr(10)) as head from files
), k as (
  select *, map {{{', '.join(f"'{a}': '{b}'" for a, b in classify.LANGUAGES.items())}}}[ext] as lang,
    coalesce(map {{{', '.join(f"'{a}': '{b}'" for a, b in classify.CONFIG_NAMES.items())}}}[name],
      {', '.join(f"case when regexp_matches(path, $q${p}$q$) then '{v}' end" for p, v in classify.CONFIG_PATTERNS)}) as config
  from g
)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path``, ``text`` of a made-up file for each part."""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    key = F.col("p_partkey")
    path = F.concat_ws("/", pick(_DIRS, F.col("p_size")), key.cast("string"), pick(_NAMES, key))
    return star.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), pick(_TEXTS, F.floor(key / 7)).alias("text"))


@query(f"""
with {_FILES} select p_partkey, case
  when regexp_matches(path, '^\\.[^/]*/') then 'tooling' when list_has_any(dirs, {_listed(classify.VENDOR_DIRS)}) then 'vendored'
  when lang = 'sql' and list_has_any(dirs, {_listed(classify.GENERATED_DIRS)}) then 'config'
  when list_has_any(dirs, {_listed(classify.GENERATED_DIRS)}) or regexp_matches(name, $q${classify.GENERATED_FILE}$q$) then 'generated'
  when lang = 'python' and starts_with(text, 'revision') then 'generated'
  when list_has_any(dirs, {_listed(classify.TEST_DIRS)}) or regexp_matches(name, $q${classify.TEST_FILE}$q$) then 'test'
  when config is not null then 'config' when lang is not null and regexp_matches(head, $q${classify.BANNER}$q$) then 'generated' else 'source' end as role
from k
""")
def classify_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files are for, by their place, their name and how they begin."""
    return _files(spark, sf_dir).select("p_partkey", classify.role(F.col("path"), F.col("text")).alias("role"))


@query(f"""
with {_FILES} select p_partkey, lang, config, case when text = '' then 0 else len(text) - len(replace(text, chr(10), '')) + (not ends_with(text, chr(10)))::int end::int as lines,
  case when name = 'settings-prod.yaml' then 'production' end as environment from k
""")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, kind of settings, lines and environment of files."""
    path = F.col("path")
    return _files(spark, sf_dir).select(
        "p_partkey", classify.language(path).alias("lang"), classify.config_kind(path).alias("config"), classify.line_count(F.col("text")).alias("lines"),
        classify.environment_of_path(path).alias("environment"),
    )


#: Parts of a style by directory name: style, part, rank, name.
_PARTS = [("lingual", "front", 0, "en"), ("lingual", "middle", 1, "fr"), ("lingual", "middle", 1, "de"), ("lingual", "back", 2, "es"), ("nordic", "front", 0, "de"), ("nordic", "back", 1, "en")]
_PARTS_SQL = ", ".join(f"('{s}', '{p}', {r}, '{n}')" for s, p, r, n in _PARTS)
_ASSIGNED = f"""
{PATHS_SQL}, parts(style, part, rank, name) as (values {_PARTS_SQL}),
ms as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as module from p),
seg as (select module, s, unnest(range(1, len(s) + 1)) as i from (select module, string_split(module, '/') as s from ms)),
asg as (select module, style, max((case when i = len(s) then 3 else 2 end, -rank, part)) as b from seg join parts on lower(s[i]) = name group by 1, 2)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = star.paths(spark, sf_dir).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("module")).distinct()
    return design.assign(modules, "module", spark.createDataFrame(_PARTS, "style string, part string, rank int, name string"))


@query(f"with {_ASSIGNED} select module, style, b[3] as part, b[1]::int as score from asg")
def style_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)


_FORBIDDEN = """
ord(style, parts) as (values ('lingual', ['front', 'middle', 'back']), ('nordic', ['front', 'back'])),
forb as (select style, parts[j] as "from", parts[i] as "to" from ord, unnest(range(1, len(parts) + 1)) a(i), unnest(range(1, len(parts) + 1)) b(j) where j > i)"""


def _forbidden(spark: SparkSession) -> DataFrame:
    return design.forbidden_pairs(spark.createDataFrame([("lingual", ["front", "middle", "back"]), ("nordic", ["front", "back"])], "style string, parts array<string>"))


@query(f"""
with {_ASSIGNED}, {_FORBIDDEN}, n as (select style, b[3] as part, count(*) as n from asg group by 1, 2)
select f.style, f."from", f."to", a.n::bigint as from_modules, b.n::bigint as to_modules from forb f
join n a on a.style = f.style and a.part = f."from" join n b on b.style = f.style and b.part = f."to"
""")
def design_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that styles forbid between parts that modules play, and how many play them."""
    played = _assigned(spark, sf_dir).groupBy("style", "part").agg(F.count("*").alias("n"))
    a, b = (played.select(F.col("style").alias(f"{k}_style"), F.col("part").alias(f"{k}_part"), F.col("n").alias(f"{k}_modules")) for k in ("from", "to"))
    rules = _forbidden(spark).join(a, (F.col("style") == F.col("from_style")) & (F.col("from") == F.col("from_part")))
    return rules.join(b, (F.col("style") == F.col("to_style")) & (F.col("to") == F.col("to_part"))).select("style", "from", "to", "from_modules", "to_modules")


_DEPS = """
dep as (select a.module as src, b.module as dst from ms a join ms b on split_part(a.module, '/', 1) = split_part(b.module, '/', 1) and a.module <> b.module)"""


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of one host depend on each other: a few per host."""
    modules = star.paths(spark, sf_dir).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("module")).distinct()
    a, b = (modules.select(F.col("module").alias(n), F.substring_index("module", "/", 1).alias(f"{n}_host")) for n in ("src", "dst"))
    return a.join(b, (F.col("src_host") == F.col("dst_host")) & (F.col("src") != F.col("dst"))).select("src", "dst")


@query(f"""
with {_ASSIGNED}, {_FORBIDDEN}, {_DEPS}
select f.style, f."from", f."to", src, dst from dep join asg a on a.module = src join asg b on b.module = dst and a.style = b.style
join forb f on f.style = a.style and f."from" = a.b[3] and f."to" = b.b[3]
""")
def layer_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.wrong_way(_deps(spark, sf_dir), _assigned(spark, sf_dir), "module", _forbidden(spark)).select("style", "from", "to", "src", "dst")


@query(f"""
with {_ASSIGNED}, {_FORBIDDEN}, {_DEPS}, cov as (select style, count(*)::double / (select count(*) from ms) as coverage from asg group by 1),
j as (select a.style, a.b[3] as f, b.b[3] as t from dep join asg a on a.module = src join asg b on b.module = dst and a.style = b.style where a.b[3] <> b.b[3]),
com as (select j.style, 1 - count(forb.style)::double / count(*) as compliance from j left join forb on forb.style = j.style and forb."from" = f and forb."to" = t group by 1)
select style, round_even(coverage, 4) as coverage, round_even(coalesce(compliance, 1), 4)::double as compliance,
  round_even(round_even(coverage, 4) * round_even(coalesce(compliance, 1), 4), 4)::double as fit
from cov left join com using (style)
""")
def style_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _assigned(spark, sf_dir)
    total = star.paths(spark, sf_dir).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("m")).agg(F.count_distinct("m").alias("n"))
    covered = assigned.crossJoin(F.broadcast(total)).groupBy("style").agg((F.count("*") / F.max("n")).alias("coverage"))
    shares = design.fit(assigned, _deps(spark, sf_dir), "module", F.lit(1), _forbidden(spark)).select("style", "compliance")
    whole = covered.join(shares, "style").withColumn("coverage", F.bround("coverage", 4))
    return whole.select("style", "coverage", "compliance", F.bround(F.col("coverage") * F.col("compliance"), 4).alias("fit"))


@query(f"""
with {TRADE_SQL}, d as (select id, count(*) as degree from (select src as id from t union all select dst from t) group by 1),
r as (select n_regionkey as region, 'nation:' || n_nationkey as id, coalesce(degree, 0) as degree,
  row_number() over (partition by n_regionkey order by coalesce(degree, 0) desc, 'nation:' || n_nationkey) as nth,
  count(*) over (partition by n_regionkey) as total from nation left join d on id = 'nation:' || n_nationkey)
select region, id, degree::bigint as degree, nth::int as nth, (total - 3)::bigint as more from r where nth <= 3
""")
def top_k_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most connected members of each stage, and how many more there are."""
    members = star.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), star.node_id("nation", "n_nationkey").alias("id"))
    known = members.join(derive.degrees(star.trade(spark, sf_dir)), F.col("id") == F.col("end"), "left").select("region", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    first, rest = derive.capped(known, ["region"], "degree", 3)
    nth = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("degree"), "id")).alias("nth")
    more = rest.toDF("r", "more")
    fewer = known.groupBy("region").agg((F.count("*") - 3).alias("left")).toDF("l", "left")
    joined = first.select("region", "id", "degree", nth).join(more, F.col("region") == F.col("r"), "left").join(fewer, F.col("region") == F.col("l"))
    return joined.select("region", "id", "degree", "nth", F.coalesce("more", "left").alias("more"))


_SPANS = "s as (select l_orderkey, l_linenumber, l_partkey as lane, date_diff('day', date '1990-01-01', l_shipdate::date) as lo, date_diff('day', date '1990-01-01', l_shipdate::date) + l_quantity::int % 5 as hi from lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    items = star.table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("lane"), day.alias("lo"), (day + F.col("l_quantity").cast("int") % 5).alias("hi"))


@query(f"with {_SPANS} select a.lane, count(*)::bigint as pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo))::bigint as shared from s a join s b on a.lane = b.lane and (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) and a.lo <= b.hi and b.lo <= a.hi group by 1")
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collinear segments that share a stretch, summed by line."""
    s = _spans(spark, sf_dir)
    pairs = joins.overlaps(s, s, ["lane"], "lo", "hi", 8.0)
    later = F.struct("a_l_orderkey", "a_l_linenumber") < F.struct("b_l_orderkey", "b_l_linenumber")
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    return pairs.filter(later).groupBy(F.col("a_lane").alias("lane")).agg(F.count("*").alias("pairs"), F.sum(shared).alias("shared"))


@query("""
with b as (select p_partkey as id, (p_partkey * 37 % 2000)::int as x1, (p_partkey * 37 % 2000 + p_size)::int as x2,
  (p_partkey * 91 % 1000)::int as y1, (p_partkey * 91 % 1000 + p_size)::int as y2 from part)
select a.id as a, c.id as b from b a join b c on a.id < c.id and a.x1 <= c.x2 and c.x1 <= a.x2 and a.y1 <= c.y2 and c.y1 <= a.y2
""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch: boxes of one place as one row, met by the cells of a grid."""
    x, y = (F.col("p_partkey") * 37 % 2000).cast("int"), (F.col("p_partkey") * 91 % 1000).cast("int")
    boxes = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x1"), (x + F.col("p_size")).alias("x2"), y.alias("y1"), (y + F.col("p_size")).alias("y2"))
    pairs = joins.unstacked(joins.pairs_within(joins.stacked(boxes, []), [], 64.0), [])
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


_CUT = "1998-01-01"
_RECORDS = f"""
base as (select distinct 'dep' as kind, 'c' || o_custkey as a, o_orderpriority as b from orders where o_orderdate < timestamp '{_CUT}'),
head as (select distinct 'dep' as kind, 'c' || o_custkey as a, o_orderpriority as b from orders where o_orderdate >= timestamp '{_CUT}')"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = star.table(spark, sf_dir, "orders")
    cols = [F.lit("dep").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.col("o_orderpriority").alias("b")]
    at = F.col("o_orderdate") < F.lit(_CUT).cast("timestamp")
    return orders.filter(at).select(*cols).distinct(), orders.filter(~at).select(*cols).distinct()


@query("""
select distinct 'module' as kind, 'nation/' || n_name as fields from nation
union select distinct 'dep', c_mktsegment || '|' || n_name from customer join nation on c_nationkey = n_nationkey
union select distinct 'role', n_name || '|' || r_name from nation join region on n_regionkey = r_regionkey
""")
def lock_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of several kinds as one set of records."""
    t = lambda n: star.table(spark, sf_dir, n)
    named = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    parts = [
        named.select(F.lit("module").alias("kind"), F.concat(F.lit("nation/"), "n_name").alias("fields")),
        t("customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("dep").alias("kind"), F.concat_ws("|", "c_mktsegment", "n_name").alias("fields")),
        named.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("role").alias("kind"), F.concat_ws("|", "n_name", "r_name").alias("fields")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query(f"with {_RECORDS} select *, 'added' as op from (select * from head except select * from base) union all select *, 'removed' from (select * from base except select * from head)")
def lock_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.diff(*_records(spark, sf_dir))


@query(f"""
with {_RECORDS} select 'added' as op, (select count(*) from (select * from head except select * from base))::bigint as n
union all select 'removed', (select count(*) from (select * from base except select * from head))::bigint
""")
def lock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = findings.diff(*_records(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"))
    both = spark.createDataFrame([("added",), ("removed",)], "name string")
    return both.join(counts, F.col("name") == F.col("op"), "left").select(F.col("name").alias("op"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, 'note' as kind, md5(text) as hash, cast(null as varchar) as error from documents where text is not null")
def lock_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as escaped fields and parsed back."""
    docs = star.table(spark, sf_dir, "documents").filter("text is not null")
    records = docs.select(F.lit("note").alias("kind"), F.array(F.col("doc_id").cast("string"), "text").alias("fields"))
    read = lock.parse(lock.render(records))
    return read.select(F.element_at("fields", 1).cast("long").alias("doc_id"), "kind", F.md5(F.element_at("fields", 2).cast("binary")).alias("hash"), "error")


_HALVES = """
f as (select event_id, event_type as "check", 'u' || (user_id % 20) as file, 'value ' || round(value)::bigint as message, ts from events),
b as (select * from f where ts < timestamp '2024-01-15'), h as (select * from f where ts >= timestamp '2024-01-15')"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = star.table(spark, sf_dir, "events")
    f = events.select(
        "event_id", F.col("event_type").alias("check"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("file"),
        fn.blank_digits(F.concat(F.lit("value "), F.round("value").cast("long").cast("string"))).alias("key"), "ts",
    )
    at = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return f.filter(at).drop("ts"), f.filter(~at).drop("ts")


_KEYED = """
bk as (select event_id, "check", file, regexp_replace(message, '[0-9]+', '#', 'g') as key from b),
hk as (select event_id, "check", file, regexp_replace(message, '[0-9]+', '#', 'g') as key from h)"""


@query(f"""
with {_HALVES}, {_KEYED}, c as (select "check", file, key, count(*) as n from bk group by all),
r as (select *, row_number() over (partition by "check", file, key order by event_id) as nth from hk)
select r.event_id, r."check", r.file, r.key from r left join c using ("check", file, key) where nth > coalesce(n, 0)
""")
def finding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _halves(spark, sf_dir)
    return findings.unmatched(head, base, ["check", "file", "key"], ["event_id"])


@query(f"""
with {_HALVES}, {_KEYED}, hn as (select * from hk where file <> 'u7'),
cb as (select "check", file, key, count(*) as n from bk group by all), ch as (select "check", file, key, count(*) as n from hn group by all),
new as (select r.* from (select *, row_number() over (partition by "check", file, key order by event_id) as nth from hn) r left join cb using ("check", file, key) where nth > coalesce(n, 0)),
fixed as (select r.* from (select *, row_number() over (partition by "check", file, key order by event_id) as nth from bk) r left join ch using ("check", file, key) where nth > coalesce(n, 0)),
gone as (select "check", key, count(*) as n from fixed where file = 'u7' group by all)
select event_id, "check", file, key from (select new.event_id, new."check", new.file, new.key, row_number() over (partition by "check", key order by event_id) as nth from new) x
left join gone using ("check", key) where nth > coalesce(n, 0)
""")
def moved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New findings that no finding of a vanished file accounts for."""
    base, head = _halves(spark, sf_dir)
    head = head.filter("file <> 'u7'")
    key = ["check", "file", "key"]
    new, fixed = findings.unmatched(head, base, key, ["event_id"]), findings.unmatched(base, head, key, ["event_id"])
    gone = spark.createDataFrame([("u7",)], "file string")
    return findings.without_moved(new, fixed, gone, ["check", "key"], ["event_id"], "file").select("event_id", "check", "file", "key")


@query("""
select event_id, sha256(event_type || chr(0) || user_id || chr(0) || row_number() over (partition by event_type, user_id order by event_id)) as fingerprint from events
""")
def gitlab_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return findings.fingerprints(rows, ["event_type", "user_id"], ["event_id"]).select("event_id", "fingerprint")


_GRADES = """
g as (select o_orderstatus as s, o_orderpriority as area, case when avg(o_totalprice) < 150200 then 'A' when avg(o_totalprice) < 151500 then 'B' else 'C' end as grade
  from orders group by 1, 2)"""


@query(f"""
with {_GRADES}, a as (select area, grade from g where s = 'F'), b as (select area, grade from g where s = 'O' and area <> '5-LOW')
select area, a.grade as before, b.grade as after, coalesce(b.grade > a.grade, false) as worse from a full join b using (area) where a.grade is distinct from b.grade
""")
def grade_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.avg("o_totalprice")
    g = star.table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("area")).agg(
        F.when(price < 150200, "A").when(price < 151500, "B").otherwise("C").alias("grade")
    )
    return findings.grade_changes(g.filter("o_orderstatus = 'F'"), g.filter("o_orderstatus = 'O' and area <> '5-LOW'"))


_SCORES = r"""
tok as (select doc_id, list_filter(list_concat(
  regexp_extract_all(lower(regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'),
  regexp_extract_all(lower(replace(text, '_', ' ')), '[a-z0-9]+')), lambda w: length(w) > 1) as t from documents),
sc as (select doc_id, (list_bool_or(list_transform(t, lambda x: contains(x, 'license')))::int + 2 * list_bool_or(list_transform(t, lambda x: contains(x, 'ouon')))::int) as score from tok)"""


@query("with " + _SCORES + " select doc_id, score::bigint as score from sc where score > 0")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by how many words of the question they hold; a word said twice counts
    twice."""
    docs = star.table(spark, sf_dir, "documents").filter("text is not null")
    return ask.keyword_scores(docs, "doc_id", F.col("text"), ["license", "ouon", "ouon"])


@query("with " + _SCORES + """, j as (select doc_id, score, '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "score": ' || score::bigint || chr(10) || '}' as shown from sc where score > 0),
r as (select doc_id, score, (len(shown) + 4 * 3) // 4 as cost, sum((len(shown) + 4 * 3) // 4) over (order by score desc, doc_id rows unbounded preceding) as spent from j)
select doc_id, score::bigint as score, cost::bigint as cost, spent::bigint as spent from r where spent <= 2000
""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits that fit the budget."""
    docs = star.table(spark, sf_dir, "documents").filter("text is not null")
    hits = ask.keyword_scores(docs, "doc_id", F.col("text"), ["license", "ouon", "ouon"])
    return ask.within_budget(hits, fn.json_cost(F.struct("doc_id", "score")), [F.desc("score"), F.col("doc_id")], 2000).select("doc_id", "score", "cost", "spent")


@query(f"""
with recursive {TRADE_SQL}, e as (select distinct src, dst from t where src <> dst), r(id) as (select 'nation:0' union select e.dst from r join e on e.src = r.id),
f as (select dst as id, count(*) as n from e group by 1), m as (select src as id from e union select dst from e union select id from r)
select id, (coalesce(n, 0) + case when id in (select id from r) then 5 else 0 end)::bigint as impact from m left join f using (id)
""")
def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-in, plus five for what a request reaches."""
    e = star.trade(spark, sf_dir).filter("src <> dst").select("src", "dst").distinct()
    hit = traverse.reach(e, spark.createDataFrame([("nation:0",)], "id string")).select(F.col("id").alias("on"))
    fan = e.groupBy(F.col("dst").alias("f")).agg(F.count("*").alias("n"))
    every = e.select(F.col("src").alias("id")).union(e.select("dst")).union(hit).distinct()
    joined = every.join(fan, F.col("id") == F.col("f"), "left").join(hit, F.col("id") == F.col("on"), "left")
    return joined.select("id", (F.coalesce("n", F.lit(0)) + F.when(F.col("on").isNotNull(), 5).otherwise(0)).alias("impact"))


_RANKED = f"with {_SIZES} select doc_id, v.\"check\", value::bigint as value, minutes::bigint as minutes, row_number() over (order by minutes desc, v.\"check\", doc_id)::int as place from v order by place limit 100"


@query(_RANKED)
def fix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred violations worth fixing first."""
    top = _violations(spark, sf_dir).select("doc_id", "check", "value", "minutes").orderBy(F.desc("minutes"), "check", "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("minutes"), "check", "doc_id")))


@query(f"""
with {FACTS_SQL} select regexp_extract(src, ':(.*)$', 1) as seller, count(distinct dst)::bigint as partners, count(distinct (l_orderkey, l_linenumber))::bigint as sites,
  array_to_string((list_sort(list_distinct(list('lineitem/' || l_orderkey))))[1:6], '|') as cited from facts group by 1
""")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an edge with the first six places it is cited at."""
    facts = star.trade_facts(spark, sf_dir).select(F.regexp_extract("src", ":(.*)$", 1).alias("seller"), "dst", "l_orderkey", "l_linenumber")
    counts = facts.groupBy("seller").agg(F.count_distinct("dst").alias("partners"), F.count_distinct("l_orderkey", "l_linenumber").alias("sites"))
    places = facts.select("seller", F.concat(F.lit("lineitem/"), F.col("l_orderkey").cast("string")).alias("place"))
    return counts.join(derive.cited(places, "seller", "place"), "seller")
