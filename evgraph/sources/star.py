"""Property graphs over ordinary relational tables: the star schema as nodes and
edges, the trade graph between nations, and the paths and lines of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``kind``, ``label``, ``qualified_name`` of six tables' rows."""
    of = lambda t, key, label: table(spark, sf_dir, t).select(
        node_id(t, key).alias("id"), F.lit(t).alias("kind"), label.alias("label"), F.concat(F.lit(t + "."), label).alias("qualified_name")
    )
    parts = [
        of("region", "r_regionkey", F.col("r_name")),
        of("nation", "n_nationkey", F.col("n_name")),
        of("customer", "c_custkey", F.col("c_name")),
        of("supplier", "s_suppkey", F.col("s_name")),
        of("part", "p_partkey", F.col("p_name")),
        of("orders", "o_orderkey", F.col("o_orderpriority")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """``src``, ``dst``, ``kind``, ``context``, ``file``, ``line``: keys as edges, and
    each line item as a call of a part and a dependency on a supplier."""

    def of(t: str, src: Column, dst: Column, kind: str, context: str, file: Column, line: Column) -> DataFrame:
        cols = [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(context).alias("context")]
        return table(spark, sf_dir, t).select(*cols, file.alias("file"), line.cast("int").alias("line"))

    key = lambda t, k: (F.lit(t), F.col(k) + 1)
    parts = [
        of("nation", node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "contains", "geography", *key("nation", "n_nationkey")),
        of("customer", node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "contains", "geography", *key("customer", "c_custkey")),
        of("supplier", node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "contains", "geography", *key("supplier", "s_suppkey")),
        of("orders", node_id("orders", "o_orderkey"), node_id("customer", "o_custkey"), "references", "sales", *key("orders", "o_orderkey")),
    ]
    if lines:
        # One scan of the largest table gives both edges of each of its rows.
        edge = lambda dst, kind: F.struct(dst.alias("dst"), F.lit(kind).alias("kind"))
        both = F.array(edge(node_id("part", "l_partkey"), "calls"), edge(node_id("supplier", "l_suppkey"), "depends_on"))
        items = table(spark, sf_dir, "lineitem").select(
            node_id("orders", "l_orderkey").alias("src"),
            F.explode(both).alias("to"),
            F.lit("supply").alias("context"),
            F.concat(F.lit("lineitem/"), F.col("l_orderkey").cast("string")).alias("file"),
            F.col("l_linenumber").cast("int").alias("line"),
        )
        parts.append(items.select("src", "to.dst", "to.kind", "context", "file", "line"))
    return reduce(DataFrame.unionByName, parts)


def trade_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the supplier's nation sells to the customer's."""
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    sold = t("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = t("orders", "o_orderkey", "o_custkey").join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select(
        node_id("nation", "s_nationkey").alias("src"), node_id("nation", "c_nationkey").alias("dst"), "l_orderkey", "l_linenumber", "l_returnflag"
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src``, ``dst``, ``weight``: line items sold from nation to nation."""
    return trade_facts(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src``, ``dst``: from part to part of an order's next line, where both lines
    were returned. Nodes grow with the parts, edges with the line items."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    back = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    steps = back.select("*", F.lead("l_partkey").over(w).alias("next"), F.lead("l_returnflag").over(w).alias("flag"))
    both = steps.filter("l_returnflag = 'R' and flag = 'R'")
    return both.select(node_id("part", "l_partkey").alias("src"), node_id("part", "next").alias("dst")).distinct()


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``path``, ``host``: page addresses as file paths."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"), F.substring_index(bare, "/", 1).alias("host"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n`` (from 0), ``line`` of every text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path``, ``text``: the line items of each customer in order, as lines of a source
    file; some quantities open or close comments, docstrings and imports."""
    special = {1: "/* open", 2: "end */", 3: '"""', 4: "'''one line'''", 5: "import (", 6: ")", 7: "import {", 8: "}", 9: "# note", 10: "from x import y", 11: "  ", 12: "/* shut */", 13: "***", 14: "from x import ("}
    plain = F.concat("l_returnflag", F.lit("\t  "), "l_linestatus", F.lit(" "), F.year("l_shipdate").cast("string"))
    line = plain
    for quantity, text in special.items():
        line = F.when(F.col("l_quantity") == quantity, text).otherwise(line)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    held = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line")))
    return both.groupBy("o_custkey").agg(F.array_join(F.transform(held, lambda x: x.line), "\n").alias("text")).select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path"), "text")


#: The same graphs for DuckDB, as common table expressions.
NODES_SQL = """
nodes as (
  select 'region:' || r_regionkey as id, 'region' as kind, r_name as label from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation
  union all select 'customer:' || c_custkey, 'customer', c_name from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'part:' || p_partkey, 'part', p_name from part
  union all select 'orders:' || o_orderkey, 'orders', o_orderpriority from orders
)"""
EDGES_SQL = """
edges as (
  select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'contains' as kind, 'geography' as context,
         'nation' as file, (n_nationkey + 1)::int as line from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'contains', 'geography', 'customer', (c_custkey + 1)::int from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'contains', 'geography', 'supplier', (s_suppkey + 1)::int from supplier
  union all select 'orders:' || o_orderkey, 'customer:' || o_custkey, 'references', 'sales', 'orders', (o_orderkey + 1)::int from orders
  union all select 'orders:' || l_orderkey, 'part:' || l_partkey, 'calls', 'supply', 'lineitem/' || l_orderkey, l_linenumber from lineitem
  union all select 'orders:' || l_orderkey, 'supplier:' || l_suppkey, 'depends_on', 'supply', 'lineitem/' || l_orderkey, l_linenumber from lineitem
)"""
FACTS_SQL = """
facts as (
  select 'nation:' || s_nationkey as src, 'nation:' || c_nationkey as dst, l_orderkey, l_linenumber, l_returnflag
  from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
)"""
TRADE_SQL = (
    FACTS_SQL
    + """,
t as (select src, dst, count(*) as weight from facts group by src, dst)"""
)
HANDOVERS_SQL = """
h as (
  select distinct 'part:' || l_partkey as src, 'part:' || nxt as dst from (
    select l_partkey, l_returnflag, lead(l_partkey) over w as nxt, lead(l_returnflag) over w as flag from lineitem
    window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag)) where l_returnflag = 'R' and flag = 'R'
)"""
LISTINGS_SQL = """
files as (
  select path, list(line order by l_orderkey, l_linenumber, line) as w from (select 'customer/' || o_custkey as path, l_orderkey, l_linenumber, case l_quantity::int
    when 1 then '/* open' when 2 then 'end */' when 3 then '\"\"\"' when 4 then repeat(chr(39), 3) || 'one line' || repeat(chr(39), 3)
    when 5 then 'import (' when 6 then ')' when 7 then 'import {' when 8 then '}' when 9 then '# note' when 10 then 'from x import y'
    when 11 then '' when 12 then '/* shut */' when 13 then '***' when 14 then 'from x import ('
    else l_returnflag || ' ' || l_linestatus || ' ' || year(l_shipdate) end as line
  from lineitem join orders on l_orderkey = o_orderkey) group by path
)"""
PATHS_SQL = """
p as (
  select page_id, path, split_part(path, '/', 1) as host from (
    select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages)
)"""
LINES_SQL = r"""
l as (
  select doc_id, i - 1 as n, w[i] as line from (
    select doc_id, w, unnest(range(1, len(w) + 1)) as i from (
      select doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents))
)"""
