"""The data model: evidence, nodes, edges, and the columns that read their ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType(
    [
        T.StructField("file", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("rev", T.StringType()),
    ]
)
ATTRS = T.MapType(T.StringType(), T.StringType())
NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
        T.StructField("lang", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("producer", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("context", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
        T.StructField("confidence", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("arity", T.IntegerType()),
        T.StructField("attrs", ATTRS),
        T.StructField("producer", T.StringType()),
    ]
)
#: From least to most confident.
RESOLUTIONS = ("unresolved", "external", "candidate", "resolved")
#: Kinds that explain and don't depend: left out of paths and blast radius.
RATIONALE = "rationale"


def path_of(node_id: Column) -> Column:
    """The file part of a node id."""
    return F.substring_index(node_id, "#", 1)


def module_of(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def qualified_prefix(path: Column) -> Column:
    """What the names of a file begin with: its path by dots, without its ending; a
    package's own file stands for its directory. Rust files go by crate and module."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"(^|/)__init__$", "")
    module = F.regexp_replace(F.regexp_replace(bare, r"^(?:.*/)?([^/]+/)src/", "$1"), r"^src/", "")
    module = F.regexp_replace(F.regexp_replace(module, "/mod$", ""), "(^|/)(lib|main)$", "")
    return F.replace(F.when(path.endswith(".rs"), module).otherwise(bare), F.lit("/"), F.lit("."))


def symbol_id(path: Column, qualified_name: Column) -> Column:
    """The id of a symbol by its name in the file; that of the file for no name."""
    prefix = qualified_prefix(path)
    whole = F.when(prefix == "", qualified_name).otherwise(F.concat_ws(".", prefix, qualified_name))
    return F.when(qualified_name == "", path).otherwise(F.concat(path, F.lit("#"), whole))


def shown_module(module: Column) -> Column:
    return F.when(module == "", ".").otherwise(module)


def resolution_rank(resolution: Column) -> Column:
    rank = F.lit(len(RESOLUTIONS))
    for i, r in enumerate(RESOLUTIONS):
        rank = F.when(resolution == r, i).otherwise(rank)
    return rank


def resolution_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RESOLUTIONS]), rank.cast("int") + 1)


def evidence_order(evidence: Column) -> Column:
    """Sort key of a citation: whole files last, then by place."""
    return F.struct(
        (evidence["start_line"] == 0).alias("whole"),
        evidence["file"].alias("file"),
        evidence["start_line"].alias("start_line"),
        evidence["end_line"].alias("end_line"),
        F.coalesce(evidence["rev"], F.lit("")).alias("rev"),
    )


def via_of(edges_kind: Column, context: Column) -> Column:
    return F.coalesce(context, edges_kind)
