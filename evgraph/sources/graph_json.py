"""The stored graph: a JSON document of nodes and edges, and columnar tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evgraph.schema import EDGES, NODES

DOCUMENT = T.StructType(
    [
        T.StructField("schema", T.IntegerType()),
        T.StructField("built_at_commit", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODES)),
        T.StructField("edges", T.ArrayType(EDGES)),
        T.StructField("modules", T.ArrayType(T.StringType())),
        T.StructField("module_deps", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document; edges keep their place as ``ord``."""
    document = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    edges = document.select(F.posexplode("edges").alias("ord", "e")).select("ord", "e.*")
    return document.select(F.explode("nodes").alias("n")).select("n.*"), edges


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet, which is what queries at scale read."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def document(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> str:
    """One canonical document: sorted, indented by two, for graphs a reader can hold.
    Larger ones than ``most`` rows are refused; use ``save``."""

    def rows(df: DataFrame, order: list[str]) -> list[dict]:
        found = [json.loads(r) for r in df.orderBy(*order).limit(most + 1).toJSON().collect()]
        if len(found) > most:
            raise ValueError(f"over {most} rows: save them as tables")
        return found

    body = {"schema": 2, "nodes": rows(nodes, ["id"]), "edges": rows(edges, ["src", "dst", "kind"])}
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
