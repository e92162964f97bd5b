"""Functions over columns; ``register`` makes those with Python bodies known to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """``evgraph_nfc_path``, ``evgraph_folded`` and ``evgraph_secret_fingerprint`` for
    SQL; all else is made of built-in functions."""
    from evgraph.functions.text import folded, nfc_path
    from evgraph.operators.semantics import secret_fingerprint

    known = {"evgraph_nfc_path": nfc_path, "evgraph_folded": folded, "evgraph_secret_fingerprint": secret_fingerprint}
    for name, function in known.items():
        spark.udf.register(name, function)
    return sorted(known)
