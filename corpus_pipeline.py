"""A training corpus in five stages, each one of the training-data operators.

Every stage reads what the stage before it kept, as a table. All but the last give
the columns of ``documents``; the last gives the packed pieces.

In every stage null and empty texts are texts without words: the quality rules reject
them, and the other stages, if given some, keep one (near duplicates), take none (mix)
or pack their end alone. Null ids and sources are values like others, texts of any
length are read whole, repeated rows are copies, further columns are carried along
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm import mixing, packing, quality, simhash, toxicity
from evgraph.llm.common import read, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a severity of one half or more go; the model is fitted to the
    labels of documents that are still there."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id: sets of five-word
    shingles link at a similarity of 0.8 or more."""
    return simhash.first_of_each(docs, shingle=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as it is taken."""
    return mixing.shuffled(mixing.mix(docs), docs.columns).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, size=2048, end=0, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_text),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the regression nor the random choices of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
