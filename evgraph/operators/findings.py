"""Set and multiset differences: records of two snapshots, findings that moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rows only in ``head`` as added, rows only in ``base`` as removed."""
    cols = base.columns
    return head.select(*cols).subtract(base.select(*cols)).withColumn("op", F.lit("added")).unionByName(
        base.select(*cols).subtract(head.select(*cols)).withColumn("op", F.lit("removed"))
    )


def unmatched(items: DataFrame, other: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Multiset difference on ``key``: of equal keys, the first rows by ``order``
    find partners and the later ones are left. Counts of ``other`` are aggregated
    first; the numbering runs within one key."""
    counts = other.groupBy(*key).agg(F.count("*").alias("__n"))
    on = [items[k].eqNullSafe(counts[k]) for k in key]
    joined = items.join(counts, on, "left").select(*[items[c] for c in items.columns], F.coalesce("__n", F.lit(0)).alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return joined.withColumn("__nth", nth).filter(F.col("__nth") > F.col("__n")).drop("__nth", "__n")


def without_moved(new: DataFrame, fixed: DataFrame, gone: DataFrame, key: list[str], order: list[str], file: str) -> DataFrame:
    """New findings left once each fixed finding of a vanished file has taken the
    first new one with its ``key``. ``gone``: files (``file``) that are no more."""
    lost = fixed.join(gone.select(F.col("file").alias("__gone")), F.col(file) == F.col("__gone"), "left_semi")
    return unmatched(new, lost, key, order)


def fingerprints(findings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A hash per finding that survives moved lines: its key and how often the key
    came before."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("string")
    raw = F.concat_ws("\0", *[F.col(k).cast("string") for k in key], nth)
    return findings.withColumn("fingerprint", F.sha2(raw, 256))


def grade_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Areas (``area``, ``grade``) whose grade differs, on either side alone as well."""
    b, h = base.select("area", F.col("grade").alias("before")), head.select("area", F.col("grade").alias("after"))
    both = b.join(h, "area", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.withColumn("worse", F.coalesce(F.col("after") > F.col("before"), F.lit(False)))


def rank_of(grade: Column) -> Column:
    return F.instr(F.lit("ABCDE"), grade)
