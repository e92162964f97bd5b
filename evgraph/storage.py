"""Tables in the folder that all executors share; how iterations cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. A folder of our own only where none is named and
    all tasks run in this process: on a cluster each executor would write to its own
    disk, so there a missing ``spark.checkpoint.dir`` is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="evgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _staging_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evgraph-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage for good: a lost executor costs a reread, and values that depend
    on the partitioning (row numbers, positions) are fixed from here on. Staged
    tables go when the application ends, or earlier by ``drop`` and ``drop_staged``.
    """
    spark = df.sparkSession
    path = f"{_staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, root = _file_system(spark, _staging_root(spark))
    files.deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, where: str = "true") -> tuple[DataFrame, int]:
    """``df`` staged and its number of rows, or of those that fit ``where``, counted
    while it is written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count_if(F.expr(where)).alias("n")), name)
    return out, int(seen.get["n"])


def drop(staged: DataFrame) -> None:
    """Delete one table that ``stage`` returned and nothing reads any more."""
    where = staged.inputFiles()
    if where:
        files, path = _file_system(staged.sparkSession, where[0].rpartition("/")[0])
        files.delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application staged; results read later are lost."""
    files, root = _file_system(spark, _staging_root(spark))
    files.delete(root, True)
