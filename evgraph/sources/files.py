"""Source trees: a pruned listing, then one read per file for role, hash and lines.

Spark's own file sources leave out names that begin with a dot or an underscore,
which source trees are full of. So the driver lists names (never contents) and
executors read the files, each once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions import classify
from evgraph.functions.text import nfc_path

LISTED = "path string, uri string, size long, code string"


def listing(
    spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = 2_000_000, max_files: int = 200_000, max_depth: int = 40
) -> DataFrame:
    """``path``, ``uri``, ``size``, ``code`` of the files under ``root`` in the order
    of their names. Excluded directories and links are not entered. ``code`` says why
    a file is not read: too-large, too-deep, over-count; null where it is."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    excluded, found, kept = set(classify.EXCLUDED_DIRS), [], 0
    stack = [("", top, 0)]
    while stack:
        prefix, at, depth = stack.pop()
        entries = sorted(((s.getPath().getName(), s) for s in fs.listStatus(at)), key=lambda e: e[0])
        inner = []
        for name, status in entries:
            path = prefix + name
            if status.isSymlink():
                continue
            if status.isDirectory():
                if name not in excluded:
                    if depth + 1 > max_depth:
                        found.append((path, status.getPath().toString(), 0, "too-deep"))
                    else:
                        inner.append((path + "/", status.getPath(), depth + 1))
                continue
            size = status.getLen()
            code = "too-large" if size > max_bytes else "over-count" if kept >= max_files else None
            kept += code is None
            found.append((path, status.getPath().toString(), size, code))
        stack += reversed(inner)
    listed = spark.createDataFrame(found, LISTED)
    lines = read_ignores(spark, root.rstrip("/")) if ignore is None else ignore
    return listed.filter(~classify.is_ignored(F.col("path"), lines))


def contents(listed: DataFrame) -> DataFrame:
    """Adds ``content`` to files that are to be read; one that can't be has null."""

    def load(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["uri"]:
                try:
                    store, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://"))
                    with store.open_input_stream(path) as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "size": batch["size"], "content": out})

    spread = listed.filter("code is null").select("path", "uri", "size")
    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "path").mapInPandas(load, "path string, size long, content binary")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = 2_000_000) -> DataFrame:
    """``path`` (relative), ``role``, ``lang``, ``config_kind``, ``size``,
    ``content_hash``, ``line_count`` and ``text`` of every file that counts.

    ``ignore``: lines of ignore files; None reads those at the root. Bytes that are
    not UTF-8 are replaced.
    """
    read = contents(listing(spark, root, ignore, max_bytes)).filter("content is not null")
    path, text = F.col("path"), F.make_valid_utf8(F.col("content").cast("string"))
    return read.select(
        nfc_path("path").alias("path"),
        classify.role(path, text).alias("role"),
        classify.language(path).alias("lang"),
        classify.config_kind(path).alias("config_kind"),
        "size",
        F.sha2("content", 256).alias("content_hash"),
        classify.line_count(text).alias("line_count"),
        text.alias("text"),
    )


def skipped(spark: SparkSession, root: str, max_bytes: int = 2_000_000) -> DataFrame:
    """Files that are not read, and why."""
    return listing(spark, root, None, max_bytes).filter("code is not null").select("path", "size", "code")


def read_ignores(spark: SparkSession, root: str, most: int = 1 << 20) -> list[str]:
    """Lines of the ignore file at the root, through the store it lies in."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or fs.getFileStatus(path).getLen() > most:
        return []
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
    finally:
        stream.close()


def architecture(files: DataFrame) -> DataFrame:
    """Files that count for the architecture."""
    return files.filter(F.col("role").isin(*classify.ROLES_OF_ARCHITECTURE))
