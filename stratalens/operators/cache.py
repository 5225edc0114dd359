"""Reuse of syntax facts by content hash.

Only what a file's own text decides is stored: its syntax facts, parse failures
among them.  Graph rules read other files too and always run again, so a warm run
cannot differ from a cold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import materialize
from stratalens.sources import extract

#: Part of the key; facts of another version are not read.
VERSION = 1


def _hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.coalesce("source", F.lit("")), 256))


def store(files: DataFrame, syn: DataFrame, path: str) -> None:
    """Write a snapshot; a reader sees the old one or the new one, as each
    version of it has its own folder and the marker file comes last."""
    rows = syn.join(_hashed(files).select("path", "content_hash"), "path")
    known = _hashed(files).select("path", "content_hash")
    rows.write.mode("overwrite").parquet(f"{path}/v{VERSION}/syn")
    known.write.mode("overwrite").parquet(f"{path}/v{VERSION}/files")


def syntax(files: DataFrame, path: str | None) -> DataFrame:
    """``syn`` of ``files``: stored facts for unchanged files, and a parse of the
    others; a missing snapshot parses all."""
    spark = files.sparkSession
    if path is None:
        return materialize(extract.syntax(files), "syn")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{VERSION}/files/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return materialize(extract.syntax(files), "syn")
    known = spark.read.parquet(f"{path}/v{VERSION}/files").withColumn("hit", F.lit(True))
    now = _hashed(files).join(known, ["path", "content_hash"], "left")
    hits = now.where("hit").select("path", "content_hash")
    warm = spark.read.parquet(f"{path}/v{VERSION}/syn").join(hits, ["path", "content_hash"], "left_semi").drop("content_hash")
    return materialize(warm.unionByName(extract.syntax(now.where("hit is null"))), "syn")
