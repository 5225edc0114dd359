"""Session helpers shared by every operator: shared scratch space, size-checked
broadcasts and access to this package from Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have at most to be broadcast; measured, never assumed.
BROADCAST_ROWS = 200_000

#: Arrow batches handed to Python workers stay small: texts may be very long.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20

#: Hashes of a bitmap; it has a row for each 64 of them.
BITMAP_BITS = 23

#: Rows of a file that ``packed`` fills.
PACKED_ROWS = 1 << 15

#: Bytes of an input that may be dealt out anew.
SPREAD_BYTES = 32 << 20

#: Spark's setting by which a query's shuffle files go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Seconds between two runs of the driver's collector.
SWEEP_SECONDS = 5.0
_swept = 0.0

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if _PACKAGE_ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_PACKAGE_ROOT, known]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only where it is
    unset (tests, one machine) a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_stratalens_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext._stratalens_scratch = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already at exit
        pass


def materialize(df: DataFrame, name: str = "part", drop: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.  Now and
    then the driver's collector runs afterwards, so that Spark drops the shuffle
    files behind what was written; with ``drop`` Spark drops them as soon as it is.
    The folder is removed by ``release`` or when the driver exits.
    """
    global _swept
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stratalens-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    if drop:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop:
            spark.conf.set(DROP_SHUFFLES, before)
    if time.monotonic() - _swept > SWEEP_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalens_path = path
    return out


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has no more than ``rows`` narrow rows, in as few partitions as
    they fill, if there are no more than may be broadcast; else ``df`` as it is, with
    whatever Spark splits at run time.

    For tables that ``materialize`` is to write: a file costs more than its rows if
    these are few.  On local disks without Hadoop's native library a task starts three
    processes for each file, to set modes, and each counts with all of its executor's
    memory until it runs.  ``rows`` should come from a count; ``df`` should end in a
    shuffle, as the stage after that gets as few tasks.
    """
    return df.coalesce(max(1, -(-rows // PACKED_ROWS))) if rows <= BROADCAST_ROWS else df


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._stratalens_path)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if a bounded count proves ``df`` has few rows,
    ``BROADCAST_ROWS`` unless told otherwise.

    ``df`` should be materialized.  Beyond the bound the join is left to
    Spark's shuffle joins, which split skewed keys at run time.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def _free(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until no table has such a column."""
    while any(name.lower() in map(str.lower, t.columns) for t in tables):
        name = f"_{name}"
    return name


def matching(df: DataFrame, own: Column, keys: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``own`` is one of ``keys`` (one column, null-safe), or,
    with ``keep`` false, none of them; ``keys`` should be materialized.

    Few keys are broadcast.  Of more, a bitmap of ``1 << BITMAP_BITS`` hashes is, so
    its size does not depend on them; only rows that it lets through are shuffled.
    """
    name = _free("key", df, keys)
    keys = keys.toDF(name).distinct()
    how = "left_semi" if keep else "left_anti"
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:
        return df.join(F.broadcast(keys), own.eqNullSafe(F.col(name)), how)
    word, bits = _free("word", df), _free("bits", df)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    index = lambda c: F.floor(place(c) / 64).cast("long")
    filled = keys.select(index(F.col(name)).alias(word), bit(F.col(name)).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = df.join(F.broadcast(materialize(filled, "bitmap")), index(own) == F.col(word), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False))
    some = marked.where(may).select(*df.columns).join(keys, own.eqNullSafe(F.col(name)), how)
    return some if keep else marked.where(~may).select(*df.columns).unionByName(some)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores, if its files give fewer tasks
    than that (one file of one row group is one task).  Beyond ``SPREAD_BYTES``
    by the scan's own size nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(2 * cores)
    return df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
