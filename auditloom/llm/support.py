"""Shared helpers: tables, the shared folder, materialised intermediates, Arrow text buffers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints/auditloom"  # of a session without a cluster; it has one machine only
BATCH_BYTES = 4 << 20  # of an Arrow batch


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the input folder, with only the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A session on one machine may leave it unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/auditloom-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    An executor lost later costs nothing: the files belong to the shared folder, not to an executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/auditloom-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, unless they end earlier by its setting; a longer row is a batch of its own.

    Batches lie outside the heap, in the JVM and again in the Python worker, once for each running task.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows, counted, are at most so many."""
    return F.broadcast(df) if df.count() <= rows else df


def without_copies(docs: DataFrame, decided: DataFrame, mark: Column, id_col: str, broadcast_rows: int = 0) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, mark, stays; one row for each of ``docs``) lets stay.

    A row is known by its id and ``mark``, a digest of its text.  Of rows that repeat both, one stays if any does.
    """
    judged = decided.groupBy("doc_id", "mark").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times")).where("times > 1 or not stays")
    judged = materialize(judged.toDF("a", "b", "stays", "times"), "judged")
    name = free_name(docs, "mark")
    marked = docs.withColumn(name, mark)
    gone, twins = judged.where("not stays"), judged.where("stays")
    small = broadcast_rows and judged.count() <= broadcast_rows
    same = lambda g: marked[id_col].eqNullSafe(g["a"]) & (marked[name] == g["b"])
    met = lambda rows, g, how: rows.join(F.broadcast(g) if small else g, same(g), how)
    left = met(marked, gone, "left_anti")
    if not twins.isEmpty():
        left = met(left, twins, "left_anti").unionByName(met(left, twins, "left_semi").dropDuplicates([id_col, name]))
    return left.select(*[left[c] for c in docs.columns])
