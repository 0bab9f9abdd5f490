"""The provenance multigraph of each epoch.  Edges point from effect to cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOCKET = "s"


def edges(resolved: DataFrame, unlink_twice: bool = False) -> DataFrame:
    """(epoch_id, event_id, src, dst, rel, t_s) of the events that make an edge.

    Opening, closing and forking make an edge once for each pair of nodes; other relations one for each event.  Only USED and WAS_GENERATED_BY have t_s.
    """
    process = F.concat(F.lit("p"), F.col("pid").cast("string"))
    parent = F.concat(F.lit("p"), F.col("ppid").cast("string"))
    inode = F.concat(F.lit("i"), F.col("file").cast("string"))
    call = F.col("syscall")
    shapes = [
        (call == 59, process, parent, "FORKED_BY"), (call == 2, inode, process, "OPENED_BY"), (call == 3, inode, process, "CLOSED_BY"), (call == 0, process, inode, "USED"), (call == 1, inode, process, "WAS_GENERATED_BY"),
        (call.isin(87, 263), inode, process, "UNLINKED_BY"), (call.isin(60, 231), process, parent, "EXITED_BY"), (call == 45, process, F.lit(SOCKET), "USED"), (call == 44, F.lit(SOCKET), process, "WAS_GENERATED_BY"),
    ]
    shape = F.coalesce(*[F.when(test, F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))) for test, src, dst, rel in shapes])
    rows = resolved.withColumn("e", shape).where("e.src is not null and e.dst is not null and e.src <> e.dst").select("epoch_id", "event_id", "pid", "syscall", "e.src", "e.dst", "e.rel")
    once = F.col("rel").isin("FORKED_BY", "OPENED_BY", "CLOSED_BY")
    nth = F.row_number().over(Window.partitionBy("epoch_id", "pid", "src", "dst", "rel").orderBy("event_id"))  # one end of these is the process itself
    rows = rows.withColumn("nth", nth).where(~once | (F.col("nth") == 1)).drop("nth")
    if unlink_twice:
        rows = rows.withColumn("copy", F.explode(F.when(F.col("syscall") == 87, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    return rows.withColumn("t_s", F.when(F.col("rel").isin("USED", "WAS_GENERATED_BY"), F.col("event_id")))


def nodes(edge_table: DataFrame) -> DataFrame:
    """(epoch_id, node, kind) of the nodes of edges."""
    every = edge_table.select("epoch_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    kind = F.when(F.col("node") == SOCKET, "socket").when(F.col("node").startswith("p"), "process").otherwise("inode")
    return every.withColumn("kind", kind)


def degrees(edge_table: DataFrame) -> DataFrame:
    """(epoch_id, node, n_out, n_in)."""
    end = lambda node, o, i: F.struct(F.col(node).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edge_table.select("epoch_id", F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    return ends.groupBy("epoch_id", "node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def without_events(edge_table: DataFrame, dropped: DataFrame) -> DataFrame:
    """The edges without those of dropped events; nodes that lose all their edges are gone with them (see :func:`nodes`)."""
    return edge_table.join(dropped.select("epoch_id", "event_id").distinct(), ["epoch_id", "event_id"], "left_anti")


def runs(resolved: DataFrame) -> DataFrame:
    """(epoch_id, event_id, pid, fd, syscall, op, object, is_socket, run, rn, n, last_run, repeated) of reads, writes, openings and closings.

    A run of accesses of one (process, object, operation) is broken by a write of the object by anyone (for reads) or a read of anything by the process.
    ``repeated`` are openings and closings after the first of a (file, process), which have no run.
    """
    call = F.col("syscall")
    op = F.when(call.isin(0, 45), "r").when(call.isin(1, 44), "w").when(call == 2, "o").otherwise("c")
    rows = resolved.where(call.isin(0, 1, 2, 3) & F.col("file").isNotNull() | call.isin(44, 45)).select(
        "epoch_id", "event_id", "pid", "fd", "syscall", op.alias("op"), F.when(call.isin(44, 45), SOCKET).otherwise(F.concat(F.lit("i"), F.col("file").cast("string"))).alias("object"), call.isin(44, 45).alias("is_socket")
    )
    io, at = F.col("op").isin("r", "w"), F.col("event_id")
    pair = Window.partitionBy("epoch_id", "pid", "object", "op").orderBy("event_id")
    before = lambda key: Window.partitionBy("epoch_id", key).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lw", F.max(F.when(F.col("op") == "w", at)).over(before("object")))  # by object first: all windows after it are a process's
    rows = rows.withColumn("lr", F.max(F.when(F.col("op") == "r", at)).over(before("pid"))).withColumns({"prev": F.lag("event_id").over(pair), "nth": F.row_number().over(pair)})
    broken = F.col("prev").isNotNull() & ((F.coalesce("lr", F.lit(-1)) > F.col("prev")) | ((F.col("op") == "r") & (F.coalesce("lw", F.lit(-1)) > F.col("prev"))))
    rows = rows.withColumn("run", F.when(io, F.sum(broken.cast("int")).over(pair)))
    one = Window.partitionBy("epoch_id", "pid", "object", "op", "run")
    rows = rows.withColumn("last_run", F.max("run").over(Window.partitionBy("epoch_id", "pid", "object", "op")))
    rows = rows.withColumn("rn", F.when(io, F.row_number().over(one.orderBy("event_id")))).withColumn("n", F.when(io, F.count(F.lit(1)).over(one)))
    return rows.withColumn("repeated", ~io & (F.col("nth") > 1)).drop("prev", "lw", "lr", "nth")


def repeats(resolved: DataFrame) -> DataFrame:
    """(epoch_id, event_id) of openings and closings after the first of a (file, process)."""
    rows = resolved.where(F.col("syscall").isin(2, 3) & F.col("file").isNotNull())
    nth = F.row_number().over(Window.partitionBy("epoch_id", "pid", "file", "syscall").orderBy("event_id"))
    return rows.withColumn("nth", nth).where("nth > 1").select("epoch_id", "event_id")
