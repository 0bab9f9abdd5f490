"""Reachability: dependence, tracing from seeds, and the techniques that rest on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import dependence
from auditloom.operators.support import materialize


def trace(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(epoch_id, node) reachable from the seed nodes (epoch_id, node) of the same epoch."""
    steps = materialize(edges.select("epoch_id", "src", "dst").distinct(), "steps")
    found = new = materialize(seeds.select("epoch_id", "node").distinct(), "trace")
    while not new.isEmpty():
        further = new.join(steps, (new.epoch_id == steps.epoch_id) & (new.node == steps.src)).select(new.epoch_id, steps.dst.alias("node")).distinct()
        new = materialize(further.join(found, ["epoch_id", "node"], "left_anti"), "trace")
        found = found.unionByName(new)
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    kept = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*kept, F.col("dst").alias("src"), F.col("src").alias("dst"))


def required(edges: DataFrame, full: bool) -> DataFrame:
    """(epoch_id, event_id) of edges that dependence needs.

    For each source and each other node it reaches, the in-edge with the lowest t_s (none is lowest), the last on ties,
    whose tail the source reaches.  Sources are those without in-edges or, with ``full``, all nodes, in either direction.
    An epoch's different (src, dst) are one group; of parallel edges only the first in order can be chosen.
    """
    order = F.struct(F.coalesce("t_s", F.lit(-1)).cast("long").alias("t_s"), (-F.col("event_id")).alias("last"))
    first = edges.groupBy("epoch_id", "src", "dst").agg(F.min(order).alias("first"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t_s", "ascending"), ("last", "ascending")])
        ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
        ends, n = ends.indices.to_numpy(zero_copy_only=False).astype("int64"), len(ends.dictionary)
        src, dst = ends[: len(rows)], ends[len(rows) :]
        of, count = dependence.components(n, src, dst)
        kept = dependence.needed(n, src, dst, full, of, count)
        if full:
            kept = np.union1d(kept, dependence.needed(n, dst, src, full, of, count, backward=True))
        found = rows.take(pa.array(kept))
        return pa.table({"epoch_id": found["epoch_id"], "event_id": pc.negate(found["last"])})

    kind = dict(edges.dtypes)["epoch_id"]
    return first.select("epoch_id", "src", "dst", "first.t_s", "first.last").groupBy("epoch_id").applyInArrow(run, f"epoch_id {kind}, event_id long")


def dpreserve_sd(edges: DataFrame) -> DataFrame:
    """(epoch_id, event_id) of edges that source dependence does not need."""
    return edges.select("epoch_id", "event_id").join(required(edges, full=False), ["epoch_id", "event_id"], "left_anti")


def dpreserve_fd(edges: DataFrame) -> DataFrame:
    """(epoch_id, event_id) of edges that full dependence does not need, in either direction."""
    return edges.select("epoch_id", "event_id").join(required(edges, full=True), ["epoch_id", "event_id"], "left_anti")


def tag_seeds(events: DataFrame, keywords: list[str], pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """(epoch_id, event_id) of events whose call record holds a keyword, or whose directory and path hold both parts of a pair."""
    held = [F.col("message").contains(k) for k in keywords] + [F.col("cwd").contains(a) & F.col("path").contains(b) for a, b in pairs]
    return events.where(F.coalesce(*[F.when(h, F.lit(True)) for h in held], F.lit(False))).select("epoch_id", "event_id")


def tag(events: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(epoch_id, event_id) of events that are no seeds and whose edge, if any, neither leads from a seed's cause nor to a seed's effect."""
    hit = materialize(edges.join(seeds, ["epoch_id", "event_id"], "left_semi"), "seeds")
    back = trace(edges, hit.select("epoch_id", F.col("dst").alias("node"))).withColumnRenamed("node", "src")
    fore = trace(reversed_edges(edges), hit.select("epoch_id", F.col("src").alias("node"))).withColumnRenamed("node", "dst")
    traced = edges.join(back, ["epoch_id", "src"], "left_semi").select("epoch_id", "event_id").unionByName(edges.join(fore, ["epoch_id", "dst"], "left_semi").select("epoch_id", "event_id"))
    kept = traced.unionByName(seeds.select("epoch_id", "event_id")).distinct()
    return events.select("epoch_id", "event_id").join(kept, ["epoch_id", "event_id"], "left_anti")
