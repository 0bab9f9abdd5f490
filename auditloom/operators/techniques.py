"""Reduction techniques: each gives the events it drops, and some rewrite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import analysis, closure, graph, sessions
from auditloom.operators.support import materialize

KEY = ["epoch_id", "event_id"]
MODIFYING = ("FORKED_BY", "WAS_GENERATED_BY", "UNLINKED_BY")


@dataclass
class Context:
    """Tables that techniques start from."""

    resolved: DataFrame
    edges: DataFrame
    templates: DataFrame | None = None  # (tokens) for node merging; mined from the context if not given
    keywords: list[str] = field(default_factory=list)  # of call records
    pairs: list[tuple[str, str]] = field(default_factory=list)  # of parts of a directory and a path


def context(resolved: DataFrame) -> Context:
    return Context(resolved, graph.edges(resolved))


# -- windows ------------------------------------------------------------------------------------------------------------
def redundant_io(ctx: Context) -> DataFrame:
    """Repeated openings and closings, and the inside of runs of file reads and writes."""
    return graph.runs(ctx.resolved).where("repeated or (not is_socket and rn > 1 and rn < n)").select(*KEY)


def iburst(ctx: Context) -> DataFrame:
    """The inside of file runs, both sides of breaks between runs (of files and sockets), and repeated openings and closings."""
    hit = "(not is_socket and rn > 1 and rn < n) or (rn = n and run < last_run) or (rn = 1 and run > 0)"
    return graph.runs(ctx.resolved).where(f"repeated or {hit}").select(*KEY)


def approx_at_once(ctx: Context) -> DataFrame:
    """Repeated openings, accesses of the standard descriptors and the inside of socket runs."""
    return graph.runs(ctx.resolved).where("repeated or (syscall in (0, 1, 3) and fd between 0 and 2) or (is_socket and rn > 1 and rn < n)").select(*KEY)


def unsupported(ctx: Context) -> DataFrame:
    return ctx.resolved.where(~F.col("syscall").isin(*sessions.HANDLED)).select(*KEY)


# -- induction ------------------------------------------------------------------------------------------------------------
def programs(ctx: Context) -> DataFrame:
    """(epoch_id, node, program, rank, members): processes by the program of the event that forked them, ranked by pid."""
    forks = ctx.edges.where("rel = 'FORKED_BY'").select(*KEY, F.col("src").alias("node"), "pid").join(ctx.resolved.select(*KEY, "program"), KEY).where("program is not null")
    first = forks.groupBy("epoch_id", "node", "pid").agg(F.min_by("program", "event_id").alias("program"))
    group = Window.partitionBy("epoch_id", "program")
    ranked = first.withColumn("rank", F.row_number().over(group.orderBy("pid"))).withColumn("members", F.count(F.lit(1)).over(group))
    return ranked.where("members > 1")


def _touches(ctx: Context) -> DataFrame:
    """Edges of grouped processes: (epoch_id, event_id, node, program, rank, members, dir, neighbour)."""
    rows = ctx.edges.where("rel not in ('FORKED_BY', 'EXITED_BY')")
    into = rows.select(*KEY, F.col("dst").alias("node"), F.lit("in").alias("dir"), F.col("src").alias("neighbour"))
    out = rows.select(*KEY, F.col("src").alias("node"), F.lit("out").alias("dir"), F.col("dst").alias("neighbour"))
    return into.unionByName(out).join(programs(ctx), ["epoch_id", "node"])


def induction_frequencies(ctx: Context) -> DataFrame:
    """(epoch_id, program, dir, neighbour, members, n): edges of a program's processes by neighbour."""
    return _touches(ctx).groupBy("epoch_id", "program", "dir", "neighbour", "members").agg(F.count(F.lit(1)).alias("n"))


def induction(ctx: Context) -> DataFrame:
    """Edges to neighbours that a program's processes touch once each on the whole, except those of its first process."""
    common = induction_frequencies(ctx).where("n = members").select("epoch_id", "program", "dir", "neighbour")
    return _touches(ctx).where("rank > 1").join(common, ["epoch_id", "program", "dir", "neighbour"], "left_semi").select(*KEY).distinct()


def opened_names(ctx: Context) -> DataFrame:
    """(epoch_id, pid, file, cwd, path) of the latest opening of each file by each process."""
    opens = ctx.resolved.where("syscall = 2 and path is not null and file is not null")
    return opens.groupBy("epoch_id", "pid", "file").agg(F.max_by("cwd", "event_id").alias("cwd"), F.max_by("path", "event_id").alias("path"))


def grammar(ctx: Context) -> DataFrame:
    """(epoch_id, program, dir, files): what the first process of each program shares with the others, as full paths in order.

    Standard descriptors and files that it did not open itself are left out.
    """
    common = induction_frequencies(ctx).where("n = members").select("epoch_id", "program", "dir", "neighbour")
    rows = _touches(ctx).where("rank = 1 and neighbour like 'i%'").join(common, ["epoch_id", "program", "dir", "neighbour"], "left_semi").select("epoch_id", "program", "dir", "node", "neighbour").distinct()
    rows = rows.withColumn("pid", F.substring("node", 2, 20).cast("int")).withColumn("file", F.substring("neighbour", 2, 20).cast("long")).where("file >= 3")
    named = rows.join(opened_names(ctx), ["epoch_id", "pid", "file"]).withColumn("full", T.construct_path(F.col("cwd"), F.col("path")))
    return named.groupBy("epoch_id", "program", "dir").agg(F.array_join(F.array_sort(F.collect_list("full")), " ").alias("files"))


# -- node merging ------------------------------------------------------------------------------------------------------------
def counted_accesses(ctx: Context) -> DataFrame:
    """(epoch_id, event_id, pid, exe): events that are no writes, of files not written before in the epoch."""
    rows = ctx.resolved.where("exe is not null")
    before = Window.partitionBy("epoch_id", "exe").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("written", F.max((F.col("syscall") == 1).cast("int")).over(before))
    return rows.where("syscall <> 1 and coalesce(written, 0) = 0").select(*KEY, "pid", "exe")


def frequent_accesses(ctx: Context) -> DataFrame:
    """(epoch_id, pid, exe, n): counted accesses of files never written in the epoch."""
    written = ctx.resolved.where("syscall = 1 and exe is not null").select("epoch_id", "exe").distinct()
    return counted_accesses(ctx).join(written, ["epoch_id", "exe"], "left_anti").groupBy("epoch_id", "pid", "exe").agg(F.count(F.lit(1)).alias("n"))


def mine_templates(profile: DataFrame) -> DataFrame:
    """(template, tokens, n): paths to leaves of the prefix tree of profiles (epoch_id, pid, exe, n) whose counters are two or more.

    Each profile's files go by their total count and then by name.  A path is known by its length and two 64-bit hashes of its files and their
    places, so that a process with many files makes one row for each; a leaf's files are read from one of the processes that have it.
    """
    totals = profile.groupBy("exe").agg(F.sum("n").alias("total"))
    process = Window.partitionBy("epoch_id", "pid")
    rows = profile.join(totals, "exe").withColumn("place", F.row_number().over(process.orderBy("total", "exe"))).withColumn("size", F.count(F.lit(1)).over(process))
    upto = process.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"path_{k}": F.bit_xor(F.xxhash64("exe", "place", F.lit(k))).over(upto) for k in (1, 2)})
    path = ["place", "path_1", "path_2"]
    counted = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("deepest"), F.min(F.struct("epoch_id", "pid")).alias("one"))
    leaves = counted.where("n > 1 and deepest = place").select("one.epoch_id", "one.pid", F.col("place").alias("last"), "n")
    found = rows.join(leaves.withColumnRenamed("n", "times"), ["epoch_id", "pid"]).where("place <= last")
    tokens = found.groupBy("epoch_id", "pid", "last", F.col("times").alias("n")).agg(F.sort_array(F.collect_list("exe")).alias("tokens"))  # one process's files
    return tokens.select(F.array_join("tokens", " ").alias("template"), "tokens", "n")


def nodemerge(ctx: Context, templates: DataFrame) -> DataFrame:
    """The first events of a process whose files all lie in a template (tokens): as many as it has counted events, less the template's other files."""
    profile = frequent_accesses(ctx)
    sized = profile.withColumn("files", F.count(F.lit(1)).over(Window.partitionBy("epoch_id", "pid")))
    known = templates.select("tokens").distinct().withColumn("size", F.size("tokens")).select("tokens", "size", F.explode("tokens").alias("exe"))
    fits = sized.join(known, "exe").groupBy("epoch_id", "pid", "files", "tokens", "size").agg(F.count(F.lit(1)).alias("in_template")).where("in_template = files")
    largest = fits.groupBy("epoch_id", "pid", "files").agg(F.max("size").alias("size"))
    process = Window.partitionBy("epoch_id", "pid")
    ids = counted_accesses(ctx).withColumn("nth", F.row_number().over(process.orderBy("event_id"))).withColumn("ids", F.count(F.lit(1)).over(process))
    return ids.join(largest, ["epoch_id", "pid"]).where("nth <= ids - (size - files)").select(*KEY)


# -- generalised names ---------------------------------------------------------------------------------------------------------
def wildcards(values: DataFrame, kind: str) -> DataFrame:
    """(epoch_id, value, wildcard) of the different values of (epoch_id, value); ``kind`` is path or dir.

    Leader clustering is sequential, so an epoch's different values are one group; the events are not.
    """
    close, merge = (T.similar, T.wildcard) if kind == "path" else (T.near_dirs, T.merge_dirs)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = T.leader_clusters(sorted(rows["value"]), close, merge)
        return pd.DataFrame({"epoch_id": rows["epoch_id"], "value": rows["value"], "wildcard": rows["value"].map(shapes)})

    kind_of = dict(values.dtypes)["epoch_id"]
    return values.distinct().groupBy("epoch_id").applyInPandas(cluster, f"epoch_id {kind_of}, value string, wildcard string")


def approx_actions(ctx: Context, least_length: int = 10) -> DataFrame:
    """(epoch_id, event_id, place, action) by generalised names.

    A file is in the group of each generalised name that a process gave it.  Of the accesses of one process to a group, reads and writes apart, the oldest
    is MANGLE and the others DROP; groups follow one another by name, which is their place.
    """
    access = ctx.resolved.where("syscall in (0, 1) and file >= 3").select(*KEY, "pid", "file", "syscall")
    named = access.select("epoch_id", "pid", "file").distinct().join(opened_names(ctx), ["epoch_id", "pid", "file"])
    dirs = wildcards(named.select("epoch_id", F.col("cwd").alias("value")), "dir").toDF("epoch_id", "cwd", "cwd_wildcard")
    paths = wildcards(named.select("epoch_id", F.col("path").alias("value")), "path").toDF("epoch_id", "path", "path_wildcard")
    groups = named.join(dirs, ["epoch_id", "cwd"]).join(paths, ["epoch_id", "path"]).where(F.length("cwd_wildcard") + F.length("path_wildcard") >= least_length)
    rows = access.join(groups.select("epoch_id", "file", "cwd_wildcard", "path_wildcard").distinct(), ["epoch_id", "file"])
    nth = F.row_number().over(Window.partitionBy("epoch_id", "cwd_wildcard", "path_wildcard", "pid", "syscall").orderBy("event_id"))
    place = F.concat(F.lit("1/"), F.col("cwd_wildcard"), F.lit("\0"), F.col("path_wildcard"))
    return rows.select(*KEY, place.alias("place"), F.when(nth == 1, "MANGLE").otherwise("DROP").alias("action"))


def approx(ctx: Context, least_length: int = 10) -> DataFrame:
    """(epoch_id, event_id, place, action): what is dropped at once comes before what generalised names decide."""
    at_once = approx_at_once(ctx).select(*KEY, F.lit("0/").alias("place"), F.lit("DROP").alias("action"))
    return at_once.unionByName(approx_actions(ctx, least_length))


# -- garbage collection --------------------------------------------------------------------------------------------------------
def log_gc_batch(ctx: Context) -> DataFrame:
    """Garbage at the end of the epoch: the least fixpoint of trimming dead nodes.

    A dead file goes if all its edges meet one node; a dead process, once no edge that modifies it comes from a node that stays.
    Trimming drops the node's out-edges and its in-edges that do not modify it.
    """
    e = ctx.edges
    dead = e.where("rel = 'EXITED_BY'").select("epoch_id", F.col("src").alias("node")).unionByName(e.where("rel = 'UNLINKED_BY'").select("epoch_id", F.col("src").alias("node"))).distinct()
    ends = e.select("epoch_id", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select("epoch_id", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    lone = ends.groupBy("epoch_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("epoch_id", "node")
    trimmed = materialize(dead.where("node like 'i%'").join(lone, ["epoch_id", "node"], "left_semi"), "trimmed")
    processes = materialize(dead.where("node like 'p%'"), "dead")
    holds = materialize(e.where(F.col("rel").isin(*MODIFYING)).select("epoch_id", F.col("src").alias("by"), F.col("dst").alias("node")).distinct(), "holds")
    while True:
        held = holds.join(trimmed.withColumnRenamed("node", "by"), ["epoch_id", "by"], "left_anti").select("epoch_id", "node").distinct()
        new = materialize(processes.join(held, ["epoch_id", "node"], "left_anti").join(trimmed, ["epoch_id", "node"], "left_anti"), "trimmed")
        if new.isEmpty():
            break
        trimmed = trimmed.unionByName(new)
    out = e.join(trimmed.withColumnRenamed("node", "src"), ["epoch_id", "src"], "left_semi").select(*KEY)
    into = e.where(~F.col("rel").isin(*MODIFYING)).join(trimmed.withColumnRenamed("node", "dst"), ["epoch_id", "dst"], "left_semi").select(*KEY)
    return out.unionByName(into).distinct()


def collect_garbage(edge_rows: list[tuple]) -> set[int]:
    """Events dropped by garbage collection as edges (event_id, src, dst, rel) arrive; a node is judged when an unlink or exit concerns it."""
    dropped: set[int] = set()
    into: dict[str, list] = {}
    out: dict[str, list] = {}
    dead: set[str] = set()

    def others(node: str) -> set[str]:
        return {e[2] for e in out.get(node, ())} | {e[1] for e in into.get(node, ())}

    def trim(first: str) -> None:
        waiting, seen = [first], set()
        while waiting:
            node = waiting.pop()
            if node in seen or node not in dead:
                continue
            if node[0] == "p":
                if any(e[3] in MODIFYING and e[0] not in dropped for e in into.get(node, ())):
                    continue
            elif len(others(node)) != 1:
                continue
            seen.add(node)
            dropped.update(e[0] for e in out.get(node, ()))
            dropped.update(e[0] for e in into.get(node, ()) if e[3] not in MODIFYING)
            waiting.extend(sorted({e[2] for e in out.get(node, ())}))

    for edge in sorted(edge_rows):
        out.setdefault(edge[1], []).append(edge)
        into.setdefault(edge[2], []).append(edge)
        if edge[3] in ("UNLINKED_BY", "EXITED_BY"):
            dead.add(edge[1])
            trim(edge[1])
    return dropped


def log_gc(ctx: Context) -> DataFrame:
    """Garbage judged at the moment of each unlink and exit; an epoch is one ordered state machine."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = collect_garbage(list(rows[["event_id", "src", "dst", "rel"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"epoch_id": [rows["epoch_id"].iloc[0]] * len(found), "event_id": sorted(found)})

    kind = dict(ctx.edges.dtypes)["epoch_id"]
    return ctx.edges.select(*KEY, "src", "dst", "rel").groupBy("epoch_id").applyInPandas(run, f"epoch_id {kind}, event_id long")


# -- registry -----------------------------------------------------------------------------------------------------------------
def _drops(technique: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    return lambda ctx: technique(ctx).select(*KEY, F.lit("0").alias("place"), F.lit("DROP").alias("action"))


def _with_repeats(technique: Callable[[DataFrame], DataFrame]) -> Callable[[Context], DataFrame]:
    return _drops(lambda ctx: technique(ctx.edges).unionByName(graph.repeats(ctx.resolved)))


def tag(ctx: Context) -> DataFrame:
    return closure.tag(ctx.resolved, ctx.edges, materialize(closure.tag_seeds(ctx.resolved, ctx.keywords, ctx.pairs), "tagged"))


def nodemerge_mined(ctx: Context) -> DataFrame:
    """Node merging by the context's templates, or by those mined from the context itself."""
    return nodemerge(ctx, ctx.templates if ctx.templates is not None else materialize(mine_templates(frequent_accesses(ctx)), "templates"))


#: Techniques by name, in the order of the decision table's columns; each gives (epoch_id, event_id, place, action).  Add to it to extend the engine.
REGISTRY: dict[str, Callable[[Context], DataFrame]] = {
    "REDUNDANT_IO": _drops(redundant_io), "LOG_GC": _drops(log_gc_batch), "APPROX": approx, "INDUCTION": _drops(induction), "UNSUPPORTED": _drops(unsupported), "IBURST": _drops(iburst), "TAG": _drops(tag),
    "DPRESERVE_FD": _with_repeats(closure.dpreserve_fd), "DPRESERVE_SD": _with_repeats(closure.dpreserve_sd), "NODEMERGE": _drops(nodemerge_mined),
}
#: The techniques that a run uses unless told otherwise.
ACTIVE = [t for t in REGISTRY if t not in ("UNSUPPORTED", "TAG")]


def decide(ctx: Context, names: list[str] | None = None) -> DataFrame:
    """(epoch_id, event_id, technique, action) of the techniques named: for each event and technique its first action."""
    parts = [REGISTRY[name](ctx).select(*KEY, F.lit(name).alias("technique"), "place", "action") for name in names or ACTIVE]
    return analysis.first_action(reduce(DataFrame.unionByName, parts))
