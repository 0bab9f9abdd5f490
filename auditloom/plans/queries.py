"""One query for each operator, on the audit projection of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import analysis, cdm, closure, graph, sessions, techniques
from auditloom.operators.support import materialize
from auditloom.plans.projection import audit_events, audit_lines, wall_seconds
from auditloom.sources import audit
from auditloom.streaming import epochs

KEYWORDS = ["aaaaaaaa3.log"]
PAIRS = [("/home/u1", "7.log"), ("/home/u2", "aaa4")]
VIRTUAL = r"^/home/u[0-9]+/aaaaaaaa[3-5]\.log$"
VIRTUAL_FILES = (3, 5)  # the audit log's virtual files; names recur every 260 files, so a user's own file may have the path of one
MATRIX = list(techniques.REGISTRY)  # the study takes all ten


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.parse(audit_lines(audit_events(spark, sf_dir)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.events_of(sessions.sessionize(sessions.with_fields(entries(spark, sf_dir))))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.drop_unresolved(sessions.resolve(events(spark, sf_dir)))


def settled(spark: SparkSession, sf_dir: str, *fields: str) -> techniques.Context:
    """The context with its tables written once, for operators that read them many times; of an event's other fields only those named."""
    rows = materialize(resolved(spark, sf_dir).select("epoch_id", "event_id", "syscall", "pid", "ppid", "fd", "file", *fields), "resolved")
    return techniques.Context(rows, materialize(graph.edges(rows), "edges"), keywords=KEYWORDS, pairs=PAIRS)


def context(spark: SparkSession, sf_dir: str) -> techniques.Context:
    return techniques.context(resolved(spark, sf_dir))


# -- parsing and sessions -----------------------------------------------------------------------------------------------
def audit_parse(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("epoch_id", "type").agg(F.count(F.lit(1)).alias("records"), F.sum("msg_len").alias("bytes"), F.min("seconds").alias("first_second"))


def audit_fields(spark, sf_dir):
    return events(spark, sf_dir).select("epoch_id", "event_id", "seconds", "syscall", "pid", "ppid", "fd", "exe", "cwd", "path", "inode", "program")


def sessionize(spark, sf_dir):
    return sessions.sessionize(entries(spark, sf_dir)).groupBy("epoch_id", "event_id").agg(F.count(F.lit(1)).alias("records"), F.max("closed").alias("closed"))


def event_size(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "size_bytes")


def fd_resolve(spark, sf_dir):
    return sessions.resolve(events(spark, sf_dir)).select("epoch_id", "event_id", "syscall", "pid", "file")


def drop_unresolved(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("epoch_id", "syscall").agg(F.count(F.lit(1)).alias("n"))


def drop_virtual(spark, sf_dir):
    path = T.construct_path(F.col("cwd"), F.col("path"))
    rows = resolved(spark, sf_dir).withColumn("full_path", path)
    return sessions.drop_virtual(rows, F.col("full_path").rlike(VIRTUAL) & F.col("file").between(*VIRTUAL_FILES)).select("epoch_id", "event_id", "syscall")


def kernel_rules(spark, sf_dir):
    return sessions.kept_by_kernel(events(spark, sf_dir), (0, 1, 2, 3, 59)).groupBy("syscall").agg(F.count(F.lit(1)).alias("n"))


def epoch_counters(spark, sf_dir):
    return sessions.counters(events(spark, sf_dir))


# -- graph -----------------------------------------------------------------------------------------------------------------
def edges(spark, sf_dir):
    return context(spark, sf_dir).edges.select("epoch_id", "event_id", "src", "dst", "rel", "t_s")


def edges_unlink_twice(spark, sf_dir):
    return graph.edges(resolved(spark, sf_dir), unlink_twice=True).groupBy("epoch_id", "rel").agg(F.count(F.lit(1)).alias("n"))


def nodes(spark, sf_dir):
    return graph.nodes(context(spark, sf_dir).edges)


def node_degree(spark, sf_dir):
    return graph.degrees(context(spark, sf_dir).edges)


# -- techniques --------------------------------------------------------------------------------------------------------------
def _dropped(technique, settle=False, fields=()):
    def query(spark, sf_dir):
        return technique(settled(spark, sf_dir, *fields) if settle else context(spark, sf_dir)).select("epoch_id", "event_id")

    return query


def repeat_open_close(spark, sf_dir):
    return graph.repeats(resolved(spark, sf_dir))


def induction_freq(spark, sf_dir):
    return techniques.induction_frequencies(settled(spark, sf_dir, "program"))


def grammar(spark, sf_dir):
    return techniques.grammar(settled(spark, sf_dir, "program", "cwd", "path"))


def fap(spark, sf_dir):
    return techniques.frequent_accesses(context(spark, sf_dir))


def template_mine(spark, sf_dir):
    return techniques.mine_templates(techniques.frequent_accesses(context(spark, sf_dir))).select("template", "n")


def nodemerge(spark, sf_dir):
    ctx = settled(spark, sf_dir, "exe")
    return techniques.nodemerge(ctx, materialize(techniques.mine_templates(techniques.frequent_accesses(ctx)), "templates"))


def tag_seed(spark, sf_dir):
    return closure.tag_seeds(resolved(spark, sf_dir), KEYWORDS, PAIRS)


def tag_trace(spark, sf_dir):
    return techniques.tag(settled(spark, sf_dir, "message", "cwd", "path"))


def wildcard_cluster(spark, sf_dir):
    paths = resolved(spark, sf_dir).where("path is not null").select("epoch_id", F.col("path").alias("value"))
    return techniques.wildcards(paths, "path")


def approx(spark, sf_dir):
    return techniques.decide(settled(spark, sf_dir, "cwd", "path"), ["APPROX"]).drop("technique")


def reduced_log(spark, sf_dir):
    """What is left of the log without the events that runs of reads and writes make redundant."""
    rows = sessions.sessionize(entries(spark, sf_dir))
    left = sessions.without_events(rows, techniques.redundant_io(context(spark, sf_dir)))
    return left.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("records"), F.sum("msg_len").alias("bytes"))


def reduced_nodes(spark, sf_dir):
    """The nodes that keep an edge without the events that runs make redundant."""
    ctx = settled(spark, sf_dir)
    return graph.nodes(graph.without_events(ctx.edges, techniques.iburst(ctx)))


# -- strings -------------------------------------------------------------------------------------------------------------------
def levenshtein_pairs(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_name")
    other = nation.withColumnRenamed("n_name", "other")
    pairs = nation.join(other, "n_regionkey").where("n_name < other")
    distance = F.levenshtein("n_name", "other")
    return pairs.select("n_name", "other", distance.alias("distance"), (F.round(1 - distance / F.greatest(F.length("n_name"), F.length("other")), 4)).alias("similarity"))


def dir_distance(spark, sf_dir):
    rows = events(spark, sf_dir).where("exe is not null").select("epoch_id", "pid", "event_id", T.unquoted(F.col("exe")).alias("path"))
    rows = rows.withColumn("last", F.lag("path").over(Window.partitionBy("pid").orderBy("event_id"))).where("last is not null")
    return rows.select("event_id", T.dir_distance(F.col("last"), F.col("path")).alias("distance"), T.dir_wildcard(F.col("last"), F.col("path")).alias("wildcard"))


def open_flags(spark, sf_dir):
    value = F.lower(F.hex((F.col("k") * 84017 + F.col("event_id") % 4).cast("long")))
    return audit_events(spark, sf_dir).select("event_id", T.open_flags(value).alias("flags"))


def proctitle(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", T.proctitle(F.concat(F.hex("n_name"), F.lit("002D6C"))).alias("title"))


def ipv4(spark, sf_dir):
    return events(spark, sf_dir).where("saddr is not null").select("event_id", T.ipv4(F.col("saddr")).alias("address"))


def uuid_octal(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", T.uuid_hex(F.col("n_name").cast("binary")).alias("uuid"), T.octal(F.col("n_nationkey") * 20 + 7).alias("mode"))


def account_record(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("type=USER_ACCT msg=audit(100.5:"), key, F.lit("): pid="), key, F.lit(" uid=0 auid=5 ses=1 msg='op=PAM:accounting acct=\""), F.col("c_mktsegment"), F.lit("\" exe=\"/bin/su\" hostname=? addr=? terminal=cron res=success'"))
    return customer.select("c_custkey", T.account_record(line).alias("r")).select("c_custkey", "r.type", "r.time", "r.pid", "r.op", "r.acct", "r.exe", "r.res")


def bursting(spark, sf_dir):
    return sessions.bursting(sessions.sessionize(entries(spark, sf_dir)), records=3, seconds=5.0).select("event_id", "records", "span", "bursting")


def dedup_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(" ", "event_type", "props").alias("value"))
    return epochs.distinct_lines(rows)


def epoch_tumbling(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts")
    return epochs.tumbling(rows, "ts", "30 seconds").select(wall_seconds("window_start").alias("window_start"), "n")


# -- decisions and the study ------------------------------------------------------------------------------------------------------
_study: dict[tuple[str, str], tuple] = {}


def _decided(spark, sf_dir):
    """The context and the decisions of all techniques, written once for each session and folder: the study's questions share them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _study:
        _study.clear()
        ctx = settled(spark, sf_dir, "message", "cwd", "path", "program", "exe", "seconds", "size_bytes")
        _study[key] = ctx, materialize(techniques.decide(ctx, MATRIX), "decided")
    return _study[key]


def _matrix(spark, sf_dir):
    ctx, decided = _decided(spark, sf_dir)
    return analysis.matrix(ctx.resolved, decided, MATRIX)


def decision_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


def decision_rows(spark, sf_dir):
    ctx, decided = _decided(spark, sf_dir)
    return analysis.decision_rows(ctx.resolved, analysis.dropped(decided)).select("epoch_id", "event_id", "seconds", "size_bytes", "techniques")


def confusion_matrix(spark, sf_dir):
    return analysis.confusion(analysis.dropped(_decided(spark, sf_dir)[1]))


def reduction_counters(spark, sf_dir):
    ctx, decided = _decided(spark, sf_dir)
    return analysis.reductions(ctx.resolved, decided)


def technique_report(spark, sf_dir):
    return analysis.report(_decided(spark, sf_dir)[1])


def rq1_drop_counts(spark, sf_dir):
    return analysis.drop_counts(_matrix(spark, sf_dir), MATRIX)


def rq2_class_counts(spark, sf_dir):
    return analysis.class_counts(resolved(spark, sf_dir))


def syscall_class(spark, sf_dir):
    return resolved(spark, sf_dir).select("event_id", "syscall", analysis.syscall_class().alias("class"))


def rq2_class_by_technique(spark, sf_dir):
    return analysis.class_by_technique(_matrix(spark, sf_dir), MATRIX)


def _histogram(spark, sf_dir):
    return materialize(analysis.histogram(_matrix(spark, sf_dir), MATRIX), "histogram")


def _rq3(part, whole):
    def query(spark, sf_dir):
        return analysis.pairwise(_histogram(spark, sf_dir), MATRIX).select("t1", "t2", analysis.percent(part, whole).alias("percent"))

    return query


def _rq4(size):
    def query(spark, sf_dir):
        return analysis.coverage(_histogram(spark, sf_dir), MATRIX, size)

    return query


def rq4_greedy(spark, sf_dir):
    return analysis.greedy(_histogram(spark, sf_dir), MATRIX)


# -- provenance datums -----------------------------------------------------------------------------------------------------------------
def cdm_datums(spark, sf_dir):
    """The audit projection as datums: first subjects, files and flows, then events.  Objects whose number is divisible by 7 are flows for 7, missing for 14."""
    rows = audit_events(spark, sf_dir)
    kind = F.expr("""CASE syscall WHEN 0 THEN 'EVENT_READ' WHEN 1 THEN 'EVENT_WRITE' WHEN 2 THEN 'EVENT_OPEN' WHEN 3 THEN 'EVENT_CLOSE' WHEN 59 THEN 'EVENT_EXECUTE' WHEN 45 THEN 'EVENT_RECVFROM'
                     WHEN 44 THEN 'EVENT_SENDTO' WHEN 42 THEN 'EVENT_CONNECT' WHEN 43 THEN 'EVENT_ACCEPT' WHEN 10 THEN 'EVENT_MPROTECT' WHEN 41 THEN 'EVENT_OTHER' WHEN 87 THEN 'EVENT_UNLINK' WHEN 263 THEN 'EVENT_TRUNCATE' ELSE 'EVENT_EXIT' END""")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    path = F.concat(F.lit("/data/d"), (F.col("inode") % 5).cast("string"), F.lit("/"), text("f", "inode"))
    own = F.create_map(F.when(F.col("inode") % 2 == 0, "filename").otherwise("path"), path)
    inodes = rows.select("inode").distinct()
    parts = [
        rows.select("pid").distinct().select(F.lit("Subject").alias("type"), F.lit(-2).cast("long").alias("seq"), text("s", "pid").alias("uuid"), F.col("pid").alias("cid"), F.concat(F.lit("s"), (F.col("pid") - 1).cast("string")).alias("parentSubject")),
        inodes.where("inode % 7 <> 0").select(F.lit("FileObject").alias("type"), F.lit(-1).cast("long").alias("seq"), text("o", "inode").alias("uuid"), F.struct(own.alias("properties")).alias("baseObject")),
        inodes.where("inode % 14 = 7").select(F.lit("NetFlowObject").alias("type"), F.lit(-1).cast("long").alias("seq"), text("o", "inode").alias("uuid"), F.lit(80).alias("localPort")),
        rows.select(kind.alias("type"), F.col("event_id").alias("seq"), text("e", "event_id").alias("uuid"), (F.col("sec") * 1000000000).alias("timestampNanos"), text("s", "pid").alias("subject"), text("o", "inode").alias("predicateObject")),
    ]
    every = spark.createDataFrame([], audit.CDM_SCHEMA + ", seq bigint")
    for part in parts:
        every = every.unionByName(part, allowMissingColumns=True)
    return every


def cdm_edges(spark, sf_dir):
    found = cdm.dispatch(cdm_datums(spark, sf_dir))
    return cdm.edges(found.events, found.vertices())


def cdm_to_audit(spark, sf_dir):
    found = cdm.dispatch(cdm_datums(spark, sf_dir))
    return cdm.to_audit(found.events, found.processes, found.files)


def cdm_vertices(spark, sf_dir):
    found = cdm.dispatch(cdm_datums(spark, sf_dir))
    rows = [found.processes.select("uuid", F.concat_ws("|", F.col("pid").cast("string"), "parent").alias("what")), found.files.select("uuid", F.col("path").alias("what")), found.flows.select("uuid", F.col("local_port").cast("string").alias("what"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def queries() -> dict:
    return {
        "audit_parse": audit_parse, "audit_fields": audit_fields, "sessionize": sessionize, "event_size": event_size, "fd_resolve": fd_resolve, "drop_unresolved": drop_unresolved, "drop_virtual": drop_virtual,
        "kernel_rules": kernel_rules, "epoch_counters": epoch_counters, "edges": edges, "edges_unlink_twice": edges_unlink_twice, "nodes": nodes, "node_degree": node_degree,
        "redundant_io": _dropped(techniques.redundant_io), "iburst": _dropped(techniques.iburst), "repeat_open_close": repeat_open_close, "unsupported": _dropped(techniques.unsupported),
        "approx_at_once": _dropped(techniques.approx_at_once), "induction_freq": induction_freq, "induction": _dropped(techniques.induction, True, ["program"]), "grammar": grammar, "fap": fap, "template_mine": template_mine, "nodemerge": nodemerge,
        "tag_seed": tag_seed, "tag_trace": tag_trace, "dpreserve_sd": _dropped(lambda ctx: closure.dpreserve_sd(ctx.edges), True), "dpreserve_fd": _dropped(lambda ctx: closure.dpreserve_fd(ctx.edges), True),
        "log_gc_batch": _dropped(techniques.log_gc_batch, True), "log_gc": _dropped(techniques.log_gc), "wildcard_cluster": wildcard_cluster, "approx": approx, "levenshtein_pairs": levenshtein_pairs, "dir_distance": dir_distance,
        "open_flags": open_flags, "proctitle": proctitle, "ipv4": ipv4, "uuid_octal": uuid_octal, "account_record": account_record, "bursting": bursting, "decision_rows": decision_rows, "dedup_lines": dedup_lines, "epoch_tumbling": epoch_tumbling, "decision_matrix": decision_matrix, "confusion_matrix": confusion_matrix,
        "reduction_counters": reduction_counters, "rq1_drop_counts": rq1_drop_counts, "rq2_class_counts": rq2_class_counts, "syscall_class": syscall_class, "rq2_class_by_technique": rq2_class_by_technique,
        "rq3_overlap": _rq3("both", "either"), "rq3_unique_union": _rq3("only_first", "either"), "rq3_unique_self": _rq3("only_first", "first"), "rq4_pairs": _rq4(2), "rq4_triples": _rq4(3), "rq4_greedy": rq4_greedy,
        "cdm_edges": cdm_edges, "cdm_to_audit": cdm_to_audit, "cdm_vertices": cdm_vertices, "reduced_log": reduced_log, "reduced_nodes": reduced_nodes, "technique_report": technique_report,
    }
