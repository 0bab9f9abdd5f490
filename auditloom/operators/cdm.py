"""Provenance datums (CDM) to edges and to audit lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Event types by the direction of their edge, and their system calls.
SUBJECT_TO_OBJECT = ["EVENT_OPEN", "EVENT_CLOSE", "EVENT_LOADLIBRARY", "EVENT_RECVMSG", "EVENT_RECVFROM", "EVENT_READ", "EVENT_ACCEPT"]
OBJECT_TO_SUBJECT = [
    "EVENT_EXIT", "EVENT_UNIT", "EVENT_FORK", "EVENT_EXECUTE", "EVENT_CLONE", "EVENT_CHANGE_PRINCIPAL", "EVENT_MODIFY_PROCESS", "EVENT_SIGNAL", "EVENT_CONNECT", "EVENT_CREATE_OBJECT", "EVENT_WRITE", "EVENT_MPROTECT",
    "EVENT_SENDTO", "EVENT_SENDMSG", "EVENT_UNLINK", "EVENT_MODIFY_FILE_ATTRIBUTES", "EVENT_TRUNCATE", "EVENT_LSEEK",
]
CALLS = {
    "EVENT_OPEN": 2, "EVENT_CLOSE": 3, "EVENT_READ": 0, "EVENT_ACCEPT": 43, "EVENT_RECVFROM": 45, "EVENT_LOADLIBRARY": 47, "EVENT_RECVMSG": 47, "EVENT_EXECUTE": 59, "EVENT_WRITE": 1, "EVENT_UNLINK": 87,
    "EVENT_EXIT": 60, "EVENT_CONNECT": 42, "EVENT_SENDTO": 44, "EVENT_UNIT": 57, "EVENT_FORK": 57, "EVENT_CLONE": 56, "EVENT_CHANGE_PRINCIPAL": 105, "EVENT_MODIFY_PROCESS": 22, "EVENT_SIGNAL": 22,
    "EVENT_CREATE_OBJECT": 22, "EVENT_MPROTECT": 10, "EVENT_SENDMSG": 46, "EVENT_MODIFY_FILE_ATTRIBUTES": 92, "EVENT_TRUNCATE": 76, "EVENT_LSEEK": 8, "EVENT_OTHER": 11,
}


@dataclass
class Provenance:
    """Datums by kind.  Every table has seq, the datum's place in its file, and uuid."""

    events: DataFrame  # type, nanos, subject, object
    processes: DataFrame  # pid, parent, principal, nanos, unit, iteration, count, command, name, cwd
    files: DataFrame  # path
    flows: DataFrame  # local, local_port, remote, remote_port, protocol

    def vertices(self) -> DataFrame:
        """(uuid, seq) of everything that an event may have at its ends."""
        parts = [t.select("uuid", "seq") for t in (self.processes, self.files, self.flows)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dispatch(datums: DataFrame) -> Provenance:
    """Datums (seq and the columns of ``CDM_SCHEMA``) to tables; kinds that make neither vertices nor events are left out."""
    kind = F.regexp_extract("type", r"([A-Za-z]+)$", 1)
    event = F.col("type").startswith("EVENT_")
    events = datums.where(event).select("seq", "uuid", "type", F.col("timestampNanos").alias("nanos"), "subject", F.col("predicateObject").alias("object"))
    of = lambda name: datums.where(~event & (kind == name))
    held = lambda c, k: F.try_element_at(c, F.lit(k))
    props, base = F.col("properties"), F.col("baseObject.properties")
    processes = of("Subject").select(
        "seq", "uuid", F.col("cid").alias("pid"), F.col("parentSubject").alias("parent"), F.col("localPrincipal").alias("principal"), F.col("startTimestampNanos").alias("nanos"), F.col("unitId").alias("unit"),
        "iteration", "count", F.col("cmdLine").alias("command"), held(props, "name").alias("name"), held(props, "cwd").alias("cwd"),
    )
    files = of("FileObject").select("seq", "uuid", F.coalesce(held(base, "filename"), held(base, "path"), F.lit("")).alias("path"))
    flows = of("NetFlowObject").select("seq", "uuid", F.col("localAddress").alias("local"), F.col("localPort").alias("local_port"), F.col("remoteAddress").alias("remote"), F.col("remotePort").alias("remote_port"), F.col("ipProtocol").alias("protocol"))
    return Provenance(events, processes, files, flows)


def _known(rows: DataFrame, vertices: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` names a vertex that comes before them."""
    first = vertices.groupBy(F.col("uuid").alias(column)).agg(F.min("seq").alias("since"))
    return rows.join(first, column).where("since < seq").drop("since")


def edges(events: DataFrame, vertices: DataFrame) -> DataFrame:
    """(uuid, src, dst, type) of events (seq, uuid, type, subject, object) both of whose ends are vertices (uuid, seq) that come before the event."""
    forward, backward = F.col("type").isin(*SUBJECT_TO_OBJECT), F.col("type").isin(*OBJECT_TO_SUBJECT)
    rows = events.where(forward | backward).select("seq", "uuid", "type", F.when(forward, F.col("subject")).otherwise(F.col("object")).alias("src"), F.when(forward, F.col("object")).otherwise(F.col("subject")).alias("dst"))
    return _known(_known(rows, vertices, "src"), vertices, "dst").select("uuid", "src", "dst", "type")


def to_audit(events: DataFrame, subjects: DataFrame, files: DataFrame) -> DataFrame:
    """(seq, at, value): audit lines of events (seq, uuid, type, nanos, subject, object).

    ``subjects`` has (seq, uuid, pid, parent); a missing parent is process 1.  ``files`` has (seq, uuid, path).  A subject or file counts for
    events that come after it.  Files get inodes from 3 on in the order of their first use.
    """
    used = events.select("seq", F.col("object").alias("uuid")).join(files.select("uuid", F.col("seq").alias("since")), "uuid").where("since < seq")
    # Places of first use: one row for each file, numbered by ranges so that no task holds them all.
    first = used.groupBy(F.col("uuid").alias("object")).agg(F.min("seq").alias("first"))
    width = 1 << 16
    block = F.floor(F.col("first") / width)
    inside = first.withColumn("block", block).withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("first")))
    sizes = inside.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    inodes = inside.join(before, "block").select("object", (F.col("nth") + F.col("before") + 2).alias("inode"))
    parents = subjects.select(F.col("uuid").alias("parent"), F.col("pid").alias("parent_pid"))
    who = subjects.join(parents, "parent", "left").select(F.col("uuid").alias("subject"), F.col("seq").alias("subject_seq"), "pid", F.coalesce("parent_pid", F.lit(1)).alias("ppid"))
    named = files.select(F.col("uuid").alias("object"), F.col("seq").alias("since"), "path").join(inodes, "object")
    rows = events.join(who, "subject").where("subject_seq < seq").join(named, "object", "left").withColumn("path", F.when(F.col("since") < F.col("seq"), F.col("path")))
    number = F.create_map(*[F.lit(x) for k, v in CALLS.items() for x in (k, v)])[F.col("type")]
    stamp = F.concat(F.lit("msg=audit("), F.format_string("%f", F.col("nanos") / 1e9), F.lit(":0):"))
    call = lambda *rest: F.concat(F.lit("type=SYSCALL "), stamp, F.lit(" arch=c000003e syscall="), number.cast("string"), *rest)
    pid, ppid, inode = (F.col(c).cast("string") for c in ("pid", "ppid", "inode"))
    absolute = F.col("path").startswith("/") & F.col("inode").isNotNull()
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    cwd = F.concat(F.lit("type=CWD "), stamp, F.lit(' cwd="'), F.when(folder == "", "/").otherwise(folder), F.lit('"'))
    path = F.concat(F.lit("type=PATH "), stamp, F.lit(' name="'), name, F.lit('" inode='), inode)
    title = F.concat(F.lit("type=PROCTITLE "), stamp, F.lit(" proctitle=DEADBEEF"))
    program = F.concat(F.lit("type=EXECVE "), stamp, F.lit(' a0="'), name, F.lit('"'))
    kind = F.col("type")
    shapes = [
        (kind == "EVENT_OPEN", F.when(absolute, F.array(call(F.lit(" exit="), inode, F.lit(" pid="), pid), cwd, path, title))),
        (kind == "EVENT_CLOSE", F.when(absolute, F.array(call(F.lit(" a0="), inode, F.lit(" pid="), pid)))),
        (kind.isin("EVENT_READ", "EVENT_WRITE"), F.when(absolute, F.array(call(F.lit(" a0="), inode, F.lit(" pid="), pid, F.lit(' exe="'), F.col("path"), F.lit('"'))))),
        (kind == "EVENT_UNLINK", F.when(absolute, F.array(call(F.lit(" pid="), pid), cwd, path, title))),
        (kind == "EVENT_EXECUTE", F.when(absolute, F.array(call(F.lit(" ppid="), ppid, F.lit(" pid="), pid), program, cwd, path, title))),
        (kind == "EVENT_EXIT", F.array(call(F.lit(" ppid="), ppid, F.lit(" pid="), pid))),
        (number.isNotNull(), F.array(call(F.lit(" pid="), pid))),
    ]
    lines = F.when(shapes[0][0], shapes[0][1])
    for test, line in shapes[1:]:
        lines = lines.when(test, line)
    return rows.select("seq", F.posexplode(lines).alias("at", "value"))
