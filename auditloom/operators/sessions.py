"""Parsing, sessionising and descriptor resolution: from lines to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators.support import dealt

HANDLED = (0, 1, 2, 3, 42, 43, 44, 45, 59, 60, 87, 231, 263)
IGNORED = (9, 10)
BLOCK_BITS = 16  # of an entry id inside a block of an epoch


def parse(lines: DataFrame) -> DataFrame:
    """(entry_id, epoch_id, type, msg, msg_len, seconds, time)."""
    msg = F.col("value")
    return lines.select(
        "entry_id", "epoch_id", F.regexp_extract(msg, r"(?:^| )type=([^ ]+)", 1).alias("type"), msg.alias("msg"), F.octet_length(msg).alias("msg_len"), T.record_seconds(msg).alias("seconds"), T.record_time(msg).alias("time")
    )


def sessionize(entries: DataFrame) -> DataFrame:
    """Add event_id (the entry id of the event's first record) and closed.

    An event begins at a SYSCALL record and ends at the next one or at EOE.  Records before the first, or between EOE and the next SYSCALL, belong to none.
    An event is closed if it has an EOE or is followed by another.
    Entries are ordered in blocks of ids; a block's first row, which has no entry id, carries what the epoch's earlier blocks leave open.
    """
    mark = lambda kind: F.when(F.col("type") == kind, F.col("entry_id"))
    rows = entries.withColumns({"block": F.shiftright("entry_id", BLOCK_BITS), "started": mark("SYSCALL"), "ended": mark("EOE")})
    blocks = rows.groupBy("epoch_id", "block").agg(F.max("started").alias("started"), F.max("ended").alias("ended"))
    epoch = Window.partitionBy("epoch_id")
    before = epoch.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.greatest("started", "ended")).over(epoch)
    carried = blocks.select("epoch_id", "block", F.max("started").over(before).alias("started"), F.max("ended").over(before).alias("ended"), latest.alias("later"))
    rows = dealt(rows.unionByName(carried, allowMissingColumns=True), "epoch_id", "block")
    order = Window.partitionBy("epoch_id", "block").orderBy("entry_id")  # the carried row comes first
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"event_id": F.max("started").over(sofar), "last_end": F.max("ended").over(order.rowsBetween(Window.unboundedPreceding, -1)), "latest": F.max("later").over(sofar)})
    rows = rows.where("entry_id is not null and event_id is not null and (last_end is null or last_end < event_id)")
    return rows.withColumn("closed", F.col("latest") > F.col("event_id")).select(*entries.columns, "event_id", "closed")


def with_fields(entries: DataFrame) -> DataFrame:
    """Add the fields of records that events need, each null in records of another type.  Before ordering, they take the place of the text where it is not needed."""
    msg, kind = F.col("msg"), F.col("type")
    of = lambda record, name: F.when(kind == record, T.field_text(msg, name))
    texts = {"syscall": "SYSCALL", "pid": "SYSCALL", "ppid": "SYSCALL", "a0": "SYSCALL", "exit": "SYSCALL", "exe": "SYSCALL", "cwd": "CWD", "name": "PATH", "inode": "PATH", "saddr": "SOCKADDR"}
    rows = entries.withColumns({f"f_{name}": of(record, name) for name, record in texts.items()} | {"f_program": of("EXECVE", "a0")})
    text = lambda name: F.nullif(f"f_{name}", F.lit(""))
    number = lambda name, of_type: F.col(f"f_{name}").try_cast(of_type)
    return rows.withColumns(
        {f"f_{name}": number(name, "int") for name in ("syscall", "pid", "ppid")} | {f"f_{name}": text(name) for name in ("a0", "exit", "exe", "program", "saddr")} | {f"f_{name}": T.unquoted(text(name)) for name in ("cwd", "name")} | {"f_inode": number("inode", "long")}
    )


def events_of(sessions: DataFrame, fd_exit_base: int = 16) -> DataFrame:
    """One row for each closed event, with the fields of its records; the last PATH record is the target."""
    msg, kind = F.col("msg"), F.col("type")
    rows = sessions if "f_syscall" in sessions.columns else with_fields(sessions)

    def of(record: str, name: str) -> Column:
        return F.max_by(F.col(f"f_{name}"), F.when(kind == record, F.col("entry_id")))

    call = kind == "SYSCALL"
    whole = lambda name: F.max(f"f_{name}").alias(name)
    rows = rows.where("closed").groupBy("epoch_id", "event_id").agg(
        F.max(F.when(call, F.col("seconds"))).alias("seconds"), whole("syscall"), whole("pid"), whole("ppid"), whole("a0"), whole("exit"), whole("exe"),
        of("CWD", "cwd").alias("cwd"), of("PATH", "name").alias("path"), of("PATH", "inode").alias("inode"), of("EXECVE", "program").alias("program"), of("SOCKADDR", "saddr").alias("saddr"),
        F.max(F.when(call, msg)).alias("message"), F.sum("msg_len").alias("size_bytes"), F.count(F.lit(1)).alias("records"),
    )
    fd = F.when(F.col("syscall") == 2, T.hex_number(F.col("exit"), fd_exit_base)).otherwise(T.hex_number(F.col("a0")))
    return rows.where(~F.col("syscall").isin(*IGNORED)).withColumn("fd", fd)


def resolve(events: DataFrame) -> DataFrame:
    """Add file: for read, write and close the inode of the latest open of (pid, fd) that was not closed since; null if none.

    Descriptors 0 to 2 are files of that number; a descriptor whose latest owner is a socket has no file.
    Rows are dealt by process, which the windows over a process's files after it need as well.
    """
    order = Window.partitionBy("epoch_id", "pid", "fd").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    call = F.col("syscall")
    owner = F.when(call == 2, F.struct(F.col("inode").alias("file"))).when((call == 3) | (call.isin(42, 43, 44, 45) & F.col("saddr").isNotNull()), F.struct(F.lit(None).cast("long").alias("file")))
    rows = dealt(events, "epoch_id", "pid").withColumn("known", F.last(owner, ignorenulls=True).over(order)["file"])
    target = F.when(call.isin(2, 87, 263), F.col("inode")).when(call.isin(0, 1, 3) & F.col("fd").between(0, 2), F.col("fd")).when(call.isin(0, 1, 3), F.col("known"))
    return rows.withColumn("file", target).drop("known")


def drop_unresolved(resolved: DataFrame) -> DataFrame:
    """Without reads, writes and closes whose descriptor is no known file."""
    return resolved.where(~F.col("syscall").isin(0, 1, 3) | F.col("file").isNotNull())


def drop_virtual(resolved: DataFrame, is_virtual: Column) -> DataFrame:
    """Without reads and writes of a file after its first opening under a virtual path."""
    opens = resolved.where((F.col("syscall") == 2) & is_virtual & F.col("file").isNotNull())
    first = opens.groupBy(F.col("epoch_id").alias("e"), F.col("file").alias("f")).agg(F.min("event_id").alias("since"))
    touches = F.coalesce(F.col("syscall").isin(0, 1) & F.col("file").isNotNull(), F.lit(False))  # only these are joined: rows without a file have no key
    seen = resolved.where(touches).join(first, (F.col("epoch_id") == F.col("e")) & (F.col("file") == F.col("f")) & (F.col("event_id") > F.col("since")), "left_anti")
    return resolved.where(~touches).unionByName(seen)


def kept_by_kernel(events: DataFrame, syscalls: tuple[int, ...] = HANDLED, ignored_exe: tuple[str, ...] = (), any_result: tuple[int, ...] = (60, 231), ignored_uid: tuple[int, ...] = (0,)) -> DataFrame:
    """What a capture rule set would let in: calls of the list that succeeded (those of ``any_result`` whether or not), not of ignored users or programs."""
    message = F.col("message")
    good = F.coalesce(T.field(message, "success") == "yes", F.lit(True)) | F.col("syscall").isin(*any_result)
    rows = events.where(F.col("syscall").isin(*syscalls) & good & ~F.coalesce(T.number(message, "uid"), F.lit(-1)).isin(*ignored_uid))
    return rows.where(~F.coalesce(T.unquoted(F.col("exe")), F.lit("")).isin(*ignored_exe)) if ignored_exe else rows


def counters(events: DataFrame) -> DataFrame:
    """Events, entries, bytes and unsupported events of each epoch."""
    unsupported = F.sum((~F.col("syscall").isin(*HANDLED)).cast("long")).alias("unsupported")
    return events.groupBy("epoch_id").agg(F.count(F.lit(1)).alias("events"), F.sum("records").alias("entries"), F.sum("size_bytes").alias("bytes"), unsupported)


def without_events(sessions: DataFrame, dropped: DataFrame) -> DataFrame:
    """The records of the log without those of dropped events (epoch_id, event_id)."""
    return sessions.join(dropped.select("epoch_id", "event_id").distinct(), ["epoch_id", "event_id"], "left_anti")


def bursting(sessions: DataFrame, seconds: float = 5.0, records: int = 20) -> DataFrame:
    """(epoch_id, event_id, records, span, bursting): whether an event has so many records over so many seconds."""
    at = T.record_time(F.col("msg"))
    rows = sessions.groupBy("epoch_id", "event_id").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.max(at) - F.min(at), F.lit(0.0)).alias("span"))
    return rows.withColumn("bursting", (F.col("span") >= seconds) & (F.col("records") >= records))
