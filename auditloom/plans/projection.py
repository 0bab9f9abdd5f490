"""A deterministic audit log made of the ``events`` table, rendered as text lines so that every query starts from parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wall_seconds(ts: Column | str) -> Column:
    """Seconds from 1970 on the timestamp's own clock, whatever the session's time zone."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def file_name(inode: Column) -> Column:
    """Eight times a letter, a digit: names of one letter are near one another, names of different letters are not."""
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.floor(inode / 10).cast("int") % 26 + 1, F.lit(1))
    return F.concat(F.repeat(letter, 8), (inode % 10).cast("string"), F.lit(".log"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, epoch_id, sec, pid, ppid, user_id, k, inode, fd, syscall): one row for each event of the table; an epoch is a day.

    Families of four users fork one another; a few accesses go to the standard descriptors.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("sec", wall_seconds("ts"))
    rows = rows.selectExpr(
        "event_id + 1 AS event_id", "cast(floor(sec / 86400) as bigint) AS epoch_id", "sec", "cast(user_id + 1000 as int) AS pid", "cast(if(user_id % 4 = 0, 1, user_id + 999) as int) AS ppid", "user_id", "k",
        "cast(CASE WHEN k >= 95 THEN k - 92 WHEN k >= 80 THEN 1000 + user_id * 2 + 1 ELSE 1000 + user_id * 2 END as bigint) AS inode",
        """CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
           ELSE CASE WHEN k < 20 THEN 59 WHEN k < 24 THEN 60 WHEN k < 45 THEN 45 WHEN k < 65 THEN 44 WHEN k < 70 THEN 42 WHEN k < 73 THEN 43 WHEN k < 76 THEN 9 WHEN k < 79 THEN 10
                     WHEN k < 82 THEN 41 WHEN k < 90 THEN 87 WHEN k < 95 THEN 263 ELSE 231 END END AS syscall""",
    )
    return rows.withColumn("fd", F.when(F.col("syscall").isin(0, 1, 3) & (F.col("k") < 6), F.col("k") % 3).otherwise(F.col("inode")).cast("long"))


def audit_lines(events: DataFrame) -> DataFrame:
    """(entry_id, epoch_id, value): the records of each event as lines, in order; entry ids leave room for eight lines an event.

    Some events have no end record, and a path record may be up to eight seconds later than its event.
    """
    plain = lambda number: F.coalesce(number.cast("string"), F.lit("null"))
    stamp = lambda late: F.concat(F.lit("msg=audit("), plain(F.col("sec") + late), F.lit(".000001:"), plain(F.col("event_id")), F.lit("):"))
    now, k = stamp(F.lit(0)), F.col("k")
    cwd = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"))
    name, call = file_name(F.col("inode")), F.col("syscall")
    fd = F.lower(F.hex("fd"))
    extra = F.when(call == 2, F.concat(F.lit(" exit="), fd)).when(call.isin(0, 1, 3, 42, 43), F.concat(F.lit(" a0="), fd)).when(call.isin(44, 45), F.lit(" a0=a")).otherwise("")
    exe = F.concat(F.lit(' exe="'), cwd, F.lit("/"), name, F.lit('"'))
    first = F.concat(
        F.lit("type=SYSCALL "), now, F.lit(" arch=c000003e syscall="), call.cast("string"), F.when(k % 10 == 9, " success=no").otherwise(" success=yes"), extra, F.lit(" ppid="), F.col("ppid").cast("string"),
        F.lit(" pid="), F.col("pid").cast("string"), F.lit(" uid="), (F.col("user_id") % 7).cast("string"), exe,
    )
    path = call.isin(2, 87, 263)
    lines = F.array(
        first,
        F.when(path, F.concat(F.lit("type=CWD "), now, F.lit(' cwd="'), cwd, F.lit('"'))),
        F.when(path, F.concat(F.lit("type=PATH "), stamp(k % 9), F.lit(' name="'), name, F.lit('" inode='), F.col("inode").cast("string"))),
        F.when(call == 59, F.concat(F.lit("type=EXECVE "), now, F.lit(' a0="prog'), (F.col("user_id") % 5).cast("string"), F.lit('"'))),
        F.when(call.isin(42, 43, 44, 45) & (k % 2 == 0), F.concat(F.lit("type=SOCKADDR "), now, F.lit(" saddr=02000050C0A80101"))),
        F.when(k % 13 != 0, F.concat(F.lit("type=EOE "), now)),
    )
    return events.select("event_id", "epoch_id", F.posexplode(lines).alias("at", "value")).where("value is not null").select((F.col("event_id") * 8 + F.col("at")).alias("entry_id"), "epoch_id", "value")
