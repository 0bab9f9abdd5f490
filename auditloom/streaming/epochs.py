"""Streaming: epochs over files of lines, each reduced as it closes; and counts in tumbling windows of event time."""

from __future__ import annotations

import socket
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from auditloom.operators import sessions


def read_lines(spark: SparkSession, path: str, files_per_epoch: int = 100) -> DataFrame:
    """Lines of log files as they arrive; a trigger takes at most so many files."""
    lines = spark.readStream.option("pathGlobFilter", "*.log*").option("maxFilesPerTrigger", files_per_epoch).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("epoch_id"), F.col("_metadata.file_block_start").alias("start"))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP listener; the epochs of :func:`run_epochs` are its triggers."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class UnixLines(DataSource):
    """Lines from a Unix socket, read on the driver as an audit daemon's dispatcher sends them: ``format("unix_lines").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "unix_lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _UnixReader(self.options["path"])


class _UnixReader(SimpleDataSourceStreamReader):
    """Offsets count lines; lines are held until they are committed, so a batch can be read again."""

    def __init__(self, path: str):
        self.path, self.connection, self.held, self.first, self.rest = path, None, [], 0, b""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def read(self, start: dict):
        if self.connection is None:
            self.connection = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            self.connection.connect(self.path)
            self.connection.settimeout(0.1)
            self.first = start["line"]
        try:
            while (data := self.connection.recv(1 << 16)) and len(self.held) < 100_000:
                *lines, self.rest = (self.rest + data).split(b"\n")
                self.held += [x.decode("utf-8", "replace") for x in lines]
        except TimeoutError:
            pass
        after = self.first + len(self.held)
        return iter([(x,) for x in self.held[start["line"] - self.first :]]), {"line": after}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter([(x,) for x in self.held[start["line"] - self.first : end["line"] - self.first]])

    def commit(self, end: dict) -> None:
        self.held, self.first = self.held[end["line"] - self.first :], end["line"]


def read_unix(spark: SparkSession, path: str) -> DataFrame:
    """Lines from a Unix socket; the epochs of :func:`run_epochs` are its triggers."""
    spark.dataSource.register(UnixLines)
    return spark.readStream.format("unix_lines").option("path", path).load()


def run_epochs(lines: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 30) -> StreamingQuery:
    """Give each epoch's closed events to ``handle``.  State never crosses epochs; without ``seconds`` the lines there are form the epochs and the query ends.

    Lines with an epoch_id (files) are in the order of ``start``, then of their block; lines without one (sockets) are one epoch for each trigger.
    """

    def batch(df: DataFrame, number: int) -> None:
        inside = F.monotonically_increasing_id()
        rows = df.where("value <> ''")
        rows = rows.withColumn("entry_id", F.col("start") + inside.bitwiseAND(F.lit((1 << 33) - 1))) if "start" in df.columns else rows.withColumn("entry_id", inside)
        rows = rows if "epoch_id" in df.columns else rows.withColumn("epoch_id", F.lit(number).cast("long"))
        handle(sessions.resolve(sessions.events_of(sessions.sessionize(sessions.with_fields(sessions.parse(rows.select("entry_id", "epoch_id", "value")))))), number)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def tumbling(rows: DataFrame, time: str, length: str, late: str | None = None) -> DataFrame:
    """(window_start, n) of rows in windows of event time; ``late`` is how long a stream waits for late rows."""
    rows = rows.withWatermark(time, late) if late else rows
    return rows.groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def distinct_lines(lines: DataFrame, time: str | None = None, late: str = "10 minutes", key: tuple[str, ...] = ("value",)) -> DataFrame:
    """Lines without exact repeats, or the first of each ``key`` such as (type, pid); in a stream with a time column, repeats inside the watermark."""
    return lines.withWatermark(time, late).dropDuplicatesWithinWatermark([*key]) if time else lines.dropDuplicates([*key])


def replay(lines: DataFrame, time: str = "time"):
    """(wait, value) of recorded lines in order, the wait being the seconds since the line before: a driver-side test helper."""
    last = None
    for row in lines.orderBy(time, "entry_id").toLocalIterator():
        now = row[time]
        yield (0.0 if last is None or now is None else max(0.0, now - last)), row["value"]
        last = now if now is not None else last
