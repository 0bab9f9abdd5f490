"""Sources and sinks: audit logs, templates, pattern lists, configuration, decision tables and CDM datums."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CDM_SCHEMA = """
type string, uuid string, timestampNanos bigint, subject string, predicateObject string, cid int, parentSubject string, localPrincipal string,
startTimestampNanos bigint, unitId int, iteration int, `count` int, cmdLine string, properties map<string,string>,
baseObject struct<properties: map<string,string>>, localAddress string, localPort int, remoteAddress string, remotePort int, ipProtocol int
"""


def _in_order(lines: DataFrame) -> DataFrame:
    """``lines`` read from files with seq, which grows with the place in the file: the block's start, then the line inside the block."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn("seq", F.col("_metadata.file_block_start") + inside)


def read_audit(spark: SparkSession, path: str, most_lines: int | None = None) -> DataFrame:
    """(entry_id, epoch_id, value) of the ``*.log*`` files of a folder: a file is an epoch, entries are in the order of the file; of each file the first ``most_lines``."""
    lines = _in_order(spark.read.option("pathGlobFilter", "*.log*").text(path)).where("value <> ''")
    lines = lines.select(F.col("seq").alias("entry_id"), F.col("_metadata.file_path").alias("epoch_id"), "value")
    if most_lines is None:
        return lines
    nth = F.row_number().over(Window.partitionBy("epoch_id").orderBy("entry_id"))
    return lines.withColumn("nth", nth).where(F.col("nth") <= most_lines).drop("nth")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template, tokens): lines of more than one token, tokens sorted, the largest first."""
    tokens = F.array_sort(F.filter(F.split("value", " "), lambda t: t != ""))
    return spark.read.text(path).select(F.col("value").alias("template"), tokens.alias("tokens")).where("size(tokens) > 1").orderBy(F.desc(F.size("tokens")), "template")


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Regular expressions of virtual files, one a line; blank lines and comments are skipped.  The list is configuration and small."""
    return [r.value for r in spark.read.text(path).where("value <> '' and not startswith(value, '#')").collect()]


def virtual_filter(path_column: str, patterns: list[str]):
    """Whether a path fully matches any pattern."""
    return F.col(path_column).rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") if patterns else F.lit(False)


def read_decisions(spark: SparkSession, path: str, techniques: list[str]) -> DataFrame:
    schema = ", ".join(["ID bigint", "NUMBER int", *[f"`{t}` int" for t in techniques]])
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).schema(schema).csv(path)


def read_cdm(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CDM datums with seq, their place in the file, from JSON lines or, for ``.avro`` or ``.bin``, from Avro where that source is installed.

    ``limit`` keeps the first datums.  Another ending, or a path without files, is an error.
    """
    kind = str(path).rsplit(".", 1)[-1].lower()
    if kind not in ("json", "avro", "bin"):
        raise ValueError(f"{path}: datums are read from .json, .avro or .bin")
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        raise FileNotFoundError(str(path))
    datums = _in_order(spark.read.schema(CDM_SCHEMA).json(path) if kind == "json" else spark.read.format("avro").load(path))
    return datums.orderBy("seq").limit(limit) if limit else datums


@dataclass
class Config:
    """Settings of a run, with their defaults."""

    mode: str = "local"
    log_path: str = "logs"
    out_path: str = "out"
    sock_path: str = "/var/run/audispd_events"
    templates: str = "templates.txt"
    virtual_files: str = ""
    fd_exit_base: str = "16"
    epoch_seconds: str = "30"


def load_config(text: str) -> Config:
    """``key=value`` lines; comments begin with ``#``; unknown keys are ignored."""
    known = {f.name for f in fields(Config)}
    pairs = (line.strip("\r\n").split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    return Config(**{k.strip(): v for k, v in pairs if k.strip() in known})


# -- sinks ------------------------------------------------------------------------------------------------------------
def write_log(entries: DataFrame, path: str) -> None:
    """Surviving lines, one folder for each epoch, in order."""
    entries.repartition("epoch_id").sortWithinPartitions("epoch_id", "entry_id").select("epoch_id", "value").write.mode("append").partitionBy("epoch_id").text(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("append").option("header", True).csv(path)


def write_counters(counters: DataFrame, path: str) -> None:
    """Two counts a line, parted by a tabulator."""
    counters.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in counters.columns])).write.mode("append").text(path)


def write_wildcards(mapping: DataFrame, path: str) -> None:
    mapping.select(F.concat("value", F.lit(": "), "wildcard")).write.mode("overwrite").text(path)


def write_templates(templates: DataFrame, path: str) -> None:
    templates.select("template").write.mode("overwrite").text(path)


def write_grammar(rules: DataFrame, path: str) -> None:
    """``program dir: files``, a line each."""
    rules.select(F.concat(F.concat_ws(" ", "program", "dir"), F.lit(": "), "files")).write.mode("overwrite").text(path)


def write_study(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV with a header for each of the study's tables."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def send_lines(entries: DataFrame, host: str, port: int) -> None:
    """Send lines to a TCP listener, a connection for each partition."""

    def send(rows) -> None:
        import socket

        with socket.create_connection((host, port)) as s:
            for r in rows:
                s.sendall(r.value.encode() + b"\n")

    entries.select("value").foreachPartition(send)
