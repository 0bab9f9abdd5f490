"""Scalar functions over record text: field access, decoding, paths and wildcards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Names and numbers of the open(2) flags, by number.
OPEN_FLAGS = [
    ("O_WRONLY", 1), ("O_RDWR", 2), ("O_CREAT", 64), ("O_EXCL", 128), ("O_NOCTTY", 256), ("O_TRUNC", 512), ("O_APPEND", 1024), ("O_NONBLOCK", 2048), ("O_DSYNC", 4096), ("O_ASYNC", 8192), ("O_DIRECT", 16384),
    ("O_DIRECTORY", 65536), ("O_NOFOLLOW", 131072), ("O_NOATIME", 262144), ("O_CLOEXEC", 524288), ("__O_SYNC", 1048576), ("O_PATH", 2097152), ("__O_TMPFILE", 4194304),
]
DEPTH_DIFFERS = 4097
STAR = "if(p <=> q, p, '*')"
# Fields of an account record, in order.
ACCOUNT_FIELDS = ["pid", "uid", "auid", "ses", "op", "acct", "exe", "hostname", "addr", "terminal", "res"]


def field_text(msg: Column, name: str) -> Column:
    """The value of ``name=`` at the start of a token, empty where it is missing."""
    return F.regexp_extract(F.concat(F.lit(" "), msg), rf" {name}=([^ ]{{1,99}})", 1)  # a pattern that begins with a literal is searched for faster


def field(msg: Column, name: str) -> Column:
    """The value of ``name=`` at the start of a token, or null."""
    found = field_text(msg, name)
    return F.when(found != "", found)


def number(msg: Column, name: str) -> Column:
    """A decimal field as an integer; null where it is missing or malformed."""
    return field(msg, name).try_cast("int")


def hex_number(value: Column, base: int = 16) -> Column:
    return F.conv(value, base, 10).cast("long")


def unquoted(value: Column) -> Column:
    """A value without its first and last character."""
    return F.substring(value, F.lit(2), F.length(value) - 2)


def record_seconds(msg: Column) -> Column:
    return F.regexp_extract(msg, r"msg=audit\((\d+)", 1).try_cast("long")


def record_time(msg: Column) -> Column:
    return F.regexp_extract(msg, r"msg=audit\(([0-9.]+):", 1).try_cast("double")


def proctitle(value: Column) -> Column:
    """Hexadecimal text; NUL bytes become blanks."""
    return F.translate(F.decode(F.unhex(value), "UTF-8"), "\0", " ")


def ipv4(saddr: Column) -> Column:
    """The address of a hexadecimal socket address as a number; null if it is too short or not hexadecimal."""
    part = F.substring(saddr, 9, 8)
    return F.when(part.rlike("^[0-9A-Fa-f]{8}$"), hex_number(part))


def uuid_hex(value: Column) -> Column:
    """A binary identifier as lower-case hexadecimal digits."""
    return F.lower(F.hex(value))


def octal(value: Column) -> Column:
    """Permission bits in octal digits."""
    return F.conv(value.cast("string"), 10, 8)


def account_record(msg: Column) -> Column:
    """A struct of an account record's type, time and fields; a field that is missing is null."""
    kind = F.regexp_extract(msg, r"^type=(\S+)", 1)
    inner = lambda name: F.regexp_extract(msg, rf"[ ']{name}=(\"[^\"]*\"|[^ ']+)", 1)
    found = [F.when(inner(name) != "", inner(name)).alias(name) for name in ACCOUNT_FIELDS]
    return F.struct(F.when(kind != "", kind).alias("type"), record_time(msg).alias("time"), *found)


def open_flags(value: Column) -> Column:
    """Names of the flags of a hexadecimal field, joined by a bar: O_RDONLY if neither access bit is set, then each flag whose bit is, by number.

    What is no hexadecimal number counts as 0; null stays null.
    """
    flags = F.coalesce(hex_number(F.when(value.rlike("^(0[xX])?[0-9A-Fa-f]+$"), F.regexp_replace(value, "^0[xX]", ""))), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))
    names = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in OPEN_FLAGS]
    return F.when(value.isNotNull(), F.concat_ws("|", F.when(flags.bitwiseAND(F.lit(3)) == 0, "O_RDONLY"), *names))


def construct_path(cwd: Column, path: Column) -> Column:
    """An absolute path: ``path`` itself if absolute, else under ``cwd``; ``.`` and ``..`` are resolved."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    none = F.expr("cast(array() as array<string>)")
    resolved = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(resolved, "/"))


def dir_distance(a: Column, b: Column) -> Column:
    """How many components differ; a fixed large number where the depths differ."""
    x, y = F.split(a, "/"), F.split(b, "/")
    differs = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1)), F.lit(0), lambda acc, d: acc + d)
    return F.when(F.size(x) != F.size(y), DEPTH_DIFFERS).otherwise(differs)


def dir_wildcard(a: Column, b: Column) -> Column:
    """The common directory with ``*`` for components that differ; empty where the depths differ."""
    x, y = F.split(a, "/"), F.split(b, "/")
    return F.when(F.size(x) != F.size(y), "").otherwise(F.array_join(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), p).otherwise(F.lit("*"))), "/"))


def wildcard(a: str, b: str) -> str:
    """The alignment of two strings with ``*`` for what differs, from an edit-distance table.

    Going back through the table, a diagonal step is preferred, then one that drops a letter of ``a``, then one of ``b``.
    """
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out: list[str] = []
    i, j = len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            letter = a[i - 1] if a[i - 1] == b[j - 1] else "*"
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            letter, i = "*", i - 1
        else:
            letter, j = "*", j - 1
        if letter != "*" or not out or out[-1] != "*":
            out.append(letter)
    return "".join(reversed(out))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def similar(a: str, b: str, least: float = 0.70) -> bool:
    longest = max(len(a), len(b), 1)
    if abs(len(a) - len(b)) > (1 - least) * longest + 1e-9:
        return False
    return 1 - levenshtein(a, b) / longest >= least - 1e-12


def near_dirs(a: str, b: str) -> bool:
    x, y = a.split("/"), b.split("/")
    return len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) <= 1


def merge_dirs(a: str, b: str) -> str:
    return "/".join(p if p == q else "*" for p, q in zip(a.split("/"), b.split("/"), strict=True))


def leader_clusters(values: list[str], close, merge) -> dict[str, str]:
    """Each value's wildcard: values, in the order given, join the first cluster whose leader is close; a cluster's wildcard folds its members in sorted order."""
    leaders: list[list[str]] = []
    for value in dict.fromkeys(values):
        for cluster in leaders:
            if close(cluster[0], value):
                cluster.append(value)
                break
        else:
            leaders.append([value])
    out = {}
    for cluster in leaders:
        shape, *rest = sorted(cluster)
        for value in rest:
            shape = merge(shape, value)
        out |= dict.fromkeys(cluster, shape)
    return out


def register(spark: SparkSession) -> None:
    """SQL functions for users: audit_field, open_flags, dir_distance and dir_wildcard, which Spark plans like any expression, and path_wildcard."""
    flags = ", ".join(f"if(v & {bit} <> 0, '{name}', null)" for name, bit in OPEN_FLAGS)
    zipped = "zip_with(split(a, '/'), split(b, '/'), (p, q) -> {})"
    same_depth = "size(split(a, '/')) = size(split(b, '/'))"
    bodies = {
        "audit_field(msg STRING, name STRING) RETURNS STRING": "nullif(regexp_extract(msg, concat('(?:^| )', name, '=([^ ]{1,99})'), 1), '')",
        "open_flags(value STRING) RETURNS STRING": f"(SELECT concat_ws('|', if(v & 3 = 0, 'O_RDONLY', null), {flags}) FROM (SELECT coalesce(cast(conv(value, 16, 10) as bigint), 0) & 4294967295 AS v))",
        "dir_distance(a STRING, b STRING) RETURNS INT": f"if({same_depth}, aggregate({zipped.format('if(p <=> q, 0, 1)')}, 0, (n, d) -> n + d), {DEPTH_DIFFERS})",
        "dir_wildcard(a STRING, b STRING) RETURNS STRING": f"if({same_depth}, array_join({zipped.format(STAR)}, '/'), '')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("string")
    def path_wildcard(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else wildcard(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    spark.udf.register("path_wildcard", path_wildcard)
