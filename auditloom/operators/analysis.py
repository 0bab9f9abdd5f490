"""Decisions of techniques side by side, and the study's questions over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# System call numbers by class.
FILE_CALLS = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 16, 17, 18, 19, 20, 21, 23, 26, 32, 33, 40, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 90, 91, 92, 93, 94, 95, 132, 133, 161, 162, 187, 188, 189, 190, 191, 192,
    193, 194, 195, 196, 197, 198, 199, 206, 207, 208, 209, 210, 212, 213, 217, 221, 232, 233, 235, 253, 254, 255, 257, 258, 259, 260, 261, 262, 263, 264, 265, 266, 267, 268, 269, 270, 271, 277, 280, 281, 285, 291, 292, 294,
    295, 296, 300, 301, 303, 304, 306, 316, 318, 319,
]
PROCESS_CALLS = [
    9, 10, 11, 12, 24, 25, 27, 28, 39, 56, 57, 58, 59, 60, 61, 97, 98, 101, 102, 104, 105, 106, 107, 108, 109, 110, 111, 112, 113, 114, 115, 116, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126, 134, 140, 141, 142, 143, 144,
    145, 146, 147, 148, 149, 150, 151, 152, 154, 157, 158, 160, 186, 203, 204, 205, 211, 218, 231, 247, 251, 252, 272, 302, 308, 310, 311, 312, 314, 315, 317, 322, 324, 325,
]
NETWORK_CALLS = [41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 170, 171, 288, 299, 307, 321]


def syscall_class(column: str = "syscall"):
    c = F.col(column)
    return F.when(c.isin(*FILE_CALLS), "file").when(c.isin(*PROCESS_CALLS), "process").when(c.isin(*NETWORK_CALLS), "network").otherwise("other")


ACTIONS = ("ALLOW", "MANGLE", "DROP")  # 0, 1, 2


def first_action(actions: DataFrame) -> DataFrame:
    """One action for each (event, technique) of (epoch_id, event_id, technique, place, action): the first by place, which is a column of any type that has an order."""
    return actions.groupBy("epoch_id", "event_id", "technique").agg(F.min_by("action", "place").alias("action"))


def dropped(decided: DataFrame) -> DataFrame:
    """(epoch_id, event_id, technique) of what decisions drop."""
    return decided.where("action = 'DROP'").select("epoch_id", "event_id", "technique")


def matrix(events: DataFrame, decided: DataFrame, techniques: list[str]) -> DataFrame:
    """(epoch_id, event_id, syscall, one column for each technique): 2 for a dropped event, 1 for a rewritten one, else 0."""
    value = F.when(F.col("action") == "DROP", 2).when(F.col("action") == "MANGLE", 1).otherwise(0)
    masks = decided.groupBy("epoch_id", "event_id").agg(*[F.max(F.when(F.col("technique") == t, value).otherwise(0)).alias(t) for t in techniques])
    rows = events.select("epoch_id", "event_id", "syscall").join(masks, ["epoch_id", "event_id"], "left")
    return rows.select("epoch_id", "event_id", "syscall", *[F.coalesce(t, F.lit(0)).alias(t) for t in techniques])


def reductions(events: DataFrame, decided: DataFrame, size_technique: str = "DPRESERVE_SD") -> DataFrame:
    """For each epoch: events handled, removed (any technique drops them), kept (they have decisions, none of them a drop), bytes, bytes removed, and bytes that ``size_technique`` removes."""
    drop = F.col("action") == "DROP"
    judged = decided.groupBy("epoch_id", "event_id").agg(F.max(drop.cast("int")).alias("gone"), F.max((drop & (F.col("technique") == size_technique)).cast("int")).alias("sized"))
    rows = events.select("epoch_id", "event_id", "size_bytes").join(judged, ["epoch_id", "event_id"], "left")
    bytes_of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("size_bytes")).otherwise(0))
    return rows.groupBy("epoch_id").agg(
        F.count(F.lit(1)).alias("handled"), F.count(F.when(F.col("gone") == 1, 1)).alias("removed"), F.count(F.when(F.col("gone") == 0, 1)).alias("kept"),
        F.sum("size_bytes").alias("raw_bytes"), bytes_of("gone").alias("removed_bytes"), bytes_of("sized").alias("technique_bytes"),
    )


def report(decided: DataFrame) -> DataFrame:
    """(technique, dropped, percent): each technique's drops, and their share of the events that any technique drops."""
    gone = dropped(decided)
    total = gone.select("epoch_id", "event_id").distinct().agg(F.count(F.lit(1)).alias("total"))  # one row
    counts = gone.groupBy("technique").agg(F.count(F.lit(1)).alias("dropped"))
    return counts.join(F.broadcast(total)).select("technique", "dropped", percent("dropped", "total").alias("percent"))


def histogram(table: DataFrame, techniques: list[str]) -> DataFrame:
    """(mask, class, n): at most two to the power of the techniques rows for each class, whatever the input."""
    mask = sum((F.when(F.col(t) == 2, F.lit(1 << k)).otherwise(0) for k, t in enumerate(techniques)), F.lit(0))
    return table.withColumn("class", syscall_class()).groupBy(mask.alias("mask"), "class").agg(F.count(F.lit(1)).alias("n"))


def decision_rows(events: DataFrame, decided: DataFrame) -> DataFrame:
    """(epoch_id, event_id, seconds, size_bytes, techniques): each event with the names of the techniques that drop it, in order, by commas."""
    names = decided.groupBy("epoch_id", "event_id").agg(F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"))
    rows = events.select("epoch_id", "event_id", "seconds", "size_bytes").join(names, ["epoch_id", "event_id"], "left")
    return rows.withColumn("techniques", F.coalesce("techniques", F.lit("")))


def confusion(decided: DataFrame) -> DataFrame:
    """(t1, t2, n): events that both drop."""
    left, right = decided.withColumnRenamed("technique", "t1"), decided.withColumnRenamed("technique", "t2")
    return left.join(right, ["epoch_id", "event_id"]).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))


def _sum_where(test: Column) -> Column:
    return F.sum(F.when(test, F.col("n")).otherwise(0))


def drop_counts(table: DataFrame, techniques: list[str]) -> DataFrame:
    """(technique, dropped)."""
    sums = table.agg(*[F.sum((F.col(t) == 2).cast("long")).alias(t) for t in techniques])
    return sums.unpivot([], techniques, "technique", "dropped")


def class_counts(table: DataFrame) -> DataFrame:
    return table.groupBy(syscall_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_by_technique(table: DataFrame, techniques: list[str]) -> DataFrame:
    """(technique, file, network, process, network_stack, process_stack): dropped events by class, and stacked."""
    long = table.withColumn("class", syscall_class()).unpivot(["class"], techniques, "technique", "action").where("action = 2")
    wide = long.groupBy("technique").pivot("class", ["file", "network", "process"]).count().na.fill(0)
    return wide.withColumn("network_stack", F.col("file") + F.col("network")).withColumn("process_stack", F.col("file") + F.col("network") + F.col("process"))


def pairwise(hist: DataFrame, techniques: list[str]) -> DataFrame:
    """(t1, t2, both, either, only_first, first) of pairs of different techniques, from the histogram."""
    pairs = [(a, b, 1 << i, 1 << j) for i, a in enumerate(techniques) for j, b in enumerate(techniques) if i != j]
    met = hist.select("mask", "n", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("k"))
    numbered = hist.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, t1 string, t2 string, m1 int, m2 int")
    met = met.join(F.broadcast(numbered), "k")
    a, b = F.col("mask").bitwiseAND(F.col("m1")) != 0, F.col("mask").bitwiseAND(F.col("m2")) != 0
    return met.groupBy("t1", "t2").agg(_sum_where(a & b).alias("both"), _sum_where(a | b).alias("either"), _sum_where(a & ~b).alias("only_first"), _sum_where(a).alias("first"))


def percent(part: str, whole: str):
    return F.when(F.col(whole) != 0, F.round(F.col(part) * 100.0 / F.col(whole), 2))


def coverage(hist: DataFrame, techniques: list[str], size: int) -> DataFrame:
    """(subset, covered): events dropped by any technique of each subset of that size, the widest first and ties in the order of the techniques."""
    subsets = [(k, "+".join(techniques[i] for i in c), sum(1 << i for i in c)) for k, c in enumerate(combinations(range(len(techniques)), size))]
    numbered = hist.sparkSession.createDataFrame(subsets, "k int, subset string, m int")
    met = hist.select("mask", "n", F.explode(F.sequence(F.lit(0), F.lit(len(subsets) - 1))).alias("k")).join(F.broadcast(numbered), "k")
    return met.groupBy("subset", "k").agg(_sum_where(F.col("mask").bitwiseAND(F.col("m")) != 0).alias("covered")).orderBy(F.desc("covered"), "k").select("subset", "covered")


def greedy(hist: DataFrame, techniques: list[str]) -> DataFrame:
    """(place, technique, gain): techniques by what each adds to those before; ties go to the first in order.  The histogram has few rows."""
    counts = [(r.mask, r.n) for r in hist.groupBy("mask").agg(F.sum("n").alias("n")).collect()]
    chosen, rows = 0, []
    while True:
        gains = [(sum(n for m, n in counts if not m & chosen and m >> k & 1), -k) for k in range(len(techniques)) if not chosen >> k & 1]
        gain, k = max(gains, default=(0, 0))
        if not gain:
            break
        chosen |= 1 << -k
        rows.append((len(rows) + 1, techniques[-k], gain))
    return hist.sparkSession.createDataFrame(rows, "place int, technique string, gain long")
