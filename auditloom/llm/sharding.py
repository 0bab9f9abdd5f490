"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, id, row), so copies lie together but a large group can be divided, even one of equal rows.  Keys are sampled with a chance in
proportion to the record's size; evenly spaced sample keys are the splitters of many narrow ranges.  Exact
totals of the ranges show which are overfull; those get splitters from a denser sample of their own, until none is overfull or none can be divided.  Running sums inside a range
plus the totals of the ranges before it give each record's place in the whole, and the place decides the shard: shard
sizes in bytes differ by about one record.

Bounds: the first draw makes at most ``MAX_RANGES`` ranges; ranges over 2.5 times the target number at most 0.4 times that and get their bytes over the
target (and one) of new splitters, so a round adds at most 1.4 times the first draw.  Only splitters and totals of ranges reach the driver.  A window spans one range.

Defined cases: a null text has no bytes and the checksum of the empty string; a null id orders first; rows that repeat an id or are wholly equal are
records of their own; an empty table yields no rows; a record larger than a shard's share leaves some shards empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.support import materialize, text_or_empty

OVERHEAD = 16
ROWS_PER_RANGE = 50_000
MAX_RANGES = 8_192
OVERSAMPLE = 16


def _chance(seed: int) -> Column:
    """A number in [0, 1) that depends on the record alone, so that a repeated task draws the same sample."""
    return F.pmod(F.xxhash64("key", "tie", "row", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


ORDER = ("key", "tie", "row")  # numbers without nulls; no two records have the same


def _range_of(splitters: list[tuple[int, ...]]) -> Column:
    """How many splitters are at or below a record in ``ORDER``: a binary search over constant arrays."""
    if not splitters:
        return F.lit(0)
    steps, many = len(splitters).bit_length(), len(splitters)
    at = f"acc + shiftleft(1, {steps} - s)"
    below = "true"
    for numbers, column in reversed([*zip(zip(*splitters, strict=True), ORDER, strict=True)]):
        it = f"element_at(cast(split('{','.join(map(str, numbers))}', ',') as array<bigint>), least({at}, {many}))"  # the list is folded into a constant
        below = f"({it} < {column} or ({it} = {column} and {below}))"
    return F.expr(f"aggregate(sequence(1, {steps}), 0, (acc, s) -> case when {at} <= {many} and {below} then {at} else acc end)")


def _pick(sample: DataFrame, parts: Column) -> list[tuple[int, ...]]:
    """Evenly spaced places of each range's sample; ``parts`` (of its rows) is the number of pieces wanted."""
    order = Window.partitionBy("range").orderBy(*ORDER)
    ranked = sample.withColumn("n", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("range"))).withColumn("parts", parts)
    here = F.floor(F.col("n") * F.col("parts") / F.col("of"))
    before = F.floor((F.col("n") - 1) * F.col("parts") / F.col("of"))
    chosen = ranked.where((here > before) & (F.col("n") < F.col("of"))).select(*ORDER).distinct()
    return sorted(tuple(r) for r in chosen.collect())  # at most the number of ranges


def split(sized: DataFrame, shards: int) -> tuple[list[tuple[int, ...]], int, list]:
    """Splitters, total bytes, and (range, bytes, rows) of each range, for rows with ``ORDER`` and size."""
    total, rows = sized.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return [], 0, []
    ranges = min(MAX_RANGES, max(8 * shards, rows // ROWS_PER_RANGE))
    target = total / ranges
    drawn = sized.where(_chance(1) < F.col("size") * (OVERSAMPLE / target)).withColumn("range", F.lit(0))
    splitters = _pick(drawn, F.lit(ranges))
    for again in count(2):
        ranged = sized.withColumn("range", _range_of(splitters))
        totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        full = {t.range: t.bytes for t in totals if t.bytes > 2.5 * target and t.rows > 1}
        if not full:
            break
        wanted = F.element_at(F.create_map(*[F.lit(x) for r, b in full.items() for x in (r, int(b // target) + 1)]), F.col("range"))
        dense = ranged.where(F.col("range").isin(list(full))).where(_chance(again) < F.col("size") * (4 * OVERSAMPLE / target))
        more = sorted({*splitters, *_pick(dense, wanted)})
        if more == splitters:  # a denser sample drew nothing new: what is overfull is a few large records
            break
        splitters = more
    return splitters, total, totals


def shard_by_bytes(records: DataFrame, shards: int) -> DataFrame:
    """``records`` (with ``ORDER`` and size) with shard, slot and place: whole ranges of the order, near equal in bytes; one row for each row."""
    splitters, total, totals = split(records, shards)
    offsets, bytes_before, rows_before = [], 0, 0
    for t in sorted(totals, key=lambda t: t.range):
        offsets.append((t.range, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + t.bytes, rows_before + t.rows
    before = F.broadcast(records.sparkSession.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))  # a row for each range
    order = Window.partitionBy("range").orderBy(*ORDER)
    placed = (
        records.withColumn("range", _range_of(splitters).cast("int"))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(order))
        .join(before, "range")
    )
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int")).withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    placed = materialize(placed.select(*records.columns, "shard", "place"), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(*records.columns, "shard", (F.col("place") - F.col("first")).alias("slot"), "place")


def records_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, tie, row, size, text_crc32) of each document, materialised without its text; ``row`` tells equal rows apart."""
    data = text_or_empty(text).cast("binary")
    own = docs[id_col]
    tie = F.coalesce(own.cast("long") if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(own), F.lit(-(1 << 63)))
    rows = docs.select(
        own.alias("doc_id"), F.xxhash64(data).alias("key"), tie.alias("tie"), F.monotonically_increasing_id().alias("row"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return materialize(rows, "records")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(records_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
