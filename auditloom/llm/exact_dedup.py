"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Digests (SHA-256 of the UTF-8 text) are counted by the Misra-Gries family's frequent-item summary, which
holds at most ``1 / support`` counters whatever the input.  The frequent digests are verified by an exact count; their winners are
broadcast and resolve their copies on the map side, so a group that holds a third of all rows is
never shuffled.  All other digests go through an ordinary shuffle, in which a group
has at most about ``support`` of all rows.

Defined cases: a null text counts as empty, so nulls and empty texts form one group; the row with the largest id stays, a null id being the
smallest; of rows that repeat that id with the same text one stays; rows that repeat an id with different texts are judged by their texts; an empty
table yields no rows; other columns, whatever their names, pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.support import materialize, text_or_empty, without_copies

SUPPORT = 0.001  # at most 1,000 counters: the broadcast never exceeds 1,000 rows


def _winner() -> list:
    """Of a group of (doc_id, row): the last row, and the number of rows."""
    return [F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")]


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, last, group_size) of the frequent digests; at most ``1 / support`` rows."""
    items = digests.select(F.col("digest").alias("d")).freqItems(["d"], support)
    frequent = items.select(F.explode("d_freqItems").alias("digest"))
    counted = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*_winner())
    return counted.where("group_size > 1")


def decide(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of each row of ``digests`` (doc_id, digest, row); a group keeps one row."""
    winners = materialize(heavy_winners(digests, support), "winners")  # bounded by the summary's counters
    few = F.broadcast(winners)
    heavy = digests.join(few, "digest").select("doc_id", "row", "digest", "last", "group_size")
    rest = digests.join(few, "digest", "left_anti")
    light = rest.groupBy("digest").agg(*_winner())
    many = materialize(light.where("group_size > 1"), "groups")
    alone = rest.join(many, "digest", "left").select(
        "doc_id", "row", "digest", F.coalesce("last", F.struct("doc_id", "row")).alias("last"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    return heavy.unionByName(alone).select("doc_id", "digest", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"))


def _digest(text: str):
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def digest_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, row) of each row, materialised: 40 bytes a row instead of its text; ``row`` tells rows with equal ids apart."""
    return materialize(docs.select(docs[id_col].alias("doc_id"), _digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def exact_dedup(docs: DataFrame, support: float = SUPPORT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one for each different text."""
    decided = decide(digest_table(docs, id_col, text), support).select("doc_id", F.col("digest").alias("mark"), F.col("kept").alias("stays"))
    return without_copies(docs, decided, _digest(text), id_col)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(digest_table(docs)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t
"""
