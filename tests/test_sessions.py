import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import sessions


def simulate(lines):
    """{entry: (event, closed)} of one epoch's (entry, type) in order."""
    begun, ended, found = None, None, {}
    for entry, kind in lines:
        if kind == "SYSCALL":
            begun = entry
        if begun is not None and (ended is None or ended < begun):
            found[entry] = begun
        if kind == "EOE":
            ended = entry
    last = max((e for e, kind in lines if kind in ("SYSCALL", "EOE")), default=-1)
    return {entry: (event, last > event) for entry, event in found.items()}


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_events_across_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(sessions, "BLOCK_BITS", bits)
    rng, rows, want = random.Random(5), [], {}
    for epoch in range(6):
        at = sorted(rng.sample(range(200), 60))
        lines = [(e, rng.choices(["SYSCALL", "EOE", "PATH", "CWD"], [2, 1, 3, 3])[0]) for e in at]
        rows += [(f"day {epoch}", e, kind) for e, kind in lines]
        want |= {(f"day {epoch}", e): v for e, v in simulate(lines).items()}
    rng.shuffle(rows)
    found = sessions.sessionize(spark.createDataFrame(rows, "epoch_id string, entry_id long, type string"))
    assert found.columns == ["epoch_id", "entry_id", "type", "event_id", "closed"]
    assert {(r.epoch_id, r.entry_id): (r.event_id, r.closed) for r in found.collect()} == want


def test_an_epoch_is_no_single_task(spark):
    lines = spark.range(400000).select(F.col("id").alias("entry_id"), F.lit(1).alias("epoch_id"), F.when(F.col("id") % 3 == 0, "SYSCALL").otherwise("PATH").alias("type"))
    parts = [r["count"] for r in sessions.sessionize(lines).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 400000 and len(parts) > 3


def test_fields_as_by_their_pattern(spark):
    texts = ["a=1 b=2", "b=2 a=1", "a= a=3", "a=", "xa=1", "", " a=1", "a=" + "é" * 120 + " b=4", "a=1\nb=2 b=3", "type=a a=a=b", "é a=ü b= ", "a=  b=1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("a", "b"):
        plain = F.regexp_extract("t", rf"(?:^| ){name}=([^ ]{{1,99}})", 1)
        assert [r.t for r in df.where(~T.field_text(F.col("t"), name).eqNullSafe(plain)).collect()] == []
