import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d|pipeline$", n))


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "nation", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    quoted = [f'"{c}"' for c in columns]
    assert plain(found.select(*columns).collect()) == plain(want.select(*quoted).fetchall())


def test_drop_virtual_spares_a_namesake(spark, tmp_path):
    """File 1044 of user 22 has the path that file 4 has in the same folder; only files 3 to 5 are virtual."""
    rows = [("click", 50), ("view", 50), ("purchase", 50), ("click", 96), ("view", 96), ("purchase", 96), ("signup", 96)]
    day = "timestamp_ntz'2024-01-02 03:04:05'"
    made = spark.createDataFrame([(k, 22, kind, f'{{"k": {n}}}') for k, (kind, n) in enumerate(rows)], "event_id long, user_id long, event_type string, props string")
    made.selectExpr("event_id", f"{day} AS ts", "user_id", "event_type", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["drop_virtual"]).project("epoch_id, event_id, syscall").fetchall()
    found = entry.queries()["drop_virtual"](spark, str(tmp_path)).select("epoch_id", "event_id", "syscall").collect()
    assert plain(found) == plain(want)
    assert sorted(r.event_id for r in found) == [8, 16, 24, 32, 56]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
