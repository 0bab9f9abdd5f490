"""The training-data queries that have SQL against it, on a whole small table and on odd rows."""

import duckdb
import pytest

from auditloom.llm import queries
from tests.llm.fixtures import documents, folder
from tests.llm.test_jaccard import families
from tests.llm.test_warc import HTML, pages

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\r\n\x0b\x0c", "One two", "one TWO", "one  two\n", "a b c d e", "A B C D E", "a b c d e f", "É é \x1c x \x85 y z", "Σ σ ς İ ı", "word " * 3000]


def same(spark, path, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet{'' if path == SF else '/*.parquet'}')")
    found = queries.queries()[name](spark, path)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want.select(quoted).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows_equal_sql(spark, tmp_path, name):
    path = folder(documents(spark, ODD + families(3)), tmp_path)
    pages(spark, HTML).coalesce(1).write.mode("overwrite").parquet(f"{path}/pages.parquet")
    same(spark, path, name)
