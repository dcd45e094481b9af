"""Queries that SQL can express, against DuckDB on the smallest tables."""
import duckdb
import pytest

from cuefind.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect()) if name != "op8_warc_store" else \
        sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    want = found.fetchall()
    assert rows == (sorted(want) if name != "op8_warc_store" else sorted(want, key=str)) and rows
