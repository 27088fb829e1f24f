"""Queries of the operators that SQL can express, against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.llm import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    answer = con.sql(catalog.ORACLE[name])
    assert sorted(answer.columns) == names
    at = [answer.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())
