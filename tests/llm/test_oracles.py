"""The registered queries of this subpackage against their SQL on the smallest tables."""

import os

import pytest

from fotoloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_names():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
