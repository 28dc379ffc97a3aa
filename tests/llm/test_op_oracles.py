import duckdb
import pytest

from terrane.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalog.SQL[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[at[c]] for c in columns) for r in found.fetchall()), key=str)


def test_one_query_an_operator():
    assert [sum(q.startswith(f"op{n}_") for q in catalog.QUERIES) for n in range(1, 11)] == [1] * 10
