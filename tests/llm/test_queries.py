"""Every registered query of the subpackage that has SQL, against that SQL, over whole small tables."""

import duckdb
import pytest

from quillon.llm import registry

SF = "/root/testdata/sf0.001"


def plain(names, values):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    answer = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, df.collect()) == plain(names, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_query_covers_its_table(spark, name):
    df = registry.queries()[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
