import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from quillon.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    at = sorted(range(len(names)), key=names.__getitem__)
    say = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(say(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    answer = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, answer.fetchall())


def test_entry_works_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.parquet")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_and' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})


def test_search_is_one_scan_with_pushed_filters(spark, tmp_path):
    from quillon.operators import postings as P
    from quillon.plans import search
    from quillon.runtime import load

    docs = load(spark, SF, "documents").select("doc_id", "text")
    index = search.Index(P.write(P.postings(docs), f"{tmp_path}/p"), docs.select("doc_id"))
    plan = index.search("( the & ( of | and ) & th* )")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "PushedFilters: [Or(" in plan or "StringStartsWith(token" in plan
