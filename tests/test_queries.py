"""Every query with SQL against DuckDB on the smallest tables; the registry without the optional parts."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from proseflow.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def compare(spark, duck, q, sql):
    df = q(spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        compare(spark, duck, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_registry_without_the_optional_parts():
    """With neither of the optional modules importable, the rest is registered; other import errors are not hidden."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("proseflow.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "doc_features" in e.queries() and not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
