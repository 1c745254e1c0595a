"""Every query with SQL against DuckDB on the smallest data, where that is present."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, tmp_path, name):
    entry.queries()[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))

    def read(sql):
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())

    assert read(f"FROM '{tmp_path}/out/*.parquet'") == read(SQL[name])


def test_core_stands_without_llm():
    """Nothing outside the subpackage imports it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/verdigris/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "verdigris.llm" not in open(path).read(), path
