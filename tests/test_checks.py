"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from check import rows_of

from __spark_entry__ import entry, oracle_sql, queries
from wayfare.checks import all_checks
from wayfare.checks.fixtures import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(all_checks.QUERIES))
def test_same_rows(spark, con, name):
    frame = queries()[name](spark, FOLDER)
    found = [tuple(row) for row in frame.collect()]
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, found) == rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(all_checks.QUERIES) == set(all_checks.ORACLES)
    assert set(all_checks.QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("package", ["ahocorasick", "sentencepiece", "xxhash"])
def test_entry_without_a_package_that_only_training_text_needs(package):
    code = f"import sys; sys.modules['{package}'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
    assert out == [str(len(all_checks.QUERIES)), "False", "True"]
