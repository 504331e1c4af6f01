"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = ({name: x for name, x in found.items() if not re.match(r"op\d+_|pipeline$", name)}  # tested in llm/
                    for found in (entry_points.queries(), entry_points.oracle_sql()))
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
         "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = db.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want
    assert got
    for column, kind in df.dtypes:
        assert kinds[column] in (TYPES[kind], '"NULL"')


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["type", "n"] and df.count() > 0
