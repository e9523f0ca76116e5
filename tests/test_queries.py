"""Every query with an oracle against DuckDB, on the smallest tables; the others run."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def own(name):
    """Whether a query is none of the training-data operators, which have tests of their own."""
    return not re.fullmatch(r"op\d+_\w+|pipeline", name)


@pytest.fixture(scope="session")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted(([plain(r[i]) for i in order] for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(k for k in ORACLE if own(k)))
def test_oracle(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ref = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(ref.columns)
    want = rows(ref.columns, ref.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLE and own(k)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert {r["direction"] for r in entry.entry(spark).collect()} == {"me_to_them", "them_to_me"}
