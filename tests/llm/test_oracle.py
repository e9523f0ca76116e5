"""The operators' queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from chorale.llm.oracle import ORACLE_SQL
from chorale.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, ref = QUERIES[name](spark, sf_dir), db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(ref.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*ref.columns).collect()))) == sorted(map(repr, ref.fetchall()))
