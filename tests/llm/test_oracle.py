"""The queries that have SQL, against it on the same files."""

import duckdb
import pytest

from matricula.llm import oracle, queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(oracle.ORACLE[name])
    assert sorted(want.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted(want.select(", ".join(columns)).fetchall(), key=str)
