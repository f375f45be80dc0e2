"""Every registered query with an oracle, against DuckDB on the same files."""

import math

import duckdb
import pytest

from matricula.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = plain(tuple(r[c] for c in columns) for r in found.collect())
    if name not in catalogue.ORACLE:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == columns
    assert rows == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall()) and rows


def test_entry_point():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(catalogue.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()
