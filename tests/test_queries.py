"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from casalith.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == cols
        plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
        expected = [tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, expected))
