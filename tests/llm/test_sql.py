"""Every query of the subpackage that has SQL against it in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from lrforge.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


def plain(row):
    return repr(tuple(round(x, 8) if isinstance(x, float) else x for x in row))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        duck.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert sorted(map(plain, df.select(columns).collect())) == sorted(plain(r[at.index(c)] for c in columns) for r in result.fetchall())
