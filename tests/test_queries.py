"""Every registered query of the core against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from gleaner.queries import ORACLES, QUERIES


def close(rows):
    return sorted((tuple(f"{v:.5f}" if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in ORACLES:
        want = duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall()
        assert close(got) == close(map(tuple, want))
    else:
        assert got
