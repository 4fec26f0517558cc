"""Every pN_ query on the smallest tables, against SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from gleaner.llm.queries import oracle_sql, queries

FOUND = {
    "p1_found": ["newid", "subject"], "p2_found": ["item_a", "item_b"], "p3_found": ["term", "mark"], "p4_found": ["newid", "start_pos", "end_pos"],
    "p5_found": ["newid_a", "newid_b"], "p6_found": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind"],
}


def close(rows):
    return sorted((tuple(f"{v:.5f}" if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, name):
    df = queries()[name](spark, sf)
    if name in FOUND:
        assert df.columns == FOUND[name]
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name.endswith("_found"):
        assert len(got) == len(set(got))
    sql = oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        assert close(got) == close(map(tuple, c.sql(f"select {', '.join(columns)} from ({sql}) q").fetchall()))
