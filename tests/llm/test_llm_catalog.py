"""Every registered query of the training-data operators over the small tables, and those that have SQL against it."""

from __future__ import annotations

import os

import pytest

from quirelake.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
COLUMNS = {
    "p1_found": ["tbl", "id_a", "id_b"], "p2_found": ["block_id", "line_no", "noise"], "p3_found": ["id_a", "id_b"], "p4_found": ["field", "id_a", "id_b"], "p5_found": ["tbl", "record_id", "end_char"],
    "p6_found": ["field", "record_id"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in SQL:
        import duckdb

        con = duckdb.connect()
        for f in os.listdir(f"{data}/sf0.001"):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/sf0.001/{f}')")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name].strip()})").fetchall()
        assert sorted(map(str, rows)) == sorted(map(str, want))
