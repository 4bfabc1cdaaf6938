"""Every query of the catalog against its SQL, and plans that must keep their shape."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from quirelake import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(f"{data}/sf0.001"):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/sf0.001/{f}')")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
            return "NULL"
        return f"{x:.6f}" if isinstance(x, float | np.floating) else str(x.tolist() if isinstance(x, np.ndarray) else x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, f"{data}/sf0.001").toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", ["layout_tree", "tree_text", "tree_paths"])
def test_trees_of_long_documents(spark, data, tmp_path, name):
    """Pages beyond 2147, a heading and texts on one place, blocks without a place: as the SQL has them."""
    schema = spark.read.parquet(f"{data}/sf0.001/blocks.parquet").schema
    kinds = [("text", 5926, 3), ("title", 5926, 3), ("text", 5926, 3), ("text", 5926, 4), ("title", 2148, 0), ("text", 2148, 1), ("text", None, 1), ("text", 1, 0)]
    rows = [{"doc_id": "d", "page_num": page, "block_idx": at, "block_id": f"b{i}", "content": f"t{i}", "block_type": kind} for i, (kind, page, at) in enumerate(kinds)]
    spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/blocks.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW blocks AS SELECT * FROM read_parquet('{tmp_path}/blocks.parquet/*.parquet')")
    df, want = QUERIES[name](spark, str(tmp_path)), con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, df.select(names).toLocalIterator())) == sorted(str(Row(**dict(zip(names, r, strict=True)))) for r in want.fetchall())
    assert df.count() == len(rows)


def test_scan_reads_what_it_needs(spark, data):
    plan = QUERIES["list_documents"](spark, f"{data}/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "file_type" not in plan
    plan = QUERIES["term_stats"](spark, f"{data}/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "review_date" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
