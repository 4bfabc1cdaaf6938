"""Running a function over Arrow batches of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, work: Callable[..., dict[str, list]], schema: str, *, setup: Callable[[], object] | None = None) -> DataFrame:
    """``work(columns[, made by setup])`` for every batch; it gets the input's columns by name and returns the output's."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (setup(),) if setup else ()
        for batch in batches:
            if batch.num_rows:
                got = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)}, *made)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
