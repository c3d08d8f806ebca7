"""A Python function on each group of rows, with many small groups to a batch (applyInPandas makes a table and a call of each)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.lineage import workers

#: Rows of a batch of results.
ROWS = 10_000
TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def mapped(df: DataFrame, keys: list[str], f: Callable[[dict[str, list]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of the schema (names and TYPES) that f makes of the columns of each group of equal keys; a group is in one task's memory."""
    workers(df.sparkSession)
    names, types = zip(*((n, TYPES[t]) for n, t in (field.split() for field in schema.split(", "))))
    columns = df.columns

    def run(batches):
        kept: dict[str, list] = {c: [] for c in columns}
        out: list[tuple] = []
        last = None

        def packed():
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], list(names))
            out.clear()
            return made

        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in columns}
            for key, at in groupby(range(batch.num_rows), key=list(zip(*(rows[k] for k in keys))).__getitem__):
                at = list(at)
                if key != last:
                    if kept[columns[0]]:
                        out.extend(f(kept))
                        kept = {c: [] for c in columns}
                    last = key
                for c in columns:
                    kept[c].extend(rows[c][at[0] : at[-1] + 1])
                if len(out) >= ROWS:
                    yield packed()
        if kept[columns[0]]:
            out.extend(f(kept))
        if out:
            yield packed()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
