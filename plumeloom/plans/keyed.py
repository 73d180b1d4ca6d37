"""Kernels on many small keys at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_whole_keys(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run on tables of df's rows that hold whole keys one after the other, and the rows at which each of them starts.

    A group of Spark's costs a task some milliseconds in Python, which for keys of a few pixels is nearly all of their time. So
    rows are sorted by key, and what a batch has of its last key waits for the next batch. A task holds a
    batch and one key.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, rows]) if held else rows
                starts = starts_of(held, keys)
                if len(starts) > 1:
                    yield from run(held.slice(0, starts[-1]).combine_chunks(), starts[:-1]).to_batches()
                    held = held.slice(starts[-1])
        if held:
            yield from run(held.combine_chunks(), starts_of(held, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(every, schema)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose key is not that of the row before."""
    opens = np.ones(table.num_rows, bool)
    opens[1:] = False
    for k in keys:
        column = table.column(k).combine_chunks()
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False)
        opens[1:] |= pc.or_(differ, pc.xor(pc.is_null(before), pc.is_null(after))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(opens)
