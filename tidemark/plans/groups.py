"""Whole groups out of sorted Arrow batches, many at a time.

Rows are hash-partitioned by key and sorted within partitions; a task then reads tables that hold whole groups and about
a given number of rows, so that numerics run over many groups at once and no group costs a call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.plans.folds import spread


def _new_key(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's key differs from that of the row before; nulls are equal to one another."""
    out = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        c = t[k].combine_chunks()
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        null = c.is_null().to_numpy(zero_copy_only=False)
        out |= differs | (null[1:] != null[:-1])
    return np.concatenate(([True], out)) if t.num_rows else out


def group_starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first rows of the groups of a sorted table, and its length."""
    return np.append(np.flatnonzero(_new_key(t, keys)), t.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups with ``rows`` rows or more (the last may have fewer), from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = group_starts(t, keys)[-2]  # the last group may go on
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, n = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def map_groups(
    df: DataFrame, key: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, rows: int = 100_000, placed: bool = False
) -> DataFrame:
    """``fn(table, starts)`` over tables of whole groups, each sorted by ``order``; groups must fit a task.

    ``placed`` rows are hash-partitioned by key already and are not shuffled again.
    """
    key = list(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, key, rows):
            yield from fn(t, group_starts(t, key)).to_batches()

    return (df if placed else spread(df, key)).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
