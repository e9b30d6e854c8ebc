"""Running totals in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, lookup, parallelism

#: Rows for each partition, as long as that makes no more of them than the session's shuffles have.
ROWS = 50_000


def running_totals(df: DataFrame, order: Sequence[Column], adds: Sequence[str]) -> DataFrame:
    """Adds ``run_<c>``: the total of each column up to and with the row, in the global order.

    Rows are range-sorted and totalled within their partition as they stream by; partitions then get the sum of those
    before, which has a row per partition. The order should break ties, so that equal keys can be dealt to many tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), *[T.StructField(f"run_{c}", df.schema[c].dataType) for c in adds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(adds, 0)
        for b in batches:
            if not b.num_rows:
                continue
            cols = []
            for c in adds:
                v = np.cumsum(b.column(c).to_numpy(zero_copy_only=False)) + so_far[c]
                so_far[c] = v[-1]
                cols.append(pa.array(v, b.schema.field(c).type))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), *cols], names=schema.names)

    parts = min(parallelism(df.sparkSession), 1 + df.count() // ROWS)
    d = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = checkpoint(d.mapInArrow(run, schema))
    sums = d.groupBy("_part").agg(*[F.max(f"run_{c}").alias(f"_sum_{c}") for c in adds])
    prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(prior), F.lit(0)).alias(f"_base_{c}") for c in adds])
    out = lookup(d, base, ["_part"])
    return out.select(*df.columns, *[(F.col(f"run_{c}") + F.col(f"_base_{c}")).cast(df.schema[c].dataType).alias(f"run_{c}") for c in adds])
