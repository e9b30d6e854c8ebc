"""State machines along sorted rows, for steps that depend on the step before in a way no sum can express.

Rows are hash-partitioned by key and sorted within partitions; each task then reads Arrow batches in order and
keeps only the state of the key at hand. Memory is one batch plus one state, whatever the length of a series.
The order within a key is inherently sequential; work is parallel over keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_of(df: DataFrame, **extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} {t}" for n, t in extra.items()])


def spread(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hash-partition by key over a fixed number of tasks, for steps that are heavy per row: adaptive execution
    would merge partitions by their bytes."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *[F.col(k) for k in key])


def sorted_batches(df: DataFrame, key: Sequence[str], order: Sequence[str], fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    return spread(df, key).sortWithinPartitions(*key, *order).mapInPandas(fn, schema)


def hold_with_band(df: DataFrame, key: Sequence[str], target: str, active: str, threshold: float, order: str = "ts", out: str = "weight") -> DataFrame:
    """Carry a value along each series; on active rows take the target unless it is within ``threshold``.

    The first row of a series always takes its target.
    """
    key = list(key)

    def run(batches):
        last, held = None, 0.0
        for pdf in batches:
            ids = list(zip(*[pdf[k].tolist() for k in key]))
            res = []
            for k, t, a in zip(ids, pdf[target].tolist(), pdf[active].tolist()):
                if k != last:
                    last, held = k, t
                elif a and abs(t - held) >= threshold:
                    held = t
                res.append(held)
            yield pdf.assign(**{out: res})

    return sorted_batches(df, key, [order], run, schema_of(df, **{out: "double"}))
