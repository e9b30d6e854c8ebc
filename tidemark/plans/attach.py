"""Group totals attached to rows by aggregate-and-join instead of an unordered window.

An unordered ``Window.partitionBy(k)`` moves every row of a group to one task. The aggregate is combined
before its shuffle, so a group holding a third of all rows costs nothing extra; the join back is left to
adaptive execution, which broadcasts the totals when they turn out small and splits skewed partitions
when they do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.series import is_bounded


def attach(df: DataFrame, key: Sequence[str], **aggs: Column) -> DataFrame:
    """Add one column per aggregate, computed over the rows that share ``key``. The key is not NULL."""
    cols = [c.alias(n) for n, c in aggs.items()]
    if not key:
        return df.join(F.broadcast(df.agg(*cols)))  # one row by construction
    return df.join(df.groupBy(*key).agg(*cols), list(key), "left")


def attach_series(df: DataFrame, key: Sequence[str], order: str = "ts", **aggs: Column) -> DataFrame:
    """``attach`` for totals of whole series: a window where the calendar bounds them, as it needs no join."""
    if key and order in df.columns and is_bounded(df, order):
        w = Window.partitionBy(*key)
        return df.withColumns({n: c.over(w) for n, c in aggs.items()})
    return attach(df, key, **aggs)
