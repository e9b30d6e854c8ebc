"""Ranks and exact quantiles for groups of any size, ties included.

Rows, or distinct values with their counts, are range-partitioned by (group, value) and written; ranks are counted
inside a partition and raised by the counts of the partitions before it. Partitions are even whatever group or value
is hot, and there are as many as the session's shuffle partitions, so none grows with a group. The result is exact:
the sampled cuts decide only where work is done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.series import is_bounded, null_safe_join, ranged


def _before(*by: str):
    """The partitions before one, of the same group: as many records as partitions at most."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("_rp_part").rowsBetween(Window.unboundedPreceding, -1)


def _whole(*by: str):
    return Window.partitionBy(*(by or [F.lit(0)]))


def value_positions(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-null value of a group: ``group, col, _ties, _before, _n``.

    ``_before`` counts the rows with a smaller value, ``_n`` all non-null rows of the group. Equal values are counted
    before the first shuffle, so one that a third of the rows share is one record.
    """
    g = list(group)
    v = df.filter(F.col(col).isNotNull()).groupBy(*g, col).agg(F.count(F.lit(1)).alias("_ties"))
    v = ranged(v, g, col).withColumn("_rp_part", F.shiftright("_rp_id", 33))
    parts = v.groupBy(*g, "_rp_part").agg(F.sum("_ties").alias("_rk_c"))
    parts = parts.select(*g, "_rp_part", F.coalesce(F.sum("_rk_c").over(_before(*g)), F.lit(0)).alias("_rk_up"), F.sum("_rk_c").over(_whole(*g)).alias("_n"))
    inside = Window.partitionBy(*g, "_rp_part").orderBy("_rp_id").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_rk_in", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
    return null_safe_join(v, parts, [*g, "_rp_part"]).select(*g, col, "_ties", (F.col("_rk_up") + F.col("_rk_in")).alias("_before"), "_n")


def rank_within(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Add ``_ties, _before, _n`` to each row; NULL values get NULL positions.

    Rows go through one range shuffle by (group, value, hash of the row) and one by partition, and are never joined by
    value. A value may reach over many partitions: then it is the smallest or largest of each, and one record per
    partition tells how many of its rows lie in the others. Only rows alike in all columns cannot be parted.
    """
    g, names = list(group), df.columns
    d = df.withColumn("_rk_salt", F.xxhash64(*[c for c in names if not _has_map(df.schema[c].dataType)]))
    d = ranged(d, [*g, col], "_rk_salt").withColumn("_rp_part", F.shiftright("_rp_id", 33))
    w = Window.partitionBy(*g, "_rp_part").orderBy(F.col(col).asc_nulls_last())
    d = d.withColumns({"_rk_r": F.rank().over(w).cast("long") - 1, "_rk_t": F.count(F.lit(1)).over(w.rangeBetween(0, 0))})
    x = F.col(col)
    parts = d.filter(x.isNotNull()).groupBy(*g, "_rp_part").agg(
        F.count(F.lit(1)).alias("_rk_c"), F.min(x).alias("_rk_lo"), F.max(x).alias("_rk_hi"), F.min_by("_rk_t", x).alias("_rk_n_lo"), F.max_by("_rk_t", x).alias("_rk_n_hi")
    )
    lo, hi = (F.struct(F.col(v).alias("v"), F.col(n).alias("m")) for v, n in (("_rk_lo", "_rk_n_lo"), ("_rk_hi", "_rk_n_hi")))
    ends = parts.select(*g, "_rp_part", F.explode(F.when(F.col("_rk_lo") == F.col("_rk_hi"), F.array(lo)).otherwise(F.array(lo, hi))).alias("_rk_e"))
    ends = ends.select(*g, "_rp_part", F.col("_rk_e.v").alias("_rk_v"), F.col("_rk_e.m").alias("_rk_m"))
    ends = ends.withColumns({"_rk_same": F.coalesce(F.sum("_rk_m").over(_before(*g, "_rk_v")), F.lit(0)), "_rk_all": F.sum("_rk_m").over(_whole(*g, "_rk_v"))})
    ends = ends.groupBy(*g, "_rp_part").agg(F.min_by("_rk_same", "_rk_v").alias("_rk_same"), F.min_by("_rk_all", "_rk_v").alias("_rk_all_lo"), F.max_by("_rk_all", "_rk_v").alias("_rk_all_hi"))
    parts = parts.select(*g, "_rp_part", "_rk_lo", "_rk_hi", F.coalesce(F.sum("_rk_c").over(_before(*g)), F.lit(0)).alias("_rk_up"), F.sum("_rk_c").over(_whole(*g)).alias("_rk_n"))
    d = null_safe_join(d, null_safe_join(parts, ends, [*g, "_rp_part"]), [*g, "_rp_part"], "left")
    ties = F.when(x == F.col("_rk_lo"), F.col("_rk_all_lo")).when(x == F.col("_rk_hi"), F.col("_rk_all_hi")).otherwise(F.col("_rk_t"))
    before = F.col("_rk_up") + F.when(x == F.col("_rk_lo"), -F.col("_rk_same")).otherwise(F.col("_rk_r"))
    known = {"_ties": ties, "_before": before, "_n": F.col("_rk_n")}
    return d.select(*names, *[F.when(x.isNotNull(), c).alias(o) for o, c in known.items()])


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, T.MapType) or (isinstance(t, T.ArrayType) and _has_map(t.elementType))


def average_rank_share() -> Column:
    """Average rank of a row over the group's non-null count, from the columns of ``rank_within``."""
    return (F.col("_before") + (F.col("_ties") + 1) / 2) / F.col("_n")


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation as ``group, _q ARRAY<DOUBLE>``, by position lookup."""
    pos = value_positions(df, col, group)
    outs = []
    for q in qs:
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)

        def at(i: Column) -> Column:
            return F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_ties")), F.col(col)))

        frac = F.max(h - lo)
        outs.append(at(lo) + (at(hi) - at(lo)) * frac)
    return pos.groupBy(*group).agg(F.array(*outs).alias("_q"))


def quantiles(
    df: DataFrame, col: str, qs: Sequence[float], group: Sequence[str] = (), bounded: bool = False, approx: bool = False
) -> DataFrame:
    """``group, _q``: built-in ``percentile`` for groups of bounded size, position lookup otherwise.

    ``approx`` trades exactness for one pass with a fixed-size sketch.
    """
    levels = [float(q) for q in qs]
    if approx:
        return df.groupBy(*group).agg(F.percentile_approx(col, levels, 10_000).alias("_q"))
    if bounded:
        return df.groupBy(*group).agg(F.percentile(col, F.array(*[F.lit(q) for q in levels])).alias("_q"))
    return exact_quantiles(df, col, levels, group)


def attach_quantiles(
    df: DataFrame, col: str, qs: Sequence[float], key: Sequence[str] = (), out: str = "_q", order: str = "ts", approx: bool = False
) -> DataFrame:
    """Add the quantiles of a row's group as an array.

    Series bounded by the calendar get them from a window over the series, which needs no second pass and no
    join; other groups get them joined from ``quantiles``.
    """
    if key and order in df.columns and is_bounded(df, order) and not approx:
        levels = F.array(*[F.lit(float(q)) for q in qs])
        return df.withColumn(out, F.percentile(col, levels).over(Window.partitionBy(*key)))
    q = quantiles(df, col, qs, key, approx=approx).withColumnRenamed("_q", out)
    return df.join(q, list(key), "left") if key else df.join(F.broadcast(q))  # one row when there is no key
