"""Cross-sectional operators, top-k, correlations, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.prep import KEY, YEAR
from tidemark.plans.attach import attach, attach_series
from tidemark.plans.pairs import pair_correlations, pair_sums
from tidemark.plans.ranks import rank_within
from tidemark.plans.series import is_bounded, number_rows, series
from tidemark.plans.strong import strong_pairs as _strong_pairs


def forward_return(returns: DataFrame, h: int = 1, col: str = "ret", key: Sequence[str] = KEY, order: str = "ts", out: str = "forward_ret", chunk_rows=None):
    """Return h rows ahead."""
    s = series(returns, key, order, lookahead=h, chunk_rows=chunk_rows)
    return s.add({out: F.lead(col, h).over(s.ordered())})


def top_half_members(returns: DataFrame, lookback: int = 20, col: str = "ret", order: str = "ts") -> DataFrame:
    """Rows of the assets in the upper half of past performance on their date, ties by asset name.

    Performance is the compounded return of the ``lookback`` rows before the date. The cut is found from
    rank positions; only assets tied at the cut are ordered by name.
    """
    s = series(returns, KEY, order, lookback=lookback)
    past = s.span(-lookback, -1)
    perf = F.when(F.count(col).over(past) == lookback, F.product(1 + F.col(col)).over(past) - 1)
    d = s.add({"_perf": perf}).filter(F.col("_perf").isNotNull())
    d = rank_within(d, "_perf", [order]).withColumn("_above", F.col("_n") - F.col("_before") - F.col("_ties"))
    k = F.floor(F.col("_n") / 2)
    d = d.withColumn("_k", k).filter(F.col("_above") < F.col("_k"))
    sure = d.filter(F.col("_above") + F.col("_ties") <= F.col("_k"))
    cut = d.filter(F.col("_above") + F.col("_ties") > F.col("_k"))
    w = Window.partitionBy(order).orderBy("asset")
    cut = cut.withColumn("_rn", F.row_number().over(w)).filter(F.col("_above") + F.col("_rn") <= F.col("_k")).drop("_rn")
    return sure.unionByName(cut).drop("_above", "_ties", "_before", "_n", "_k").withColumnRenamed("_perf", "past_perf")


def top_half_momentum(returns: DataFrame, lookback: int = 20, col: str = "ret", order: str = "ts") -> DataFrame:
    """Equal-weight return per date of the top half by past performance."""
    return top_half_members(returns, lookback, col, order).groupBy(order).agg(F.avg(col).alias(col))


def correlation(returns: DataFrame, col: str = "ret", order: str = "ts", group: Sequence[str] = (), members: int | None = None) -> DataFrame:
    """Pearson correlation of all ordered asset pairs over their common dates: ``a, b, corr, n``."""
    return pair_correlations(returns, "asset", col, order, group, members)


def strong_pairs(
    returns: DataFrame, threshold: float = 0.8, top: int | None = None, col: str = "ret", order: str = "ts", min_dates: int = 20, block: int | None = None
) -> DataFrame:
    """Pairs of assets whose correlation reaches the threshold in size: ``a, b, corr, n`` with a < b.

    The use of a correlation matrix that grows with the result, not with the square of the universe: blocks of assets
    that cannot hold such a pair are not compared (see ``plans.strong``), and none is lost. ``top`` keeps, for each asset,
    its strongest pairs as ``asset, rank, other, corr, n``, ties to the smaller name. Of rows that repeat an asset and date
    the largest value counts; missing values, and assets that never move, make no pair. Orders other than a DATE are
    compared in full.
    """
    if is_bounded(returns, order):
        d = _strong_pairs(returns, threshold, "asset", col, order, min_dates, block, top)
    else:
        known = returns.groupBy("asset", order).agg(F.max(F.nanvl(F.col(col).cast("double"), F.lit(None))).alias(col))
        d = correlation(known, col, order).filter((F.col("a") < F.col("b")) & (F.abs("corr") >= threshold) & (F.col("n") >= min_dates))
    if top is None:
        return d
    if not is_bounded(returns, order):
        both = F.array(F.struct(F.col("a").alias("asset"), F.col("b").alias("other")), F.struct(F.col("b").alias("asset"), F.col("a").alias("other")))
        d = d.select(F.explode(both).alias("_s"), "corr", "n").select("_s.*", "corr", "n")  # pairs are found once
    w = Window.partitionBy("asset").orderBy(F.abs("corr").desc(), "other")  # limited to ``top`` before the shuffle, too
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("asset", "rank", "other", "corr", "n")


def covariance(returns: DataFrame, ann: float = YEAR, col: str = "ret", order: str = "ts", group: Sequence[str] = (), members: int | None = None) -> DataFrame:
    """Annualised sample covariance of all ordered asset pairs: ``a, b, cov, n``."""
    p = pair_sums(returns, "asset", col, order, group, members)
    n = F.col("n")
    c = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, n - 1) * ann
    return p.select(*group, "a", "b", c.alias("cov"), n.cast("long").alias("n"))


def last_n(df: DataFrame, n: int, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """The last n rows of each series.

    The n-th latest position follows from the row count, so no descending sort over whole series is made.
    """
    d = attach_series(number_rows(df, key, order), key, order, _cnt=F.count(F.lit(1)))
    return d.filter(F.col("_seq") >= F.col("_cnt") - n).drop("_seq", "_cnt")


def distribution(df: DataFrame, label: str, key: Sequence[str] = ()) -> DataFrame:
    """Count and share per label."""
    c = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("count"))
    return attach(c, key, _all=F.sum("count")).withColumn("share", F.col("count") / F.col("_all")).drop("_all")


def histogram(df: DataFrame, col: str = "ret", bins: int = 50, key: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins between minimum and maximum; the maximum belongs to the last bin."""
    d = attach(df.filter(F.col(col).isNotNull()).select(*key, col), key, _lo=F.min(col), _hi=F.max(col))
    pos = F.floor(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    d = d.withColumn("bin", F.coalesce(F.least(pos, F.lit(bins - 1)), F.lit(0)).cast("int"))
    return d.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("count"))


def price_index(bars: DataFrame, col: str = "close", key: Sequence[str] = KEY, order: str = "ts", out: str = "price_index") -> DataFrame:
    """Price over the first price of the series (aggregate and join, no window)."""
    d = attach_series(bars, key, order, _first=F.min_by(col, F.when(F.col(col).isNotNull(), F.col(order))))
    return d.withColumn(out, F.col(col) / F.col("_first")).drop("_first")


def rolling_momentum(returns: DataFrame, n: int = 20, col: str = "ret", order: str = "ts", out: str = "momentum_20d") -> DataFrame:
    s = series(returns, KEY, order, lookback=n - 1)
    return s.add({out: R.mean(s, col, n)})
