"""Preparation: fills, returns, resampling, joins with macro levels, scaling, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.attach import attach, attach_series
from tidemark.plans.ranks import attach_quantiles, quantiles
from tidemark.plans.series import number_rows, running, series
from tidemark.sources.market import check_weights

KEY = ("asset",)
YEAR = 252  # trading days per year, the annualisation constant


# ---------------------------------------------------------------------------------------------------------
# Shape


def wide_to_long(df: DataFrame, value: str = "close", order: str = "ts", key: str = "asset") -> DataFrame:
    """One column per asset to one row per (asset, ts)."""
    return df.unpivot([order], [c for c in df.columns if c != order], key, value)


def long_to_wide(df: DataFrame, value: str, assets: Sequence[str], order: str = "ts", key: str = "asset") -> DataFrame:
    """One row per ts with a column per listed asset. The list is explicit: no pass to find the values."""
    return df.groupBy(order).pivot(key, list(assets)).agg(F.first(value, ignorenulls=True))


def calendar_fill(bars: DataFrame, start: str, end: str, assets: Sequence[str], order: str = "ts", key: str = "asset") -> DataFrame:
    """One row per asset and calendar day in [start, end]; days and assets without data get NULLs.

    The calendar is made from two literals (the date range and the asset list) and never collected.
    """
    one = bars.sparkSession.range(1)
    days = one.select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(order))
    grid = days.select(order, F.explode(F.array(*[F.lit(a) for a in assets])).alias(key))
    return grid.join(bars, [key, order], "left")


# ---------------------------------------------------------------------------------------------------------
# Fills and returns


def ffill(df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Last known value carried forward."""
    tmp = running(df, key, {f"_f_{c}": ("last", c) for c in cols}, order, chunk_rows=chunk_rows)
    return tmp.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def bfill(df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Next known value carried backward."""
    tmp = running(df, key, {f"_f_{c}": ("last", c) for c in cols}, order, reverse=True, chunk_rows=chunk_rows)
    return tmp.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def fill_all(df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, order: str = "ts", zero: bool = True) -> DataFrame:
    """Forward, then backward, then 0."""
    d = bfill(ffill(df, cols, key, order), cols, key, order)
    return d.fillna(0.0, list(cols)) if zero else d


def pct_change(
    df: DataFrame,
    col: str = "close",
    key: Sequence[str] = KEY,
    order: str = "ts",
    dropna: str = "row",
    out: str = "ret",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Relative change to the row before.

    ``dropna="row"`` drops rows without a result, ``"any_asset"`` keeps only dates on which every series has
    one, ``"none"`` keeps all.
    """
    s = series(df, key, order, lookback=1, chunk_rows=chunk_rows)
    d = s.add({out: F.try_divide(F.col(col), F.lag(col).over(s.ordered())) - 1})
    if dropna == "none":
        return d
    d = d.filter(F.col(out).isNotNull())
    return complete_dates(d, key, order) if dropna == "any_asset" else d


def complete_dates(df: DataFrame, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Keep the dates on which every series of the input has a row."""
    n = df.agg(F.count_distinct(*key).alias("_all"))
    full = df.groupBy(order).agg(F.count_distinct(*key).alias("_here")).join(F.broadcast(n))  # n is one row
    return df.join(full.filter("_here = _all").select(order), order, "left_semi")


def log_return(df: DataFrame, col: str = "ret", out: str = "log_ret") -> DataFrame:
    """ln(1 + r); NULL at or below -1."""
    return df.withColumn(out, F.when(F.col(col) > -1, F.log1p(col)))


# ---------------------------------------------------------------------------------------------------------
# Resampling


def period_end(order: Column, freq: str) -> Column:
    """Last day of the day, week (Sunday), month or quarter that holds the date."""
    if freq == "D":
        return order.cast("date")
    if freq == "W":
        return F.date_add(F.date_trunc("week", order).cast("date"), 6)
    if freq == "M":
        return F.last_day(order)
    if freq == "Q":
        return F.last_day(F.add_months(F.date_trunc("quarter", order).cast("date"), 2))
    raise ValueError(f"unknown frequency {freq!r}")


def resample_last(df: DataFrame, freq: str = "D", cols: Sequence[str] = ("close",), key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Last non-null value per period, one partially combined aggregate."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return df.groupBy(*key, period_end(F.col(order), freq).alias("period")).agg(*aggs).withColumnRenamed("period", order)


def resample_sum(df: DataFrame, freq: str = "M", cols: Sequence[str] = ("ret",), key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Sum per period."""
    aggs = [F.sum(c).alias(c) for c in cols]
    return df.groupBy(*key, period_end(F.col(order), freq).alias("period")).agg(*aggs).withColumnRenamed("period", order)


# ---------------------------------------------------------------------------------------------------------
# Joins


def macro_wide(macro: DataFrame, names: Sequence[str], order: str = "ts") -> DataFrame:
    """One column per macro series."""
    return macro.groupBy(order).pivot("series", list(names)).agg(F.first("value"))


def macro_join(
    df: DataFrame, macro: DataFrame, names: Sequence[str], ma: int = 21, spread: int = 252, key: Sequence[str] = KEY, order: str = "ts"
) -> DataFrame:
    """Macro levels on the dates of each series, carried forward; per series ``<name>_yield``, its ``ma``-day
    mean and its distance from the ``spread``-day mean. A level on a date the series lacks is not used.
    """
    from tidemark.functions.rolling import mean

    d = df.join(macro_wide(macro, names, order), order, "left")
    d = ffill(d, names, key, order)
    s = series(d, key, order, lookback=max(ma, spread) - 1)
    cols = {}
    for n in names:
        cols |= {f"{n}_yield_ma": mean(s, n, ma), f"{n}_yield_spread": F.col(f"`{n}`") - mean(s, n, spread)}
    d = s.add(cols)
    for n in names:
        d = d.withColumnRenamed(n, f"{n}_yield")
    return d


def asof_macro_join(df: DataFrame, macro: DataFrame, names: Sequence[str], key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Last level at or before each row's time, also from dates the series lacks.

    Levels are carried forward on the macro calendar first, which is small, so that each row needs one
    equi-join on the latest macro date: found by a running maximum over the union of both calendars.
    """
    wide = ffill(macro_wide(macro, names, order).withColumn("_k", F.lit(1)), names, ["_k"], order).drop("_k")
    wide = wide.withColumnRenamed(order, "_m")
    days = df.select(order).distinct().select(order, F.lit(None).cast(df.schema[order].dataType).alias("_m"))
    cal = days.unionByName(wide.select(F.col("_m").alias(order), F.col("_m")))
    cal = cal.groupBy(order).agg(F.max("_m").alias("_m")).withColumn("_k", F.lit(1))
    cal = running(cal, ["_k"], {"_at": ("max", "_m")}, order).select(order, F.col("_at").alias("_m"))
    return df.join(cal, order, "left").join(wide, "_m", "left").drop("_m")


def align(left: DataFrame, right: DataFrame, on: Sequence[str] = ("asset", "ts")) -> DataFrame:
    """Rows of both sides on their common index."""
    return left.join(right, list(on), "inner")


def common_assets(left: DataFrame, right: DataFrame, key: str = "asset", check: bool = False) -> DataFrame:
    """Rows of ``left`` whose asset also occurs in ``right``; ``check`` raises when there is none."""
    out = left.join(right.select(key).distinct(), key, "left_semi")
    if check and not out.take(1):
        raise ValueError("no common assets")
    return out


# ---------------------------------------------------------------------------------------------------------
# Portfolios


def equal_weight_portfolio(returns: DataFrame, col: str = "ret", order: str = "ts", key: Sequence[str] = ()) -> DataFrame:
    """Mean return over assets per date; missing assets are skipped."""
    return returns.groupBy(*key, order).agg(F.avg(col).alias(col))


def checked_weights(weights: DataFrame) -> DataFrame:
    """The same frame; reading it raises unless its weights lie in [0, 1] and sum to 1."""
    w = F.col("weight")
    found = weights.agg(F.count_if(w.isNull() | ~w.between(0, 1)).alias("_bad"), F.sum("weight").alias("_sum"))  # one row
    wrong = F.when(F.col("_bad") > 0, F.lit("weights must lie in [0, 1]")).when(F.abs(F.col("_sum") - 1) > 1e-6, F.lit("weights must sum to 1"))
    d = weights.join(F.broadcast(found.select(wrong.alias("_wrong"))))
    return d.withColumn("weight", F.when(F.col("_wrong").isNull(), w).otherwise(F.raise_error(F.col("_wrong")).cast("double"))).drop("_wrong")


def weighted_portfolio(
    returns: DataFrame, weights: DataFrame | dict[str, float], col: str = "ret", order: str = "ts", key: Sequence[str] = ()
) -> DataFrame:
    """Sum of weight times return per date. Weights are checked: in [0, 1], summing to 1; those of a frame as they are read."""
    if isinstance(weights, dict):
        check_weights(list(weights.values()))
        weights = returns.sparkSession.createDataFrame(list(weights.items()), "asset string, weight double")
    else:
        weights = checked_weights(weights)
    return returns.join(weights, "asset").groupBy(*key, order).agg(F.sum(F.col("weight") * F.col(col)).alias(col))


# ---------------------------------------------------------------------------------------------------------
# Scaling and cleaning


def sanitize(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """To double; values that are no number, infinite or NaN become NULL, then ``fill``."""
    out = {}
    for c in cols:
        x = F.col(c).try_cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        out[c] = F.coalesce(x, F.lit(fill)) if fill is not None else x
    return df.withColumns(out)


def zscore(df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, eps: float = 1e-8, order: str = "ts") -> DataFrame:
    """(x - mean) / (sample std + eps) over the whole series."""
    aggs = {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_samp(c) for c in cols}
    d = attach_series(df, key, order, **aggs)
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps) for c in cols}).drop(*aggs)


def standard_scale(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population std; a constant column keeps scale 1."""
    aggs = {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_pop(c) for c in cols}
    d = attach(df, key, **aggs)
    scale = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in cols}).drop(*aggs)


def winsor_limits(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99, approx: bool = False) -> dict[str, tuple[float, float]]:
    """Quantiles of each column over all rows, two numbers per column."""
    out = {}
    for c in cols:
        q = quantiles(df, c, [lo, hi], approx=approx).first()
        out[c] = tuple(q["_q"]) if q and q["_q"] else (None, None)
    return out


def winsorize(
    df: DataFrame,
    cols: Sequence[str],
    lo: float = 0.01,
    hi: float = 0.99,
    limits: dict[str, tuple[float, float]] | None = None,
    key: Sequence[str] = (),
    approx: bool = False,
    order: str = "ts",
) -> DataFrame:
    """Clip at quantiles of the batch, or at given limits (from fitting time)."""
    if limits is not None:
        return df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(limits[c][1])), F.lit(limits[c][0])) for c in cols})
    d = df
    for c in cols:
        d = attach_quantiles(d, c, [lo, hi], key, f"_q_{c}", order, approx)
    clip = {
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0])) for c in cols
    }
    return d.withColumns(clip).drop(*[f"_q_{c}" for c in cols])


def robust_scale(
    df: DataFrame, cols: Sequence[str], clip: float = 10.0, key: Sequence[str] = (), approx: bool = False, order: str = "ts"
) -> DataFrame:
    """(x - median) / (q75 - q25), range 0 counting as 1, clipped to +-clip."""
    d = df
    for c in cols:
        d = attach_quantiles(d, c, [0.25, 0.5, 0.75], key, f"_q_{c}", order, approx)
    out = {}
    for c in cols:
        q = F.col(f"_q_{c}")
        iqr = q[2] - q[0]
        z = (F.col(c) - q[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)
        out[c] = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))
    return d.withColumns(out).drop(*[f"_q_{c}" for c in cols])


def drop_constant_features(df: DataFrame, cols: Sequence[str], tol: float = 1e-8) -> tuple[DataFrame, list[str]]:
    """Drop columns whose population variance does not exceed ``tol``; returns the kept names as well."""
    v = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first().asDict()
    kept = [c for c in cols if v[c] is not None and v[c] > tol]
    return df.drop(*[c for c in cols if c not in kept]), kept


# ---------------------------------------------------------------------------------------------------------
# Checks and summaries


def integrity_check(bars: DataFrame, col: str = "close", key: Sequence[str] = KEY, out: str = "ok") -> DataFrame:
    """Per series: null count, and whether the series has more than one value (max > min needs no distinct)."""
    return bars.groupBy(*key).agg(
        F.count_if(F.col(col).isNull()).alias("nulls"),
        F.coalesce(F.max(col) > F.min(col), F.lit(False)).alias("varies"),
    ).withColumn(out, (F.col("nulls") == 0) & F.col("varies"))


def assert_integrity(bars: DataFrame, col: str = "close", key: Sequence[str] = KEY) -> DataFrame:
    """Raise when any series has NULLs or is constant."""
    bad = integrity_check(bars, col, key).filter("not ok").limit(5).collect()  # five names for the message
    if bad:
        raise ValueError(f"series with nulls or without variation: {[r.asDict() for r in bad]}")
    return bars


def quality_summary(returns: DataFrame, col: str = "ret", key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Row, null and zero counts, date range, annual return, volatility and Sharpe ratio per series."""
    r = F.col(col)
    return returns.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(order).alias("first_ts"),
        F.max(order).alias("last_ts"),
        F.count_if(r.isNull()).alias("nulls"),
        F.count_if(r == 0).alias("zeros"),
        (F.avg(r) * YEAR).alias("annual_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(YEAR))).alias("annual_vol"),
    ).withColumn("sharpe", F.try_divide("annual_return", "annual_vol"))


def extreme_flag(df: DataFrame, col: str = "ret", z: float = 5.0, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Per series: null count and number of values further than ``z`` population deviations from the mean."""
    d = attach_series(df, key, order, _m=F.avg(col), _s=F.stddev_pop(col))
    far = F.abs(F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))) > z
    return d.groupBy(*key).agg(F.count_if(F.col(col).isNull()).alias("nulls"), F.count_if(far).alias("extremes"))


# ---------------------------------------------------------------------------------------------------------
# Splits


def chrono_split(df: DataFrame, key: Sequence[str] = KEY, validation: float = 0.2, order: str = "ts") -> DataFrame:
    """Add ``role``: the last share of rows of each series is ``validation``, rounded up, the rest ``train``."""
    d = attach_series(number_rows(df, key, order), key, order, _n=F.count(F.lit(1)))
    held = F.ceil(F.col("_n") * F.lit(validation))
    return d.withColumn("role", F.when(F.col("_seq") >= F.col("_n") - held, "validation").otherwise("train")).drop("_n", "_seq")


def time_series_folds(df: DataFrame, n_splits: int = 5, key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Expanding-window folds as rows (fold, role): test size n // (k+1), training is all rows before.

    A row is test in one fold and training in the folds after it, so fold ids follow from its position.
    """
    d = attach_series(number_rows(df, key, order), key, order, _n=F.count(F.lit(1)))
    size = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - size * n_splits
    own = F.when(F.col("_seq") < first, F.lit(-1)).otherwise(F.floor((F.col("_seq") - first) / size)).cast("int")
    d = d.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    d = d.filter(F.col("fold") >= F.col("_own"))
    return d.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own", "_n", "_seq")
