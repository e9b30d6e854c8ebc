"""Bootstrap intervals and block-bootstrap scenarios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import pick, poisson1_array, uniform_array, with_uniform
from tidemark.functions.rolling import sample_kurt, sample_skew
from tidemark.operators.cross import correlation
from tidemark.operators.prep import YEAR, complete_dates
from tidemark.plans.attach import attach, attach_series
from tidemark.plans.folds import spread
from tidemark.plans.groups import group_starts, map_groups
from tidemark.plans.ranks import quantiles
from tidemark.plans.series import is_bounded, number_rows

ROOT_YEAR = YEAR**0.5
BOOT = "boot_id"


def metric_column(metric: str, x: Column) -> Column:
    """Aggregates known by name; any other aggregate can be given as a column."""
    if metric == "mean":
        return F.avg(x)
    if metric == "sharpe":
        return F.avg(x) / (F.stddev_samp(x) + 1e-8) * ROOT_YEAR
    if metric == "ir":
        return F.try_divide(F.avg(x), F.stddev_pop(x)) * ROOT_YEAR
    if metric == "var_95":
        return F.percentile(x, F.lit(0.05))
    raise ValueError(f"unknown metric {metric!r}")


def _times(df: DataFrame, n: int, key: Sequence[str], out: str = BOOT) -> DataFrame:
    """n copies of each row. The rows are few before and many after, so they are spread over all tasks first."""
    return spread(df, key).withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def resampled(df: DataFrame, col: str, n: int, key: Sequence[str] = (), order: str = "ts", seed: int = 42) -> DataFrame:
    """n resamples with replacement of each series: ``key, boot_id, slot, col``.

    Slot s of resample b takes row floor(u(s, b) * rows), with finer draws for long series: an equi-join of drawn positions with row positions.
    """
    k = list(key) or ["_one"]
    d = df if key else df.withColumn("_one", F.lit(0))
    d = attach_series(number_rows(d.select(*k, order, col), k, order), k, order, _n=F.count(F.lit(1)))
    draws = _times(d.select(*k, F.col("_seq").alias("slot"), "_n"), n, [*k, "slot"])
    draws = draws.withColumn("_pick", pick(F.col("_n"), seed, F.col("slot"), F.col(BOOT)))
    return draws.join(d.select(*k, F.col("_seq").alias("_pick"), col), [*k, "_pick"]).select(*key, BOOT, "slot", col)


def _drawdowns(d: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Adds ``_dd``: the fall of a resample's compounded values from their peak so far."""
    w = Window.partitionBy(*key, BOOT).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cum", F.product(1 + F.col(col)).over(w))
    return d.withColumn("_dd", F.col("_cum") / F.max("_cum").over(w) - 1)


def bootstrap(
    df: DataFrame, metric: str | Column | Metric, col: str, n: int = 1000, key: Sequence[str] = (), order: str = "ts", seed: int = 42, method: str = "index"
) -> DataFrame:
    """Value of a metric on n resamples: ``key, boot_id, value``.

    ``index`` draws with replacement and takes any aggregate (or ``max_drawdown``). ``poisson`` gives every
    row a Poisson(1) count per resample: one pass without a join, combined before the shuffle, for ``mean``,
    ``sharpe`` and ``ir``; use it where a series is long. A ``Metric`` of the user's own is resampled that way too.
    """
    if isinstance(metric, Metric):
        return _user_metric(df, metric, col, n, key, order, seed)
    if method == "poisson":
        return _poisson(df, metric, col, n, key, order, seed)
    d = resampled(df, col, n, key, order, seed)
    if metric == "max_drawdown":
        d = _drawdowns(d, col, key)
        return d.groupBy(*key, BOOT).agg(F.min("_dd").alias("value"))
    value = metric_column(metric, F.col(col)) if isinstance(metric, str) else metric
    return d.groupBy(*key, BOOT).agg(value.alias("value"))


@dataclass(frozen=True)
class Metric:
    """A user's metric of weighted rows, as a function of sums, so that no task needs all rows of a resample.

    ``terms`` turns values (n,) into the terms to be summed (n, m), for example the values and their squares;
    ``value`` turns total weights (r,) and weighted sums (r, m) of r resamples into r numbers. Rows without a value
    (NULL or NaN) have no weight. NaN as a result is NULL; a resample without any weight gives none.
    """

    terms: Callable[[np.ndarray], np.ndarray]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]


def metric_sums(df: DataFrame, metric: Metric, col: str, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """``key, boot_id, _sums``: for each resample the total Poisson weight and the weighted sums of the metric's terms.

    As in ``weighted_sums`` a task multiplies a matrix of weights with the terms of its rows and sends n records per
    series it holds and batch; rows are spread by series and position, so a series of any length is shared by all tasks.
    """
    key = list(key)
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    boots = np.arange(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            starts = group_starts(t, key)
            x, seq = t[col].cast(pa.float64()).to_numpy(), t["_seq"].to_numpy()
            known = ~np.isnan(x)
            for lo, hi in zip(starts[:-1], starts[1:]):
                at = lo + np.flatnonzero(known[lo:hi])
                sums = 0.0
                for i in range(0, len(at), max(1, WEIGHTS // n)):
                    rows = at[i : i + max(1, WEIGHTS // n)]
                    terms = np.column_stack((np.ones(len(rows)), metric.terms(x[rows])))
                    sums = sums + poisson1_array(uniform_array(seed, seq[rows][None], boots[:, None])).astype(float) @ terms
                if len(at):
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
                    same = pa.array(np.full(n, lo))
                    heads = [t[c].take(same).combine_chunks() for c in key]
                    yield pa.RecordBatch.from_arrays([*heads, pa.array(boots.astype("i4")), flat], names=[*key, BOOT, "_sums"])

    d = spread(df.select(*key, "_seq", col), [*key, "_seq"]).sortWithinPartitions(*key)
    parts = d.mapInArrow(run, f"{head}, {BOOT} int, _sums array<double>")
    width = 1 + metric.terms(np.ones(1)).reshape(1, -1).shape[1]
    return parts.groupBy(*key, BOOT).agg(F.array(*[F.sum(F.col("_sums")[i]) for i in range(width)]).alias("_sums"))


def _user_metric(df: DataFrame, metric: Metric, col: str, n: int, key: Sequence[str], order: str, seed: int) -> DataFrame:
    k = list(key) or ["_one"]
    d = df if key else df.withColumn("_one", F.lit(0))
    g = metric_sums(number_rows(d.select(*k, order, col), k, order), metric, col, n, k, seed).filter(F.col("_sums")[0] > 0)

    @F.pandas_udf("double")
    def value(sums: pd.Series) -> pd.Series:
        if not len(sums):
            return pd.Series([], dtype=float)
        a = np.stack(sums.to_numpy())
        return pd.Series(np.asarray(metric.value(a[:, 0], a[:, 1:]), dtype=float))

    return g.select(*key, BOOT, F.nanvl(value("_sums"), F.lit(None)).alias("value"))


#: Weights (rows times resamples) drawn at once in a task.
WEIGHTS = 1_000_000


def weighted_sums(df: DataFrame, col: str, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """``key, boot_id, _n, _s, _q, _c`` of numbered rows: for each resample the sums of weights, of weighted values and their squares.

    A task draws a matrix of weights, rows by resamples, and multiplies; it sends ``n`` sums per series it holds and
    batch, never a row per resample. ``_c`` counts the rows with a value.
    """
    key = list(key)
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    boots = np.arange(n)

    def lists(a: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), n).cast(pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            starts = group_starts(t, key)
            x, seq = t[col].cast(pa.float64()).to_numpy(), t["_seq"].to_numpy()
            known = ~np.isnan(x)
            v = np.where(known, x, 0.0)
            sums = np.zeros((3, len(starts) - 1, n))
            step = max(1, WEIGHTS // n)
            for g, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
                for at in range(lo, hi, step):
                    to = min(at + step, hi)
                    w = poisson1_array(uniform_array(seed, seq[at:to, None], boots[None])).astype(float)
                    sums[:, g] += np.stack((np.ones(to - at), v[at:to], v[at:to] ** 2)) @ w
            heads = [t[c].take(pa.array(starts[:-1])).combine_chunks() for c in key]
            count = np.add.reduceat(known.astype("i8"), starts[:-1])
            yield pa.RecordBatch.from_arrays([*heads, pa.array(count), *[lists(s) for s in sums]], names=[*key, "_c", "_n", "_s", "_q"])

    d = spread(df.select(*key, "_seq", col), [*key, "_seq"]).sortWithinPartitions(*key)
    parts = d.mapInArrow(run, f"{head}, _c long, _n array<double>, _s array<double>, _q array<double>")
    each = parts.select(*key, "_c", F.posexplode(F.arrays_zip("_n", "_s", "_q")).alias(BOOT, "_v"))
    return each.groupBy(*key, BOOT).agg(*[F.sum(f"_v.{c}").alias(c) for c in ("_n", "_s", "_q")], F.sum("_c").alias("_c"))


def series_sums(df: DataFrame, col: str, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """``weighted_sums`` of series that the calendar bounds: ``key, _c, _n, _s, _q``, one record per series with arrays over the resamples.

    Weights hang on position and resample alone, so many series share a matrix of them.
    """
    key = list(key)
    boots = np.arange(n)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        x, seq = t[col].cast(pa.float64()).to_numpy(), t["_seq"].to_numpy()
        known, of = ~np.isnan(x), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        v = np.where(known, x, 0.0)
        sums = np.zeros((3, len(starts) - 1, n))
        step = max(1, WEIGHTS // n)
        for at in range(0, int(seq.max()) + 1, step):
            rows = np.flatnonzero((seq >= at) & (seq < at + step))
            w = poisson1_array(uniform_array(seed, np.arange(at, min(at + step, int(seq.max()) + 1))[:, None], boots[None])).astype(float)
            for i, terms in enumerate((np.ones(len(rows)), v[rows], v[rows] ** 2)):
                m = np.zeros((len(starts) - 1, len(w)))
                m[of[rows], seq[rows] - at] = terms
                sums[i] += m @ w
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), n).cast(pa.list_(pa.float64())) for a in sums]
        heads = [t[c].take(pa.array(starts[:-1])) for c in key]
        return pa.table([*heads, pa.array(np.add.reduceat(known.astype("i8"), starts[:-1])), *lists], names=[*key, "_c", "_n", "_s", "_q"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    return map_groups(df.select(*key, "_seq", col), key, ["_seq"], run, f"{head}, _c long, _n array<double>, _s array<double>, _q array<double>")


def _poisson_value(metric: str, n: Column, s: Column, q: Column) -> Column:
    """A metric from the sums of a resample."""
    mean = s / n
    pop = F.greatest(q / n - mean * mean, F.lit(0.0))
    if metric == "mean":
        return mean
    if metric == "sharpe":
        return mean / (F.sqrt(pop * F.try_divide(n, n - 1)) + 1e-8) * ROOT_YEAR
    if metric == "ir":
        return F.try_divide(mean, F.sqrt(pop)) * ROOT_YEAR
    raise ValueError("method='poisson' knows mean, sharpe and ir")


def _poisson(df, metric, col, n, key, order, seed) -> DataFrame:
    k = list(key) or ["_one"]
    d = df if key else df.withColumn("_one", F.lit(0))
    g = weighted_sums(number_rows(d.select(*k, order, col), k, order), col, n, k, seed)
    g = g.filter("_n > 0").withColumns({c: F.when(F.col("_c") > 0, F.col(c)) for c in ("_s", "_q")})
    return g.select(*key, BOOT, _poisson_value(metric, F.col("_n"), F.col("_s"), F.col("_q")).alias("value"))


def _sorted_quantile(values: str, q: float) -> Column:
    """Interpolated quantile of a sorted array; NULL of an empty one."""
    at = (F.size(values) - 1) * F.lit(q)
    lo, hi = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)


def _series_interval(df: DataFrame, metric: str, col: str, n: int, key: Sequence[str], order: str, seed: int, lower: float, upper: float) -> DataFrame:
    """Intervals of many bounded series: the values of a series stay in one record, so that no resample is shuffled."""
    g = series_sums(number_rows(df.select(*key, order, col), key, order), col, n, key, seed)

    def value(v: Column) -> Column:
        known = F.col("_c") > 0
        return F.when(v["_n"] > 0, _poisson_value(metric, v["_n"], F.when(known, v["_s"]), F.when(known, v["_q"])))

    g = g.filter(F.exists("_n", lambda v: v > 0)).withColumn("_v", F.array_sort(F.array_compact(F.transform(F.arrays_zip("_n", "_s", "_q"), value))))
    return g.select(*key, _sorted_quantile("_v", lower).alias("lower"), _sorted_quantile("_v", upper).alias("upper"))


def bootstrap_interval(
    df: DataFrame, metric: str | Column | Metric, col: str = "ret", n: int = 1000, key: Sequence[str] = (), order: str = "ts", seed: int = 42,
    method: str = "index", lower: float = 0.025, upper: float = 0.975,
) -> DataFrame:
    """Percentile interval over the n resamples, ``key, lower, upper``."""
    if method == "poisson" and isinstance(metric, str) and key and is_bounded(df, order):
        return _series_interval(df, metric, col, n, key, order, seed, lower, upper)
    b = bootstrap(df, metric, col, n, key, order, seed, method)
    q = F.percentile("value", F.array(F.lit(lower), F.lit(upper)))
    return b.groupBy(*key).agg(q.alias("_q")).select(*key, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def var_bootstrap(returns: DataFrame, c: float = 0.95, n: int = 10_000, key=("portfolio",), col="ret", order="ts", seed=42, method="poisson") -> DataFrame:
    """Quantile 1-c of the means of n resamples."""
    b = bootstrap(returns, "mean", col, n, key, order, seed, method)
    return b.groupBy(*key).agg(F.percentile("value", F.lit(round(1 - c, 12))).alias("var"))


def bootstrap_ci(returns: DataFrame, n: int = 1000, key=("portfolio",), col="ret", order="ts", seed=42) -> DataFrame:
    """Intervals of Sharpe ratio, VaR and maximum drawdown per key, from the same resamples."""
    d = _drawdowns(resampled(returns, col, n, key, order, seed), col, key)
    value = {m: metric_column(m, F.col(col)).alias(m) for m in ("sharpe", "var_95")}
    b = d.groupBy(*key, BOOT).agg(*value.values(), F.min("_dd").alias("max_drawdown"))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    return b.groupBy(*key).agg(*[F.percentile(m, ends).alias(f"{m}_ci") for m in (*value, "max_drawdown")])


# ---------------------------------------------------------------------------------------------------------
# Scenarios


def _dates(returns: DataFrame, order: str) -> DataFrame:
    """Dates with their position ``_seq`` and their number ``_n``: a calendar, one row per date."""
    d = returns.select(order).distinct().withColumn("_one", F.lit(0))
    return attach_series(number_rows(d, ["_one"], order), ["_one"], order, _n=F.count(F.lit(1))).drop("_one")


def _panel(returns: DataFrame, col: str, order: str) -> DataFrame:
    """Rows of the dates on which every asset has a return above -1."""
    bad = returns.filter(F.col(col).isNull() | (F.col(col) <= -1)).select(order).distinct()
    return complete_dates(returns, ["asset"], order).join(bad, order, "left_anti")


def block_bootstrap(returns: DataFrame, n_sims: int, n_days: int, block: int = 21, seed: int = 42, col="ret", order="ts") -> DataFrame:
    """Scenario paths from blocks of consecutive days, all assets together: ``sim_id, step, asset, log_ret``.

    Only dates on which every asset has a return above -1 are drawn from; others are left out for all assets. The last block is cut to the remaining days, and its start is
    drawn from the same range as the others.
    """
    if n_sims < 1 or n_days < 1 or block < 1:
        raise ValueError("n_sims, n_days and block must be positive")
    r = _panel(returns, col, order)
    cal = _dates(r, order)
    hist = r.join(cal, order).select(F.col("_seq").alias("_day"), "asset", F.log1p(col).alias("log_ret"))
    n = cal.agg(F.max("_n").alias("_n"))
    per = -(-n_days // block)
    ids = returns.sparkSession.range(n_sims * per).select(F.floor(F.col("id") / per).alias("sim_id"), (F.col("id") % per).alias("_blk"))
    ids = ids.join(F.broadcast(n))  # one row
    ids = with_uniform(ids, "_u", seed, F.col("sim_id"), F.col("_blk"))
    ids = ids.withColumn("_start", F.floor(F.col("_u") * (F.col("_n") - block + 1)).cast("long"))
    steps = ids.withColumn("_off", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    steps = steps.select("sim_id", (F.col("_blk") * block + F.col("_off")).alias("step"), (F.col("_start") + F.col("_off")).alias("_day"))
    return steps.filter(F.col("step") < n_days).join(hist, "_day").select("sim_id", "step", "asset", "log_ret")


def regime_block_bootstrap(returns: DataFrame, regimes: DataFrame, n_sims: int, seed: int = 42, col="ret", order="ts") -> DataFrame:
    """Scenario paths that follow the observed regime runs: each run of each scenario takes consecutive days of
    its own label from a drawn start, wrapping around. ``regimes(ts, label)`` is one series."""
    from tidemark.operators.regime import with_runs

    r = _panel(returns, col, order)
    reg = regimes.select(order, "label").join(r.select(order).distinct(), order).withColumn("_one", F.lit(0))
    reg = number_rows(with_runs(reg, ["_one"], "label", order), ["_one"], order, "step")
    reg = number_rows(reg.drop("_seq"), ["label"], order, "_pos")
    reg = attach_series(reg, ["label"], order, _n=F.count(F.lit(1)))
    reg = attach_series(reg, ["run"], order, _run0=F.min("step"))
    sims = _times(reg, n_sims, [order], "sim_id")
    start = pick(F.col("_n"), seed, F.col("sim_id"), F.col("run"))
    sims = sims.select("sim_id", "step", "label", ((start + F.col("step") - F.col("_run0")) % F.col("_n")).alias("_pos"))
    donors = reg.select("label", "_pos", order).join(r.select(order, "asset", F.log1p(col).alias("log_ret")), order).drop(order)
    return sims.join(donors, ["label", "_pos"]).select(F.col("sim_id").cast("long").alias("sim_id"), "step", "asset", "label", "log_ret")


def portfolio_paths(paths: DataFrame, weights: DataFrame, rebalance: str = "daily") -> DataFrame:
    """Portfolio value along each path, rebalanced daily or never: ``sim_id, step, log_ret, value``."""
    w = Window.partitionBy("sim_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = paths.join(weights, "asset")
    if rebalance == "daily":
        d = d.groupBy("sim_id", "step").agg(F.sum(F.col("weight") * F.col("log_ret")).alias("log_ret"))
        return d.withColumn("value", F.exp(F.sum("log_ret").over(w)))
    if rebalance != "none":
        raise ValueError("rebalance is 'daily' or 'none'")
    wa = Window.partitionBy("sim_id", "asset").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_p", F.col("weight") * F.exp(F.sum("log_ret").over(wa)))
    d = d.groupBy("sim_id", "step").agg(F.sum("_p").alias("value"))
    prev = F.lag("value").over(Window.partitionBy("sim_id").orderBy("step"))
    return d.withColumn("log_ret", F.log("value") - F.coalesce(F.log(prev), F.lit(0.0))).select("sim_id", "step", "log_ret", "value")


def path_statistics(port: DataFrame, rf: float = 0.05) -> DataFrame:
    """Per path: total and annual return, volatility, Sharpe ratio, maximum drawdown, final value."""
    w = Window.partitionBy("sim_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = port.withColumn("_dd", F.col("value") / F.max("value").over(w) - 1)
    g = d.groupBy("sim_id").agg(
        F.max_by("value", "step").alias("final_value"), (F.exp(F.avg("log_ret") * YEAR) - 1).alias("ann_ret"),
        (F.stddev_pop("log_ret") * ROOT_YEAR).alias("ann_vol"), F.min("_dd").alias("max_dd"),
    )
    sharpe = F.coalesce(F.try_divide(F.col("ann_ret") - rf, F.col("ann_vol")), F.lit(0.0))
    return g.withColumns({"total_return": F.col("final_value") - 1, "sharpe": sharpe})


def percentile_fan(stats: DataFrame, levels: Sequence[float] = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99), col="total_return") -> DataFrame:
    """Quantiles of the total return over all paths, one row per level."""
    q = quantiles(stats, col, levels)
    lv = F.array(*[F.lit(float(x)) for x in levels])
    return q.select(F.explode(F.arrays_zip(lv.alias("level"), F.col("_q").alias("value"))).alias("_z")).select("_z.level", "_z.value")


def scenario_risk(stats: DataFrame) -> DataFrame:
    """VaR and CVaR at 95 and 99 % (mean of losses strictly beyond), win rate and means over all paths."""
    q = quantiles(stats.withColumn("_loss", -F.col("total_return")), "_loss", [0.95, 0.99])
    d = stats.join(F.broadcast(q))  # one row
    loss = -F.col("total_return")

    def tail(i):
        v = F.col("_q")[i]
        return -F.coalesce(F.avg(F.when(loss > v, loss)), F.max(loss))

    return d.agg(
        (-F.first("_q")[0]).alias("var95"), tail(0).alias("cvar95"),
        (-F.first("_q")[1]).alias("var99"), tail(1).alias("cvar99"), (F.avg((F.col("total_return") > 0).cast("int")) * 100).alias("win_rate"),
        F.avg("total_return").alias("expected"), F.avg("ann_ret").alias("annualized_ret"), F.avg("ann_vol").alias("annualized_vol"), F.avg("sharpe").alias("sharpe"),
    )


def terminal_moments(stats: DataFrame, col="final_value") -> DataFrame:
    """Mean, median, population deviation, sample skewness and kurtosis of the final values."""
    n = F.count(col).cast("double")
    m = stats.agg(
        F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), sample_skew(F.skewness(col), n).alias("skew"), sample_kurt(F.kurtosis(col), n).alias("kurt")
    )
    return m.join(F.broadcast(quantiles(stats, col, [0.5]).select(F.col("_q")[0].alias("median"))))  # both one row


def moment_validation(paths: DataFrame, returns: DataFrame, col="ret", order="ts", members: int | None = None) -> DataFrame:
    """Mean absolute difference of means, deviations and correlations between paths and history."""
    hist = _panel(returns, col, order).select(order, "asset", F.log1p(col).alias("log_ret"))
    a = paths.groupBy("asset").agg(F.avg("log_ret").alias("_m"), F.stddev_pop("log_ret").alias("_s"))
    b = hist.groupBy("asset").agg(F.avg("log_ret").alias("_hm"), F.stddev_samp("log_ret").alias("_hs"))
    one = a.join(b, "asset").agg(F.avg(F.abs(F.col("_m") - F.col("_hm"))).alias("mean_diff"), F.avg(F.abs(F.col("_s") - F.col("_hs"))).alias("std_diff"))
    flat = paths.withColumn("_row", F.col("sim_id") * (1 << 31) + F.col("step"))
    ca = correlation(flat, "log_ret", "_row", members=members).select("a", "b", "corr")
    cb = correlation(hist, "log_ret", order, members=members).select("a", "b", F.col("corr").alias("_h"))
    two = ca.join(cb, ["a", "b"]).agg(F.avg(F.abs(F.col("corr") - F.col("_h"))).alias("corr_diff"))
    return one.join(F.broadcast(two))  # both one row


def regime_moments(returns: DataFrame, regimes: DataFrame, col="ret", order="ts", members: int | None = None) -> dict[str, DataFrame]:
    """Per label: moments of each asset, correlations, frequency, and the transition matrix.

    Labels are carried forward onto the dates of the returns; ``regimes(ts, label)`` is one series.
    """
    from tidemark.operators.prep import ffill
    from tidemark.operators.regime import transition_matrix

    logs = returns.filter(F.col(col) > -1).select(order, "asset", F.log1p(col).alias("log_ret"))
    days = logs.select(order).distinct().join(regimes.select(order, "label"), order, "left").withColumn("_one", F.lit(0))
    days = ffill(days, ["label"], ["_one"], order).filter(F.col("label").isNotNull())
    d = logs.join(days.drop("_one"), order)
    count = days.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return {
        "moments": d.groupBy("label", "asset").agg(F.avg("log_ret").alias("mean"), F.stddev_samp("log_ret").alias("std")),
        "correlation": correlation(d, "log_ret", order, ["label"], members),
        "frequency": attach(count, [], _all=F.sum("count")).withColumn("frequency", F.col("count") / F.col("_all")).drop("_all"),
        "transitions": transition_matrix(days, ["_one"], "label", order).drop("_one"),
    }
