"""Back-tests as tables over ``strategy_id, window_id, asset, ts``: thousands of settings run as one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cross import top_half_momentum
from tidemark.operators.prep import YEAR, equal_weight_portfolio
from tidemark.operators.risk import performance_table
from tidemark.operators.sizing import SETTINGS, Strategy, apply_constraints, size_weights, with_settings
from tidemark.plans.attach import attach_series
from tidemark.plans.folds import hold_with_band, schema_of, sorted_batches
from tidemark.plans.series import number_rows, running, series
from tidemark.session import checkpoint

RUN = ["strategy_id", "window_id"]
BAND = 0.002  # weights closer than this to the held one are not traded
ROOT_YEAR = YEAR**0.5


# ---------------------------------------------------------------------------------------------------------
# Calendars and windows


def _since_last(dates: DataFrame, days: int, key: Sequence[str], order: str) -> DataFrame:
    """Rebalance ``days`` after the last rebalance: a fold over the dates of each key."""
    key = list(key)

    def run(batches):
        last, at = None, None
        for pdf in batches:
            ids, out = list(zip(*[pdf[k].tolist() for k in key])), []
            for k, t in zip(ids, pd.to_datetime(pdf[order])):
                hit = k != last or (t - at).days >= days
                if hit:
                    last, at = k, t
                out.append(hit)
            yield pdf.assign(rebalance_day=out)

    return sorted_batches(dates, key, [order], run, schema_of(dates, rebalance_day="boolean"))


def rebalance_calendar(dates: DataFrame, freq: str | int | Column = "W", key: Sequence[str] = RUN, order: str = "ts", since: str = "row") -> DataFrame:
    """Adds ``rebalance_day``. D: every row; W: Mondays; M, Q: the first row of a new month or quarter; a
    number N: rows N or more days after the row before, or after the last rebalance (``since="rebalance"``).
    The first row of each key always rebalances. ``freq`` may be a column holding these codes.
    """
    if since == "rebalance":
        return _since_last(dates, int(freq), key, order)
    s = series(dates, key, order, lookback=1)
    f = (freq if isinstance(freq, Column) else F.lit(str(freq))).cast("string")
    prev = s.shared("prev", F.lag(order).over(s.ordered()))
    t = F.col(order)
    hit = (
        F.when(prev.isNull() | (f == "D"), True)
        .when(f == "W", F.weekday(t) == 0)
        .when(f == "M", F.month(t) != F.month(prev))
        .when(f == "Q", F.quarter(t) != F.quarter(prev))
        .otherwise(F.coalesce(F.date_diff(t.cast("date"), prev.cast("date")) >= f.try_cast("int"), F.lit(True)))
    )
    return s.add({"rebalance_day": hit})


def number_dates(df: DataFrame, order: str = "ts") -> DataFrame:
    """Distinct dates with their position ``i`` and their number ``n``."""
    d = df.select(order).distinct().withColumn("_one", F.lit(0))
    d = number_rows(d, ["_one"], order, "i")
    return attach_series(d, ["_one"], order, n=F.count(F.lit(1))).drop("_one")


def walk_forward_windows(dates: DataFrame, window: int = 252, step: int = 63, roles: Sequence[str] = ("train", "test"), order: str = "ts") -> DataFrame:
    """Rows ``ts, window_id, role``. Window k trains on [k*step, k*step + window) and is tested on the ``step``
    dates after; a date is tested in exactly one window, whose number follows from its position.
    """
    d = number_dates(dates, order)
    last = F.floor((F.col("n") - window - 1) / step)
    test = d.filter(F.col("i") >= window).select(order, F.floor((F.col("i") - window) / step).cast("int").alias("window_id"), F.lit("test").alias("role"))
    if "train" not in roles:
        return test
    lo = F.greatest(F.ceil((F.col("i") - window + 1) / step), F.lit(0))
    hi = F.least(F.floor(F.col("i") / step), last)
    ids = F.when(lo <= hi, F.sequence(lo, hi))
    train = d.withColumn("_k", F.explode(ids)).select(order, F.col("_k").cast("int").alias("window_id"), F.lit("train").alias("role"))
    return train.unionByName(test) if "test" in roles else train


# ---------------------------------------------------------------------------------------------------------
# Positions


def hold_between_rebalances(weights: DataFrame, key: Sequence[str] = (*RUN, "asset"), order: str = "ts", weight: str = "weight", flag: str = "rebalance_day") -> DataFrame:
    """Keep the weight of the last rebalance day; 0 before the first."""
    d = running(weights, key, {"_held": ("last", F.when(F.col(flag), F.col(weight)))}, order)
    return d.withColumn(weight, F.coalesce("_held", F.lit(0.0))).drop("_held")


def no_trade_zone(weights: DataFrame, threshold: float = BAND, key: Sequence[str] = (*RUN, "asset"), order: str = "ts", weight="weight", flag="rebalance_day") -> DataFrame:
    """Hold between rebalances, and also when the new weight is within ``threshold`` of the held one."""
    d = hold_with_band(weights.withColumnRenamed(weight, "_target"), key, "_target", flag, threshold, order, weight)
    return d.drop("_target")


def turnover(positions: DataFrame, key: Sequence[str] = (*RUN, "asset"), order: str = "ts") -> DataFrame:
    """Adds ``trade``, the change of weight; the first row counts in full."""
    s = series(positions, key, order, lookback=1)
    return s.add({"trade": F.col("weight") - F.coalesce(s.shared("prev", F.lag("weight").over(s.ordered())), F.lit(0.0))})


def exposure(positions: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Mean gross weight and mean number of active assets per date."""
    d = positions.groupBy(*key, order).agg(F.sum(F.abs("weight")).alias("_g"), F.count_if(F.col("weight") != 0).alias("_a"))
    return d.groupBy(*key).agg(F.avg("_g").alias("mean_exposure"), F.avg("_a").alias("mean_active"))


# ---------------------------------------------------------------------------------------------------------
# Ledger


def daily_ledger(trades: DataFrame, order: str = "ts") -> DataFrame:
    """One row per run and date: return, turnover, trade count, cost rate and fixed cost.

    Nothing is charged on the first date of a run. Expects ``weight, ret, trade`` and the settings.
    """
    moved = F.abs("trade")
    d = trades.groupBy(*RUN, order).agg(
        F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"), F.sum(moved).alias("turnover"),
        F.count_if(moved > F.col("min_trade")).alias("trades"), F.sum(F.abs("weight")).alias("gross"),
        *[F.first(c).alias(c) for c in ("cost", "slippage", "fixed_cost", "cash", "stop_loss", "take_profit", "max_drawdown")],
    )
    d = attach_series(d, RUN, order, _first=F.min(order))
    charged = F.col(order) > F.col("_first")
    return d.withColumns(
        {
            "cost_rate": F.when(charged, F.col("turnover") * (F.col("cost") + F.col("slippage"))).otherwise(0.0),
            "fixed": F.when(charged, F.col("trades") * F.col("fixed_cost")).otherwise(0.0),
            "trades": F.when(charged, F.col("trades")).otherwise(0),
        }
    ).drop("_first", "cost", "slippage", "fixed_cost")


def transaction_cost(ledger: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Cost in money per row: rate times the value before the row's return, plus the fixed part."""
    s = series(ledger, key, order, lookback=1)
    before = F.coalesce(s.shared("prev", F.lag("equity").over(s.ordered())), F.col("cash"))
    return s.add({"cost": before * F.col("cost_rate") + F.col("fixed")})


def equity_curve(ledger: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Adds ``equity`` with V_t = (V_{t-1} (1 - c_t) - f_t)(1 + r_t) from ``cash``.

    With P the running product of the factors, V = P (cash + sum of -f (1+r) / P): two running totals. A
    factor of zero (everything lost) starts the recurrence anew from 0.
    """
    a = (1 - F.col("cost_rate")) * (1 + F.col("ret"))
    d = ledger.withColumns({"_a": a, "_b": -F.col("fixed") * (1 + F.col("ret"))})
    d = running(d, key, {"_z": ("sum", (F.col("_a") == 0).cast("int"))}, order)
    d = running(d, [*key, "_z"], {"_p": ("product", F.when(F.col("_a") == 0, 1.0).otherwise(F.col("_a")))}, order)
    d = running(d, [*key, "_z"], {"_q": ("sum", F.col("_b") / F.col("_p"))}, order)
    base = F.when(F.col("_z") == 0, F.col("cash")).otherwise(0.0)
    return d.withColumn("equity", F.col("_p") * (base + F.col("_q"))).drop("_a", "_b", "_z", "_p", "_q")


def with_drawdown(ledger: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Adds ``peak`` (not below the initial cash) and ``drawdown``."""
    d = running(ledger, key, {"_top": ("max", "equity")}, order)
    d = d.withColumn("peak", F.greatest("_top", "cash")).drop("_top")
    return d.withColumn("drawdown", F.coalesce(F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")), F.lit(0.0)))


def loss_rules(ledger: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Adds ``consecutive_losses`` (4 of the last 5 changes of equity below -1 %) and ``extreme_daily_loss``
    (the last below -5 %), both from the tenth row on."""
    s = series(ledger, key, order, lookback=9)
    prev = s.shared("prev", F.lag("equity").over(s.ordered()))
    d = s.add({"_chg": F.try_divide(F.col("equity"), prev) - 1})
    s = series(d, key, order, lookback=9)
    rows = s.shared("rows", F.count(F.lit(1)).over(s.rows(10))) >= 10
    bad = s.shared("bad", F.count_if(F.col("_chg") < -0.01).over(s.rows(5))) >= 4
    d = s.add({"consecutive_losses": rows & bad, "extreme_daily_loss": rows & F.coalesce(F.col("_chg") < -0.05, F.lit(False))})
    return d.drop("_chg")


#: A user's stop rule: consecutive rows of one run and the state left by the rows before (None at first) give one flag per
#: row, a reason (one for all, or one per row) and the state for the rows that follow.
StopFunction = Callable[[pd.DataFrame, Any], tuple[Sequence[bool], "str | Sequence[str]", Any]]


def stop_function(ledger: DataFrame, fn: StopFunction, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """First date at which a user's function stops a run: ``key, stop_ts, stop_reason, stop_equity``.

    The rows of a run stream through one task in order, a batch at a time, so that the function may use what no window
    expresses; runs are worked on in parallel. It is not called again for a run that has stopped. Where a batch ends
    is up to Spark: what the function remembers belongs in its state. An error in it fails the job, rather than leaving a
    run without its stop. A run without a stop, and an empty ledger, give no row.
    """
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, stopped = None, None, False
        for pdf in batches:
            hits = []
            for k, rows in pdf.groupby(key, sort=False, dropna=False):
                if k != last:
                    last, state, stopped = k, None, False
                if stopped:
                    continue
                flags, reason, state = fn(rows.reset_index(drop=True), state)
                flags = np.asarray(flags, dtype=bool)
                if flags.any():
                    i, stopped = int(flags.argmax()), True
                    hits.append((*k, rows[order].iloc[i], reason if isinstance(reason, str) else reason[i], rows["equity"].iloc[i]))
            yield pd.DataFrame(hits, columns=[*key, "stop_ts", "stop_reason", "stop_equity"])

    kinds = {f.name: f.dataType.simpleString() for f in ledger.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", stop_ts {kinds[order]}, stop_reason string, stop_equity double"
    return sorted_batches(ledger, key, [order], run, schema)


def stop_rules(
    ledger: DataFrame, custom: Column | StopFunction | None = None, custom_reason: str = "custom", key: Sequence[str] = RUN, order: str = "ts"
) -> DataFrame:
    """First date and reason per run at which a stop fires, in the order stop-loss, take-profit, maximum
    drawdown, custom. ``custom`` is a predicate over the ledger's columns, or a function (see ``stop_function``) that
    gives its own reasons. Runs without a stop have no row.
    """
    dd, total = F.col("drawdown"), F.col("equity") / F.col("cash") - 1
    reason = (
        F.when(dd <= -F.col("stop_loss"), F.format_string("stop_loss_triggered_%.1f%%", F.col("stop_loss") * 100))
        .when(total >= F.col("take_profit"), F.format_string("take_profit_triggered_%.1f%%", F.col("take_profit") * 100))
        .when(dd <= -F.col("max_drawdown"), F.format_string("max_drawdown_triggered_%.1f%%", F.col("max_drawdown") * 100))
    )
    if isinstance(custom, Column):
        reason = reason.when(custom, F.lit(f"custom_risk_management_{custom_reason}"))
    d = ledger.withColumn("stop_reason", reason).filter(F.col("stop_reason").isNotNull())
    stops = d.groupBy(*key).agg(F.min(order).alias("stop_ts"), F.min_by("stop_reason", order).alias("stop_reason"), F.min_by("equity", order).alias("stop_equity"))
    if custom is None or isinstance(custom, Column):
        return stops
    own = stop_function(ledger, custom, key, order).withColumn("stop_reason", F.concat(F.lit("custom_risk_management_"), "stop_reason"))
    both = stops.withColumn("_own", F.lit(0)).unionByName(own.withColumn("_own", F.lit(1)))
    first = F.min_by(F.struct("stop_ts", "stop_reason", "stop_equity"), F.struct("stop_ts", "_own"))
    return both.groupBy(*key).agg(first.alias("_s")).select(*key, "_s.*")


def truncate_after_stop(table: DataFrame, stops: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """After a stop: weights, returns, costs and trades 0, equity flat. Works on positions and on the ledger."""
    d = table.join(stops.select(*key, "stop_ts", "stop_equity"), list(key), "left")
    after = F.coalesce(F.col(order) > F.col("stop_ts"), F.lit(False))
    zero = {c: F.when(after, F.lit(0).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c in ("weight", "ret", "turnover", "trades", "gross", "cost_rate", "fixed") if c in table.columns}
    if "asset" in table.columns:
        zero.pop("ret", None)  # the asset's own return is no result
    if "equity" in table.columns:
        zero["equity"] = F.when(after, F.col("stop_equity")).otherwise(F.col("equity"))
    return d.withColumns(zero).drop("stop_ts", "stop_equity")


def trade_log(positions: DataFrame, ledger: DataFrame, stops: DataFrame, order: str = "ts") -> DataFrame:
    """One row per change of weight: ``strategy_id, window_id, asset, ts, change, weight, cost``.

    ``positions`` are those before stops, with the settings; a stop closes what is held on the date after it. ``cost`` is
    in money, as the ledger charged it: nothing on the first date of a run, nor for closing after a stop. The costs of a
    date add up to ``transaction_cost``.
    """
    d = turnover(truncate_after_stop(positions, stops, order=order), order=order).filter("trade <> 0")
    s = series(ledger.select(*RUN, order, "equity"), RUN, order, lookback=1)
    before = s.add({"_before": s.shared("prev", F.lag("equity").over(s.ordered()))}).drop("equity")
    d = d.join(before, [*RUN, order]).join(stops.select(*RUN, "stop_ts"), RUN, "left")
    charged = F.col("_before").isNotNull() & ~F.coalesce(F.col(order) > F.col("stop_ts"), F.lit(False))
    moved = F.abs("trade")
    cost = F.col("_before") * moved * (F.col("cost") + F.col("slippage")) + F.when(moved > F.col("min_trade"), F.col("fixed_cost")).otherwise(0.0)
    return d.select(*RUN, "asset", order, F.col("trade").alias("change"), "weight", F.when(charged, cost).otherwise(0.0).alias("cost"))


# ---------------------------------------------------------------------------------------------------------
# Metrics


def backtest_metrics(ledger: DataFrame, rf: float = 0.02, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, maximum drawdown, Calmar ratio, win rate.

    The total return starts from the equity after the first date. With ``key=["strategy_id"]`` the windows of a
    walk-forward run are taken as one curve.
    """
    d = running(ledger, key, {"_top": ("max", "equity")}, order)
    ok = F.when(~F.isnan("ret") & (F.abs("ret") != float("inf")), F.col("ret"))
    g = d.groupBy(*key).agg(
        (F.max_by("equity", order) / F.min_by("equity", order) - 1).alias("total_return"), F.count(ok).alias("total_periods"),
        F.coalesce(F.stddev_samp(ok) * ROOT_YEAR, F.lit(0.0)).alias("annualized_volatility"), F.count_if(ok > 0).alias("positive_periods"),
        F.min(F.try_divide(F.col("equity") - F.col("_top"), F.col("_top"))).alias("max_drawdown"),
    )
    g = g.withColumn("annualized_return", F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("total_periods")) - 1)
    return g.withColumns(
        {
            "sharpe_ratio": F.coalesce(F.try_divide(F.col("annualized_return") - rf, F.col("annualized_volatility")), F.lit(0.0)),
            "calmar_ratio": F.coalesce(F.try_divide(F.col("annualized_return"), F.abs("max_drawdown")), F.lit(0.0)),
            "win_rate": F.col("positive_periods") / F.col("total_periods"),
        }
    )


def equity_metrics(equity: DataFrame, rf: float = 0.02, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """The same from an equity curve alone, by its relative changes."""
    s = series(equity, key, order, lookback=1)
    d = s.add({"_chg": F.try_divide(F.col("equity"), s.shared("prev", F.lag("equity").over(s.ordered()))) - 1})
    d = running(d, key, {"_top": ("max", "equity")}, order)
    g = d.groupBy(*key).agg(
        (F.max_by("equity", order) / F.min_by("equity", order) - 1).alias("total_return"), F.count("_chg").alias("_n"),
        F.coalesce(F.stddev_samp("_chg") * ROOT_YEAR, F.lit(0.0)).alias("annualized_volatility"),
        F.min(F.try_divide(F.col("equity") - F.col("_top"), F.col("_top"))).alias("max_drawdown"),
    )
    g = g.withColumn("annualized_return", F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("_n")) - 1)
    sharpe = F.coalesce(F.try_divide(F.col("annualized_return") - rf, F.col("annualized_volatility")), F.lit(0.0))
    return g.withColumn("sharpe_ratio", sharpe).drop("_n")


def cost_metrics(ledger: DataFrame, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Total and mean cost, number of trades, turnover per date."""
    return transaction_cost(ledger, RUN, order).groupBy(*key).agg(
        F.sum("cost").alias("total_transaction_costs"), F.sum("trades").alias("total_trades"), F.avg("cost").alias("avg_transaction_cost"),
        (F.sum("turnover") / F.count(F.lit(1))).alias("turnover_ratio"),
    )


def confidence_metrics(calendar: DataFrame, confidence: DataFrame, threshold: float = 0.5, key: Sequence[str] = RUN, order: str = "ts") -> DataFrame:
    """Over rebalance days: mean confidence, and counts of low (below threshold) and high (above 0.8) ones."""
    c = confidence.groupBy(order).agg(F.avg("confidence").alias("_c"))
    d = calendar.filter("rebalance_day").join(c, order)
    low = F.col("_c") < threshold
    return d.groupBy(*key).agg(
        F.avg("_c").alias("avg_confidence"), F.count_if(low).alias("low_confidence_periods"), F.count_if(~low & (F.col("_c") > 0.8)).alias("high_confidence_periods")
    )


def confidence_map(regimes: DataFrame, mapping: dict[int, float] | None = None, k: int = 3, state: str = "state", default: float = 0.5) -> DataFrame:
    """Adds ``confidence`` per state: the mapping, clipped to [0, 1], or evenly from 0.9 down to 0.1."""
    if mapping is None:
        mapping = {0: 0.8} if k == 1 else {i: 0.9 - 0.8 * i / (k - 1) for i in range(k)}
    m = F.create_map(*[F.lit(x) for i, v in mapping.items() for x in (int(i), float(min(1.0, max(0.0, v))))])
    return regimes.withColumn("confidence", F.coalesce(F.try_element_at(m, F.col(state).cast("int")), F.lit(default)))


# ---------------------------------------------------------------------------------------------------------
# Composition


@dataclass
class BacktestTables:
    """Lazy result tables, one row per run and further key."""

    positions: DataFrame
    ledger: DataFrame
    stops: DataFrame
    metrics: DataFrame
    calendar: DataFrame
    trades: DataFrame


def run_backtest(
    returns: DataFrame,
    signals: DataFrame,
    strategies: Sequence[Strategy],
    windows: tuple[int, int] | None = None,
    confidence: DataFrame | None = None,
    lag: int = 0,
    band: float = BAND,
    sizing: Callable[[DataFrame], DataFrame] | None = None,
    stop: Column | StopFunction | None = None,
    stop_reason: str = "custom",
    materialize: bool = True,
    order: str = "ts",
    ret: str = "ret",
) -> BacktestTables:
    """Signals to positions, ledger, stops and metrics for all strategies (and walk-forward windows) at once.

    ``returns(asset, ts, ret)`` and ``signals([strategy_id,] asset, ts, signal)`` are aligned on common rows.
    A signal earns the return of its own row; ``lag=1`` makes it earn the next. ``windows=(window, step)`` restarts
    every ``step`` dates after the first ``window``. ``sizing`` replaces the built-in rules; ``stop`` is a predicate over
    the ledger, or a function along its rows (``stop_function``). The aligned signals feed several cross-section totals, and the positions feed the ledger and the
    result, so both are written to the checkpoint folder once (``materialize``).
    """
    if lag:
        key = [c for c in ("strategy_id", "asset") if c in signals.columns]
        s = series(signals, key, order, lookback=lag)
        signals = s.add({"signal": F.lag("signal", lag).over(s.ordered())})
    d = returns.select("asset", order, F.col(ret).alias("ret")).join(signals, ["asset", order])
    if materialize:
        d = checkpoint(d)
    w = size_weights(d, strategies, confidence, returns, order, ret)
    if sizing is not None:
        w = with_settings(sizing(w.drop(*SETTINGS, "weight")), strategies)
    w = apply_constraints(w, order)
    if windows is not None:
        test = walk_forward_windows(d, *windows, roles=("test",), order=order).select(order, "window_id")
        w = w.join(test, order)
    else:
        w = w.withColumn("window_id", F.lit(0))
    dates = w.groupBy(*RUN, order).agg(F.first("rebalance").alias("_freq"))
    cal = rebalance_calendar(dates, F.col("_freq"), RUN, order).drop("_freq")
    w = w.join(cal, [*RUN, order]).drop("signal", "rebalance", "sizing", "base_position", "confidence_threshold")
    p = no_trade_zone(w, band, order=order) if band > 0 else hold_between_rebalances(w, order=order)
    if materialize:
        p = checkpoint(p)
    ledger = with_drawdown(equity_curve(daily_ledger(turnover(p, order=order), order), order=order), order=order)
    if stop is not None:
        ledger = loss_rules(ledger, order=order)
    stops = stop_rules(ledger, stop, stop_reason, order=order)
    positions = truncate_after_stop(p, stops, order=order).select(*RUN, "asset", order, "weight")
    ledger = with_drawdown(truncate_after_stop(ledger.drop("peak", "drawdown"), stops, order=order), order=order)
    ledger = ledger.drop("stop_loss", "take_profit", "max_drawdown")
    metrics = backtest_metrics(ledger, order=order).join(cost_metrics(ledger, order=order), RUN)
    return BacktestTables(positions, ledger, stops, metrics, cal, trade_log(p, ledger, stops, order))


def chained_equity(ledger: DataFrame, order: str = "ts") -> DataFrame:
    """One equity curve per strategy across windows: compounded returns after costs, instead of restarts."""
    net = (1 - F.col("cost_rate")) * (1 + F.col("ret"))
    return running(ledger, ["strategy_id"], {"chained": ("product", net)}, order)


def compare_strategies(returns: DataFrame, lookback: int = 20, ret: str = "ret", order: str = "ts", formatted: bool = False) -> DataFrame:
    """Performance of the equal-weight portfolio and of the top half by momentum."""
    a = equal_weight_portfolio(returns, ret, order).withColumn("strategy", F.lit("Equal-weight long-only"))
    b = top_half_momentum(returns, lookback, ret, order).withColumn("strategy", F.lit(f"Naive momentum ({lookback}-day)"))
    return performance_table(a.unionByName(b), ["strategy"], ret, order, formatted)
