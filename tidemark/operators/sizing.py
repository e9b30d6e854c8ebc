"""Position sizing and constraints over ``strategy_id, asset, ts, signal`` rows.

Every rule is a raw score per row over the sum of its absolute values in the cross-section of one strategy and
date, so all strategies share one aggregate, whatever mix of rules they use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.plans.attach import attach
from tidemark.plans.folds import schema_of
from tidemark.plans.ranks import exact_quantiles
from tidemark.plans.series import number_rows, series

SIZINGS = ("proportional", "fixed", "regime_confidence", "softmax", "quadratic", "risk_budget", "risk_parity", "raw")
BROADCAST_STRATEGIES = 10_000


@dataclass(frozen=True)
class Strategy:
    """Settings of one strategy. Limits given with the wrong sign are taken by size, shares are kept in [0, 1]."""

    strategy_id: str
    sizing: str = "proportional"
    rebalance: str = "W"
    leverage: float = 1.0
    max_position: float = 1.0
    base_position: float = 1.0
    allow_short: bool = True
    cost: float = 0.001
    slippage: float = 0.0005
    fixed_cost: float = 0.0
    min_trade: float = 1e-6
    cash: float = 1.0
    stop_loss: float | None = None
    take_profit: float | None = None
    max_drawdown: float | None = None
    confidence_threshold: float = 0.5

    def __post_init__(self):
        if self.sizing not in SIZINGS:
            raise ValueError(f"unknown sizing {self.sizing!r}")
        for f in ("leverage", "base_position", "cost", "slippage", "fixed_cost", "min_trade"):
            object.__setattr__(self, f, max(0.0, float(getattr(self, f))))
        for f in ("max_position", "confidence_threshold"):
            object.__setattr__(self, f, min(1.0, max(0.0, float(getattr(self, f)))))
        for f in ("stop_loss", "take_profit", "max_drawdown"):
            v = getattr(self, f)
            object.__setattr__(self, f, None if v is None else abs(float(v)))


SCHEMA = (
    "strategy_id string, sizing string, rebalance string, leverage double, max_position double, base_position double, allow_short boolean, "
    "cost double, slippage double, fixed_cost double, min_trade double, cash double, stop_loss double, take_profit double, max_drawdown double, "
    "confidence_threshold double"
)
SETTINGS = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] != "strategy_id"]


def strategies_frame(spark: SparkSession, strategies: Sequence[Strategy]) -> DataFrame:
    names = ["strategy_id", *SETTINGS]
    return spark.createDataFrame([tuple(asdict(s)[n] for n in names) for s in strategies], SCHEMA)


def with_settings(df: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """Join the settings by strategy; the list is declared by the caller, and broadcast while it is short."""
    p = strategies_frame(df.sparkSession, strategies)
    return df.join(F.broadcast(p) if len(strategies) <= BROADCAST_STRATEGIES else p, "strategy_id")


def for_strategies(signals: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """One copy of the signals per strategy, unless the signals name their strategy already."""
    if "strategy_id" in signals.columns:
        return signals
    return signals.withColumn("strategy_id", F.explode(F.array(*[F.lit(s.strategy_id) for s in strategies])))


def with_confidence(df: DataFrame, confidence: DataFrame | None, default: float, out: str = "_conf", order: str = "ts") -> DataFrame:
    """Confidence of the row: its own; 0.5 on a date that has others; the asset's mean on other dates; else 0.5."""
    if confidence is None:
        return df.withColumn(out, F.lit(default))
    c = confidence.select("asset", order, F.col("confidence").alias("_c"))
    dates = c.select(order).distinct().withColumn("_has", F.lit(True))
    means = c.groupBy("asset").agg(F.avg("_c").alias("_mean"))
    d = df.join(c, ["asset", order], "left").join(dates, order, "left").join(means, "asset", "left")
    if default == 1.0:  # the volatility budget uses full confidence wherever a value is missing
        return d.withColumn(out, F.coalesce("_c", F.lit(1.0))).drop("_c", "_has", "_mean")
    return d.withColumn(out, F.coalesce("_c", F.when(F.col("_has"), 0.5), "_mean", F.lit(0.5))).drop("_c", "_has", "_mean")


def trailing_vol(returns: DataFrame, n: int = 21, ret: str = "ret", order: str = "ts") -> DataFrame:
    """Deviation of the last n rows with and without the current one, and the row's position: ``_vol, _past, _i``.

    A past deviation of zero is replaced by the median over the assets of the date.
    """
    d = number_rows(returns.select("asset", order, ret), ["asset"], order, "_i")
    s = series(d, ["asset"], order, lookback=n)
    past = s.span(-n, -1)
    p = F.when(s.shared("cnt", F.count(ret).over(past)) == n, s.shared("past", F.stddev_samp(ret).over(past)))
    d = s.add({"_vol": R.std(s, ret, n), "_past": p})
    flat = d.filter("_past = 0").select(order).distinct()
    med = exact_quantiles(d.join(flat, order, "left_semi"), "_past", [0.5], [order]).select(order, F.col("_q")[0].alias("_med"))
    d = d.join(med, order, "left")
    return d.select("asset", order, "_i", "_vol", F.when(F.col("_past") == 0, F.col("_med")).otherwise(F.col("_past")).alias("_past"))


def size_weights(
    signals: DataFrame, strategies: Sequence[Strategy], confidence: DataFrame | None = None, returns: DataFrame | None = None, order: str = "ts", ret: str = "ret"
) -> DataFrame:
    """Unconstrained weights per strategy by its sizing rule; keeps the settings next to each row."""
    used = {s.sizing for s in strategies}
    d = with_settings(for_strategies(signals, strategies), strategies).withColumn("_s", F.coalesce("signal", F.lit(0.0)))
    s, kind = F.col("_s"), F.col("sizing")
    if used & {"risk_budget", "risk_parity"}:
        if returns is None:
            raise ValueError("risk_budget and risk_parity need returns")
        d = d.join(trailing_vol(returns, 21, ret, order), ["asset", order], "left")
    else:
        d = d.withColumns({"_vol": F.lit(1.0), "_past": F.lit(1.0), "_i": F.lit(0)})
    d = with_confidence(d, confidence, 0.5) if "regime_confidence" in used else d.withColumn("_conf", F.lit(0.5))
    d = with_confidence(d, confidence, 1.0, "_full") if "risk_budget" in used else d.withColumn("_full", F.lit(1.0))
    grp = ["strategy_id", order]
    d = attach(d, grp, _top=F.max(F.abs("_s"))) if "softmax" in used else d.withColumn("_top", F.lit(0.0))
    vol = F.when(F.col("_vol") == 0, 1.0).otherwise(F.col("_vol"))
    raw = (
        F.when(kind == "fixed", F.signum(s))
        .when(kind == "softmax", F.exp(F.abs(s) - F.col("_top")) * F.signum(s))
        .when(kind == "quadratic", s * s * F.signum(s))
        .when(kind == "risk_budget", s * F.col("_full") / (vol + 1e-4))
        .when(kind == "risk_parity", F.try_divide(F.lit(1.0), F.col("_past")))
        .otherwise(s)
    )
    d = attach(d.withColumn("_raw", raw), grp, _total=F.sum(F.abs("_raw")))
    share = F.coalesce(F.try_divide(F.col("_raw"), F.col("_total")), F.lit(0.0))
    lev = F.col("leverage")
    conf = F.least(F.greatest(F.col("_conf"), F.lit(0.2)), F.lit(1.0)) * F.col("base_position")
    weight = (
        F.when(kind == "raw", s * lev)
        .when(kind == "risk_parity", F.when((F.col("_i") < 21) | F.col("_past").isNull(), s * 0.1).otherwise(share * F.signum(s)))
        .when((kind == "regime_confidence") & F.lit(confidence is not None), share * conf * lev)
        .otherwise(share * lev)
    )
    return d.withColumn("weight", weight).drop("_s", "_vol", "_past", "_i", "_conf", "_full", "_top", "_raw", "_total")


def custom_weights(signals: DataFrame, fn: Callable[[DataFrame], DataFrame] | Callable[[], Column]) -> DataFrame:
    """Weights from a user function over the rows: a frame-to-frame function, or one that returns a column."""
    out = fn(signals) if fn.__code__.co_argcount else signals.withColumn("weight", fn())
    missing = {"strategy_id", "asset", "ts", "weight"} - set(out.columns)
    if missing:
        raise ValueError(f"custom sizing lacks columns {sorted(missing)}")
    return out


def custom_weights_by_date(signals: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], order: str = "ts") -> DataFrame:
    """Weights from a pandas function that sees one strategy and date; proportional sizing where it fails, marked by ``fallback``.

    The cross-section of one date must fit one task; ``custom_weights`` has no such limit.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        failed = False
        try:
            w = pd.Series(fn(pdf), index=pdf.index, dtype=float)
        except Exception:  # any failure of the user function falls back
            failed = True
            s = pdf["signal"].fillna(0.0)
            total = s.abs().sum()
            w = s / total if total > 0 else s * 0.0
        return pdf.assign(weight=w.to_numpy(), fallback=failed)

    return signals.groupBy("strategy_id", order).applyInPandas(run, schema_of(signals, weight="double", fallback="boolean"))


def apply_constraints(weights: DataFrame, order: str = "ts") -> DataFrame:
    """NULL to 0, no shorts where not allowed, each weight within the maximum, the sum within the leverage.

    Expects the settings next to the rows (as ``size_weights`` leaves them).
    """
    w = F.coalesce("weight", F.lit(0.0))
    w = F.when(~F.col("allow_short"), F.greatest(w, F.lit(0.0))).otherwise(w)
    w = F.least(F.greatest(w, -F.col("max_position")), F.col("max_position"))
    d = attach(weights.withColumn("weight", w), ["strategy_id", order], _gross=F.sum(F.abs("weight")))
    over = F.col("_gross") > F.col("leverage")
    return d.withColumn("weight", F.when(over, F.col("weight") * F.col("leverage") / F.when(over, F.col("_gross"))).otherwise(F.col("weight"))).drop("_gross")
