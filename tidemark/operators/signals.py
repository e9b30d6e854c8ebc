"""Trading signals: components, blending by regime, ridge blending, overlay, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cross import forward_return
from tidemark.operators.features import price_bollinger, rolling_mean, rolling_std, vol_breakout_z
from tidemark.operators.risk import moment_matrices, normal_equations
from tidemark.plans.attach import attach_series
from tidemark.plans.series import running
from tidemark.session import checkpoint

COMPONENTS = ("momentum", "meanrev", "macro", "vol_breakout", "cross")

# Weight of each component per regime label; any other label uses "Default".
REGIME_WEIGHTS = {
    "High Vol": {"momentum": 0.35, "meanrev": 0.1, "macro": 0.1, "vol_breakout": 0.35, "cross": 0.1},
    "Medium Vol": {"momentum": 0.45, "meanrev": 0.15, "macro": 0.2, "vol_breakout": 0.1, "cross": 0.1},
    "Low Vol": {"momentum": 0.35, "meanrev": 0.15, "macro": 0.3, "vol_breakout": 0.1, "cross": 0.1},
    "Default": {"momentum": 0.3, "meanrev": 0.2, "macro": 0.2, "vol_breakout": 0.2, "cross": 0.1},
}
REQUIRED = ("momentum_20d", "realized_volatility", "bollinger_position")


def _input(f: DataFrame, name: str, default: float) -> Column:
    return F.col(name) if name in f.columns else F.lit(default)


def feature_check(features: DataFrame, price: str = "price", col: str = "returns", order: str = "ts") -> DataFrame:
    """Derive the required features that are missing, or raise; text columns are rejected as inputs later on."""
    d, key = features, ["asset"]
    if "momentum_20d" not in d.columns and col in d.columns:
        d = rolling_mean(d, col, 20, key, "momentum_20d", order)
    if "realized_volatility" not in d.columns and col in d.columns:
        d = rolling_std(d, col, 20, key, "realized_volatility", order)
    if "bollinger_position" not in d.columns and price in d.columns:
        d = price_bollinger(d, 20, price, out="bollinger_position", order=order)
    missing = [c for c in REQUIRED if c not in d.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return d


def non_numeric(features: DataFrame, index: Sequence[str] = ("asset", "ts")) -> list[str]:
    """Feature columns that are not numbers."""
    ok = ("double", "float", "integer", "long", "short", "byte", "decimal")
    return [f.name for f in features.schema if f.name not in index and not f.dataType.typeName().startswith(ok)]


def misaligned(returns: DataFrame, features: DataFrame, order: str = "ts") -> DataFrame:
    """Rows per asset that only one of the two frames has."""
    on = ["asset", order]
    a = returns.join(features, on, "left_anti").groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("returns"))
    b = features.join(returns, on, "left_anti").groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("features"))
    return a.unionByName(b)


# ---------------------------------------------------------------------------------------------------------
# Components


def _z(f: DataFrame, names: Sequence[str], order: str) -> tuple[DataFrame, dict[str, Column]]:
    have = [n for n in names if n in f.columns]
    aggs = {f"_m_{n}": F.avg(n) for n in have} | {f"_s_{n}": F.stddev_samp(n) for n in have}
    d = attach_series(f, ["asset"], order, **aggs) if have else f
    return d, {n: (F.col(n) - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + 1e-6) if n in have else F.lit(0.0) for n in names}


def momentum_signal(f: DataFrame, out="momentum", order="ts", zscore=True, tanh=True) -> DataFrame:
    """0.6 tanh(z of 20-day momentum) + 0.4 tanh(z of the MACD signal line)."""
    d, z = _z(f, ["momentum_20d", "macd_signal"], order)
    if not zscore:
        z = {n: _input(f, n, 0.0) for n in z}
    g = F.tanh if tanh else (lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    d = d.withColumn(out, 0.6 * g(z["momentum_20d"]) + 0.4 * g(z["macd_signal"]))
    return d.drop(*[f"_{p}_{n}" for n in z for p in "ms"])


def meanrev_signal(f: DataFrame, out="meanrev") -> DataFrame:
    """Against the relative strength, with Williams %R."""
    rsi, will = _input(f, "rsi_14", 50.0), _input(f, "williams_r", 0.0)
    return f.withColumn(out, -0.5 * F.tanh((rsi / 100 - 0.5) * 2) + 0.5 * F.tanh(will / 100))


def macro_signal(f: DataFrame, out="macro") -> DataFrame:
    slope, vix, pmi = _input(f, "term_structure_slope", 0.0), _input(f, "vix_percentile", 0.0), _input(f, "semiconductor_pmi", 50.0)
    return f.withColumn(out, 0.4 * F.tanh(slope) + 0.3 * (vix - 0.5) + 0.3 * (pmi / 100 - 0.5))


def vol_breakout_signal(f: DataFrame, out="vol_breakout", order="ts") -> DataFrame:
    d = f if "realized_volatility" in f.columns else f.withColumn("realized_volatility", F.lit(0.0))
    d = vol_breakout_z(d, 20, 5, "realized_volatility", out="_vbz", order=order)
    d = d.withColumn(out, F.tanh("_vbz")).drop("_vbz")
    return d if "realized_volatility" in f.columns else d.drop("realized_volatility")


def cross_sectional_signal(f: DataFrame, out="cross") -> DataFrame:
    rank, spread = _input(f, "momentum_rank", 0.0), _input(f, "pair_spread", 0.0)
    return f.withColumn(out, 0.7 * (rank - 0.5) + 0.3 * F.tanh(spread))


def signal_components(f: DataFrame, order="ts", zscore=True, tanh=True) -> DataFrame:
    """All five components; the windows share one shuffle by asset."""
    d = vol_breakout_signal(momentum_signal(f, order=order, zscore=zscore, tanh=tanh), order=order)
    return cross_sectional_signal(macro_signal(meanrev_signal(d)))


# ---------------------------------------------------------------------------------------------------------
# Blending


def with_labels(df: DataFrame, regimes: DataFrame | None, order="ts") -> DataFrame:
    """Regime label per row; ``Default`` where there is none. Regimes are per asset, or market-wide without one."""
    if regimes is None:
        return df.withColumn("label", F.lit("Default"))
    on = ["asset", order] if "asset" in regimes.columns else [order]
    return df.join(regimes.select(*on, "label"), on, "left").withColumn("label", F.coalesce("label", F.lit("Default")))


def regime_blend(components: DataFrame, weights: Mapping[str, Mapping[str, float]] = REGIME_WEIGHTS, out="blend") -> DataFrame:
    """Weighted sum of the components with the weights of the row's label."""

    def weight(c: str) -> Column:
        w = None
        for label, row in weights.items():
            if label != "Default":
                w = (F if w is None else w).when(F.col("label") == label, row[c])
        return w.otherwise(weights["Default"][c]) if w is not None else F.lit(weights["Default"][c])

    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total + weight(c) * F.col(c)
    return components.withColumn(out, total)


def ridge_models(rows: DataFrame, target: str, xs: Sequence[str] = COMPONENTS, alphas: Sequence[float] | None = None, key=("asset", "label"), min_rows=20):
    """Ridge of the target on the components per (asset, label), penalty by leave-one-out error.

    One aggregate gives the normal equations of every group; their eigenvectors are taken batch-wise where
    the sums lie. In those coordinates prediction and leverage of a row are short sums for every penalty, so
    the leave-one-out errors of all penalties are one more plain aggregate, and no matrix travels with rows.
    Returns one row per group: ``_mx, _my, _vec (row-major), _s2, _c, alpha, coef``.
    """
    alphas = list(alphas if alphas is not None else np.logspace(-4, 1, 20))
    k, key_ = len(xs), list(key)
    eq = normal_equations(rows, key, list(xs), target).filter(F.col("_n") >= min_rows)
    kinds = {f.name: f.dataType.simpleString() for f in eq.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in key_] + ["_n long", "_mx array<double>", "_my double", "_vec array<double>", "_s2 array<double>", "_c array<double>"])

    def rotate(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n, sx, sy, xx, xy = moment_matrices(row, k)
                mx, my = sx / n, sy / n
                s2, vec = np.linalg.eigh(xx - n * np.outer(mx, mx))
                out.append([row[c] for c in key_] + [int(n), list(mx), my, list(vec.ravel()), list(np.maximum(s2, 0.0)), list(vec.T @ (xy - n * mx * my))])
            yield pd.DataFrame(out, columns=[*key_, "_n", "_mx", "_my", "_vec", "_s2", "_c"])

    groups = eq.mapInPandas(rotate, schema)
    ok = F.col(target).isNotNull()
    for x in xs:
        ok &= F.col(x).isNotNull()
    d = rows.filter(ok).join(groups, key_)
    d = d.withColumns({f"_u{j}": _rotated(xs, j, k) for j in range(k)})
    loo = []
    for i, a in enumerate(alphas):
        fit, lev = F.lit(0.0), 1 / F.col("_n")
        for j in range(k):
            w = F.col(f"_u{j}") / (F.col("_s2")[j] + a)
            fit, lev = fit + w * F.col("_c")[j], lev + w * F.col(f"_u{j}")
        err = F.try_divide(F.col(target) - F.col("_my") - fit, 1 - lev)
        loo.append(F.struct(F.avg(err * err).alias("mse"), F.lit(i).alias("i")))
    best = d.groupBy(*key_).agg(F.array_min(F.array(*loo))["i"].alias("_i"))
    m = groups.join(best, key_).withColumn("alpha", F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("_i"))).drop("_i")
    shrunk = [F.col("_c")[j] / (F.col("_s2")[j] + F.col("alpha")) for j in range(k)]
    coef = []
    for r in range(k):
        t = F.lit(0.0)
        for j in range(k):
            t = t + F.col("_vec")[r * k + j] * shrunk[j]
        coef.append(t)
    return m.withColumn("coef", F.array(*coef))


def _rotated(xs: Sequence[str], j: int, k: int) -> Column:
    t = F.lit(0.0)
    for r, x in enumerate(xs):
        t = t + (F.col(x) - F.col("_mx")[r]) * F.col("_vec")[r * k + j]
    return t


def ridge_meta_blend(rows: DataFrame, target: str, models: DataFrame | None = None, xs: Sequence[str] = COMPONENTS, key=("asset", "label"), out="meta", **fit) -> DataFrame:
    """In-sample ridge prediction per row; 0 for rows with NULLs and for groups below ``min_rows``."""
    m = models if models is not None else ridge_models(rows, target, xs, key=key, **fit)
    d = rows.join(m.select(*key, "_mx", "_my", "coef"), list(key), "left")
    pred = F.col("_my")
    ok = F.col(target).isNotNull()
    for r, x in enumerate(xs):
        pred = pred + (F.col(x) - F.col("_mx")[r]) * F.col("coef")[r]
        ok &= F.col(x).isNotNull()
    return d.withColumn(out, F.coalesce(F.when(ok, pred), F.lit(0.0))).drop("_mx", "_my", "coef")


def feature_importance(models: DataFrame, key: Sequence[str] = ("label",)) -> DataFrame:
    """Mean absolute ridge coefficient per label."""
    return models.select(*key, F.explode("coef").alias("_b")).groupBy(*key).agg(F.avg(F.abs("_b")).alias("mean_abs_coef"))


def risk_overlay(df: DataFrame, col="signal", ret="returns", min_scale=0.3, mode="profit_peak", key=("asset", "label"), order="ts") -> DataFrame:
    """Scale signals by the drawdown of their own running profit within (asset, label).

    ``profit_peak``: drawdown relative to the peak of the summed profit, NULL at a peak of 0; it only bites
    while the peak is negative. ``corrected``: relative to one plus the peak.
    """
    d = running(df, key, {"_eq": ("sum", F.col(col) * F.col(ret))}, order)
    d = running(d, key, {"_peak": ("max", "_eq")}, order)
    peak = F.col("_peak")
    base = F.when(peak != 0, peak) + 1e-6 if mode == "profit_peak" else 1 + peak
    scale = 1 - F.try_divide(F.col("_eq") - peak, base)
    scale = F.when(scale.isNotNull(), F.least(F.greatest(scale, F.lit(min_scale)), F.lit(1.0)))
    return d.withColumn(col, F.col(col) * scale).drop("_eq", "_peak")


def generate_signals(
    features: DataFrame,
    returns: DataFrame,
    regimes: DataFrame | None = None,
    *,
    meta: bool = True,
    overlay: bool = True,
    overlay_mode: str = "profit_peak",
    use_regimes: bool = True,
    zscore: bool = True,
    tanh: bool = True,
    vol_normalise: bool = False,
    threshold: float = 0.0,
    order: str = "ts",
    ret: str = "ret",
    materialize: bool = True,
) -> DataFrame:
    """Components, regime blend, ridge blend and overlay: ``asset, ts, signal`` without NULLs.

    With ``meta`` the signal is half blend, half ridge prediction. The components are read four times then,
    so they are written to the checkpoint folder first (``materialize``). The remaining switches turn single
    steps on or off.
    """
    bad = non_numeric(features)
    if bad:
        raise ValueError(f"features are not numbers: {bad}")
    d = signal_components(feature_check(features, order=order), order, zscore, tanh)
    nxt = forward_return(returns.select("asset", order, ret), 1, ret, order=order, out="_next").drop(ret)
    now = d if "returns" in d.columns else d.join(returns.select("asset", order, F.col(ret).alias("returns")), ["asset", order], "left")
    keep = ["asset", order, "returns", "realized_volatility", *COMPONENTS]
    d = with_labels(now.select(*keep), regimes if use_regimes else None, order)
    if meta:
        d = d.join(nxt, ["asset", order], "left")
        d = checkpoint(d) if materialize else d
        d = ridge_meta_blend(d, "_next")
        d = regime_blend(d).withColumn("signal", 0.5 * F.col("blend") + 0.5 * F.col("meta"))
    else:
        d = regime_blend(d).withColumn("signal", F.col("blend"))
    if overlay:
        d = risk_overlay(d, mode=overlay_mode, order=order)
    s = F.coalesce("signal", F.lit(0.0))
    if vol_normalise:
        s = F.coalesce(F.try_divide(s, F.col("realized_volatility")), F.lit(0.0))
    if threshold > 0:
        s = F.when(F.abs(s) > threshold, F.signum(s) * (F.abs(s) - threshold)).otherwise(0.0)  # soft threshold
    return d.select("asset", order, s.alias("signal"))


# ---------------------------------------------------------------------------------------------------------
# Diagnostics


def signal_correlations(signals: DataFrame, returns: DataFrame, key: Sequence[str] = (), order="ts", ret="ret") -> DataFrame:
    """Correlation of the signal with the next return, per asset (and further keys)."""
    nxt = forward_return(returns.select("asset", order, ret), 1, ret, order=order, out="_next")
    d = signals.join(nxt.select("asset", order, "_next"), ["asset", order])
    return d.groupBy("asset", *key).agg(
        F.corr("signal", "_next").alias("forward_corr"), F.avg("signal").alias("signal_mean"), F.stddev_samp("signal").alias("signal_std"),
        F.min("signal").alias("_lo"), F.max("signal").alias("_hi"), F.count_if(F.col("signal") != 0).alias("_nz"), F.count(F.lit(1)).alias("_n"),
    )


def diagnose_signals(signals: DataFrame, returns: DataFrame, regimes: DataFrame | None = None, order="ts", ret="ret") -> DataFrame:
    """One row (per label when regimes are given): means over assets of mean, deviation and forward correlation,
    range, non-zero and total counts, and the red flags."""
    key = []
    if regimes is not None:
        key = ["label"]
        signals = with_labels(signals, regimes, order)
    a = signal_correlations(signals, returns, key, order, ret)
    corr = F.when(~F.isnan("forward_corr"), F.col("forward_corr"))
    g = a.groupBy(*key).agg(
        F.avg("signal_mean").alias("mean"), F.avg("signal_std").alias("std"), F.min("_lo").alias("min"), F.max("_hi").alias("max"),
        F.sum("_nz").alias("non_zero_count"), F.sum("_n").alias("total_count"),
        F.coalesce(F.avg(corr), F.lit(0.0)).alias("corr_mean"), F.coalesce(F.stddev_pop(corr), F.lit(0.0)).alias("corr_std"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.abs("corr_mean") < 0.01, "weak forward correlation"),
            F.when(F.col("non_zero_count") < 0.5 * F.col("total_count"), "mostly zero signals"),
            F.when(F.col("std") < 0.1, "low signal variation"),
        )
    )
    return g.withColumn("red_flags", flags)


def adjust_by_forecast(signals: DataFrame, vol: str | Column, base_threshold=1.0, penalize=True, col="signal") -> DataFrame:
    """Divide signals by the forecast volatility, or zero those not above ``base_threshold`` times it."""
    v = F.col(vol) if isinstance(vol, str) else vol
    s = F.col(col)
    return signals.withColumn(col, s / (v + 1e-8) if penalize else F.when(F.abs(s) > base_threshold * v, s).otherwise(0.0))
