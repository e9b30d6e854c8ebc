"""Rolling and recursive features of return series.

Single features take a frame and add one column. The feature sets put all frames of one series into one
projection, so that a whole set needs one shuffle by series, plus one by date for the cross-section.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators.prep import KEY, YEAR, fill_all, macro_join, sanitize, zscore
from tidemark.plans.attach import attach_series
from tidemark.plans.ranks import average_rank_share, rank_within
from tidemark.plans.series import SEQ, Series, number_rows, recurrence, running, series

ROOT_YEAR = YEAR**0.5


def _add(df: DataFrame, key: Sequence[str], order: str, lookback: int, chunk_rows: int | None, **exprs) -> DataFrame:
    """Add columns given as ``Series -> Column`` functions over one prepared frame."""
    s = series(df, key, order, lookback, chunk_rows=chunk_rows)
    return s.add({o: f(s) for o, f in exprs.items()})


def rolling_mean(df, col="ret", n=20, key=KEY, out="mean", order="ts", need=None, chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: R.mean(s, col, n, need)})


def rolling_std(df, col="ret", n=21, key=KEY, out="std", order="ts", need=None, chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: R.std(s, col, n, need)})


def rolling_skew(df, col="ret", n=21, key=KEY, out="skew", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: R.skew(s, col, n)})


def rolling_kurt(df, col="ret", n=21, key=KEY, out="kurt", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: R.kurt(s, col, n)})


def rolling_minmax(df, col="ret", n=14, key=KEY, out=("low", "high"), order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out[0]: lambda s: R.low(s, col, n), out[1]: lambda s: R.high(s, col, n)})


def index_returns(df: DataFrame, index_asset: str, col: str = "ret", order: str = "ts", out: str = "_index") -> DataFrame:
    """Returns of one asset next to every row of the same date."""
    idx = df.filter(F.col("asset") == index_asset).select(order, F.col(col).alias(out))
    return df.join(idx, order, "left")


def rolling_beta(df, index_asset, n=20, eps=1e-6, col="ret", key=KEY, out="beta", order="ts", chunk_rows=None) -> DataFrame:
    """Rolling covariance with an index asset over the index variance."""
    d = index_returns(df, index_asset, col, order)
    d = _add(d, key, order, n - 1, chunk_rows, **{out: lambda s: R.cov(s, col, "_index", n) / (R.var(s, "_index", n) + eps)})
    return d.drop("_index")


# ---------------------------------------------------------------------------------------------------------
# Exponentially weighted


def ewm(df: DataFrame, specs: Mapping[str, tuple[str, str, float]], key: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Several exponentially weighted columns at once: ``{out: (kind, column, span)}``.

    ``mean`` weighs (1-a)**age normalised by the weights present, ``std`` is its bias-corrected deviation,
    both with a = 2/(span+1); ``wilder`` is the recursive form y0 = x0 with a = 1/span. All share the block
    windows of one recurrence.
    """
    plain = {o: F.col(c) if kind != "std" else F.lit(None).cast("double") for o, (kind, c, n) in specs.items() if n == 1}
    specs = {o: s for o, s in specs.items() if o not in plain}
    if plain:
        df = df.withColumns(plain)
    if not specs:
        return df
    centred = {f"_mu_{o}": F.avg(c) for o, (kind, c, _) in specs.items() if kind == "std"}
    d = number_rows(df, key, order)
    d = attach_series(d, list(key), order, **centred) if centred else d
    items: dict[str, tuple[float, Column]] = {}
    for o, (kind, c, n) in specs.items():
        if kind == "std":  # deviations do not change, and squares do not cancel
            d = d.withColumn(f"_x_{o}", F.col(c) - F.col(f"_mu_{o}")).drop(f"_mu_{o}")
            c = f"_x_{o}"
        x, has = F.col(c), F.col(c).isNotNull().cast("double")
        if kind == "wilder":
            items[f"_n_{o}"] = (1 - 1 / n, F.when(F.col(SEQ) == 0, x).otherwise(x / n))
            continue
        a = 1 - 2 / (n + 1)
        items |= {f"_n_{o}": (a, x), f"_d_{o}": (a, has)}
        if kind == "std":
            items |= {f"_q_{o}": (a, x * x), f"_e_{o}": (a * a, has)}
    d = recurrence(d, key, items, order, seq=SEQ)
    out: dict[str, Column] = {}
    for o, (kind, _, _) in specs.items():
        m = F.try_divide(F.col(f"_n_{o}"), F.col(f"_d_{o}")) if kind != "wilder" else F.col(f"_n_{o}")
        if kind == "std":
            w, w2 = F.col(f"_d_{o}"), F.col(f"_e_{o}")
            spread = F.greatest(F.try_divide(F.col(f"_q_{o}"), w) - m * m, F.lit(0.0))
            left = w * w - w2
            m = F.sqrt(spread * w * w / F.when(left > 1e-12 * w * w, left))
        out[o] = m
    return d.withColumns(out).drop(SEQ, *items, *[f"_x_{o}" for o in specs])


def ewm_mean(df, span, col="ret", key=KEY, out="ewm_mean", order="ts") -> DataFrame:
    return ewm(df, {out: ("mean", col, span)}, key, order)


def ewm_std(df, span, col="ret", key=KEY, out="ewm_std", order="ts") -> DataFrame:
    return ewm(df, {out: ("std", col, span)}, key, order)


def ewm_wilder(df, n, col="ret", key=KEY, out="ewm_wilder", order="ts") -> DataFrame:
    return ewm(df, {out: ("wilder", col, n)}, key, order)


def macd(df, fast=12, slow=26, signal=9, col="ret", key=KEY, order="ts") -> DataFrame:
    """Adds ``macd`` (fast minus slow mean) and ``macd_signal`` (its own mean)."""
    d = ewm(df, {"_fast": ("mean", col, fast), "_slow": ("mean", col, slow)}, key, order)
    d = d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(d, {"macd_signal": ("mean", "macd", signal)}, key, order)


def _gain_loss(s: Series, col: str) -> tuple[Column, Column]:
    """Rise and fall against the row before; the first row counts as no move."""
    d = F.coalesce(R.change(s, col), F.lit(0.0))
    return F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))


def rsi_wilder(df, n=14, col="ret", key=KEY, out="rsi", order="ts", chunk_rows=None) -> DataFrame:
    """Relative strength with recursive smoothing: 50 without any move, 100 without a fall."""
    s = series(df, key, order, lookback=1, chunk_rows=chunk_rows)
    up, down = _gain_loss(s, col)
    d = s.add({"_up": up, "_down": down})
    d = ewm(d, {"_u": ("wilder", "_up", n), "_v": ("wilder", "_down", n)}, key, order)
    return d.withColumn(out, F.coalesce(F.try_divide(F.col("_u") * 100, F.col("_u") + F.col("_v")), F.lit(50.0))).drop(
        "_up", "_down", "_u", "_v"
    )


# ---------------------------------------------------------------------------------------------------------
# Indicators as expressions over a prepared series. ``moves`` columns hold rise and fall per row.


def with_moves(df: DataFrame, col: str = "ret", key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    s = series(df, key, order, lookback=1, chunk_rows=chunk_rows)
    up, down = _gain_loss(s, col)
    return s.add({"_up": up, "_down": down, "_prev": F.lag(col).over(s.ordered())})


def rsi_sma_expr(s: Series, n: int) -> Column:
    rs = R.mean(s, "_up", n) / (R.mean(s, "_down", n) + 1e-6)
    return F.coalesce(100 - 100 / (1 + rs), F.lit(50.0))


def bollinger_expr(s: Series, col: str, n: int = 20) -> Column:
    m, d = R.mean(s, col, n), R.std(s, col, n)
    return F.try_divide(F.col(col) - (m - 2 * d), 4 * d)


def williams_expr(s: Series, col: str, n: int = 14) -> Column:
    hi, lo = R.high(s, col, n), R.low(s, col, n)
    return F.try_divide(hi - F.col(col), hi - lo) * -100


def pmi_expr(s: Series, col: str, n: int = 20) -> Column:
    return F.try_divide(R.mean(s, col, n), R.std(s, col, n)) * 50 + 50


def std_ratio_expr(s: Series, col: str, short: int, long: int, eps: float = 0.0) -> Column:
    return F.try_divide(R.std(s, col, short), R.std(s, col, long) + eps)


def rsi_sma(df, n=14, col="ret", key=KEY, out="rsi", order="ts", chunk_rows=None) -> DataFrame:
    d = with_moves(df, col, key, order, chunk_rows)
    return _add(d, key, order, n - 1, chunk_rows, **{out: lambda s: rsi_sma_expr(s, n)}).drop("_up", "_down", "_prev")


def bollinger_position(df, n=20, col="ret", key=KEY, out="bollinger_position", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: bollinger_expr(s, col, n)})


def price_bollinger(df, n=20, col="close", eps=1e-6, key=KEY, out="bollinger_position", order="ts", chunk_rows=None) -> DataFrame:
    """Distance of the price from its rolling mean in rolling deviations."""
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: (F.col(col) - R.mean(s, col, n)) / (R.std(s, col, n) + eps)})


def williams_r(df, n=14, col="ret", key=KEY, out="williams_r", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: williams_expr(s, col, n)})


def obv(df, col="ret", key=KEY, out="on_balance_volume", order="ts", chunk_rows=None) -> DataFrame:
    """Running sum of |r| signed by the direction of the move."""
    d = with_moves(df, col, key, order, chunk_rows)
    step = F.signum(F.col("_up") - F.col("_down")) * F.abs(F.col(col))
    return running(d, key, {out: ("sum", step)}, order, chunk_rows=chunk_rows).drop("_up", "_down", "_prev")


def pmi_proxy(df, n=20, col="ret", key=KEY, out="pmi", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: pmi_expr(s, col, n)})


def short_long_spread(df, short=5, long=20, col="ret", key=KEY, out="spread", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, long - 1, chunk_rows, **{out: lambda s: R.mean(s, col, short) - R.mean(s, col, long)})


def vol_ratio(df, short=10, long=30, eps=1e-6, col="ret", key=KEY, out="vol_ratio", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, long - 1, chunk_rows, **{out: lambda s: std_ratio_expr(s, col, short, long, eps)})


def volume_ratio(df, col="ret", key=KEY, out="volume_ratio", order="ts", chunk_rows=None) -> DataFrame:
    """Deviation of 5 rows over that of 21 rows."""
    return vol_ratio(df, 5, 21, 0.0, col, key, out, order, chunk_rows)


def roc(df, n=5, col="ret", key=KEY, out="roc", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n, chunk_rows, **{out: lambda s: R.ratio_change(s, col, n)})


def volume_surge(df, n=20, col="volume", eps=1e-6, key=KEY, out="volume_surge", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: (F.col(col) - R.mean(s, col, n)) / (R.std(s, col, n) + eps)})


def vol_of_vol(df, n=15, m=20, col="ret", key=KEY, out="vol_of_vol", order="ts", chunk_rows=None) -> DataFrame:
    d = rolling_std(df, col, n, key, "_rv", order, chunk_rows=chunk_rows)
    return rolling_std(d, "_rv", m, key, out, order, chunk_rows=chunk_rows).drop("_rv")


def vol_breakout_z(df, n=20, min_periods=5, col="realized_volatility", eps=1e-6, key=KEY, out="vol_breakout", order="ts", chunk_rows=None):
    return _add(
        df, key, order, n - 1, chunk_rows,
        **{out: lambda s: (F.col(col) - R.mean(s, col, n, min_periods)) / (R.std(s, col, n, min_periods) + eps)},
    )


def rolling_vol_ann(df, n=21, col="ret", key=KEY, out="vol_ann", order="ts", chunk_rows=None) -> DataFrame:
    return _add(df, key, order, n - 1, chunk_rows, **{out: lambda s: R.std(s, col, n) * ROOT_YEAR})


def rolling_sharpe(df, n=63, col="ret", key=KEY, out="rolling_sharpe", order="ts", chunk_rows=None) -> DataFrame:
    return _add(
        df, key, order, n - 1, chunk_rows,
        **{out: lambda s: F.try_divide(R.mean(s, col, n) * YEAR, R.std(s, col, n) * ROOT_YEAR)},
    )


def cumulative_return(df, col="ret", key=KEY, order="ts", chunk_rows=None) -> DataFrame:
    """Adds ``cum`` (product of 1+r), ``peak`` (its running maximum) and ``cum_sum`` (sum of r)."""
    d = running(df, key, {"cum": ("product", 1 + F.col(col)), "cum_sum": ("sum", F.col(col))}, order, chunk_rows=chunk_rows)
    return running(d, key, {"peak": ("max", "cum")}, order, chunk_rows=chunk_rows)


# ---------------------------------------------------------------------------------------------------------
# Macro and pairs


def pair_spread(df: DataFrame, a: str, b: str, col: str = "ret", order: str = "ts", out: str = "pair_spread") -> DataFrame:
    """r_a - r_b per date, next to every row."""
    two = df.filter(F.col("asset").isin(a, b))
    per_date = two.groupBy(order).agg(
        (F.max(F.when(F.col("asset") == a, F.col(col))) - F.max(F.when(F.col("asset") == b, F.col(col)))).alias(out)
    )
    return df.join(per_date, order, "left")


def term_structure_slope(macro: DataFrame, long: str, short: str, order: str = "ts", out: str = "term_structure_slope") -> DataFrame:
    """Long minus short level per macro date."""
    v = F.col("value")
    return macro.groupBy(order).agg(
        (F.max(F.when(F.col("series") == long, v)) - F.max(F.when(F.col("series") == short, v))).alias(out)
    )


def curve_inversion(macro: DataFrame, long: str, short: str, order: str = "ts", out: str = "curve_inversion") -> DataFrame:
    """1.0 where the short level is below the long one. The name says the opposite; the rule is kept as it is known."""
    d = term_structure_slope(macro, long, short, order, "_slope")
    return d.select(order, F.when(F.col("_slope") > 0, 1.0).otherwise(0.0).alias(out))


def macro_change(macro: DataFrame, order: str = "ts", out: str = "change") -> DataFrame:
    s = series(macro, ["series"], order, lookback=1)
    return s.add({out: R.ratio_change(s, "value", 1)})


def pct_rank_full(df: DataFrame, col: str, key: Sequence[str] = ("series",), out: str = "pct_rank") -> DataFrame:
    """Average rank over the non-null count of the whole sample."""
    return rank_within(df, col, key).withColumn(out, average_rank_share()).drop("_ties", "_before", "_n")


def cross_sectional_rank_pct(df: DataFrame, col: str = "momentum_20d", order: str = "ts", out: str = "momentum_rank") -> DataFrame:
    """Average rank across assets of a date over the number of non-null assets."""
    return pct_rank_full(df, col, [order], out)


# ---------------------------------------------------------------------------------------------------------
# Feature sets

ENHANCED = (
    "returns", "log_returns", "volatility", "realized_volatility", "momentum", "momentum_5d", "roc_5d", "momentum_20d", "roc_20d",
    "momentum_60d", "roc_60d", "rsi_14", "rsi_30", "macd_signal", "bollinger_position", "williams_r", "volume_ratio",
    "volume_sma_ratio", "on_balance_volume", "yield_spread", "term_structure_slope", "dollar_strength",
)
SECTOR = ("semiconductor_pmi", "memory_vs_logic_spread", "equipment_vs_design_ratio")


def enhanced_features(
    returns: DataFrame,
    macro: DataFrame | None = None,
    sector: bool = True,
    col: str = "ret",
    key: Sequence[str] = KEY,
    order: str = "ts",
    macro_names: Mapping[str, str] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The wide feature set per series, NULL and infinite values as 0.

    ``macro_names`` maps ``long``, ``short`` and ``dollar`` to macro series. Without macro levels the slope is
    a 63-row mean and the dollar strength a 21-row deviation of the returns.
    """
    d = returns.select(*key, order, F.col(col).alias("returns"))
    d = ewm(
        d,
        {"_fast": ("mean", "returns", 12), "_slow": ("mean", "returns", 26), "volatility": ("std", "returns", 15)},
        key, order,
    )
    d = d.withColumn("_macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    d = ewm(d, {"macd_signal": ("mean", "_macd", 9)}, key, order).drop("_macd")
    d = with_moves(d, "returns", key, order, chunk_rows)
    step = F.signum(F.col("_up") - F.col("_down")) * F.abs("returns")
    d = running(d, key, {"on_balance_volume": ("sum", step)}, order, chunk_rows=chunk_rows)

    s = series(d, key, order, lookback=63, chunk_rows=chunk_rows)
    r = "returns"
    cols = {
        "log_returns": F.when(F.col(r) > -1, F.log1p(r)),
        "realized_volatility": R.std(s, r, 15),
        "momentum": R.mean(s, r, 15),
        "rsi_14": rsi_sma_expr(s, 14),
        "rsi_30": rsi_sma_expr(s, 30),
        "bollinger_position": bollinger_expr(s, r),
        "williams_r": williams_expr(s, r),
        "volume_ratio": std_ratio_expr(s, r, 5, 21),
        "volume_sma_ratio": std_ratio_expr(s, r, 5, 21),
        "skewness": R.skew(s, r, 15),
        "kurtosis": R.kurt(s, r, 15),
    }
    for n in (5, 20, 60):
        cols[f"momentum_{n}d"] = R.mean(s, r, n)
        cols[f"roc_{n}d"] = R.ratio_change(s, r, n)
    if sector:
        cols["semiconductor_pmi"] = pmi_expr(s, r)
        cols["memory_vs_logic_spread"] = R.mean(s, r, 5) - R.mean(s, r, 20)
        cols["equipment_vs_design_ratio"] = std_ratio_expr(s, r, 10, 30, 1e-6)
    if macro is None:
        cols["yield_spread"] = R.mean(s, r, 63)
        cols["dollar_strength"] = R.std(s, r, 21)
    d = s.add(cols)
    if macro is None:
        d = d.withColumn("term_structure_slope", F.col("yield_spread"))
    else:
        names = dict(macro_names or {})
        if "long" in names and "short" in names:
            d = d.join(term_structure_slope(macro, names["long"], names["short"], order), order, "left")
            d = d.withColumn("yield_spread", F.col("term_structure_slope"))
        if "dollar" in names:
            m = macro_change(macro.filter(F.col("series") == names["dollar"]), order, "dollar_strength")
            d = d.join(m.select(order, "dollar_strength"), order, "left")
    wanted = [c for c in (*ENHANCED, *(SECTOR if sector else ()), "skewness", "kurtosis") if c in d.columns]
    d = d.select(*key, order, *wanted)
    return sanitize(d, wanted)


def basic_features(
    returns: DataFrame,
    macro: DataFrame | None = None,
    normalize: bool = False,
    col: str = "ret",
    order: str = "ts",
    pair: tuple[str, str] | None = None,
    index_asset: str | None = None,
    sector_assets: Sequence[str] = (),
    macro_names: Mapping[str, str] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The per-asset feature set with cross-sectional columns; filled forward, backward, then 0.

    ``pair`` gives the dispersion of two assets, ``index_asset`` the beta and (for ``sector_assets``) the
    spread to an index; ``macro_names`` maps ``vix``, ``short`` and ``long`` to macro series. A ``volume``
    column, when present, gives the volume surge.
    """
    key = ["asset"]
    has_volume = "volume" in returns.columns
    d = returns.select("asset", order, F.col(col).alias("returns"), *(["volume"] if has_volume else []))
    d = with_moves(d, "returns", key, order, chunk_rows)
    d = ewm(
        d,
        {
            "_fast": ("mean", "returns", 12), "_slow": ("mean", "returns", 26), "ewm_volatility": ("std", "returns", 21),
            "_u": ("wilder", "_up", 14), "_v": ("wilder", "_down", 14),
        },
        key, order,
    )
    d = d.withColumns(
        {
            "macd": F.col("_fast") - F.col("_slow"),
            "rsi": F.coalesce(F.try_divide(F.col("_u") * 100, F.col("_u") + F.col("_v")), F.lit(50.0)),
        }
    ).drop("_fast", "_slow", "_u", "_v")
    d = ewm(d, {"macd_signal": ("mean", "macd", 9)}, key, order)
    d = d.withColumns({"_index": F.lit(None).cast("double"), "_pair": F.lit(None).cast("double")})
    if index_asset:
        d = index_returns(d.drop("_index"), index_asset, "returns", order)
    if pair:
        d = pair_spread(d.drop("_pair"), *pair, "returns", order, "_pair")

    s = series(d, key, order, lookback=49, chunk_rows=chunk_rows)
    r = "returns"
    cols = {
        "volatility": R.std(s, r, 21),
        "momentum": R.mean(s, r, 20),
        "momentum_20d": R.mean(s, r, 20),
        "fast_ma": R.mean(s, r, 20),
        "slow_ma": R.mean(s, r, 50),
        "skewness": R.skew(s, r, 21),
        "kurtosis": R.kurt(s, r, 21),
        "rsi_14": rsi_sma_expr(s, 14),
        "realized_volatility": R.std(s, r, 15),
        "williams_r": williams_expr(s, r),
        "semiconductor_pmi": pmi_expr(s, r),
        "bollinger_position": bollinger_expr(s, r),
    }
    if has_volume:
        cols["etf_volume_surge"] = (F.col("volume") - R.mean(s, "volume", 20)) / (R.std(s, "volume", 20) + 1e-6)
    if index_asset:
        beta = R.cov(s, r, "_index", 20) / (R.var(s, "_index", 20) + 1e-6)
        cols["beta_to_index"] = F.when(F.col("asset") == index_asset, 0.0).otherwise(beta)
        cols["sector_index_spread"] = F.when(F.col("asset").isin(list(sector_assets)), F.col(r) - F.col("_index")).otherwise(0.0)
    if pair:
        cols["pair_dispersion"] = F.col("_pair")
        cols["pair_spread"] = F.when(F.col("asset") == pair[0], F.col("_pair")).otherwise(0.0)
    d = s.add(cols)
    d = rolling_std(d, "realized_volatility", 20, key, "vol_of_vol", order, chunk_rows=chunk_rows)
    d = cross_sectional_rank_pct(d, "momentum_20d", order)
    features = ["returns", *cols, "ewm_volatility", "rsi", "macd", "macd_signal", "vol_of_vol", "momentum_rank"]
    if macro is not None:
        names = dict(macro_names or {})
        rates = [names[k] for k in ("short", "long") if k in names]
        if rates:
            d = macro_join(d, macro, rates, key=key, order=order)
            features += [f"{n}_yield{x}" for n in rates for x in ("", "_ma", "_spread")]
        if len(rates) == 2:
            lng, sht = F.col(f"{names['long']}_yield"), F.col(f"{names['short']}_yield")
            d = d.withColumns({"term_structure_slope": lng - sht, "yield_curve_inversion": F.when(sht < lng, 1.0).otherwise(0.0)})
            features += ["term_structure_slope", "yield_curve_inversion"]
        if "vix" in names:
            from tidemark.operators.prep import ffill, macro_wide

            d = ffill(d.join(macro_wide(macro, [names["vix"]], order), order, "left"), [names["vix"]], key, order)
            d = pct_rank_full(d, names["vix"], key, "vix_percentile")
            features.append("vix_percentile")
    if "term_structure_slope" not in features:
        d = d.withColumn("term_structure_slope", F.lit(0.0))
        features.append("term_structure_slope")
    d = fill_all(d.select("asset", order, *features), features, key, order)
    return zscore(d, features, key, order=order) if normalize else d


def portfolio_features(
    returns: DataFrame, macro: DataFrame | None = None, names: Sequence[str] = (), key: Sequence[str] = ("portfolio",), col: str = "ret",
    order: str = "ts", chunk_rows: int | None = None,
) -> DataFrame:
    """Returns, 21-row deviation, 20-row mean, skewness and kurtosis, with macro levels when given; filled."""
    d = returns.select(*key, order, F.col(col).alias("returns"))
    r = "returns"
    d = _add(
        d, key, order, 20, chunk_rows,
        volatility=lambda s: R.std(s, r, 21), momentum=lambda s: R.mean(s, r, 20),
        skewness=lambda s: R.skew(s, r, 21), kurtosis=lambda s: R.kurt(s, r, 21),
    )
    feats = ["returns", "volatility", "momentum", "skewness", "kurtosis"]
    if macro is not None and names:
        d = macro_join(d, macro, names, key=key, order=order)
        feats += [f"{n}_yield{x}" for n in names for x in ("", "_ma", "_spread")]
    return fill_all(d, feats, key, order)
