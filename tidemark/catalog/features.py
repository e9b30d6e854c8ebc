"""Rolling, recursive and macro features: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import BARS, MACRO, RETS, full, macro, mrets, r6, rets, rnd, rounded, sql, with_mrets, with_rets
from tidemark.functions import rolling as R
from tidemark.operators import features as ft
from tidemark.plans.series import long_series, running, series

QUERIES, ORACLES = {}, {}
W = "PARTITION BY asset ORDER BY ts"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def feature(name, build, expr, source="rets", digits=6, pre=()):
    """One added column ``name`` over the weekly supplier returns."""

    def run(spark, sf):
        d = build(mrets(spark, sf)).select("asset", "ts", r6(name, digits).alias(name))
        return d

    run.__doc__ = f"Column {name} per series."
    QUERIES[name] = run
    ORACLES[name] = with_mrets(f"SELECT asset, ts, {rnd(expr, digits)} AS {name} FROM {source}", *pre)


def m(x, n, need=None):
    return full(f"avg({x})", x, n, W, need)


def s(x, n, need=None):
    return full(f"stddev_samp({x})", x, n, W, need)


MOVES = f"""moves AS (SELECT *, greatest(coalesce(d, 0), 0) AS up, greatest(-coalesce(d, 0), 0) AS down
  FROM (SELECT *, ret - lag(ret) OVER ({W}) AS d FROM rets))"""


def rsi(n):
    return f"coalesce(100 - 100 / (1 + ({m('up', n)}) / (({m('down', n)}) + 1e-6)), 50)"


BOLL = f"(ret - (({m('ret', 20)}) - 2 * ({s('ret', 20)}))) / nullif(4 * ({s('ret', 20)}), 0)"
WILL = f"(({full('max(ret)', 'ret', 14, W)}) - ret) / nullif(({full('max(ret)', 'ret', 14, W)}) - ({full('min(ret)', 'ret', 14, W)}), 0) * -100"
PMI = f"({m('ret', 20)}) / nullif({s('ret', 20)}, 0) * 50 + 50"


def sratio(a, b, eps="0"):
    return f"({s('ret', a)}) / nullif(({s('ret', b)}) + {eps}, 0)"


def roc_sql(n):
    return f"ret / nullif(lag(ret, {n}) OVER ({W}), 0) - 1"


feature("rolling_mean", lambda d: ft.rolling_mean(d, n=20, out="rolling_mean"), m("ret", 20))
feature("rolling_std", lambda d: ft.rolling_std(d, n=21, out="rolling_std"), s("ret", 21))
feature("rolling_skew", lambda d: ft.rolling_skew(d, n=21, out="rolling_skew"), full("skewness(ret)", "ret", 21, W))
feature("rolling_kurt", lambda d: ft.rolling_kurt(d, n=21, out="rolling_kurt"), full("kurtosis(ret)", "ret", 21, W), digits=4)
feature("rsi_sma", lambda d: ft.rsi_sma(d, 14, out="rsi_sma"), rsi(14), "moves", pre=(MOVES,))
feature("bollinger_position", ft.bollinger_position, BOLL)
feature("price_bollinger", lambda d: ft.price_bollinger(d, out="price_bollinger"), f"(close - ({m('close', 20)})) / (({s('close', 20)}) + 1e-6)")
feature("williams_r", ft.williams_r, WILL)
feature(
    "on_balance_volume", ft.obv,
    f"sum(CASE WHEN d > 0 THEN abs(ret) WHEN d < 0 THEN -abs(ret) ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)", "moves", pre=(MOVES,),
)
feature("pmi_proxy", lambda d: ft.pmi_proxy(d, out="pmi_proxy"), PMI)
feature("short_long_spread", lambda d: ft.short_long_spread(d, out="short_long_spread"), f"({m('ret', 5)}) - ({m('ret', 20)})")
feature("vol_ratio_10_30", lambda d: ft.vol_ratio(d, out="vol_ratio_10_30"), sratio(10, 30, "1e-6"))
feature("volume_ratio", ft.volume_ratio, sratio(5, 21))
feature("roc_5d", lambda d: ft.roc(d, 5, out="roc_5d"), roc_sql(5), digits=4)
feature("volume_surge", ft.volume_surge, f"(volume - ({m('volume', 20)})) / (({s('volume', 20)}) + 1e-6)")
_RV = f"rv AS (SELECT *, {s('ret', 15)} AS realized_volatility FROM rets)"
feature("vol_of_vol", ft.vol_of_vol, s("realized_volatility", 20), "rv", pre=(_RV,))
feature("rolling_vol_ann", lambda d: ft.rolling_vol_ann(d, 63, out="rolling_vol_ann"), f"({s('ret', 63)}) * sqrt(252)")
feature("rolling_sharpe", ft.rolling_sharpe, f"({m('ret', 63)}) * 252 / nullif(({s('ret', 63)}) * sqrt(252), 0)")
feature(
    "vol_breakout_z",
    lambda d: ft.vol_breakout_z(ft.rolling_std(d, n=15, out="realized_volatility"), out="vol_breakout_z"),
    f"(realized_volatility - ({m('realized_volatility', 20, 5)})) / (({s('realized_volatility', 20, 5)}) + 1e-6)", "rv", pre=(_RV,),
)


@query(with_mrets(f"SELECT asset, ts, {rnd(full('min(ret)', 'ret', 14, W))} AS low, {rnd(full('max(ret)', 'ret', 14, W))} AS high FROM rets"))
def rolling_minmax(spark, sf):
    return rounded(ft.rolling_minmax(mrets(spark, sf)).select("asset", "ts", "low", "high"))


_BETA = """b AS (SELECT r.asset, r.ts, r.ret, i.ret AS idx FROM rets r LEFT JOIN (SELECT ts, ret FROM rets WHERE asset = 'N-O') i USING (ts))"""


@query(
    with_rets(
        f"""SELECT asset, ts, {rnd(f"({full('covar_samp(ret, idx)', 'idx', 20, W)}) / (({full('var_samp(idx)', 'idx', 20, W)}) + 1e-6)")} AS beta FROM b""",
        _BETA,
    )
)
def rolling_beta(spark, sf):
    return rounded(ft.rolling_beta(rets(spark, sf), "N-O").select("asset", "ts", "beta"))


# --- exponentially weighted: every past row with its weight

SEQ = f"seq AS (SELECT *, row_number() OVER ({W}) AS i FROM rets)"


def ewm_cte(name, src, x, span, std=False):
    a = f"(1 - CAST(2 AS DOUBLE) / {span + 1})"
    w = f"pow({a}, t.i - p.i)"
    mean_ = f"sum(p.{x} * {w}) / sum({w})"
    val = mean_
    if std:
        val = f"sqrt(greatest(sum(p.{x} * p.{x} * {w}) / sum({w}) - pow({mean_}, 2), 0) * pow(sum({w}), 2) / CASE WHEN t.i > 1 THEN pow(sum({w}), 2) - sum({w} * {w}) END)"
    return f"""{name} AS (SELECT t.asset, t.ts, t.i, {val} AS {name} FROM {src} t JOIN {src} p ON p.asset = t.asset AND p.i <= t.i GROUP BY 1, 2, 3)"""


def wilder_cte(name, src, x, n):
    a = f"(1 - CAST(1 AS DOUBLE) / {n})"
    return f"""{name} AS (SELECT t.asset, t.ts, t.i, sum(p.{x} * pow({a}, t.i - p.i) * CASE WHEN p.i = 1 THEN 1 ELSE CAST(1 AS DOUBLE) / {n} END) AS {name}
  FROM {src} t JOIN {src} p ON p.asset = t.asset AND p.i <= t.i GROUP BY 1, 2, 3)"""


@query(with_mrets(f"SELECT asset, ts, {rnd('e')} AS ewm_mean FROM e", SEQ, ewm_cte("e", "seq", "ret", 12)))
def ewm_mean(spark, sf):
    return rounded(ft.ewm_mean(mrets(spark, sf), 12).select("asset", "ts", "ewm_mean"))


@query(with_mrets(f"SELECT asset, ts, {rnd('e')} AS ewm_std FROM e", SEQ, ewm_cte("e", "seq", "ret", 21, True)))
def ewm_std(spark, sf):
    return rounded(ft.ewm_std(mrets(spark, sf), 21).select("asset", "ts", "ewm_std"))


@query(with_mrets(f"SELECT asset, ts, {rnd('e')} AS ewm_wilder FROM e", SEQ, wilder_cte("e", "seq", "ret", 14)))
def ewm_wilder(spark, sf):
    return rounded(ft.ewm_wilder(mrets(spark, sf), 14).select("asset", "ts", "ewm_wilder"))


MACD = (
    SEQ, ewm_cte("e12", "seq", "ret", 12), ewm_cte("e26", "seq", "ret", 26),
    "md AS (SELECT asset, ts, i, e12 - e26 AS macd FROM e12 JOIN e26 USING (asset, ts, i))", ewm_cte("ms", "md", "macd", 9),
)


@query(with_mrets(f"SELECT asset, ts, {rnd('macd')} AS macd, {rnd('ms')} AS macd_signal FROM md JOIN ms USING (asset, ts, i)", *MACD))
def macd(spark, sf):
    return rounded(ft.macd(mrets(spark, sf)).select("asset", "ts", "macd", "macd_signal"))


WRSI = (
    MOVES, f"mseq AS (SELECT *, row_number() OVER ({W}) AS i FROM moves)", wilder_cte("gu", "mseq", "up", 14), wilder_cte("gd", "mseq", "down", 14),
    """wrsi AS (SELECT asset, ts, CASE WHEN gu = 0 AND gd = 0 THEN 50 WHEN gd = 0 THEN 100 ELSE 100 - 100 / (1 + gu / gd) END AS rsi FROM gu JOIN gd USING (asset, ts, i))""",
)


@query(with_mrets(f"SELECT asset, ts, {rnd('rsi')} AS rsi FROM wrsi", *WRSI))
def rsi_wilder(spark, sf):
    return rounded(ft.rsi_wilder(mrets(spark, sf)).select("asset", "ts", "rsi"))


@query(
    with_rets(
        f"""SELECT asset, ts, {rnd('cum', 4)} AS cum, {rnd('cum_sum')} AS cum_sum, {rnd(f'max(cum) OVER ({W} ROWS UNBOUNDED PRECEDING)', 4)} AS peak
        FROM (SELECT asset, ts, product(1 + ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum, sum(ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum_sum FROM rets)"""
    )
)
def cumulative_return(spark, sf):
    d = ft.cumulative_return(rets(spark, sf))
    return rounded(d.select("asset", "ts", "cum", "cum_sum", "peak"), cum=4, peak=4)


# --- macro and pairs


@query(
    with_rets(
        f"""SELECT asset, ts, {rnd("(max(ret) FILTER (asset = 'A-F') OVER (PARTITION BY ts)) - (max(ret) FILTER (asset = 'R-F') OVER (PARTITION BY ts))")} AS pair_spread FROM rets"""
    )
)
def pair_spread(spark, sf):
    return rounded(ft.pair_spread(rets(spark, sf), "A-F", "R-F").select("asset", "ts", "pair_spread"))


_SLOPE = "max(value) FILTER (series = '5-LOW') - max(value) FILTER (series = '1-URGENT')"


@query(
    sql(
        f"SELECT ts, {rnd(_SLOPE)} AS term_structure_slope, CASE WHEN {_SLOPE} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS curve_inversion FROM macro GROUP BY ts",
        MACRO,
    )
)
def term_structure(spark, sf):
    mac = macro(spark, sf)
    a = ft.term_structure_slope(mac, "5-LOW", "1-URGENT")
    return rounded(a.join(ft.curve_inversion(mac, "5-LOW", "1-URGENT"), "ts"))


@query(
    sql(
        f"SELECT series, ts, {rnd('(rank() OVER (PARTITION BY series ORDER BY value) + (count(*) OVER (PARTITION BY series, value) - 1) / 2) / count(*) OVER (PARTITION BY series)')} AS pct_rank FROM macro",
        MACRO,
    )
)
def pct_rank_full(spark, sf):
    return rounded(ft.pct_rank_full(macro(spark, sf), "value").select("series", "ts", "pct_rank"))


@query(sql(f"SELECT series, ts, {rnd('value / lag(value) OVER (PARTITION BY series ORDER BY ts) - 1')} AS change FROM macro", MACRO))
def macro_change(spark, sf):
    return rounded(ft.macro_change(macro(spark, sf)).select("series", "ts", "change"))


# --- sets

_ENH = {
    "returns": "ret", "log_returns": "ln(1 + ret)", "volatility": "v15", "realized_volatility": s("ret", 15), "momentum": m("ret", 15),
    "momentum_5d": m("ret", 5), "roc_5d": roc_sql(5), "momentum_20d": m("ret", 20), "roc_20d": roc_sql(20), "momentum_60d": m("ret", 60), "roc_60d": roc_sql(60),
    "rsi_14": rsi(14), "rsi_30": rsi(30), "macd_signal": "ms", "bollinger_position": BOLL, "williams_r": WILL, "volume_ratio": sratio(5, 21),
    "volume_sma_ratio": sratio(5, 21),
    "on_balance_volume": f"sum(CASE WHEN d > 0 THEN abs(ret) WHEN d < 0 THEN -abs(ret) ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)",
    "yield_spread": m("ret", 63), "term_structure_slope": m("ret", 63), "dollar_strength": s("ret", 21), "semiconductor_pmi": PMI,
    "memory_vs_logic_spread": f"({m('ret', 5)}) - ({m('ret', 20)})", "equipment_vs_design_ratio": sratio(10, 30, "1e-6"),
    "skewness": full("skewness(ret)", "ret", 15, W), "kurtosis": full("kurtosis(ret)", "ret", 15, W),
}
_EJ = """ej AS (SELECT moves.*, v15, ms FROM moves JOIN v15 USING (asset, ts) JOIN ms USING (asset, ts))"""


@query(
    with_mrets(
        "SELECT asset, ts, " + ", ".join(f"{rnd(f'coalesce({e}, 0)', 4)} AS {n}" for n, e in _ENH.items()) + " FROM ej",
        *MACD, MOVES, ewm_cte("v15", "seq", "ret", 15, True), _EJ,
    )
)
def enhanced_features(spark, sf):
    return rounded(ft.enhanced_features(mrets(spark, sf)), 4)


_ENM = _ENH | {"yield_spread": "slope", "term_structure_slope": "slope", "dollar_strength": "chg"}
_EM = f"""em AS (SELECT ej.*, slope, chg FROM ej LEFT JOIN (SELECT ts, {_SLOPE} AS slope FROM macro GROUP BY ts) USING (ts)
  LEFT JOIN (SELECT ts, value / lag(value) OVER (ORDER BY ts) - 1 AS chg FROM macro WHERE series = '3-MEDIUM') USING (ts))"""


@query(
    with_rets(
        "SELECT asset, ts, " + ", ".join(f"{rnd(f'coalesce({e}, 0)', 4)} AS {n}" for n, e in _ENM.items()) + " FROM em",
        *MACD, MOVES, ewm_cte("v15", "seq", "ret", 15, True), MACRO, _EJ, _EM,
    )
)
def enhanced_features_macro(spark, sf):
    """The wide set with slope and dollar strength from macro levels."""
    return rounded(ft.enhanced_features(rets(spark, sf), macro(spark, sf), macro_names={"long": "5-LOW", "short": "1-URGENT", "dollar": "3-MEDIUM"}), 4)


def fill_sql(c):
    w = "PARTITION BY asset ORDER BY ts"
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    )


_BAS = {
    "returns": "ret", "volatility": s("ret", 21), "momentum": m("ret", 20), "momentum_20d": m("ret", 20), "fast_ma": m("ret", 20), "slow_ma": m("ret", 50),
    "skewness": full("skewness(ret)", "ret", 21, W), "kurtosis": full("kurtosis(ret)", "ret", 21, W), "rsi_14": rsi(14), "realized_volatility": s("ret", 15),
    "williams_r": WILL, "semiconductor_pmi": PMI, "bollinger_position": BOLL, "etf_volume_surge": f"(volume - ({m('volume', 20)})) / (({s('volume', 20)}) + 1e-6)",
    "beta_to_index": f"CASE WHEN asset = 'N-O' THEN 0 ELSE ({full('covar_samp(ret, idx)', 'idx', 20, W)}) / (({full('var_samp(idx)', 'idx', 20, W)}) + 1e-6) END",
    "sector_index_spread": "CASE WHEN asset = 'A-F' THEN ret - idx ELSE 0 END", "pair_dispersion": "ps", "pair_spread": "CASE WHEN asset = 'A-F' THEN ps ELSE 0 END",
    "ewm_volatility": "v21", "rsi": "rsi", "macd": "macd", "macd_signal": "ms",
}
_BJ = """bj AS (SELECT m.*, i.ret AS idx, v21, rsi, macd, ms,
    (max(m.ret) FILTER (m.asset = 'A-F') OVER (PARTITION BY m.ts)) - (max(m.ret) FILTER (m.asset = 'R-F') OVER (PARTITION BY m.ts)) AS ps
  FROM moves m JOIN v21 USING (asset, ts) JOIN wrsi USING (asset, ts) JOIN md USING (asset, ts) JOIN ms USING (asset, ts)
  LEFT JOIN (SELECT ts, ret FROM rets WHERE asset = 'N-O') i USING (ts))"""
_B1 = "b1 AS (SELECT asset, ts, " + ", ".join(f"{e} AS {n}" for n, e in _BAS.items()) + " FROM bj)"
_B2 = f"""b2 AS (SELECT *, {s('realized_volatility', 20)} AS vol_of_vol,
  CASE WHEN momentum_20d IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY momentum_20d) + (count(*) OVER (PARTITION BY ts, momentum_20d) - 1) / 2)
    / count(momentum_20d) OVER (PARTITION BY ts) END AS momentum_rank FROM b1)"""
_BCOLS = [*_BAS, "vol_of_vol", "momentum_rank"]


@query(
    with_rets(
        "SELECT asset, ts, " + ", ".join(f"{rnd(fill_sql(c), 4)} AS {c}" for c in _BCOLS) + ", CAST(0 AS DOUBLE) AS term_structure_slope FROM b2",
        *MACD, *WRSI, ewm_cte("v21", "seq", "ret", 21, True), _BJ, _B1, _B2,
    )
)
def basic_features(spark, sf):
    d = ft.basic_features(rets(spark, sf), pair=("A-F", "R-F"), index_asset="N-O", sector_assets=["A-F"])
    return rounded(d, 4)


@query(
    sql(
        "SELECT portfolio, ts, " + ", ".join(
            f"{rnd(fill_sql(c).replace('asset', 'portfolio'), 4)} AS {c}" for c in ("returns", "volatility", "momentum", "skewness", "kurtosis")
        ) + " FROM f",
        BARS, RETS, "port AS (SELECT substr(asset, 3, 1) AS portfolio, ts, avg(ret) AS ret FROM rets GROUP BY 1, 2)",
        "f AS (SELECT portfolio, ts, ret AS returns, " + ", ".join(
            f"{e.replace('asset', 'portfolio')} AS {n}" for n, e in
            {"volatility": s("ret", 21), "momentum": m("ret", 20), "skewness": full("skewness(ret)", "ret", 21, W), "kurtosis": full("kurtosis(ret)", "ret", 21, W)}.items()
        ) + " FROM port)",
    )
)
def portfolio_features(spark, sf):
    r = rets(spark, sf).groupBy(F.substring("asset", 3, 1).alias("portfolio"), "ts").agg(F.avg("ret").alias("ret"))
    return rounded(ft.portfolio_features(r), 4)


def _carried(c, key="asset"):
    return f"last_value({c}0 IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}"


def _levels(c, name):
    """A carried level, its 21-row mean and its distance from the 252-row mean."""
    return {f"{name}_yield": c, f"{name}_yield_ma": m(c, 21), f"{name}_yield_spread": f"{c} - ({m(c, 252)})"}


_MW3 = "mw3 AS (SELECT ts, " + ", ".join(f"max(value) FILTER (series = '{n}') AS {c}0" for c, n in (("u", "1-URGENT"), ("l", "5-LOW"), ("x", "3-MEDIUM"))) + " FROM macro GROUP BY ts)"
_PF = {"returns": "ret", "volatility": s("ret", 21), "momentum": m("ret", 20), "skewness": full("skewness(ret)", "ret", 21, W), "kurtosis": full("kurtosis(ret)", "ret", 21, W), **_levels("u", "1-URGENT")}


@query(
    sql(
        "SELECT portfolio, ts, " + ", ".join(f"""{rnd(fill_sql(f'"{c}"').replace('asset', 'portfolio'), 4)} AS "{c}" """ for c in _PF) + " FROM f",
        BARS, RETS, MACRO, _MW3, "port AS (SELECT substr(asset, 3, 1) AS portfolio, ts, avg(ret) AS ret FROM rets GROUP BY 1, 2)",
        f"pm AS (SELECT *, {_carried('u', 'portfolio')} FROM port LEFT JOIN mw3 USING (ts))",
        "f AS (SELECT portfolio, ts, " + ", ".join(f"""{e.replace('asset', 'portfolio')} AS "{n}" """ for n, e in _PF.items()) + " FROM pm)",
    )
)
def portfolio_features_macro(spark, sf):
    """The portfolio set with a macro level."""
    r = rets(spark, sf).groupBy(F.substring("asset", 3, 1).alias("portfolio"), "ts").agg(F.avg("ret").alias("ret"))
    d = rounded(ft.portfolio_features(r, macro(spark, sf), ["1-URGENT"]), 4)
    return d.select("portfolio", "ts", *[F.col(f"`{c}`") for c in _PF])


_BMS = {n: e for n, e in _BAS.items() if n not in ("beta_to_index", "sector_index_spread", "pair_dispersion", "pair_spread")}
_BMS |= {
    **_levels("u", "1-URGENT"), **_levels("l", "5-LOW"), "term_structure_slope": "l - u", "yield_curve_inversion": "CASE WHEN u < l THEN 1.0 ELSE 0.0 END",
    "vix_percentile": "CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY asset ORDER BY x) + (count(*) OVER (PARTITION BY asset, x) - 1) / 2) / count(x) OVER (PARTITION BY asset) END",
}
_BMC = [*_BMS, "vol_of_vol", "momentum_rank"]


@query(
    with_rets(
        "SELECT asset, ts, " + ", ".join(f"""{rnd(f'("{c}" - avg("{c}") OVER a) / (stddev_samp("{c}") OVER a + 1e-8)', 4)} AS "{c}" """ for c in _BMC) + " FROM filled WINDOW a AS (PARTITION BY asset)",
        *MACD, *WRSI, ewm_cte("v21", "seq", "ret", 21, True), MACRO, _MW3,
        f"bm AS (SELECT *, {_carried('u')}, {_carried('l')}, {_carried('x')} FROM moves JOIN v21 USING (asset, ts) JOIN wrsi USING (asset, ts) JOIN md USING (asset, ts) JOIN ms USING (asset, ts) LEFT JOIN mw3 USING (ts))",
        "b1 AS (SELECT asset, ts, " + ", ".join(f"""CAST({e} AS DOUBLE) AS "{n}" """ for n, e in _BMS.items()) + " FROM bm)", _B2,
        "filled AS (SELECT asset, ts, " + ", ".join(f"""{fill_sql(f'"{c}"')} AS "{c}" """ for c in _BMC) + " FROM b2)",
    )
)
def basic_features_macro(spark, sf):
    """The per-asset set with macro levels and normalised columns."""
    d = ft.basic_features(rets(spark, sf), macro(spark, sf), normalize=True, macro_names={"vix": "3-MEDIUM", "short": "1-URGENT", "long": "5-LOW"})
    return rounded(d, 4)


@query()
def long_series_features(spark, sf):
    """Features of event values per type: time-stamped series of unbounded length, by the chunked plan."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("asset"), "ts", (F.col("value") / 100).alias("ret"))
    e = long_series(e, ["asset"])
    w = series(e, ["asset"], lookback=20, chunk_rows=1000)
    d = w.add({"mean": R.mean(w, "ret", 20), "std": R.std(w, "ret", 21)})
    d = running(d, ["asset"], {"cum_sum": ("sum", "ret")}, chunk_rows=1000)
    return rounded(d.select("asset", F.col("ts").cast("string").alias("at"), "mean", "std", "cum_sum"))


ORACLES["long_series_features"] = f"""WITH rets AS (SELECT event_type AS asset, ts AS t, event_id, ts, value / 100 AS ret FROM events)
SELECT asset, CAST(ts AS VARCHAR) AS at, {rnd(m('ret', 20))} AS mean, {rnd(s('ret', 21))} AS std, {rnd(f'sum(ret) OVER ({W} ROWS UNBOUNDED PRECEDING)')} AS cum_sum FROM rets"""


HOT = """hot AS (SELECT CASE WHEN event_id % 10 > 0 THEN 'hot' ELSE event_type END AS asset, value / 100 AS ret,
  CASE WHEN event_id % 10 > 0 THEN 1700000000000000 + event_id * 1000 ELSE epoch_us(ts) END AS us FROM events)"""
_HW = W.replace("ts", "us")


@query(
    sql(
        f"""SELECT asset, us, {rnd(m('ret', 20).replace(W, _HW))} AS mean, {rnd(f'sum(ret) OVER ({_HW} ROWS UNBOUNDED PRECEDING)')} AS cum_sum,
        {rnd(f'max(ret) OVER ({_HW} ROWS UNBOUNDED PRECEDING)')} AS top, row_number() OVER ({_HW}) - 1 AS pos FROM hot""",
        HOT,
    )
)
def long_series_hot(spark, sf):
    """The same where nine tenths of all events are one series, milliseconds apart: positions by range partitions."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rest = F.col("event_id") % 10 == 0
    ts = F.when(rest, F.col("ts").cast("timestamp")).otherwise(F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("event_id") * 1000))
    e = long_series(e.select(F.when(rest, F.col("event_type")).otherwise("hot").alias("asset"), ts.alias("ts"), (F.col("value") / 100).alias("ret")), ["asset"])
    w = series(e, ["asset"], lookback=20, chunk_rows=1000)
    d = running(w.add({"mean": R.mean(w, "ret", 20)}), ["asset"], {"cum_sum": ("sum", "ret"), "top": ("max", "ret")}, chunk_rows=1000)
    return rounded(d.select("asset", F.unix_micros("ts").alias("us"), "mean", "cum_sum", "top", F.col("_seq").alias("pos")))
