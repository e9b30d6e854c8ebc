"""Sizing and back-tests: queries and their SQL. Returns are squashed to +-2 %, so that equity stays in range."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.base import BARS, MANY, PANEL, RETS, mrets, panel, rnd, rounded, sql
from tidemark.functions import rolling as R
from tidemark.operators import backtest as bt
from tidemark.operators import sizing as sz
from tidemark.operators.sizing import Strategy
from tidemark.plans.series import series
from tidemark.session import checkpoint

QUERIES, ORACLES = {}, {}
W = "PARTITION BY asset ORDER BY ts"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _inputs(src):
    """SQL of squashed returns, signals and confidence over ``src``."""
    return f"""br AS (SELECT asset, ts, 0.02 * tanh(ret) AS ret, volume FROM {src}),
sg AS (SELECT asset, ts, ret, volume, CASE WHEN count(ret) OVER ({W} ROWS 4 PRECEDING) = 5 THEN tanh(avg(ret) OVER ({W} ROWS 4 PRECEDING) * 100) END AS signal FROM br),
cf AS (SELECT asset, ts, 1 / (1 + abs(ret) * 100) AS confidence FROM br WHERE volume > 40)"""


def returns_of(r):
    return r.select("asset", "ts", (0.02 * F.tanh("ret")).alias("ret"), "volume")


def signals_of(r):
    s = series(r, ["asset"], lookback=4)
    return s.add({"signal": F.tanh(R.mean(s, "ret", 5) * 100)}).select("asset", "ts", "signal")


def confidence_of(r):
    return r.filter("volume > 40").select("asset", "ts", (1 / (1 + F.abs("ret") * 100)).alias("confidence"))


# --- sizing rules over the supplier returns

ZS = f"""z0 AS (SELECT asset, ts, ret, coalesce(signal, 0) AS s, row_number() OVER ({W}) - 1 AS i,
    CASE WHEN count(ret) OVER ({W} ROWS 20 PRECEDING) = 21 THEN stddev_samp(ret) OVER ({W} ROWS 20 PRECEDING) END AS vol,
    CASE WHEN count(ret) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) = 21 THEN stddev_samp(ret) OVER ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) END AS past FROM sg),
z AS (SELECT z0.*, coalesce(c.confidence, CASE WHEN h.ts IS NOT NULL THEN 0.5 END, m.c, 0.5) AS conf, coalesce(c.confidence, 1) AS fullc
  FROM z0 LEFT JOIN cf c ON c.asset = z0.asset AND c.ts = z0.ts LEFT JOIN (SELECT DISTINCT ts FROM cf) h ON h.ts = z0.ts
  LEFT JOIN (SELECT asset, avg(confidence) AS c FROM cf GROUP BY 1) m ON m.asset = z0.asset)"""


def _share(raw):
    return f"coalesce(({raw}) / nullif(sum(abs({raw})) OVER (PARTITION BY ts), 0), 0)"


RULES = {
    "proportional": _share("s"),
    "fixed": _share("sign(s)"),
    "regime_confidence": f"{_share('s')} * least(greatest(conf, 0.2), 1) * 0.5",
    "softmax": _share("exp(abs(s)) * sign(s)"),
    "quadratic": _share("s * s * sign(s)"),
    "risk_budget": _share("s * fullc / (CASE WHEN vol = 0 THEN 1 ELSE vol END + 1e-4)"),
    "risk_parity": f"CASE WHEN i < 21 OR past IS NULL THEN s * 0.1 ELSE {_share('1 / past')} * sign(s) END",
}


def _sized(spark, sf, kind, **kw):
    r = checkpoint(returns_of(mrets(spark, sf)))  # read by signals, confidence and their totals
    return sz.size_weights(signals_of(r), [Strategy("x", kind, base_position=0.5, **kw)], confidence_of(r), r)


for _kind, _expr in RULES.items():

    def _run(spark, sf, kind=_kind):
        return rounded(_sized(spark, sf, kind).select("asset", "ts", "weight"))

    _run.__doc__ = f"Sizing rule {_kind}."
    QUERIES[f"size_{_kind}"] = _run
    ORACLES[f"size_{_kind}"] = sql(f"SELECT asset, ts, {rnd(_expr)} AS weight FROM z", MANY, RETS, _inputs("rets"), ZS)


@query(
    sql(
        f"""SELECT asset, ts, {rnd('CASE WHEN sum(w) OVER (PARTITION BY ts) > 0.8 THEN w * 0.8 / sum(w) OVER (PARTITION BY ts) ELSE w END')} AS weight FROM (
        SELECT asset, ts, least(greatest(({_share('s')}) * 0.8, 0), 0.05) AS w FROM z)""",
        MANY, RETS, _inputs("rets"), ZS,
    )
)
def apply_constraints(spark, sf):
    d = _sized(spark, sf, "proportional", allow_short=False, max_position=0.05, leverage=0.8)
    return rounded(sz.apply_constraints(d).select("asset", "ts", "weight"))


@query(sql(f"SELECT asset, ts, {rnd('CASE WHEN s > 0 THEN s / 10 ELSE 0 END')} AS weight FROM z", MANY, RETS, _inputs("rets"), ZS))
def custom_weights(spark, sf):
    """A user rule given as a column."""
    s = sz.for_strategies(signals_of(returns_of(mrets(spark, sf))), [Strategy("x")])
    d = sz.custom_weights(s, lambda: F.when(F.col("signal") > 0, F.col("signal") / 10).otherwise(0.0))
    return rounded(d.select("asset", "ts", "weight"))


@query(sql(f"SELECT asset, ts, {rnd(_share('s'))} AS weight FROM z", MANY, RETS, _inputs("rets"), ZS))
def custom_weights_by_date(spark, sf):
    """A user rule that fails on every date, so that proportional sizing takes over."""
    s = sz.for_strategies(signals_of(returns_of(mrets(spark, sf))), [Strategy("x")])

    def broken(pdf):
        raise RuntimeError("no rule")

    return rounded(sz.custom_weights_by_date(s, broken).select("asset", "ts", "weight"))


@query(
    sql(
        f"SELECT asset, ts, {rnd('CASE WHEN n % 2 = 1 THEN share ELSE sign(s) / n END')} AS weight, n % 2 = 1 AS fallback FROM (SELECT asset, ts, s, {_share('s')} AS share, count(*) OVER (PARTITION BY ts) AS n FROM z)",
        MANY, RETS, _inputs("rets"), ZS,
    )
)
def custom_weights_fallback(spark, sf):
    """A user rule by date that fails on dates with an odd number of assets."""
    s = sz.for_strategies(signals_of(returns_of(mrets(spark, sf))), [Strategy("x")])

    def even(pdf):
        if len(pdf) % 2:
            raise ValueError("an odd number of assets")
        return np.sign(pdf["signal"].fillna(0.0)) / len(pdf)

    return rounded(sz.custom_weights_by_date(s, even).select("asset", "ts", "weight", "fallback"))


# --- calendars and windows

_CALW = "(ORDER BY ts)"
_DAYS = "days AS (SELECT DISTINCT ts FROM panel)"
_FREQ = {
    "d": ("D", "true"), "w": ("W", "dayofweek(ts) = 1"), "m": ("M", f"month(ts) <> month(lag(ts) OVER {_CALW})"),
    "q": ("Q", f"quarter(ts) <> quarter(lag(ts) OVER {_CALW})"), "n": (3, f"ts - lag(ts) OVER {_CALW} >= 3"),
}


@query(
    sql(
        "SELECT ts, " + ", ".join(f"coalesce(lag(ts) OVER {_CALW} IS NULL OR {e}, true) AS {n}" for n, (_, e) in _FREQ.items()) + " FROM days",
        BARS, RETS, PANEL, _DAYS,
    )
)
def rebalance_calendar(spark, sf):
    d = panel(spark, sf).select("ts").distinct().withColumn("k", F.lit(0))
    for n, (f, _) in _FREQ.items():
        d = bt.rebalance_calendar(d, f, ["k"]).withColumnRenamed("rebalance_day", n)
    return d.drop("k")


@query(
    "WITH RECURSIVE "
    + ",\n".join(
        [BARS, RETS, PANEL, _DAYS, "nd AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM days)",
         """f AS (SELECT ts, i, true AS hit, ts AS at_ FROM nd WHERE i = 1 UNION ALL
            SELECT n.ts, n.i, n.ts - f.at_ >= 10, CASE WHEN n.ts - f.at_ >= 10 THEN n.ts ELSE f.at_ END FROM f JOIN nd n ON n.i = f.i + 1)"""]
    )
    + " SELECT ts, hit AS rebalance_day FROM f"
)
def rebalance_since_last(spark, sf):
    d = panel(spark, sf).select("ts").distinct().withColumn("k", F.lit(0))
    return bt.rebalance_calendar(d, 10, ["k"], since="rebalance").drop("k")


@query(
    sql(
        """SELECT ts, CAST(k AS INT) AS window_id, CASE WHEN i < k * 63 + 252 THEN 'train' ELSE 'test' END AS role
        FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM days), range(100) t(k)
        WHERE k * 63 < n - 252 AND i >= k * 63 AND i < k * 63 + 252 + 63""",
        BARS, RETS, PANEL, _DAYS,
    )
)
def walk_forward_windows(spark, sf):
    return bt.walk_forward_windows(panel(spark, sf))


# --- positions, ledger and metrics, with recursive SQL

STRATS = [
    Strategy("daily", "proportional", "D", stop_loss=0.05, take_profit=0.5),
    Strategy("weekly", "fixed", "W", fixed_cost=0.00002, max_position=0.3, max_drawdown=0.04),
    Strategy("monthly", "quadratic", "M", leverage=0.9, allow_short=False, cost=0.002, take_profit=0.01),
]


def _strategy_sql(windows):
    p = ", ".join(
        f"('{s.strategy_id}', '{s.rebalance}', '{s.sizing}', {s.leverage}, {s.max_position}, {str(s.allow_short).lower()}, {s.cost + s.slippage}, {s.fixed_cost}, "
        f"{s.stop_loss if s.stop_loss is not None else 'NULL'}, {s.take_profit if s.take_profit is not None else 'NULL'}, {s.max_drawdown if s.max_drawdown is not None else 'NULL'})"
        for s in STRATS
    )
    win = "CASE WHEN d >= 252 THEN (d - 252) // 63 END" if windows else "0"
    g = "PARTITION BY strategy_id, window_id"
    return [
        BARS, RETS, PANEL, _inputs("panel"),
        f"st(strategy_id, freq, sizing, lev, mx, short, rate, fix, sl, tp, mdd) AS (VALUES {p})",
        f"dn AS (SELECT ts, d, {win} AS window_id FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS d FROM (SELECT DISTINCT ts FROM sg)))",
        """r0 AS (SELECT st.*, asset, sg.ts, ret, CASE sizing WHEN 'fixed' THEN sign(coalesce(signal, 0)) WHEN 'quadratic' THEN pow(coalesce(signal, 0), 2) * sign(coalesce(signal, 0)) ELSE coalesce(signal, 0) END AS raw
          FROM sg CROSS JOIN st)""",
        """r1 AS (SELECT *, coalesce(raw / nullif(sum(abs(raw)) OVER (PARTITION BY strategy_id, ts), 0), 0) * lev AS w0 FROM r0)""",
        """r2 AS (SELECT *, least(greatest(CASE WHEN short THEN w0 ELSE greatest(w0, 0) END, -mx), mx) AS w1 FROM r1)""",
        """r3 AS (SELECT *, CASE WHEN sum(abs(w1)) OVER q > lev THEN w1 * lev / sum(abs(w1)) OVER q ELSE w1 END AS target FROM r2 WINDOW q AS (PARTITION BY strategy_id, ts))""",
        f"""cal AS (SELECT *, coalesce(CASE WHEN i = 1 THEN true WHEN freq = 'D' THEN true WHEN freq = 'W' THEN dayofweek(ts) = 1 ELSE month(ts) <> month(lag(ts) OVER ({g} ORDER BY ts)) END, true) AS reb
          FROM (SELECT strategy_id, freq, window_id, ts, row_number() OVER ({g} ORDER BY ts) AS i FROM st CROSS JOIN dn WHERE window_id IS NOT NULL))""",
        """tg AS (SELECT r.strategy_id, c.window_id, asset, r.ts, i, ret, target, reb FROM r3 r JOIN cal c ON c.strategy_id = r.strategy_id AND c.ts = r.ts)""",
        """pos AS (SELECT strategy_id, window_id, asset, ts, i, ret, target AS weight, target AS trade FROM tg WHERE i = 1 UNION ALL
          SELECT t.strategy_id, t.window_id, t.asset, t.ts, t.i, t.ret, CASE WHEN reb AND abs(target - weight) >= 0.002 THEN target ELSE weight END,
            CASE WHEN reb AND abs(target - weight) >= 0.002 THEN target - weight ELSE 0 END
          FROM pos p JOIN tg t ON t.strategy_id = p.strategy_id AND t.window_id = p.window_id AND t.asset = p.asset AND t.i = p.i + 1)""",
        """led AS (SELECT strategy_id, window_id, ts, i, sum(weight * ret) AS r, sum(abs(trade)) AS turnover, CASE WHEN i > 1 THEN count(*) FILTER (abs(trade) > 1e-6) ELSE 0 END AS trades,
            CASE WHEN i > 1 THEN sum(abs(trade)) * any_value(rate) ELSE 0 END AS c, CASE WHEN i > 1 THEN count(*) FILTER (abs(trade) > 1e-6) * any_value(fix) ELSE 0 END AS f,
            any_value(sl) AS sl, any_value(tp) AS tp, any_value(mdd) AS mdd FROM pos JOIN st USING (strategy_id) GROUP BY 1, 2, 3, 4)""",
        """eq AS (SELECT strategy_id, window_id, ts, i, r, turnover, trades, c, f, sl, tp, mdd, 1 + r AS v, greatest(1.0, 1 + r) AS peak, CAST(0 AS DOUBLE) AS cost, false AS stopped,
            CASE WHEN (1 + r) / greatest(1.0, 1 + r) - 1 <= -sl THEN 'stop_loss' WHEN r >= tp THEN 'take_profit' WHEN (1 + r) / greatest(1.0, 1 + r) - 1 <= -mdd THEN 'max_drawdown' END AS why FROM led WHERE i = 1 UNION ALL
          SELECT strategy_id, window_id, ts, i, r, turnover, trades, c, f, sl, tp, mdd, v, greatest(p, v), cost, was,
            CASE WHEN was THEN why0 WHEN v / greatest(p, v) - 1 <= -sl THEN 'stop_loss' WHEN v - 1 >= tp THEN 'take_profit' WHEN v / greatest(p, v) - 1 <= -mdd THEN 'max_drawdown' END
          FROM (SELECT l.strategy_id, l.window_id, l.ts, l.i, CASE WHEN e.why IS NOT NULL THEN 0 ELSE l.r END AS r, CASE WHEN e.why IS NOT NULL THEN 0 ELSE l.turnover END AS turnover,
                  CASE WHEN e.why IS NOT NULL THEN 0 ELSE l.trades END AS trades, l.c, l.f, l.sl, l.tp, l.mdd, e.peak AS p, e.why AS why0, e.why IS NOT NULL AS was,
                  CASE WHEN e.why IS NOT NULL THEN e.v ELSE (e.v * (1 - l.c) - l.f) * (1 + l.r) END AS v, CASE WHEN e.why IS NOT NULL THEN 0 ELSE e.v * l.c + l.f END AS cost
                FROM eq e JOIN led l ON l.strategy_id = e.strategy_id AND l.window_id = e.window_id AND l.i = e.i + 1))""",
    ]


def _bt_sql(select, windows=False):
    return "WITH RECURSIVE " + ",\n".join(_strategy_sql(windows)) + "\n" + select


def _backtest(spark, sf, windows=None):
    r = returns_of(panel(spark, sf))
    return bt.run_backtest(r, signals_of(r), STRATS, windows=windows)


@query(
    _bt_sql(
        f"""SELECT strategy_id, CAST(window_id AS INT) AS window_id, asset, pos.ts, {rnd('CASE WHEN stopped THEN 0 ELSE weight END')} AS weight
        FROM pos JOIN (SELECT strategy_id, window_id, ts, lag(why) OVER (PARTITION BY strategy_id, window_id ORDER BY ts) IS NOT NULL AS stopped FROM eq) USING (strategy_id, window_id, ts)"""
    )
)
def backtest_positions(spark, sf):
    return rounded(_backtest(spark, sf).positions)


LEDGER = f"""SELECT strategy_id, CAST(window_id AS INT) AS window_id, ts, {rnd('r')} AS ret, {rnd('turnover')} AS turnover, trades, {rnd('v')} AS equity, {rnd('v / peak - 1')} AS drawdown FROM eq"""


@query(_bt_sql(LEDGER))
def backtest_ledger(spark, sf):
    d = _backtest(spark, sf).ledger.select("strategy_id", "window_id", "ts", "ret", "turnover", "trades", "equity", "drawdown")
    return rounded(d)


@query(_bt_sql(LEDGER, True))
def walk_forward_ledger(spark, sf):
    d = _backtest(spark, sf, (252, 63)).ledger.select("strategy_id", "window_id", "ts", "ret", "turnover", "trades", "equity", "drawdown")
    return rounded(d)


@query(
    _bt_sql(
        "SELECT strategy_id, CAST(window_id AS INT) AS window_id, min(ts) AS stop_ts, min_by(why, ts) AS stop_reason FROM eq WHERE why IS NOT NULL GROUP BY 1, 2", True
    )
)
def backtest_stops(spark, sf):
    d = _backtest(spark, sf, (252, 63)).stops
    return d.select("strategy_id", "window_id", "stop_ts", F.regexp_extract("stop_reason", "^(.*)_triggered", 1).alias("stop_reason"))


LOG = f"""SELECT strategy_id, CAST(window_id AS INT) AS window_id, asset, ts, {rnd('w - lw')} AS change, {rnd('w')} AS weight,
  {rnd('CASE WHEN i > 1 AND NOT stopped THEN lv * abs(w - lw) * rate + CASE WHEN abs(w - lw) > 1e-6 THEN fix ELSE 0 END ELSE 0 END')} AS cost
  FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY strategy_id, window_id, asset ORDER BY ts), 0) AS lw FROM (
    SELECT p.strategy_id, p.window_id, asset, p.ts, p.i, stopped, lv, CASE WHEN stopped THEN 0 ELSE weight END AS w FROM pos p JOIN (
      SELECT strategy_id, window_id, ts, lag(v) OVER g AS lv, lag(why) OVER g IS NOT NULL AS stopped FROM eq WINDOW g AS (PARTITION BY strategy_id, window_id ORDER BY ts)) e
    ON e.strategy_id = p.strategy_id AND e.window_id = p.window_id AND e.ts = p.ts)) JOIN st USING (strategy_id) WHERE w <> lw"""


@query(_bt_sql(LOG))
def backtest_trades(spark, sf):
    """Every change of weight with its cost."""
    return rounded(_backtest(spark, sf).trades)


@query(_bt_sql(LOG, True))
def walk_forward_trades(spark, sf):
    return rounded(_backtest(spark, sf, (252, 63)).trades)


LOSING = 4


def losing_streak(rows, state):
    """Stop on the fourth losing date in a row; the state is the streak so far."""
    flags, streak = [], state or 0
    for r in rows["ret"]:
        streak = streak + 1 if r < 0 else 0
        flags.append(streak >= LOSING)
    return flags, f"{LOSING}_losses", streak


@query(
    _bt_sql(
        f"""SELECT strategy_id, CAST(window_id AS INT) AS window_id, min(ts) AS stop_ts, min_by(reason, epoch(ts) * 2 + own) AS stop_reason FROM (
        SELECT strategy_id, window_id, ts, why AS reason, 0 AS own FROM eq WHERE why IS NOT NULL UNION ALL
        SELECT strategy_id, window_id, ts, 'custom_risk_management_{LOSING}_losses', 1 FROM (
          SELECT *, count(*) FILTER (r < 0) OVER (PARTITION BY strategy_id, window_id ORDER BY ts ROWS {LOSING - 1} PRECEDING) AS bad FROM led) WHERE bad = {LOSING}) GROUP BY 1, 2""",
        True,
    )
)
def backtest_stop_function(spark, sf):
    """A user's stop function with its own state beside the built-in rules."""
    r = returns_of(panel(spark, sf))
    d = bt.run_backtest(r, signals_of(r), STRATS, windows=(252, 63), stop=losing_streak).stops
    return d.select("strategy_id", "window_id", "stop_ts", F.regexp_replace("stop_reason", "_triggered.*", "").alias("stop_reason"))


def _metrics_sql(key):
    return f"""SELECT {key}, {rnd('tot')} AS total_return, {rnd('ar')} AS annualized_return, {rnd('av')} AS annualized_volatility, {rnd('(ar - 0.02) / av')} AS sharpe_ratio, {rnd('mdd')} AS max_drawdown,
    {rnd('ar / abs(mdd)')} AS calmar_ratio, n AS total_periods, pos AS positive_periods, {rnd('pos / n')} AS win_rate FROM (
    SELECT *, pow(1 + tot, 252 / n) - 1 AS ar FROM (SELECT {key}, max_by(v, ts) / min_by(v, ts) - 1 AS tot, count(*) AS n, stddev_samp(r) * sqrt(252) AS av, count(*) FILTER (r > 0) AS pos, min(v / top - 1) AS mdd
    FROM (SELECT *, max(v) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM eq) GROUP BY {key}))"""


@query(_bt_sql(_metrics_sql("strategy_id")))
def backtest_metrics(spark, sf):
    m = _backtest(spark, sf).metrics
    return rounded(m.drop("window_id", "total_transaction_costs", "total_trades", "avg_transaction_cost", "turnover_ratio"))


@query(_bt_sql(_metrics_sql("strategy_id"), True))
def walk_forward_metrics(spark, sf):
    """The windows of a walk-forward run as one curve."""
    return rounded(bt.backtest_metrics(_backtest(spark, sf, (252, 63)).ledger, key=["strategy_id"]))


@query(
    _bt_sql(
        f"""SELECT strategy_id, {rnd('sum(cost)')} AS total_transaction_costs, CAST(sum(trades) AS BIGINT) AS total_trades, {rnd('avg(cost)')} AS avg_transaction_cost, {rnd('sum(turnover) / count(*)')} AS turnover_ratio FROM eq GROUP BY 1"""
    )
)
def cost_metrics(spark, sf):
    return rounded(bt.cost_metrics(_backtest(spark, sf).ledger).drop("window_id"))


@query(
    _bt_sql(
        f"""SELECT strategy_id, {rnd('max_by(v, ts) / min_by(v, ts) - 1')} AS total_return, {rnd('stddev_samp(chg) * sqrt(252)')} AS annualized_volatility, {rnd('min(v / top - 1)')} AS max_drawdown,
        {rnd('pow(max_by(v, ts) / min_by(v, ts), 252 / count(chg)) - 1')} AS annualized_return,
        {rnd('(pow(max_by(v, ts) / min_by(v, ts), 252 / count(chg)) - 1 - 0.02) / (stddev_samp(chg) * sqrt(252))')} AS sharpe_ratio
        FROM (SELECT *, v / lag(v) OVER w - 1 AS chg, max(v) OVER (PARTITION BY strategy_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS top FROM eq WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)) GROUP BY 1"""
    )
)
def equity_metrics(spark, sf):
    return rounded(bt.equity_metrics(_backtest(spark, sf).ledger).drop("window_id"))


@query(
    _bt_sql(
        """SELECT strategy_id, ts, coalesce(n >= 10 AND bad >= 4, false) AS consecutive_losses, coalesce(n >= 10 AND chg < -0.05, false) AS extreme_daily_loss FROM (
        SELECT *, count(*) FILTER (chg < -0.01) OVER (PARTITION BY strategy_id ORDER BY ts ROWS 4 PRECEDING) AS bad FROM (
        SELECT *, row_number() OVER w AS n, v / lag(v) OVER w - 1 AS chg FROM eq WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)))"""
    )
)
def loss_rules(spark, sf):
    d = bt.loss_rules(_backtest(spark, sf).ledger)
    return d.select("strategy_id", "ts", "consecutive_losses", "extreme_daily_loss")


@query(
    _bt_sql(
        f"""SELECT strategy_id, {rnd('avg(g)')} AS mean_exposure, {rnd('avg(a)')} AS mean_active FROM (
        SELECT strategy_id, ts, sum(abs(weight)) AS g, count(*) FILTER (weight <> 0) AS a FROM pos GROUP BY 1, 2) GROUP BY 1"""
    )
)
def exposure(spark, sf):
    free = [Strategy(**{**s.__dict__, "stop_loss": None, "take_profit": None, "max_drawdown": None}) for s in STRATS]
    r = returns_of(panel(spark, sf))
    return rounded(bt.exposure(bt.run_backtest(r, signals_of(r), free).positions).drop("window_id"))


@query(
    sql(
        f"""SELECT k, {rnd('avg(c)')} AS avg_confidence, count(*) FILTER (c < 0.5) AS low_confidence_periods, count(*) FILTER (c > 0.8) AS high_confidence_periods
        FROM (SELECT 0 AS k, ts, avg(confidence) AS c FROM cf GROUP BY ts) JOIN (SELECT ts, lag(ts) OVER (ORDER BY ts) IS NULL OR dayofweek(ts) = 1 AS reb FROM days) USING (ts) WHERE reb GROUP BY k""",
        BARS, RETS, PANEL, _DAYS, _inputs("panel"),
    )
)
def backtest_confidence_metrics(spark, sf):
    r = returns_of(panel(spark, sf))
    cal = bt.rebalance_calendar(r.select("ts").distinct().withColumn("k", F.lit(0)), "W", ["k"])
    return rounded(bt.confidence_metrics(cal, confidence_of(r), key=["k"]))


@query("SELECT event_id, event_id % 4 AS state, CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN CAST(0.1 AS DOUBLE) ELSE 0.5 END AS confidence FROM events")
def confidence_map(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") % 4).alias("state"))
    return rounded(bt.confidence_map(e))


@query(
    sql(
        f"""SELECT strategy, {rnd('avg(ret) * 252')} AS annual_return, {rnd('stddev_samp(ret) * sqrt(252)')} AS annual_vol, {rnd('avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252)')} AS sharpe,
        {rnd('any_value(dd)')} AS max_drawdown, {rnd('quantile_cont(ret, 0.05)')} AS var_95 FROM pf JOIN (SELECT strategy, min(cum / peak - 1) AS dd FROM (
          SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (
          SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM pf)) GROUP BY 1) USING (strategy) GROUP BY 1""",
        BARS, RETS, PANEL, _inputs("panel"),
        """pf AS (SELECT 'Equal-weight long-only' AS strategy, ts, avg(ret) AS ret FROM br GROUP BY ts UNION ALL
          SELECT 'Naive momentum (20-day)', ts, avg(ret) FROM (
            SELECT ts, ret, row_number() OVER (PARTITION BY ts ORDER BY p DESC, asset) AS rn, count(*) OVER (PARTITION BY ts) AS n FROM (
              SELECT asset, ts, ret, count(*) OVER w AS c, product(1 + ret) OVER w - 1 AS p FROM br
              WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE c = 20)
          WHERE rn <= n // 2 GROUP BY ts)""",
    )
)
def compare_strategies(spark, sf):
    return rounded(bt.compare_strategies(returns_of(panel(spark, sf))))
