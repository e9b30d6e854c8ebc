"""Edge cases worked out by hand or with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import by, daily, noise, same
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import features as ft
from tidemark.operators import prep, risk, validate
from tidemark.operators import signals as sg
from tidemark.operators.sizing import Strategy, apply_constraints, custom_weights_by_date, size_weights
from tidemark.sources import market


def test_portfolio_checks():
    market.check_portfolio(["A", "B"], "2020-01-01", "2021-01-01", [0.4, 0.6])
    for bad in (dict(assets=[]), dict(weights=[1.0]), dict(weights=[0.5, 0.6]), dict(weights=[-0.5, 1.5]), dict(frequency="Y"), dict(start="")):
        args = dict(assets=["A", "B"], start="2020-01-01", end="2021-01-01") | bad
        with pytest.raises(ValueError):
            market.check_portfolio(**args)


def test_price_column_priority(spark):
    d = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 3.0)], "Date string, `Close X` double, `Adj Close` double, Close double")
    assert market.normalize_columns(d, "X").first()["close"] == 1.0
    assert market.normalize_columns(d.drop("Close X"), "X").first()["close"] == 2.0
    with pytest.raises(ValueError):
        market.normalize_columns(d.select("Date"), "X")


def test_fill_order_and_integrity(spark):
    d = daily(spark, {"a": {"close": [np.nan, 1, np.nan, 3, np.nan]}, "b": {"close": [np.nan] * 5}, "c": {"close": [2.0] * 5}})
    f = prep.fill_all(d, ["close"])
    assert by(f, "close") == [1, 1, 1, 3, 3] and by(f, "close", "b") == [0.0] * 5
    ok = {r["asset"]: r["ok"] for r in prep.integrity_check(f).collect()}
    assert ok == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError):
        prep.assert_integrity(f)


def test_constant_and_short_series(spark):
    d = daily(spark, {"a": {"ret": [0.01] * 30}, "s": {"ret": [0.01, 0.02]}})
    assert by(ft.rsi_wilder(d), "rsi") == [50.0] * 30
    assert by(ft.rsi_sma(d), "rsi") == [50.0] * 13 + [0.0] * 17  # no gain over (0 + eps)
    assert set(by(ft.williams_r(d), "williams_r")) == {None} and set(by(ft.bollinger_position(d), "bollinger_position")) == {None}
    assert set(by(ft.rolling_mean(d, n=3), "mean", "s")) == {None}
    up = daily(spark, {"a": {"ret": np.arange(30.0)}})
    assert by(ft.rsi_wilder(up), "rsi")[-1] == 100.0
    e = ft.enhanced_features(d)
    assert e.filter(" or ".join(f"`{c}` is null" for c in e.columns)).count() == 0


def test_drawdown_and_ratios(spark):
    d = daily(spark, {"a": {"ret": [0.1, -0.1, -0.1, 0.05]}, "g": {"ret": [0.01, 0.02, 0.01, 0.02]}}).withColumnRenamed("asset", "portfolio")
    same([r["drawdown"] for r in risk.drawdowns(d).filter("portfolio = 'a'").orderBy("ts").collect()], [0, -0.1, -0.19, -0.1495])
    r = {x["portfolio"]: x for x in risk.ratios(d).collect()}
    assert r["g"]["omega"] == float("inf") and r["g"]["calmar"] == 0.0
    rec = {x["portfolio"]: x["recovery_time"] for x in risk.recovery_time(d).collect()}
    assert rec == {"a": 0.0, "g": 0.0}
    assert {x["portfolio"]: x["max_consecutive_loss"] for x in risk.max_consecutive_loss(d).collect()} == {"a": 2, "g": 0}


def test_tests_against_known_values(spark):
    # t distribution: P(T > 2.015) = 0.05 with 5 degrees of freedom; binomial: P(X >= 8 | 10, 0.5) = 56/1024
    assert abs(validate.t_sf(2.0150483733330233, 5) - 0.05) < 1e-10
    assert abs(validate.binomial_sf(8, 10, 0.5) - 56 / 1024) < 1e-12
    assert validate.binomial_quantile(0.5, 10, 0.5) == 5
    d = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5), (3.0, 0.1)], "a double, b double")
    r = validate.paired_t_test(d, "a", "b").first()
    diff = np.array([1.0, 1.5, 2.9])
    same([r["t_statistic"]], [diff.mean() / (diff.std(ddof=1) / 3**0.5)])
    with pytest.raises(ValueError):
        validate.paired_t_test(d, "a", "b", alternative="other")


def test_no_trade_zone(spark):
    d = daily(spark, {"a": {"weight": [0.1, 0.1015, 0.103, 0.1, 0.2]}})
    d = d.withColumns({"strategy_id": F.lit("s"), "window_id": F.lit(0), "rebalance_day": F.lit(True)})
    assert by(bt.no_trade_zone(d), "weight") == [0.1, 0.1, 0.103, 0.1, 0.2]
    rare = d.withColumn("rebalance_day", F.dayofmonth("ts").isin(1, 4))
    assert by(bt.hold_between_rebalances(rare), "weight") == [0.1, 0.1, 0.1, 0.1, 0.1]


def _ledger(spark, eq, **stops):
    base = dict(stop_loss=None, take_profit=None, max_drawdown=None) | stops
    rows = [("s", 0, dt.date(2020, 1, 1) + dt.timedelta(i), float(v), 1.0, base["stop_loss"], base["take_profit"], base["max_drawdown"]) for i, v in enumerate(eq)]
    d = spark.createDataFrame(rows, "strategy_id string, window_id int, ts date, equity double, cash double, stop_loss double, take_profit double, max_drawdown double")
    return bt.with_drawdown(d)


def test_stops(spark):
    both = bt.stop_rules(_ledger(spark, [2.0, 1.5, 1.0], stop_loss=0.2, take_profit=0.4)).first()
    assert str(both["stop_ts"]) == "2020-01-01" and both["stop_reason"].startswith("take_profit")
    same_day = bt.stop_rules(_ledger(spark, [1.2, 1.1], stop_loss=0.05, take_profit=0.1)).first()
    assert same_day["stop_reason"].startswith("take_profit")  # the first row already makes 20 %
    tie = bt.stop_rules(_ledger(spark, [1.09, 1.0], stop_loss=0.05, max_drawdown=0.05)).first()
    assert tie["stop_reason"] == "stop_loss_triggered_5.0%"
    led = _ledger(spark, [1.0, 0.9, 1.3], stop_loss=0.05)
    cut = bt.truncate_after_stop(led.withColumn("ret", F.lit(0.1)), bt.stop_rules(led)).orderBy("ts").collect()
    assert [r["equity"] for r in cut] == [1.0, 0.9, 0.9] and [r["ret"] for r in cut] == [0.1, 0.1, 0.0]
    loss = bt.loss_rules(_ledger(spark, [1.0] * 8 + [0.98, 0.96, 0.94, 0.92, 0.8])).orderBy("ts").collect()
    assert [r["consecutive_losses"] for r in loss][-2:] == [True, True] and loss[-1]["extreme_daily_loss"]
    custom = bt.stop_rules(bt.loss_rules(_ledger(spark, [1.0] * 10 + [0.9])), F.col("extreme_daily_loss"), "extreme_daily_loss").first()
    assert custom["stop_reason"] == "custom_risk_management_extreme_daily_loss"


def test_equity_with_fixed_costs_and_total_loss(spark):
    r, c, f = [0.1, -1.0, 0.2, 0.05], [0.0, 0.01, 0.0, 0.02], [0.0, 0.001, 0.002, 0.0]
    v, want = 1.0, []
    for a, b, k in zip(r, c, f):
        v = (v * (1 - b) - k) * (1 + a)
        want.append(v)
    d = daily(spark, {"a": {"ret": r, "cost_rate": c, "fixed": f}}).withColumns({"strategy_id": F.lit("s"), "window_id": F.lit(0), "cash": F.lit(1.0)})
    same(by(bt.equity_curve(d), "equity"), want)


@pytest.fixture(scope="module")
def market_data(spark):
    n = 60
    rets = {a: noise(n, i, 0.02) for i, a in enumerate("abc")}
    sig = {a: noise(n, 10 + i, 1.0) for i, a in enumerate("abc")}
    d = daily(spark, {a: {"ret": rets[a], "signal": sig[a]} for a in "abc"}).cache()
    return pd.DataFrame(rets), pd.DataFrame(sig), d


def _loop(rets, sig, conf, cost=0.0015, fixed=0.0, freq=lambda t, p: True):
    """Plain day loop over the same rules."""
    v, held, out = 1.0, np.zeros(3), []
    days = pd.date_range("2020-01-01", periods=len(rets))
    for i in range(len(rets)):
        if i == 0 or freq(days[i], days[i - 1]):
            s = sig.iloc[i].to_numpy()
            w = s / np.abs(s).sum() * np.clip(conf, 0.2, 1)
            w = np.clip(w, -0.5, 0.5)
            if np.abs(w).sum() > 1:
                w = w / np.abs(w).sum()
            if i:
                w = np.where(np.abs(w - held) < 0.002, held, w)
                move = np.abs(w - held)
                v -= move.sum() * cost * v + (move > 1e-6).sum() * fixed
            held = w
        v *= 1 + (held * rets.iloc[i].to_numpy()).sum()
        out.append(v)
    return out


def test_backtest_against_day_loop(market_data):
    rets, sig, d = market_data
    conf = d.select("asset", "ts").withColumn("confidence", F.lit(0.9))
    s = Strategy("s", "regime_confidence", "M", max_position=0.5, fixed_cost=0.0001)
    t = bt.run_backtest(d.select("asset", "ts", "ret"), d.select("asset", "ts", "signal"), [s], confidence=conf)
    got = [r["equity"] for r in t.ledger.orderBy("ts").collect()]
    same(got, _loop(rets, sig, 0.9, fixed=0.0001, freq=lambda a, b: a.month != b.month))
    daily_ = bt.run_backtest(d.select("asset", "ts", "ret"), d.select("asset", "ts", "signal"), [Strategy("s", "regime_confidence", "D", max_position=0.5)], confidence=conf)
    same([r["equity"] for r in daily_.ledger.orderBy("ts").collect()], _loop(rets, sig, 0.9))
    assert daily_.positions.groupBy("ts").agg(F.sum(F.abs("weight")).alias("g")).filter("g > 1 + 1e-9").count() == 0


def test_lag_and_custom_stop(market_data):
    _, _, d = market_data
    r, s = d.select("asset", "ts", "ret"), d.select("asset", "ts", "signal")
    t = bt.run_backtest(r, s, [Strategy("s", rebalance="D")], lag=1, stop=F.col("equity") < 10.0, stop_reason="always")
    assert t.stops.first()["stop_reason"] == "custom_risk_management_always"
    first = t.positions.filter("ts = '2020-01-01'").agg(F.sum(F.abs("weight"))).first()[0]
    assert first == 0.0


def test_constraints_and_custom_sizing(market_data):
    _, _, d = market_data
    s = d.select("asset", "ts", "signal")
    w = apply_constraints(size_weights(s, [Strategy("s", max_position=0.3, allow_short=False, leverage=0.5)]))
    r = w.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert r["lo"] >= 0 and r["hi"] <= 0.3
    own = custom_weights_by_date(s.withColumn("strategy_id", F.lit("s")), lambda pdf: pdf["signal"] * 0 + 0.1)
    assert own.agg(F.avg("weight")).first()[0] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        Strategy("s", "unknown")
    assert Strategy("s", stop_loss=-0.1).stop_loss == 0.1 and Strategy("s", max_position=3).max_position == 1.0


def test_ridge_matches_leave_one_out(spark):
    rng = np.random.default_rng(5)
    n = 80
    x = rng.normal(size=(n, 5))
    y = x @ np.array([0.5, 0, -0.2, 0, 0.1]) + rng.normal(0, 1, n)
    rows = [("a", "Default", *map(float, r), float(v)) for r, v in zip(x, y)] + [("b", "Default", *map(float, x[0]), 1.0)]
    d = spark.createDataFrame(rows, "asset string, label string, " + ", ".join(f"`{c}` double" for c in sg.COMPONENTS) + ", y double")
    alphas = np.logspace(-4, 3, 20)
    xc, yc = x - x.mean(0), y - y.mean()
    best = []
    for a in alphas:
        h = xc @ np.linalg.solve(xc.T @ xc + a * np.eye(5), xc.T) + 1 / n
        best.append((((yc - (h - 1 / n) @ yc) / (1 - np.diag(h))) ** 2).mean())
    a = alphas[int(np.argmin(best))]
    m = sg.ridge_models(d, "y", alphas=alphas).collect()
    assert len(m) == 1 and m[0]["alpha"] == pytest.approx(a)
    same(m[0]["coef"], np.linalg.solve(xc.T @ xc + a * np.eye(5), xc.T @ yc), 1e-8)
    p = sg.ridge_meta_blend(d, "y", alphas=alphas)
    assert p.filter("asset = 'b'").first()["meta"] == 0.0


def test_feature_check_and_overlay(spark):
    d = daily(spark, {"a": {"returns": noise(30), "price": noise(30) + 100}})
    assert {"momentum_20d", "realized_volatility", "bollinger_position"} <= set(sg.feature_check(d).columns)
    with pytest.raises(ValueError):
        sg.feature_check(d.drop("returns"))
    assert sg.non_numeric(d.withColumn("t", F.lit("x"))) == ["t"]
    with pytest.raises(ValueError):
        sg.generate_signals(d.withColumn("t", F.lit("x")), d.withColumnRenamed("returns", "ret"))
    s = daily(spark, {"a": {"signal": [1.0, 1.0, 1.0], "returns": [0.1, -0.2, 0.05]}}).withColumn("label", F.lit("x"))
    got = by(sg.risk_overlay(s, mode="corrected"), "signal")
    same(got, [1.0, 1.0, 1.0])  # a drawdown gives 1 - dd > 1, which is cut at 1


def test_windows_cover_each_test_date_once(spark):
    d = daily(spark, {"a": {"x": np.zeros(400)}})
    w = bt.walk_forward_windows(d, 100, 30)
    t = w.filter("role = 'test'")
    assert t.count() == t.select("ts").distinct().count() == 300
    assert w.filter("role = 'train'").groupBy("window_id").count().filter("count != 100").count() == 0
    f = prep.time_series_folds(d, 5)
    assert f.filter("role = 'test'").groupBy("fold").count().filter("count != 66").count() == 0
