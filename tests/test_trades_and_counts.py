"""Trade log, stop functions, users' metrics, state history, counters, summaries and file slices."""

import datetime as dt

import numpy as np
import pytest
from helpers import daily, noise, same
from pyspark.sql import functions as F

from tidemark.catalog import stream as cs
from tidemark.functions import draws
from tidemark.operators import backtest as bt
from tidemark.operators import prep, resample
from tidemark.operators.sizing import Strategy
from tidemark.sources import market
from tidemark.streaming import regimes as sr


@pytest.fixture(scope="module")
def runs(spark):
    r = daily(spark, {a: {"ret": noise(80, i, 0.03)} for i, a in enumerate("abc")})
    s = daily(spark, {a: {"signal": noise(80, 9 + i, 1.0)} for i, a in enumerate("abc")})
    strategies = [Strategy("free", rebalance="W", fixed_cost=0.0001, slippage=0.001), Strategy("stopped", rebalance="D", stop_loss=0.05)]
    return bt.run_backtest(r, s, strategies)


def test_trades_add_up_to_weights_and_costs(runs):
    log, pos = runs.trades.toPandas(), runs.positions.toPandas()
    stops = {r["strategy_id"]: r["stop_ts"] for r in runs.stops.collect()}
    assert set(stops) == {"stopped"}
    for (s, a), p in pos.groupby(["strategy_id", "asset"]):
        p = p.sort_values("ts").reset_index(drop=True)
        change = p.weight.diff().fillna(p.weight)
        mine = log[(log.strategy_id == s) & (log.asset == a)].set_index("ts")["change"]
        assert set(mine.index) == set(p.ts[change != 0])
        same(mine.sort_index(), change[change != 0])
    closing = log[(log.strategy_id == "stopped") & (log.ts > stops["stopped"])]
    assert len(closing) and (closing.weight == 0).all() and (closing.cost == 0).all()
    cost = bt.transaction_cost(runs.ledger).filter("cost > 0").toPandas().set_index(["strategy_id", "ts"])["cost"]
    same(log[log.cost > 0].groupby(["strategy_id", "ts"])["cost"].sum().sort_index(), cost.sort_index())


def _led(spark, values, strategies=("s",)):
    rows = [(s, 0, dt.date(2020, 1, 1) + dt.timedelta(i), float(v), 1.0, 0.5, 9.0, 0.9) for s in strategies for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "strategy_id string, window_id int, ts date, equity double, cash double, stop_loss double, take_profit double, max_drawdown double")
    return bt.with_drawdown(d)


def falling_rule():
    def falling(rows, state):
        """Third fall in a row, by a state of the last equity and the streak."""
        last, n = state or (None, 0)
        flags, reasons = [], []
        for v in rows["equity"]:
            n = n + 1 if last is not None and v < last else 0
            last = v
            flags.append(n >= 3)
            reasons.append(f"fell_{n}")
        return flags, reasons, (last, n)

    return falling  # of no module's top level, so that workers get it by value


falling = falling_rule()


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_stop_function_keeps_its_state_between_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        led = _led(spark, [1, 0.99, 0.98, 1.0, 0.97, 0.96, 0.95, 0.94], ["a", "b"]).unionByName(_led(spark, [1, 0.9, 1, 0.9, 1], ["c"]))
        got = bt.stop_rules(led, falling).orderBy("strategy_id").collect()
        early = bt.stop_rules(_led(spark, [1, 0.9, 0.8, 0.4, 0.3]), falling).first()
        later = bt.stop_rules(_led(spark, [1, 0.9, 0.8, 0.7, 0.3]), falling).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["strategy_id"], str(r["stop_ts"]), r["stop_reason"], r["stop_equity"]) for r in got] == [(s, "2020-01-07", "custom_risk_management_fell_3", 0.95) for s in "ab"]
    assert early["stop_reason"] == "stop_loss_triggered_50.0%"  # on the same date the built-in rule names the reason
    assert later["stop_reason"] == "custom_risk_management_fell_3" and later["stop_equity"] == 0.7


def test_stop_function_on_no_rows_and_on_errors(spark):
    led = _led(spark, [1, 1.1])
    assert bt.stop_function(led.filter("false"), falling).count() == 0
    with pytest.raises(Exception, match="no such rule"):
        bt.stop_function(led, lambda rows, state: (_ for _ in ()).throw(RuntimeError("no such rule"))).collect()


def test_users_metric_equals_weighted_rows(spark, monkeypatch):
    """Against a plain loop over weights; nulls, a series without a value, a series of one row, small blocks."""
    monkeypatch.setattr(resample, "WEIGHTS", 100)
    x = noise(70)
    x[::9] = np.nan
    d = daily(spark, {"a": {"ret": x}, "none": {"ret": np.full(5, np.nan)}, "one": {"ret": [0.25]}})
    m = resample.Metric(lambda v: np.abs(v), lambda w, s: np.where(w > 1, s[:, 0] / w, np.nan))
    got = {(r["asset"], r["boot_id"]): r["value"] for r in resample.bootstrap(d, m, "ret", 40, ["asset"]).collect()}
    for a, v in (("a", x), ("none", np.full(5, np.nan)), ("one", np.array([0.25]))):
        for b in range(40):
            w = draws.poisson1_array(draws.uniform_array(42, np.arange(len(v)), np.full(len(v), b))) * ~np.isnan(v)
            if not w.sum():
                assert (a, b) not in got
            elif w.sum() == 1:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx((w * np.abs(np.nan_to_num(v))).sum() / w.sum())
    flat = resample.bootstrap_interval(d, m, "ret", 40).first()
    assert 0 < flat["lower"] < flat["upper"]
    assert resample.bootstrap(d.filter("false"), m, "ret", 40, ["asset"]).count() == 0


def test_history_is_read_from_the_state(spark, sf):
    sr.use_rocksdb(spark)
    out, state = cs.drained(spark, sr.regime_stream(cs.source(spark, sf), cs.stream_params(), min_rows=10, history=5))
    kept = sr.update_history(spark, state)
    n = {r["event_type"]: r["count"] for r in kept.groupBy("event_type").count().collect()}
    assert set(n.values()) == {5}
    last = {(r["event_type"], r["ts"], r["regime"], r["confidence"]) for r in out.collect()}
    assert {tuple(r) for r in kept.select("event_type", "ts", "regime", "confidence").collect()} <= last
    assert sr.update_history(spark, state, last=2).count() == 2 * len(n)


def test_counters_of_a_stream(spark, sf):
    r = cs.update_counters(spark, sf).first()
    assert r["n"] == spark.read.parquet(f"{sf}/events.parquet").count() and r["written"] == r["n"] - r["failures"] > 0
    with pytest.raises(TimeoutError):
        sr.UpdateCounters().wait(seconds=0.1)


def test_summary_takes_one_row_per_stage(spark):
    one, two = spark.range(1).toDF("n"), spark.range(2).toDF("n")
    assert market.summary_record(a=one, b=one.withColumn("m", F.lit("x"))).first().asDict() == {"a_n": 0, "b_n": 0, "b_m": "x"}
    for bad in (two, two.limit(0)):
        with pytest.raises(Exception, match="stage b has"):
            market.summary_record(a=one, b=bad).collect()


def test_a_large_asset_is_written_by_several_tasks(spark, tmp_path):
    big = spark.range(4000).selectExpr("CASE WHEN id % 10 > 0 THEN 'big' ELSE 'a' || id % 7 END AS asset", "date_add(DATE '2000-01-01', CAST(id AS INT)) AS ts", "CAST(id AS DOUBLE) AS close")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        market.write_bars(big, str(tmp_path / "bars"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "bars" / "asset=big").glob("*.parquet"))) >= 3
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 4000


def test_weights_of_a_frame_are_checked(spark):
    r = daily(spark, {a: {"ret": [0.01, 0.02]} for a in "ab"})
    frame = lambda *w: spark.createDataFrame(list(zip("ab", w)), "asset string, weight double")
    same([x["ret"] for x in prep.weighted_portfolio(r, frame(0.25, 0.75)).orderBy("ts").collect()], [0.01, 0.02])
    for w, text in (((0.5, 0.6), "sum to 1"), ((1.5, -0.5), "lie in"), ((1.0, None), "lie in")):
        with pytest.raises(Exception, match=text):
            prep.weighted_portfolio(r, frame(*w)).collect()
