"""Steps whose shuffles, memory or time once grew faster than the input."""

import numpy as np
import pandas as pd
import pytest
from helpers import daily
from pyspark.sql import functions as F

from tidemark.catalog import backtest, signals
from tidemark.catalog.stream import stream_params
from tidemark.operators import cross, resample
from tidemark.plans import pairs
from tidemark.plans import timemajor as tm
from tidemark.streaming import regimes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    x = {f"s{i:02d}": np.where(rng.random(60) < 0.2, np.nan, rng.normal(size=60)) for i in range(11)}
    return pd.DataFrame(x), daily(spark, {a: {"ret": v} for a, v in x.items()}).dropna()


def test_correlations_of_many_blocks_shuffle_no_pairs(gappy, monkeypatch):
    x, d = gappy
    monkeypatch.setattr(pairs, "WIDE", 3)
    monkeypatch.setattr(pairs, "STRIP", 2)
    c = cross.correlation(d)
    assert "CartesianProduct" in plan(c) and "Exchange" not in plan(c)
    got, want, k = c.toPandas(), x.corr(), x.notna().astype(int)
    assert len(got) == 121 and not got.duplicated(["a", "b"]).any()
    for r in got.itertuples():
        assert r.corr == pytest.approx(want.loc[r.a, r.b], abs=1e-9) and r.n == (k[r.a] * k[r.b]).sum()


def test_strong_pairs_copy_no_series_per_block(gappy):
    _, d = gappy
    p = plan(cross.strong_pairs(d, 0.1, block=2))
    assert "CartesianProduct" in p and "Exchange" not in p
    assert plan(cross.strong_pairs(d, 0.1, top=2, block=2)).count("MapInArrow") == 1  # pairs are found once


def test_poisson_intervals_of_bounded_series_shuffle_no_resamples(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = {f"s{i}": {"ret": np.where(rng.random(40 - i) < 0.1, np.nan, rng.normal(0.1, 1, 40 - i))} for i in range(4)} | {"none": {"ret": np.full(30, np.nan)}, "flat": {"ret": np.ones(30)}}
    d = daily(spark, x)
    monkeypatch.setattr(resample, "WEIGHTS", 500)  # several blocks of positions
    for metric in ("mean", "sharpe", "ir"):
        got = resample.bootstrap_interval(d, metric, "ret", 50, ["asset"], method="poisson")
        each = resample.bootstrap(d, metric, "ret", 50, ["asset"], method="poisson")  # a row per resample
        want = each.groupBy("asset").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
        want = {r["asset"]: r["q"] or [None, None] for r in want.collect()}
        rows = {r["asset"]: [r["lower"], r["upper"]] for r in got.collect()}
        assert set(rows) == set(want)
        for a, ends in want.items():
            assert rows[a] == (ends if None in ends else pytest.approx(ends, rel=1e-9, abs=1e-7)), (metric, a)
        assert plan(got).split("MapInArrow")[0].count("Exchange") == 0


class Cell:
    """A state variable of a processor, kept in the test."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update


def updates(n, piece, monkeypatch):
    monkeypatch.setattr(regimes, "OUT_ROWS", 100, raising=False)
    at, x = np.random.default_rng(2).permutation(n), np.random.default_rng(3).normal(size=n)
    p = regimes.RegimeUpdate(stream_params(), ["event_type"], 5, 0.6, 0.7, 10)
    p.state, p.past = Cell(), Cell()

    def rows():
        for i in range(0, n, piece):
            ts = [pd.NaT if j == 7 else pd.Timestamp(int(j) // 2 * 2, unit="us") for j in at[i : i + piece]]  # half of them repeat a time
            yield pd.DataFrame({"event_type": "a", "ts": pd.Series(ts, dtype="M8[ns]"), "x": [[v] for v in x[i : i + piece]]})

    return list(p.handleInputRows(("a",), rows(), None)), p


def test_regime_updates_leave_a_task_piece_by_piece(monkeypatch):
    frames, p = updates(1000, 90, monkeypatch)
    assert max(map(len, frames)) <= 100 and len(frames) > 4
    d = pd.concat(frames)
    assert d["ts"].is_monotonic_increasing and d["ts"].is_unique and len(d) == 500 - 4
    assert p.state.value[3] == 500 and p.state.value[2] == 500 and len(p.past.value) == 10
    whole, _ = updates(1000, 1000, monkeypatch)
    pd.testing.assert_frame_equal(d.reset_index(drop=True), pd.concat(whole).reset_index(drop=True))


def test_expected_sums_of_spans_of_time_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    s = tm.Stack.of([rng.normal(size=(n, 2)) for n in (9, 9, 7, 2, 1)])
    one = tm.Models(np.array([0.2, 0.8]), np.array([[0.7, 0.3], [0.4, 0.6]]), rng.normal(size=(2, 2)), np.array([np.eye(2), 2 * np.eye(2)]))
    many = tm.Models.same(one, 5)
    own = tm.Models(*[a.copy() for a in (many.start, many.trans, many.means, many.covs)])
    ends = tm.Ends(np.log(rng.random((5, 2))), np.log(rng.random((5, 2))), np.array([True, False, True, False, True]))
    whole = tm.expected(s, many, ends)
    for cells in (1, 10, 15):
        monkeypatch.setattr(tm, "CELLS", cells)
        for m in (many, own):
            got = tm.expected(s, m, ends)
            for c in tm.SUMS:
                np.testing.assert_allclose(got[c], whole[c], rtol=1e-12, atol=1e-12)


def test_blends_and_sizes_take_their_returns_from_one_pass(spark, sf):
    for q in (signals.QUERIES["regime_blend"], backtest.QUERIES["size_regime_confidence"]):
        assert "parquet" not in plan(q(spark, sf))
