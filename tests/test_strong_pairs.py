"""Pruned search for strongly correlated series: every pair over the threshold, few pairs of blocks compared."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import stamped
from pyspark.sql import functions as F

from tidemark.operators import cross
from tidemark.plans import strong


@pytest.fixture(scope="module")
def market(spark):
    """Series that follow a market by very different degrees, some against it, copies, a constant, and some with gaps."""
    rng = np.random.default_rng(11)
    t, m = 120, rng.normal(size=120)
    x = {f"s{i:02d}": np.cos(a) * m + np.sin(a) * rng.normal(size=t) * 0.3 for i, a in enumerate(np.linspace(0.0, np.pi, 48))}
    x["twin"], x["mirror"], x["flat"] = x["s05"].copy(), -2 * x["s20"], np.full(t, 0.1)
    for i in range(6):
        x[f"gap{i}"] = np.where(rng.random(t) < 0.3, np.nan, x[f"s{8 * i:02d}"] + rng.normal(size=t) * 0.02)
    x["short"] = np.where(np.arange(t) < 10, m, np.nan)
    rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(i), None if v != v else float(v)) for a, vs in x.items() for i, v in enumerate(vs)]
    rows.append(("s01", dt.date(2020, 1, 1), -99.0))  # repeats a date with a smaller value
    return pd.DataFrame(x), spark.createDataFrame(rows, "asset string, ts date, ret double").repartition(5)


def wanted(x, threshold):
    c, k = x.corr(min_periods=20), x.notna().astype(int)
    n = k.T @ k
    return {(a, b): (c.loc[a, b], n.loc[a, b]) for a in x for b in x if a < b and abs(c.loc[a, b]) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.95])
@pytest.mark.parametrize("block", [4, 256])
def test_no_strong_pair_is_lost(market, threshold, block):
    x, d = market
    got = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in cross.strong_pairs(d, threshold, block=block).collect()}
    want = wanted(x.drop(columns="flat"), threshold)
    assert set(got) == set(want) and any(c < 0 for c, _ in got.values())
    for k, (c, n) in want.items():
        assert got[k] == (pytest.approx(c, abs=1e-9), n)


def test_most_blocks_are_not_compared(spark):
    blocks = spark.createDataFrame([(2 * i, 0.1 * i, 0.1 * i + 0.1) for i in range(30)] + [(1, None, None)], "_blk long, lo double, hi double")
    got = {(r["_p"], r["_q"]) for r in strong.block_pairs(blocks, 0.98).collect()}
    arc = np.arccos(0.98)
    for i in range(30):
        for j in range(i, 30):
            near = max(0.0, 0.1 * (j - i) - 0.1) <= arc
            against = max(0.1 * (i + j) - np.pi, np.pi - 0.1 * (i + j) - 0.2) <= arc
            assert ((2 * i, 2 * j) in got) == (near or against)
    assert sum(1 in p for p in got) == 31 and len(got) < 250


def test_strongest_partners_and_other_orders(market):
    x, d = market
    top = cross.strong_pairs(d, 0.5, top=2, block=8).toPandas()
    want = wanted(x.drop(columns="flat"), 0.5)
    for a, rows in top.sort_values("rank").groupby("asset"):
        mine = sorted(((-round(abs(c), 9), q if p == a else p) for (p, q), (c, _) in want.items() if a in (p, q)))[:2]
        assert sorted(np.round(rows["corr"].abs(), 9), reverse=True) == pytest.approx([-c for c, _ in mine]) and rows["rank"].tolist() == list(range(1, len(mine) + 1))
    full = {(r["a"], r["b"]) for r in cross.strong_pairs(stamped(d), 0.95).collect()}
    assert full == set(wanted(x.drop(columns="flat"), 0.95))


def test_empty_and_single(spark):
    d = spark.createDataFrame([], "asset string, ts date, ret double")
    assert cross.strong_pairs(d, 0.5).count() == 0
    one = spark.range(30).select(F.lit("a").alias("asset"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("ts"), F.rand(1).alias("ret"))
    assert cross.strong_pairs(one, 0.0).count() == 0
