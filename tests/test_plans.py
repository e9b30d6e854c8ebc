"""Chunked plans give what keyed plans give; ranks, quantiles and pair sums are exact whatever the skew."""

import numpy as np
import pandas as pd
import pytest
from helpers import by, daily, noise, same, stamped
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.draws import uniform
from tidemark.operators import cross, features, prep, regime
from tidemark.plans import pairs, ranks
from tidemark.plans.series import long_series, number_rows, ranged, recurrence, running, series


@pytest.fixture(scope="module")
def df(spark):
    x = noise(300)
    x[[0, 7, 8, 150]] = np.nan
    return daily(spark, {"a": {"ret": x}, "b": {"ret": noise(40, 1)}}).cache()


@pytest.mark.parametrize("chunk", [25, 64, 1000])
def test_rolling_in_chunks(df, chunk):
    def run(d, **kw):
        s = series(d, ["asset"], lookback=20, lookahead=2, **kw)
        return s.add({"m": R.mean(s, "ret", 21), "s": R.std(s, "ret", 5), "k": R.kurt(s, "ret", 8), "n": F.lead("ret", 2).over(s.ordered())})

    a, b = run(df), run(stamped(df), chunk_rows=chunk)
    assert b.count() == df.count()
    for c in ("m", "s", "k", "n"):
        for asset in "ab":
            same(by(b, c, asset), [np.nan if v is None else v for v in by(a, c, asset)])
    ref = pd.Series([np.nan if v is None else v for v in by(df, "ret")])
    same(by(a, "m"), ref.rolling(21).mean())
    same(by(a, "k"), ref.rolling(8).kurt(), 1e-6)


@pytest.mark.parametrize("chunk", [7, 50])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_in_chunks(df, chunk, reverse):
    items = {"s": ("sum", "ret"), "p": ("product", 1 + F.col("ret")), "x": ("max", "ret"), "i": ("min", "ret"), "l": ("last", "ret")}
    a = running(df, ["asset"], items, reverse=reverse)
    b = running(stamped(df), ["asset"], items, reverse=reverse, chunk_rows=chunk)
    for c in items:
        same(by(b, c), [np.nan if v is None else v for v in by(a, c)])


def test_long_series_numbers_once(df):
    d = long_series(stamped(df), ["asset"])
    out = running(d, ["asset"], {"s": ("sum", "ret")}, chunk_rows=30)
    assert by(out, "_seq") == list(range(300))
    assert by(number_rows(stamped(df), ["asset"], chunked=True), "_seq") == list(range(300))


def hot(spark, n=4000):
    """Nine tenths of the rows in one key and one day, microseconds apart; a NULL key; shuffled."""
    rng = np.random.default_rng(3)
    keys = np.where(np.arange(n) % 10 > 0, "hot", np.array(["a", "b", None], dtype=object)[np.arange(n) % 3])
    us = np.where(keys == "hot", 10**15 + np.arange(n), 10**15 + 86_400_000_000 * np.arange(n))
    pdf = pd.DataFrame({"asset": keys, "us": us, "ret": rng.normal(size=n)}).sample(frac=1, random_state=1)
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "asset string, us long, ret double")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "long", "double"])
def test_positions_of_a_hot_key_and_day(spark, kind):
    pdf, raw = hot(spark)
    ts = {"timestamp": "timestamp_micros(us)", "timestamp_ntz": "cast(timestamp_micros(us) AS timestamp_ntz)", "long": "us * 1000", "double": "us / 7.0D"}[kind]
    d = raw.repartition(7).selectExpr("asset", f"{ts} AS ts", "us", "ret")
    got = number_rows(d, ["asset"]).toPandas()
    want = pdf.assign(pos=pdf.groupby("asset", dropna=False)["us"].rank().astype(int) - 1).set_index("us")
    assert len(got) == len(pdf) and (got.set_index("us")["_seq"].sort_index() == want["pos"].sort_index()).all()
    s = series(d, ["asset"], lookback=3, chunk_rows=500)
    got = s.add({"m": F.sum("ret").over(s.rows(3))}).toPandas().set_index("us")["m"].sort_index()
    flat = pdf.sort_values("us").groupby("asset", dropna=False)["ret"].rolling(3, min_periods=1).sum()
    same(got, flat.droplevel(0).reindex(pdf.sort_values("us").index))


def test_hot_key_is_cut_into_even_partitions(spark):
    _, raw = hot(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = ranged(raw, ["asset"], "us").groupBy(F.shiftright("_rp_id", 33)).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(n) == 4 and n.max() < 0.35 * n.sum()


def test_numbering_an_empty_frame(spark):
    d = spark.createDataFrame([], "asset string, ts timestamp, ret double")
    assert number_rows(d, ["asset"]).count() == 0


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_of_hot_groups_and_values(spark, grouped, coalesce):
    """A third of the rows share one value, and most one group; nulls, NaN, both zeros, a NULL group."""
    rng = np.random.default_rng(5)
    n = 3000
    x = np.round(rng.normal(size=n), 2)
    x[rng.random(n) < 0.35] = 0.5
    x[:4] = [np.nan, np.nan, 0.0, -0.0]
    g = np.where(np.arange(n) % 10 > 1, "hot", np.array(["a", None], dtype=object)[np.arange(n) % 2])
    rows = [(a, i, None if i % 97 == 5 else float(v)) for i, (a, v) in enumerate(zip(g, x))]
    d = spark.createDataFrame(rows, "g string, i int, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = ranks.rank_within(d, "x", ["g"] if grouped else []).toPandas().set_index("i").sort_index()
        pos = ranks.value_positions(d, "x", ["g"] if grouped else []).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = {i: (np.inf if v != v else v + 0.0) for _, i, v in rows if v is not None}
    groups = {}
    for a, i, v in rows:
        if v is not None:
            groups.setdefault(a if grouped else 0, []).append(key[i])
    assert len(got) == n
    for a, i, v in rows:
        r = got.loc[i]
        if v is None:
            assert r[["_ties", "_before", "_n"]].isna().all()
            continue
        vs = np.array(groups[a if grouped else 0])
        assert (r["_ties"], r["_before"], r["_n"]) == ((vs == key[i]).sum(), (vs < key[i]).sum(), len(vs))
    assert len(pos) == sum(len(set(v)) for v in groups.values())
    for r in pos:
        vs, v = np.array(groups[r["g"] if grouped else 0]), (np.inf if r["x"] != r["x"] else r["x"] + 0.0)
        assert (r["_ties"], r["_before"], r["_n"]) == ((vs == v).sum(), (vs < v).sum(), len(vs))


def test_ranks_beside_columns_with_short_helper_names(spark):
    """Columns named like a plan's own helpers do no harm."""
    names = ["_up", "_lo", "_hi", "_c", "_t", "_r", "_id", "_part", "_same", "_e", "_v", "_m", "_salt", "_from", "_rows", "_shift"]
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0)], "g string, x double").selectExpr("*", *[f"7 AS {n}" for n in names])
    got = ranks.rank_within(d, "x", ["g"])
    assert got.columns == [*d.columns, "_ties", "_before", "_n"]
    assert sorted((r["x"], r["_ties"], r["_before"], r["_n"], r["_up"]) for r in got.collect()) == [(1.0, 1, 0, 3, 7), (2.0, 2, 1, 3, 7), (2.0, 2, 1, 3, 7)]
    assert sorted(r["_seq"] for r in number_rows(d, ["g"], "x").collect()) == [0, 1, 2]


def test_ranks_of_an_empty_frame(spark):
    d = spark.createDataFrame([], "g string, x double")
    assert ranks.rank_within(d, "x", ["g"]).count() == 0 and ranks.value_positions(d, "x").count() == 0


@pytest.mark.parametrize("block", [None, 13])
def test_recurrence(df, block):
    d = df.fillna(0.0)
    x, a, y, want = by(d, "ret"), 0.8, 0.0, []
    for v in x:
        y = a * y + v
        want.append(y)
    if block is None:
        for form in (d, stamped(d)):
            same(by(recurrence(form, ["asset"], {"y": (a, F.col("ret"))}), "y"), want)
    else:  # a short block is exact only up to a**block
        same(by(recurrence(d, ["asset"], {"y": (0.05, F.col("ret"))}, block=block), "y"), pd.Series(x).ewm(alpha=0.95, adjust=False).mean() * 1, 1)


@pytest.mark.parametrize("form", [lambda d: d, stamped])
def test_ewm_matches_pandas(df, form):
    x = pd.Series([np.nan if v is None else v for v in by(df, "ret")])
    d = features.ewm(form(df), {"m": ("mean", "ret", 12), "s": ("std", "ret", 21), "long": ("mean", "ret", 200)})
    same(by(d, "m"), x.ewm(span=12).mean())
    same(by(d, "s"), x.ewm(span=21).std())
    same(by(d, "long"), x.ewm(span=200).mean())
    z = x.fillna(0.0)
    same(by(features.ewm_wilder(form(df.fillna(0.0)), 14), "ewm_wilder"), z.ewm(alpha=1 / 14, adjust=False).mean())


def test_fills_and_mode_in_chunks(df):
    for f in (prep.ffill, prep.bfill):
        same(by(f(stamped(df), ["ret"], chunk_rows=10), "ret"), [np.nan if v is None else v for v in by(f(df, ["ret"]), "ret")])
    lab = df.withColumn("label", F.when(F.col("ret") > 0, "up").otherwise("down"))
    assert by(regime.smooth_mode(stamped(lab), 3, ["asset"], chunk_rows=20), "label") == by(regime.smooth_mode(lab, 3, ["asset"]), "label")


def test_mode_ties_take_the_smallest(spark):
    d = spark.createDataFrame([("a", i, "ab"[i % 2]) for i in range(8)], "asset string, ts int, label string")
    assert by(regime.smooth_mode(d, 1, ["asset"]), "label") == ["a", "a", "b", "a", "b", "a", "b", "b"]


@pytest.mark.parametrize("share", [0.0, 0.34, 1.0])
def test_quantiles_with_a_hot_value(spark, share):
    x = np.random.default_rng(3).normal(size=2000)
    x[: int(2000 * share)] = 0.25
    d = spark.createDataFrame([("g", float(v)) for v in x] + [("h", None)], "k string, x double")
    got = {r["k"]: r["_q"] for r in ranks.exact_quantiles(d, "x", [0.01, 0.5, 0.975], ["k"]).collect()}
    same(got["g"], np.quantile(x, [0.01, 0.5, 0.975]))
    same(ranks.exact_quantiles(d, "x", [0.3]).first()["_q"], [np.quantile(x, 0.3)])
    r = ranks.rank_within(d, "x", ["k"]).withColumn("r", ranks.average_rank_share())
    want = pd.Series(x).rank(pct=True)
    pdf = r.filter("x is not null").toPandas().sort_values("x")
    same(pdf["r"], want.to_numpy()[np.argsort(x, kind="stable")])


@pytest.mark.parametrize("block", [2, 256])
def test_pair_sums_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    wide = pd.DataFrame({c: noise(800, i) for i, c in enumerate("abcde")})
    wide.iloc[5:20, 1] = np.nan
    d = daily(spark, {c: {"ret": wide[c].to_numpy()} for c in wide})
    want = wide.corr()
    got = cross.correlation(d).collect()
    assert len(got) == 25
    for r in got:
        assert abs(r["corr"] - want.loc[r["a"], r["b"]]) < 1e-9


def test_draws_are_uniform(spark):
    u = spark.range(20000).select(uniform(7, F.col("id"), F.col("id") % 100).alias("u")).toPandas()["u"]
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005 and u.between(0, 1, inclusive="left").all()
    assert abs(u.autocorr()) < 0.03


def test_draws_reach_all_places_of_long_series(spark):
    from tidemark.functions.draws import PRIME, pick

    at = spark.range(2000).withColumn("far", F.col("id") + PRIME)
    u = at.select(uniform(7, F.col("id"), F.lit(3)).alias("a"), uniform(7, F.col("far"), F.lit(3)).alias("b"), uniform(7, F.col("id"), F.lit(3 + PRIME)).alias("c")).toPandas()
    assert (u.a != u.b).all() and (u.b != u.c).all() and (u.a != u.c).all()
    n = 1 << 40
    got = at.select(pick(F.lit(n), 7, F.col("id")).alias("p"), pick(F.lit(50), 7, F.col("id")).alias("q"), F.floor(uniform(7, F.col("id")) * 50).alias("r")).toPandas()
    assert got.p.between(0, n - 1).all() and abs(got.p.mean() / n - 0.5) < 0.03 and (got.q == got.r).all()
    assert abs((got.p % 256).mean() - 127.5) < 8 and (got.p % 256).nunique() == 256
    step = got.p - np.floor(np.round(got.p / n * PRIME) * (n / PRIME))
    assert (step.abs() > 1).sum() > 1900  # not only the places of PRIME draws


def test_top_half_ties_by_name(spark):
    d = daily(spark, {c: {"ret": np.full(4, v)} for c, v in {"a": 0.1, "b": 0.1, "c": 0.1, "d": 0.2}.items()})
    got = {(r["asset"], str(r["ts"])) for r in cross.top_half_members(d, 3).collect()}
    assert got == {("d", "2020-01-04"), ("a", "2020-01-04")}
