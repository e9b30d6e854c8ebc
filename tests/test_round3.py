"""Weight matrices, draws on both sides, dates with repeated rows."""

import numpy as np
from helpers import daily, noise
from pyspark.sql import functions as F

from tidemark.functions import draws
from tidemark.operators import prep, resample
from tidemark.plans import groups


def test_draws_of_arrays_equal_columns(spark):
    a = [0, 1, 7, draws.PRIME - 1, draws.PRIME, draws.PRIME + 5, 3 * draws.PRIME + 1, 2**40]
    d = spark.createDataFrame([(i, j) for i in a for j in (0, 3, 2**33)], "i long, j long")
    got = d.select("i", "j", draws.uniform(42, F.col("i"), F.col("j")).alias("u"), draws.poisson1(draws.uniform(42, F.col("i"), F.col("j"))).alias("w")).toPandas()
    own = draws.uniform_array(42, got.i.to_numpy(), got.j.to_numpy())
    assert (own == got.u.to_numpy()).all() and (draws.poisson1_array(own) == got.w.to_numpy()).all()


def test_poisson_bootstrap_against_copies_of_rows(spark, monkeypatch):
    """Nulls, a series without a value, a series of one row; blocks of few weights."""
    monkeypatch.setattr(resample, "WEIGHTS", 100)
    x = noise(90)
    x[::7] = np.nan
    d = daily(spark, {"a": {"ret": x}, "none": {"ret": np.full(20, np.nan)}, "one": {"ret": noise(1, 3)}})
    n = 30
    got = {(r["asset"], r["boot_id"]): r["value"] for r in resample.bootstrap(d, "sharpe", "ret", n, ["asset"], method="poisson").collect()}
    for name, v in (("a", x), ("one", noise(1, 3)), ("none", np.full(20, np.nan))):
        w = draws.poisson1_array(draws.uniform_array(42, np.arange(len(v))[:, None], np.arange(n)[None]))
        for b in range(n):
            total = w[:, b].sum()
            if not total:
                assert (name, b) not in got
                continue
            if np.isnan(v).all():
                assert got[name, b] is None
                continue
            mean = np.nansum(v * w[:, b]) / total
            pop = max(np.nansum(v * v * w[:, b]) / total - mean**2, 0)
            want = None if total == 1 else mean / (np.sqrt(pop * total / (total - 1)) + 1e-8) * 252**0.5
            assert (got[name, b] is None) == (want is None) and (want is None or abs(got[name, b] - want) < 1e-6 * max(1, abs(want)))
    assert resample.bootstrap(d.limit(0), "mean", "ret", 5, ["asset"], method="poisson").count() == 0
    pooled = resample.bootstrap(d.filter("asset = 'a'"), "mean", "ret", 5, method="poisson").collect()
    assert len(pooled) == 5


def test_intervals_come_from_one_resample(spark):
    d = daily(spark, {"a": {"ret": noise(60)}}).withColumnRenamed("asset", "portfolio")
    ci = resample.bootstrap_ci(d, 40).first()
    for m in ("sharpe", "var_95", "max_drawdown"):
        b = resample.bootstrap_interval(d, m, "ret", 40, ["portfolio"]).first()
        np.testing.assert_allclose(ci[f"{m}_ci"], [b["lower"], b["upper"]], atol=1e-12)


def test_complete_dates_count_series_not_rows(spark):
    rows = [("a", 1), ("a", 1), ("b", 2), ("a", 2), ("a", 2), ("a", 3), ("b", 3)]
    got = prep.complete_dates(spark.createDataFrame(rows, "asset string, ts int")).groupBy("ts").count().collect()
    assert {(r["ts"], r["count"]) for r in got} == {(2, 3), (3, 2)}


def test_groups_stay_whole_over_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if k == 3 else f"k{k}", i) for k in range(6) for i in range(1 + 5 * k)]
        d = spark.createDataFrame(rows, "key string, i int")

        def run(t, starts):
            return groups.pa.table({"key": t["key"].take(groups.pa.array(starts[:-1])), "n": np.diff(starts), "sorted": [t["i"].to_pylist()[a:b] == list(range(b - a)) for a, b in zip(starts[:-1], starts[1:])]})

        for most in (1, 10, 1000):
            got = groups.map_groups(d, ["key"], ["i"], run, "key string, n long, sorted boolean", rows=most).collect()
            assert {(r["key"], r["n"]) for r in got} == {(None if k == 3 else f"k{k}", 1 + 5 * k) for k in range(6)} and all(r["sorted"] for r in got) and len(got) == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
