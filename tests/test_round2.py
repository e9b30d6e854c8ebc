"""Whole results on inputs that the catalogue does not hold."""

import numpy as np
import pandas as pd
import pytest
from helpers import by, daily, noise, same
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import features, hmm, resample


def test_short_series_stay(spark):
    d = daily(spark, {"long": {"ret": noise(90)}, "short": {"ret": noise(25, 1)}})
    got = hmm.regimes_per_series(d, ["ret"], k=3).groupBy("asset", "converged").agg(F.count("*").alias("n"), F.count("label").alias("known")).collect()
    assert {(r["asset"], r["converged"], r["n"], r["known"]) for r in got} == {("long", True, 90, 90), ("short", True, 25, 25)}


def test_bootstrap_panel_stays_whole(spark):
    bad = noise(60)
    bad[30] = -1.5
    d = daily(spark, {"a": {"ret": bad}, "b": {"ret": noise(60, 1)}})
    steps = resample.block_bootstrap(d, 20, 100).groupBy("sim_id", "step").count()
    assert steps.filter("count <> 2").count() == 0 and steps.count() == 2000


def test_ewm_of_a_level_and_of_span_one(spark):
    x = 1e8 + np.array([0.01, -0.01, 0.01, 0.02, -0.02, 0.0, 0.01])
    d = daily(spark, {"a": {"x": x}})
    got = features.ewm(d, {"s": ("std", "x", 3), "one": ("mean", "x", 1), "w": ("wilder", "x", 1), "none": ("std", "x", 1)})
    same(by(got, "s")[1:], pd.Series(x - 1e8).ewm(span=3).std().to_numpy()[1:], 1e-6)
    same(by(got, "one"), x)
    same(by(got, "w"), x)
    assert by(got, "none") == [None] * 7


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
