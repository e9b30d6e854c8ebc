"""Fitted models: queries without SQL, checked by invariants and brute force in the tests; models of given parameters, with SQL."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from tidemark.catalog.base import mrets, panel, rets, rnd, rounded, with_mrets, with_rets
from tidemark.functions import rolling as R
from tidemark.operators import backtest as bt
from tidemark.operators import classify as cl
from tidemark.operators import hmm
from tidemark.operators import regime as rg
from tidemark.plans.series import series
from tidemark.session import checkpoint, work_path

QUERIES, ORACLES = {}, {}
A = ["asset"]
COLS = ["r", "vol", "mom"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def feats(r):
    """Squashed returns, their deviation and mean over 10 rows."""
    r = r.select("asset", "ts", F.tanh("ret").alias("r"))
    s = series(r, A, lookback=9)
    d = s.add({"vol": R.std(s, "r", 10), "mom": R.mean(s, "r", 10)})
    return d.filter("vol is not null")


def fitted(spark, sf):
    f = checkpoint(feats(mrets(spark, sf)))
    return f, hmm.fit_hmm(f, COLS, A, 3)


W10 = "OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
CLEAN = ", ".join(f"greatest(least({c}, h_{c}), l_{c}) AS {c}" for c in COLS)
ORACLES["prepare_regime_features"] = with_mrets(
    "SELECT asset, ts, " + ", ".join(rnd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in COLS) + f" FROM (SELECT asset, ts, {CLEAN} FROM ft, lim)",
    "sq AS (SELECT asset, ts, tanh(ret) AS r FROM rets)",
    f"ft AS (SELECT * FROM (SELECT asset, ts, r, CASE WHEN count(r) {W10} = 10 THEN stddev_samp(r) {W10} END AS vol, CASE WHEN count(r) {W10} = 10 THEN avg(r) {W10} END AS mom FROM sq) WHERE vol IS NOT NULL)",
    "lim AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS l_{c}, quantile_cont({c}, 0.99) AS h_{c}" for c in COLS) + " FROM ft)",
)


@query
def prepare_regime_features(spark, sf):
    d, prep = hmm.prepare_regime_features(feats(mrets(spark, sf)), COLS)
    return rounded(d.select("asset", "ts", *[F.col("x")[i].alias(c) for i, c in enumerate(prep.cols)]))


@query
def kmeans_init(spark, sf):
    d, _ = hmm.prepare_regime_features(feats(mrets(spark, sf)), COLS)
    p = hmm.kmeans_init(checkpoint(d), 3)
    return spark.createDataFrame([(i, *map(float, m)) for i, m in enumerate(p.means)], "state int, " + ", ".join(f"{c} double" for c in COLS))


@query
def fit_hmm(spark, sf):
    _, p = fitted(spark, sf)
    rows = [(i, p.labels[i], float(p.log_likelihood), p.iterations, p.converged, *map(float, p.means[i])) for i in range(p.k)]
    return rounded(spark.createDataFrame(rows, "state int, label string, log_likelihood double, iterations int, converged boolean, " + ", ".join(f"{c} double" for c in COLS)), 3)


@query
def predict_regimes(spark, sf):
    f, p = fitted(spark, sf)
    return hmm.predict_regimes(f, p, 5, A)


@query
def predict_proba(spark, sf):
    f, p = fitted(spark, sf)
    return rounded(hmm.predict_proba(f, p, A).select("asset", "ts", *[F.col("p")[i].alias(f"p{i}") for i in range(3)]), 4)


@query
def information_criteria(spark, sf):
    f, p = fitted(spark, sf)
    return rounded(hmm.information_criteria(f, p, A), 3)


@query
def transition_matrix_model(spark, sf):
    return rounded(hmm.transition_matrix_model(spark, fitted(spark, sf)[1]), 4)


@query
def save_load_hmm(spark, sf):
    """Labels from a model that was written and read back."""
    f, p = fitted(spark, sf)
    path = work_path(spark, "model")
    hmm.save_hmm(spark, p, path)
    return hmm.predict_regimes(f, hmm.load_hmm(spark, path), 5, A).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def regimes_per_asset(spark, sf):
    """One model per supplier series, all in one job."""
    return hmm.regimes_per_series(feats(mrets(spark, sf)), COLS, A)


@query
def walk_forward_confidence(spark, sf):
    d = panel(spark, sf).groupBy("ts").agg(F.avg(F.tanh("ret")).alias("ret")).withColumn("series", F.lit("all"))
    w = bt.walk_forward_windows(d)
    return hmm.walk_forward_confidence(d, w)


@query
def ts_cross_validate(spark, sf):
    return rounded(hmm.ts_cross_validate(feats(rets(spark, sf)), COLS, key=A), 4)


@query
def stability_report(spark, sf):
    f, p = fitted(spark, sf)
    return rounded(hmm.stability_report(f, p, COLS, A, 3), 3)


def _windows(spark, sf):
    """Windows of past rows, labelled by volatility band."""
    r = rets(spark, sf).select("asset", "ts", F.tanh("ret").alias("ret"))
    d = rg.vol_regime(r).filter(F.col("label").isNotNull())
    d = d.withColumn("state", F.when(F.col("label") == "Low Vol", 0).when(F.col("label") == "Medium Vol", 1).otherwise(2))
    return checkpoint(rg.sequence_windows(d, ["ret", "vol"], 20))


@query
def regime_classifier(spark, sf):
    seq = _windows(spark, sf)
    model, _ = cl.fit_regime_classifier(seq, 3)
    p = cl.classifier_proba(seq, model)
    return rounded(p.select("asset", "ts", *[F.col("p")[i].alias(f"p{i}") for i in range(3)]), 3)


@query
def regime_classifier_perceptron(spark, sf):
    seq = _windows(spark, sf)
    model, acc = cl.fit_regime_classifier(seq, 3, hidden=[8])
    return rounded(cl.predict_latest(seq, model).select("asset", "ts", *[F.col("p")[i].alias(f"p{i}") for i in range(3)]), 2)


ORACLES["save_load_classifier"] = with_rets("SELECT asset, count(*) - 40 AS rows, CAST(0 AS BIGINT) AS changed, 20 AS length FROM rets GROUP BY 1 HAVING count(*) > 40")


@query
def save_load_classifier(spark, sf):
    """Probabilities of every window from a classifier that was written and read back, held against those before."""
    seq, path = _windows(spark, sf), work_path(spark, "classifier")
    model, _ = cl.fit_regime_classifier(seq, 3)
    cl.save_classifier(spark, model, path, 20, rg.LABELS)
    again, length, _ = cl.load_classifier(spark, path)
    both = cl.classifier_proba(seq, model).join(cl.classifier_proba(seq, again).withColumnRenamed("p", "q"), ["asset", "ts"])
    return both.groupBy("asset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") != F.col("q")).alias("changed")).withColumn("length", F.lit(length))


@query
def fused_model_labels(spark, sf):
    """Markov probabilities fused with those of the classifier."""
    f = checkpoint(feats(rets(spark, sf)))
    p = hmm.fit_hmm(f, COLS, A, 3)
    seq = checkpoint(rg.sequence_windows(f.join(hmm.predict_regimes(f, p, 5, A).select("asset", "ts", "state"), ["asset", "ts"]), COLS, 20))
    model, _ = cl.fit_regime_classifier(seq, 3)
    return rg.fuse_labels(hmm.predict_proba(f, p, A), cl.classifier_proba(seq, model), key=A)


@query
def vol_forecast_interval(spark, sf):
    r = rets(spark, sf).select("asset", "ts", F.tanh("ret").alias("ret"))
    s = series(r, A, lookback=9)
    d = s.add({"vol": R.std(s, "ret", 10)}).filter("vol is not null")
    return rounded(cl.vol_forecast_interval(rg.sequence_windows(d, ["vol"], 5), "vol", 5), 4)


# --- a model of given parameters: two states of squashed returns, as a recursion over rows in SQL

START, TRANS, MEANS, VARS = (0.6, 0.4), ((0.9, 0.1), (0.2, 0.8)), (0.0, 0.3), (0.04, 0.5)
GIVEN = hmm.HmmParams(
    np.array(START), np.array(TRANS), np.array(MEANS)[:, None], np.array(VARS)[:, None, None], hmm.Prep(["r"], {"r": (-1.0, 1.0)}, [0.0], [1.0]), ["Low Vol", "High Vol"]
)


def _density(s: int) -> str:
    return f"exp(-0.5 * (tanh(ret) - CAST({MEANS[s]} AS DOUBLE)) * (tanh(ret) - CAST({MEANS[s]} AS DOUBLE)) / CAST({VARS[s]} AS DOUBLE)) / sqrt(2 * pi() * CAST({VARS[s]} AS DOUBLE))"


def _double(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


ROWS = f"""x AS MATERIALIZED (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n, {_density(0)} AS e0, {_density(1)} AS e1 FROM rets)"""
AHEAD = f"""fw AS (
  SELECT asset, i, f0 / (f0 + f1) AS f0, f1 / (f0 + f1) AS f1, ln(f0 + f1) AS ll FROM (SELECT asset, i, {_double(START[0])} * e0 AS f0, {_double(START[1])} * e1 AS f1 FROM x WHERE i = 1)
  UNION ALL
  SELECT asset, i, g0 / (g0 + g1), g1 / (g0 + g1), ll + ln(g0 + g1) FROM (
    SELECT x.asset, x.i, ll, (f0 * {_double(TRANS[0][0])} + f1 * {_double(TRANS[1][0])}) * e0 AS g0, (f0 * {_double(TRANS[0][1])} + f1 * {_double(TRANS[1][1])}) * e1 AS g1
    FROM fw JOIN x ON x.asset = fw.asset AND x.i = fw.i + 1))"""
BEHIND = f"""bw AS (
  SELECT asset, i, CAST(0.5 AS DOUBLE) AS b0, CAST(0.5 AS DOUBLE) AS b1 FROM x WHERE i = n
  UNION ALL
  SELECT asset, i, h0 / (h0 + h1), h1 / (h0 + h1) FROM (
    SELECT bw.asset, bw.i - 1 AS i, {_double(TRANS[0][0])} * e0 * b0 + {_double(TRANS[0][1])} * e1 * b1 AS h0, {_double(TRANS[1][0])} * e0 * b0 + {_double(TRANS[1][1])} * e1 * b1 AS h1
    FROM bw JOIN x ON x.asset = bw.asset AND x.i = bw.i WHERE bw.i > 1))"""
PATHS = f"""vt AS (
  SELECT asset, i, ln({_double(START[0])}) + ln(e0) AS v0, ln({_double(START[1])}) + ln(e1) AS v1, 0 AS p0, 0 AS p1 FROM x WHERE i = 1
  UNION ALL
  SELECT x.asset, x.i, greatest(v0 + ln({_double(TRANS[0][0])}), v1 + ln({_double(TRANS[1][0])})) + ln(e0), greatest(v0 + ln({_double(TRANS[0][1])}), v1 + ln({_double(TRANS[1][1])})) + ln(e1),
    CASE WHEN v0 + ln({_double(TRANS[0][0])}) >= v1 + ln({_double(TRANS[1][0])}) THEN 0 ELSE 1 END, CASE WHEN v0 + ln({_double(TRANS[0][1])}) >= v1 + ln({_double(TRANS[1][1])}) THEN 0 ELSE 1 END
  FROM vt JOIN x ON x.asset = vt.asset AND x.i = vt.i + 1),
tb AS (
  SELECT vt.asset, vt.i, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END AS state FROM vt JOIN x ON x.asset = vt.asset AND x.i = vt.i WHERE vt.i = n
  UNION ALL
  SELECT vt.asset, vt.i - 1, CASE WHEN state = 0 THEN p0 ELSE p1 END FROM tb JOIN vt ON vt.asset = tb.asset AND vt.i = tb.i WHERE vt.i > 1)"""


def given(oracle: str):
    def add(f):
        ORACLES[f.__name__] = oracle.replace("WITH ", "WITH RECURSIVE ", 1)
        return query(f)

    return add


def _squashed(spark, sf):
    return mrets(spark, sf).select("asset", "ts", F.tanh("ret").alias("r"))


@given(
    with_mrets(
        f"SELECT asset, {rnd('ll', 4)} AS log_likelihood, CAST(i AS DOUBLE) AS n, {rnd('-2 * ll + 14', 4)} AS aic, {rnd('-2 * ll + ln(i) * 7', 4)} AS bic FROM fw JOIN x USING (asset, i) WHERE i = n",
        ROWS, AHEAD,
    )
)
def information_criteria_given(spark, sf):
    """Likelihood of every supplier series under given parameters."""
    return rounded(hmm.information_criteria(_squashed(spark, sf), GIVEN, A), 4)


@given(with_mrets(f"SELECT asset, ts, {rnd('f0 * b0 / (f0 * b0 + f1 * b1)')} AS p0, {rnd('f1 * b1 / (f0 * b0 + f1 * b1)')} AS p1 FROM x JOIN fw USING (asset, i) JOIN bw USING (asset, i)", ROWS, AHEAD, BEHIND))
def predict_proba_given(spark, sf):
    """State probabilities of every row under given parameters."""
    return rounded(hmm.predict_proba(_squashed(spark, sf), GIVEN, A).select("asset", "ts", *[F.col("p")[i].alias(f"p{i}") for i in range(2)]))


@given(with_mrets("SELECT asset, ts, CAST(state AS INTEGER) AS state, CASE WHEN state = 0 THEN 'Low Vol' ELSE 'High Vol' END AS label FROM x JOIN tb USING (asset, i)", ROWS, PATHS))
def predict_regimes_given(spark, sf):
    """Most likely states of every row under given parameters, not smoothed."""
    return hmm.predict_regimes(_squashed(spark, sf), GIVEN, 0, A)
