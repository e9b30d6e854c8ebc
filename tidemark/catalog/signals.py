"""Signals: queries and their SQL. Features are a short set over the weekly supplier returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import MANY, RETS, mrets, rnd, rounded, sql
from tidemark.functions import rolling as R
from tidemark.operators import signals as sg
from tidemark.plans.series import series
from tidemark.session import checkpoint

QUERIES, ORACLES = {}, {}
W = "PARTITION BY asset ORDER BY ts"


def _f(agg, n):
    return f"CASE WHEN count(ret) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN {agg}(ret) OVER ({W} ROWS {n - 1} PRECEDING) END"


FEAT = f"""feat AS (SELECT asset, ts, ret AS returns, {_f('avg', 20)} AS momentum_20d, {_f('avg', 9)} AS macd_signal, {_f('stddev_samp', 15)} AS realized_volatility,
  50 + 10 * tanh(ret) AS rsi_14, -50 * tanh(abs(ret)) AS williams_r, ({_f('avg', 5)}) - ({_f('avg', 20)}) AS term_structure_slope, volume / (volume + 100) AS vix_percentile,
  volume / 10 AS semiconductor_pmi, volume / (volume + 50) AS momentum_rank, ret / 10 AS pair_spread, ({_f('avg', 5)}) AS bollinger_position FROM rets)"""
COMP = f"""comp AS (SELECT asset, ts, returns, realized_volatility,
  0.6 * tanh((momentum_20d - avg(momentum_20d) OVER p) / (stddev_samp(momentum_20d) OVER p + 1e-6)) + 0.4 * tanh((macd_signal - avg(macd_signal) OVER p) / (stddev_samp(macd_signal) OVER p + 1e-6)) AS momentum,
  0.5 * -tanh((rsi_14 / 100 - 0.5) * 2) + 0.5 * tanh(williams_r / 100) AS meanrev,
  0.4 * tanh(term_structure_slope) + 0.3 * (vix_percentile - 0.5) + 0.3 * (semiconductor_pmi / 100 - 0.5) AS macro,
  CASE WHEN count(realized_volatility) OVER w >= 5 THEN tanh((realized_volatility - avg(realized_volatility) OVER w) / (stddev_samp(realized_volatility) OVER w + 1e-6)) END AS vol_breakout,
  0.7 * (momentum_rank - 0.5) + 0.3 * tanh(pair_spread) AS "cross"
  FROM feat WINDOW p AS (PARTITION BY asset), w AS ({W} ROWS 19 PRECEDING))"""
REG = """reg AS (SELECT asset, ts, CASE WHEN volume > 120 THEN 'High Vol' WHEN volume > 60 THEN 'Medium Vol' WHEN volume > 30 THEN 'Low Vol' ELSE 'Other' END AS label FROM rets)"""


def _w(c):
    return (
        f"CASE label WHEN 'High Vol' THEN {sg.REGIME_WEIGHTS['High Vol'][c]} WHEN 'Medium Vol' THEN {sg.REGIME_WEIGHTS['Medium Vol'][c]} "
        f"WHEN 'Low Vol' THEN {sg.REGIME_WEIGHTS['Low Vol'][c]} ELSE {sg.REGIME_WEIGHTS['Default'][c]} END"
    )


BLEND = 'bl AS (SELECT c.*, label, ' + " + ".join(f'({_w(c)}) * "{c}"' for c in sg.COMPONENTS) + " AS blend FROM comp c JOIN reg USING (asset, ts))"
WO = "PARTITION BY asset, label ORDER BY ts ROWS UNBOUNDED PRECEDING"
OVER = f"""ov AS (SELECT asset, ts, label, signal * least(greatest(1 - (eq - peak) / (nullif(peak, 0) + 1e-6), 0.3 + 0 * peak / nullif(peak, 0)), 1) AS signal FROM (
  SELECT *, max(eq) OVER ({WO}) AS peak FROM (SELECT *, blend AS signal, sum(blend * returns) OVER ({WO}) AS eq FROM bl)))"""
SIG = "sig AS (SELECT asset, ts, coalesce(signal, 0) AS signal FROM ov)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def with_feat(select, *more):
    return sql(select, MANY, RETS, FEAT, *more)


def written_returns(spark, sf):
    """Returns written once, for queries that take features and regimes from them."""
    return checkpoint(mrets(spark, sf))


def feat(spark, sf, r=None):
    s = series(mrets(spark, sf) if r is None else r, ["asset"], lookback=19)
    d = s.add(
        {
            "momentum_20d": R.mean(s, "ret", 20), "macd_signal": R.mean(s, "ret", 9), "realized_volatility": R.std(s, "ret", 15),
            "rsi_14": 50 + 10 * F.tanh("ret"), "williams_r": -50 * F.tanh(F.abs("ret")), "term_structure_slope": R.mean(s, "ret", 5) - R.mean(s, "ret", 20),
            "vix_percentile": F.col("volume") / (F.col("volume") + 100), "semiconductor_pmi": F.col("volume") / 10,
            "momentum_rank": F.col("volume") / (F.col("volume") + 50), "pair_spread": F.col("ret") / 10, "bollinger_position": R.mean(s, "ret", 5),
        }
    )
    return d.withColumnRenamed("ret", "returns").drop("close", "volume")


def regimes(spark, sf, r=None):
    v = F.col("volume")
    return (mrets(spark, sf) if r is None else r).select(
        "asset", "ts", F.when(v > 120, "High Vol").when(v > 60, "Medium Vol").when(v > 30, "Low Vol").otherwise("Other").alias("label")
    )


for _name, _fn in (
    ("momentum", sg.momentum_signal), ("meanrev", sg.meanrev_signal), ("macro", sg.macro_signal), ("vol_breakout", sg.vol_breakout_signal), ("cross", sg.cross_sectional_signal),
):

    def _run(spark, sf, fn=_fn, name=_name):
        return rounded(fn(feat(spark, sf)).select("asset", "ts", F.col(name).alias("value")))

    QUERIES[f"{_name}_signal"] = _run
    ORACLES[f"{_name}_signal"] = with_feat(f'SELECT asset, ts, {rnd(chr(34) + _name + chr(34))} AS value FROM comp', COMP)


@query(with_feat(f"SELECT asset, ts, label, {rnd('blend')} AS blend FROM bl", COMP, REG, BLEND))
def regime_blend(spark, sf):
    r = written_returns(spark, sf)
    d = sg.with_labels(sg.signal_components(feat(spark, sf, r)), regimes(spark, sf, r))
    return rounded(sg.regime_blend(d).select("asset", "ts", "label", "blend"))


@query(with_feat(f"SELECT asset, ts, label, {rnd('signal')} AS signal FROM ov", COMP, REG, BLEND, OVER))
def risk_overlay(spark, sf):
    d = sg.regime_blend(sg.with_labels(sg.signal_components(feat(spark, sf)), regimes(spark, sf))).withColumn("signal", F.col("blend"))
    return rounded(sg.risk_overlay(d).select("asset", "ts", "label", "signal"))


@query(with_feat(f"SELECT asset, ts, {rnd('signal')} AS signal FROM sig", COMP, REG, BLEND, OVER, SIG))
def generate_signals(spark, sf):
    """Signals without the fitted term."""
    return rounded(sg.generate_signals(feat(spark, sf), mrets(spark, sf), regimes(spark, sf), meta=False))


@query()
def generate_signals_ridge(spark, sf):
    """Signals with the ridge term, half and half."""
    return rounded(sg.generate_signals(feat(spark, sf), mrets(spark, sf), regimes(spark, sf)))


@query(
    with_feat(
        f"""SELECT asset, ts, {rnd('CASE WHEN abs(s) > 0.2 THEN sign(s) * (abs(s) - 0.2) ELSE 0 END')} AS signal FROM (
        SELECT asset, ts, coalesce(0.3 * momentum + 0.2 * meanrev + 0.2 * macro + 0.2 * vol_breakout + 0.1 * "cross", 0) AS s FROM comp)""",
        COMP,
    )
)
def signal_switches(spark, sf):
    """Without regimes and overlay, with a soft threshold."""
    return rounded(sg.generate_signals(feat(spark, sf), mrets(spark, sf), regimes(spark, sf), meta=False, overlay=False, use_regimes=False, threshold=0.2))


@query()
def feature_importance(spark, sf):
    d = sg.with_labels(sg.signal_components(feat(spark, sf)), regimes(spark, sf))
    nxt = mrets(spark, sf)
    from tidemark.operators.cross import forward_return

    d = d.join(forward_return(nxt, out="_next").select("asset", "ts", "_next"), ["asset", "ts"])
    return rounded(sg.feature_importance(sg.ridge_models(d, "_next")), 4)


@query(
    with_feat(
        f"""SELECT asset, ts, {rnd('momentum_20d')} AS momentum_20d, {rnd('v')} AS realized_volatility FROM (
        SELECT *, {_f('stddev_samp', 20).replace('ret', 'returns')} AS v FROM feat)"""
    )
)
def feature_check(spark, sf):
    """Missing required features derived from the returns."""
    d = sg.feature_check(feat(spark, sf).drop("momentum_20d", "realized_volatility"))
    return rounded(d.select("asset", "ts", "momentum_20d", "realized_volatility"))


@query(sql("SELECT asset, count(*) AS n, 'returns' AS side FROM rets WHERE volume <= 30 GROUP BY 1", MANY, RETS))
def misaligned(spark, sf):
    r = mrets(spark, sf)
    return sg.misaligned(r, r.filter("volume > 30"))


_DIAG = f"""d AS (SELECT s.asset, label, signal, nxt FROM sig s JOIN reg USING (asset, ts) JOIN (SELECT asset, ts, lead(ret) OVER ({W}) AS nxt FROM rets) USING (asset, ts))"""


def _diag(by):
    k = f"{by}, " if by else ""
    return f"""SELECT {k}{rnd('avg(m)')} AS mean, {rnd('avg(s)')} AS std, {rnd('min(lo)')} AS min, {rnd('max(hi)')} AS max, CAST(sum(nz) AS BIGINT) AS non_zero_count,
      CAST(sum(n) AS BIGINT) AS total_count, {rnd('avg(c)')} AS corr_mean, {rnd('stddev_pop(c)')} AS corr_std FROM (
      SELECT asset, {k}avg(signal) AS m, stddev_samp(signal) AS s, min(signal) AS lo, max(signal) AS hi, count(*) FILTER (signal <> 0) AS nz, count(*) AS n,
      CASE WHEN isnan(corr(signal, nxt)) THEN NULL ELSE corr(signal, nxt) END AS c FROM d GROUP BY ALL) {'GROUP BY ' + by if by else ''}"""


def _flagged(by):
    return f"""SELECT *, concat_ws('; ', CASE WHEN abs(corr_mean) < 0.01 THEN 'weak forward correlation' END, CASE WHEN non_zero_count < 0.5 * total_count THEN 'mostly zero signals' END,
      CASE WHEN std < 0.1 THEN 'low signal variation' END) AS red_flags FROM ({_diag(by)})"""


@query(with_feat(_flagged(""), COMP, REG, BLEND, OVER, SIG, _DIAG))
def diagnose_signals(spark, sf):
    r = mrets(spark, sf)
    s = sg.generate_signals(feat(spark, sf), r, regimes(spark, sf), meta=False)
    return rounded(sg.diagnose_signals(s, r).withColumn("red_flags", F.concat_ws("; ", "red_flags")))


@query(with_feat(_flagged("label"), COMP, REG, BLEND, OVER, SIG, _DIAG))
def diagnose_signals_by_regime(spark, sf):
    r = mrets(spark, sf)
    s = sg.generate_signals(feat(spark, sf), r, regimes(spark, sf), meta=False)
    return rounded(sg.diagnose_signals(s, r, regimes(spark, sf)).withColumn("red_flags", F.concat_ws("; ", "red_flags")))


@query(
    with_feat(
        f"""SELECT asset, ts, {rnd('signal / (realized_volatility + 1e-8)', 4)} AS penalised, {rnd('CASE WHEN abs(signal) > 0.1 * realized_volatility THEN signal ELSE 0 END')} AS filtered
        FROM sig JOIN feat USING (asset, ts) WHERE realized_volatility IS NOT NULL""",
        COMP, REG, BLEND, OVER, SIG,
    )
)
def adjust_by_forecast(spark, sf):
    f = feat(spark, sf)
    s = sg.generate_signals(f, mrets(spark, sf), regimes(spark, sf), meta=False).join(f.select("asset", "ts", "realized_volatility"), ["asset", "ts"])
    s = s.filter("realized_volatility is not null")
    a = sg.adjust_by_forecast(s.withColumn("penalised", F.col("signal")), "realized_volatility", col="penalised")
    b = sg.adjust_by_forecast(a.withColumn("filtered", F.col("signal")), "realized_volatility", 0.1, False, "filtered")
    return rounded(b.select("asset", "ts", "penalised", "filtered"), penalised=4)
