"""Risk aggregates: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import BARS, MACRO, RETS, macro, mrets, panel, portfolio, rets, rnd, rounded, sql, with_mrets, with_panel, with_rets
from tidemark.operators import risk

QUERIES, ORACLES = {}, {}
K = ("portfolio",)
WP = "PARTITION BY portfolio ORDER BY ts"
CUM = f"""cum AS (SELECT *, max(cum) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS peak FROM (
  SELECT portfolio, ts, ret, product(1 + ret) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS cum FROM port))"""
DD = "dd AS (SELECT portfolio, min(cum / peak - 1) AS max_drawdown, max_by(cum / peak - 1, ts) AS current_drawdown FROM cum GROUP BY 1)"
VAR = "v AS (SELECT portfolio, quantile_cont(ret, 0.05) AS var_95 FROM port GROUP BY 1)"
# returns scaled down, so that products stay in range and thresholds are met on both sides
SMALL = "port AS (SELECT substr(asset, 3, 1) AS portfolio, ts, avg(ret) / 50 AS ret FROM rets GROUP BY 1, 2)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def small(spark, sf):
    return portfolio(spark, sf).withColumn("ret", F.col("ret") / 50)


def with_small(select, *more):
    return sql(select, BARS, RETS, SMALL, *more)


@query(
    with_small(
        f"""SELECT p.portfolio, count(ret) AS days, {rnd('avg(ret)')} AS mean_return, {rnd('stddev_samp(ret)')} AS std_return,
        {rnd('stddev_samp(ret) * sqrt(252)')} AS volatility, {rnd('avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252)')} AS sharpe,
        {rnd('any_value(var_95)')} AS var_95, {rnd('avg(ret) FILTER (ret <= var_95)')} AS es_95, {rnd('any_value(max_drawdown)')} AS max_drawdown
        FROM port p JOIN v USING (portfolio) JOIN dd USING (portfolio) GROUP BY 1""",
        CUM, DD, VAR,
    )
)
def basic_risk(spark, sf):
    return rounded(risk.basic_risk(small(spark, sf)))


@query(with_mrets(f"SELECT asset, {rnd('quantile_cont(ret, 0.05)')} AS var FROM rets GROUP BY 1"))
def var_historical(spark, sf):
    return rounded(risk.var_historical(mrets(spark, sf), key=["asset"]))


@query(with_mrets(f"SELECT asset, {rnd('avg(ret) - 1.6448536269514729 * stddev_samp(ret)')} AS var FROM rets GROUP BY 1"))
def var_parametric(spark, sf):
    return rounded(risk.var_parametric(mrets(spark, sf), key=["asset"]))


@query(
    with_mrets(
        f"""SELECT asset, {rnd('any_value(q)')} AS var, {rnd('avg(ret) FILTER (ret <= q)')} AS es FROM rets
        JOIN (SELECT asset, quantile_cont(ret, 0.05) AS q FROM rets GROUP BY 1) USING (asset) GROUP BY 1"""
    )
)
def expected_shortfall(spark, sf):
    return rounded(risk.expected_shortfall(mrets(spark, sf), key=["asset"]))


@query(with_mrets(f"SELECT asset, {rnd('(avg(ret) * 252 - 0.05) / (stddev_samp(ret) * sqrt(252))')} AS sharpe FROM rets GROUP BY 1"))
def sharpe(spark, sf):
    return rounded(risk.sharpe(mrets(spark, sf), rf=0.05, key=["asset"]))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('(avg(ret) * 252 - 0.05) / (sqrt(252) * sqrt(avg(ret * ret) FILTER (ret < 0)))')} AS sortino,
        {rnd('(avg(ret) * 252 - 0.05) / abs(any_value(max_drawdown))')} AS calmar,
        {rnd('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))')} AS omega,
        {rnd('abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))')} AS tail_ratio FROM port JOIN dd USING (portfolio) GROUP BY 1""",
        CUM, DD,
    )
)
def ratios(spark, sf):
    return rounded(risk.ratios(small(spark, sf)))


@query(with_small(f"SELECT portfolio, {rnd('max_drawdown')} AS max_drawdown FROM dd", CUM, DD))
def max_drawdown(spark, sf):
    return rounded(risk.max_drawdown(small(spark, sf)))


@query(with_small(f"SELECT portfolio, {rnd('current_drawdown')} AS current_drawdown, {rnd('abs(current_drawdown) / 0.2')} AS drawdown_ratio FROM dd", CUM, DD))
def current_drawdown(spark, sf):
    return rounded(risk.current_drawdown(small(spark, sf)))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('min(c - top)')} AS drawdown_additive FROM (SELECT *, max(c) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS top FROM (
        SELECT portfolio, ts, sum(ret) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS c FROM port)) GROUP BY 1"""
    )
)
def drawdown_additive(spark, sf):
    return rounded(risk.drawdown_additive(small(spark, sf)))


VR = """vr AS (SELECT portfolio, stddev_samp(ret) FILTER (rn <= 21) / stddev_samp(ret) AS volatility_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC) AS rn FROM port) GROUP BY 1)"""


@query(with_small(f"SELECT portfolio, {rnd('volatility_ratio')} AS volatility_ratio FROM vr", VR))
def volatility_ratio(spark, sf):
    return rounded(risk.volatility_ratio(small(spark, sf)))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('greatest(0.2, least(1.0, CASE WHEN dr > 0.6 THEN p * greatest(0.5, 1.6 - dr) ELSE p END))')} AS position FROM (
        SELECT portfolio, CASE WHEN volatility_ratio > 1 THEN 1 - ln(volatility_ratio) ELSE 1 END AS p, abs(current_drawdown) / 0.2 AS dr FROM vr JOIN dd USING (portfolio))""",
        CUM, DD, VR,
    )
)
def risk_adjusted_position(spark, sf):
    return rounded(risk.risk_adjusted_position(small(spark, sf)).select("portfolio", "position"))


RUNS = f"""runs AS (SELECT portfolio, run, count(*) FILTER (ret < 0) AS n FROM (
  SELECT *, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS run FROM port) GROUP BY 1, 2)"""
REC = f"""eps AS (SELECT portfolio, g, count(*) FILTER (cum < peak) AS n FROM (
  SELECT *, sum(CASE WHEN cum < peak THEN 0 ELSE 1 END) OVER ({WP} ROWS UNBOUNDED PRECEDING) AS g FROM cum) GROUP BY 1, 2),
rec AS (SELECT portfolio, coalesce(avg(n) FILTER (n > 0 AND g < top), 0) AS recovery_time FROM eps JOIN (SELECT portfolio, max(g) AS top FROM eps GROUP BY 1) USING (portfolio) GROUP BY 1)"""


@query(with_small("SELECT portfolio, max(n) AS max_consecutive_loss FROM runs GROUP BY 1", RUNS))
def max_consecutive_loss(spark, sf):
    return risk.max_consecutive_loss(small(spark, sf))


@query(with_small(f"SELECT portfolio, {rnd('recovery_time')} AS recovery_time FROM rec", CUM, REC))
def recovery_time(spark, sf):
    return rounded(risk.recovery_time(small(spark, sf)))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('wm')} AS worst_month, {rnd('wq')} AS worst_quarter, {rnd('recovery_time')} AS recovery_time, mcl AS max_consecutive_loss
        FROM (SELECT portfolio, min(s) AS wm FROM (SELECT portfolio, date_trunc('month', ts) AS p, sum(ret) AS s FROM port GROUP BY 1, 2) GROUP BY 1)
        JOIN (SELECT portfolio, min(s) AS wq FROM (SELECT portfolio, date_trunc('quarter', ts) AS p, sum(ret) AS s FROM port GROUP BY 1, 2) GROUP BY 1) USING (portfolio)
        JOIN rec USING (portfolio) JOIN (SELECT portfolio, max(n) AS mcl FROM runs GROUP BY 1) USING (portfolio)""",
        CUM, REC, RUNS,
    )
)
def stress_summary(spark, sf):
    return rounded(risk.stress_summary(small(spark, sf)))


SCORE = """sc AS (SELECT p.portfolio, stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252) AS sh, any_value(max_drawdown) AS mdd,
  least(80.0, least(stddev_samp(ret) * sqrt(252) / 0.3, 1) * 30 + least(abs(any_value(max_drawdown)) / 0.3, 1) * 30 + least(abs(any_value(var_95)) / 0.1, 1) * 20) AS risk_score
  FROM port p JOIN v USING (portfolio) JOIN dd USING (portfolio) GROUP BY 1)"""


@query(with_small(f"SELECT portfolio, {rnd('risk_score')} AS risk_score FROM sc", CUM, DD, VAR, SCORE))
def risk_score(spark, sf):
    return rounded(risk.risk_score(small(spark, sf)))


LABELS = """labels_ AS (SELECT portfolio, ts, CASE WHEN ret < -0.002 THEN 'Low Vol' WHEN ret < 0.01 THEN 'Medium Vol' ELSE 'High Vol' END AS label FROM port)"""


def labels(r):
    return r.select("portfolio", "ts", F.when(F.col("ret") < -0.002, "Low Vol").when(F.col("ret") < 0.01, "Medium Vol").otherwise("High Vol").alias("label"))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('risk_score')} AS risk_score, risk_level, CAST({rnd('least(greatest(base * tilt, 0.8), 1.2)')} AS DOUBLE) AS position_recommendation, reg AS current_regime,
        (CASE WHEN mdd < -0.15 THEN 1 ELSE 0 END) + (CASE WHEN sh < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN vol > 0.3 THEN 1 ELSE 0 END)
          + (CASE WHEN risk_score > 70 THEN 1 ELSE 0 END) + (CASE WHEN reg IN ('High Vol', 'Low Vol') THEN 1 ELSE 0 END) AS n_recommendations
        FROM (SELECT *, CASE WHEN risk_score < 30 THEN 'Low' WHEN risk_score < 60 THEN 'Medium' ELSE 'High' END AS risk_level,
          CASE WHEN risk_score < 30 THEN 1.0 WHEN risk_score < 60 THEN 0.9 ELSE 0.8 END AS base,
          CASE reg WHEN 'High Vol' THEN 0.8 WHEN 'Low Vol' THEN 1.2 ELSE 1.0 END AS tilt
          FROM sc JOIN (SELECT portfolio, max_by(label, ts) AS reg FROM labels_ GROUP BY 1) USING (portfolio))""",
        CUM, DD, VAR, SCORE, LABELS,
    )
)
def risk_report(spark, sf):
    r = small(spark, sf)
    d = risk.risk_report(r, labels(r))
    return rounded(d.select("portfolio", "risk_score", "risk_level", "position_recommendation", "current_regime", F.size("recommendations").alias("n_recommendations")))


WEIGHTS = {"A-F": 0.3, "A-O": 0.1, "N-F": 0.1, "N-O": 0.2, "R-F": 0.2, "R-O": 0.1}
_WV = "w(asset, weight) AS (VALUES " + ", ".join(f"('{a}', CAST({w} AS DOUBLE))" for a, w in WEIGHTS.items()) + ")"


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "asset string, weight double")


@query(
    with_panel(
        f"""SELECT asset, {rnd('rc')} AS risk_contribution, {rnd('1 - max(rc) OVER ()')} AS diversification_score, {rnd('sum(rc * rc) OVER ()')} AS concentration_score FROM (
        SELECT asset, weight * marg / sqrt(sum(weight * weight * marg) OVER ()) AS rc FROM (
          SELECT a AS asset, any_value(wa.weight) AS weight, sum(c * wb.weight) * any_value(sd) AS marg FROM (
            SELECT x.asset AS a, y.asset AS b, corr(x.ret, y.ret) AS c, stddev_samp(x.ret) AS sd FROM panel x JOIN panel y USING (ts) GROUP BY 1, 2)
          JOIN w wa ON wa.asset = a JOIN w wb ON wb.asset = b GROUP BY 1))""",
        _WV,
    )
)
def risk_decomposition(spark, sf):
    d = risk.risk_decomposition(rets(spark, sf), weights(spark))
    return rounded(d.select("asset", "risk_contribution", "diversification_score", "concentration_score"))


@query(
    with_panel(
        f"""SELECT a AS asset, {rnd('any_value(wa.weight) * sum(c * wb.weight) / any_value(sp)')} AS risk_contribution FROM (
            SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) * 252 AS c FROM panel x JOIN panel y USING (ts) GROUP BY 1, 2)
          JOIN w wa ON wa.asset = a JOIN w wb ON wb.asset = b,
          (SELECT stddev_samp(p) * sqrt(252) AS sp FROM (SELECT ts, sum(weight * ret) AS p FROM panel JOIN w USING (asset) GROUP BY 1)) GROUP BY 1""",
        _WV,
    )
)
def risk_contribution(spark, sf):
    return rounded(risk.risk_contribution(rets(spark, sf), weights(spark)).select("asset", "risk_contribution"))


@query(
    with_small(
        f"""SELECT portfolio, label, count(*) AS days, {rnd('stddev_samp(ret) * sqrt(252)')} AS volatility, {rnd('any_value(q)')} AS var, {rnd('avg(ret) FILTER (ret <= q)')} AS es
        FROM port JOIN labels_ USING (portfolio, ts) JOIN (SELECT portfolio, label, quantile_cont(ret, 0.05) AS q FROM port JOIN labels_ USING (portfolio, ts) GROUP BY 1, 2) USING (portfolio, label)
        GROUP BY 1, 2""",
        LABELS,
    )
)
def regime_metrics(spark, sf):
    r = small(spark, sf)
    return rounded(risk.regime_metrics(r, labels(r)))


DAYL = "dayl AS (SELECT ts, CASE WHEN avg(ret) < 0 THEN 'down' ELSE 'up' END AS label FROM rets GROUP BY 1)"


def day_labels(spark, sf):
    return rets(spark, sf).groupBy("ts").agg(F.when(F.avg("ret") < 0, "down").otherwise("up").alias("label"))


@query(
    with_rets(
        f"""SELECT x.asset AS a, y.asset AS b, {rnd("CASE WHEN x.asset = y.asset THEN 1 ELSE coalesce(corr(x.ret, y.ret), 0) END")} AS corr, count(*) AS n
        FROM rets x JOIN rets y USING (ts) WHERE ts IN (SELECT ts FROM dayl WHERE label = (SELECT max_by(label, ts) FROM dayl)) GROUP BY 1, 2, x.asset, y.asset""",
        DAYL,
    )
)
def regime_correlation(spark, sf):
    return rounded(risk.regime_correlation(rets(spark, sf), day_labels(spark, sf)))


@query(
    with_mrets(
        f"""SELECT asset, {rnd('any_value(q)')} AS threshold, count(*) FILTER (ret < q) AS exceedances, {rnd('count(*) FILTER (ret < q) / count(*)')} AS exceedance_rate,
        {rnd('avg(ln(abs(ret) / abs(q))) FILTER (ret < q)')} AS hill,
        {rnd('0.5 * (1 - pow(avg(abs(ret)) FILTER (ret < q), 2) / var_samp(abs(ret)) FILTER (ret < q))', 4)} AS tail_index,
        {rnd('0.5 * (avg(abs(ret)) FILTER (ret < q)) * (pow(avg(abs(ret)) FILTER (ret < q), 2) / var_samp(abs(ret)) FILTER (ret < q) + 1)', 4)} AS scale
        FROM rets JOIN (SELECT asset, quantile_cont(ret, 0.05) AS q FROM rets GROUP BY 1) USING (asset) GROUP BY 1"""
    )
)
def tail_exceedances(spark, sf):
    return rounded(risk.tail_exceedances(mrets(spark, sf), key=["asset"]), tail_index=4, scale=4)


@query(
    with_rets(
        f"""SELECT x.label, x.asset AS a, y.asset AS b, count(*) AS n, {rnd('avg(CASE WHEN x.u < 0.1 AND y.u < 0.1 THEN 1 ELSE 0 END) / 0.1')} AS lambda_l
        FROM u x JOIN u y ON x.ts = y.ts AND x.asset < y.asset GROUP BY 1, 2, 3""",
        DAYL,
        """u AS (SELECT asset, ts, label, (rank() OVER (PARTITION BY label, asset ORDER BY ret) + (count(*) OVER (PARTITION BY label, asset, ret) - 1) / 2)
          / count(*) OVER (PARTITION BY label, asset) AS u FROM rets JOIN dayl USING (ts))""",
    )
)
def lower_tail_dependence(spark, sf):
    return rounded(risk.lower_tail_dependence(rets(spark, sf), day_labels(spark, sf), 0.1))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('phi')} AS phi, {rnd('c')} AS const, {rnd('c * (1 - pow(phi, 3)) / (1 - phi) + pow(phi, 3) * r')} AS predicted_mean,
        {rnd('sqrt(s2 * (1 - pow(phi, 6)) / (1 - phi * phi))')} AS predicted_std FROM (
        SELECT portfolio, regr_slope(ret, l) AS phi, regr_intercept(ret, l) AS c, (regr_syy(ret, l) - pow(regr_sxy(ret, l), 2) / regr_sxx(ret, l)) / regr_count(ret, l) AS s2,
          max_by(ret, ts) AS r FROM (SELECT *, lag(ret) OVER ({WP}) AS l FROM port) GROUP BY 1)"""
    )
)
def ar1_forecast(spark, sf):
    return rounded(risk.ar1_forecast(small(spark, sf), 3))


@query()
def pca_attribution(spark, sf):
    return rounded(risk.pca_attribution(rets(spark, sf)), 4)


@query(
    with_mrets(
        f"""SELECT asset, {rnd('regr_intercept(ret, f)', 4)} AS const, {rnd('regr_slope(ret, f)', 4)} AS beta_mkt FROM rets JOIN (SELECT ts, avg(ret) AS f FROM rets GROUP BY 1) USING (ts) GROUP BY 1"""
    )
)
def factor_ols(spark, sf):
    r = mrets(spark, sf)
    return rounded(risk.factor_ols(r, r.groupBy("ts").agg(F.avg("ret").alias("mkt")), ["mkt"]), 4)


@query(
    with_rets(
        f"""SELECT asset, {rnd('const', 4)} AS const, {rnd('b1', 4)} AS beta_mkt, {rnd('b2 * 1e6', 4)} AS beta_rate FROM (
        SELECT asset, avg(y) - b1 * avg(a) - b2 * avg(b) AS const, b1, b2 FROM (
          SELECT *, (covar_samp(y, a) OVER w * var_samp(b) OVER w - covar_samp(y, b) OVER w * covar_samp(a, b) OVER w) / (var_samp(a) OVER w * var_samp(b) OVER w - pow(covar_samp(a, b) OVER w, 2)) AS b1,
                 (covar_samp(y, b) OVER w * var_samp(a) OVER w - covar_samp(y, a) OVER w * covar_samp(a, b) OVER w) / (var_samp(a) OVER w * var_samp(b) OVER w - pow(covar_samp(a, b) OVER w, 2)) AS b2
          FROM (SELECT asset, rets.ret AS y, f.a, g.value / 1e5 AS b FROM rets JOIN (SELECT ts, avg(ret) AS a FROM rets GROUP BY 1) f USING (ts) JOIN macro g USING (ts) WHERE series = '1-URGENT')
          WINDOW w AS (PARTITION BY asset)) GROUP BY asset, b1, b2)""",
        MACRO,
    )
)
def factor_ols_two(spark, sf):
    r = rets(spark, sf)
    m = macro(spark, sf).filter("series = '1-URGENT'").select("ts", (F.col("value") / 1e5).alias("rate"))
    f = r.groupBy("ts").agg(F.avg("ret").alias("mkt")).join(m, "ts")
    d = risk.factor_ols(r, f, ["mkt", "rate"])
    return rounded(d.withColumn("beta_rate", F.col("beta_rate") * 1e6), 4)


@query(
    with_panel(
        f"""SELECT asset, count(*) AS tail_days, {rnd('avg(ret)')} AS es_by_asset, {rnd('avg(weight * ret)')} AS marginal_es, {rnd('corr(ret, p)')} AS tail_corr,
        {rnd('avg(ret) * any_value(weight) * corr(ret, p)')} AS es_contribution FROM panel JOIN w USING (asset) JOIN pp USING (ts)
        WHERE p <= (SELECT quantile_cont(p, 0.05) FROM pp) GROUP BY 1""",
        _WV, "pp AS (SELECT ts, sum(weight * ret) AS p FROM panel JOIN w USING (asset) GROUP BY 1)",
    )
)
def es_decomposition(spark, sf):
    return rounded(risk.es_decomposition(panel(spark, sf), weights(spark)).drop("weight"))


@query(
    with_mrets(
        f"""SELECT asset, {rnd('stddev_pop(ret - b) * sqrt(252)')} AS tracking_error, {rnd('avg(ret - b) * 252 / (stddev_pop(ret - b) * sqrt(252))')} AS information_ratio
        FROM rets JOIN (SELECT ts, avg(ret) AS b FROM rets GROUP BY 1) USING (ts) GROUP BY 1"""
    )
)
def benchmark_metrics(spark, sf):
    r = mrets(spark, sf)
    return rounded(risk.benchmark_metrics(r, r.groupBy("ts").agg(F.avg("ret").alias("ret")), ["asset"]))


@query(
    with_small(
        f"""SELECT portfolio, {rnd('avg(ret) * 252')} AS annual_return, {rnd('stddev_samp(ret) * sqrt(252)')} AS annual_vol, {rnd('avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252)')} AS sharpe,
        {rnd('any_value(max_drawdown)')} AS max_drawdown, {rnd('any_value(var_95)')} AS var_95 FROM port JOIN v USING (portfolio) JOIN dd USING (portfolio) GROUP BY 1""",
        CUM, DD, VAR,
    )
)
def performance_table(spark, sf):
    return rounded(risk.performance_table(small(spark, sf)))


@query(
    with_small(
        f"""SELECT portfolio, printf('%.1f%%', avg(ret) * 252 * 100) AS "Return", printf('%.1f%%', stddev_samp(ret) * sqrt(252) * 100) AS "Volatility",
        printf('%.2f', avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252)) AS "Sharpe", printf('%.1f%%', any_value(max_drawdown) * 100) AS "Max Drawdown"
        FROM port JOIN dd USING (portfolio) GROUP BY 1""",
        CUM, DD,
    )
)
def performance_text(spark, sf):
    return risk.performance_table(small(spark, sf), formatted=True)


@query(
    with_mrets(
        f"""SELECT asset, count(*) AS rows, count(ret) AS non_null, count(*) FILTER (ret <> 0) AS nonzero, {rnd('min(ret)')} AS min, {rnd('max(ret)')} AS max, {rnd('avg(ret)')} AS mean,
        {rnd('stddev_samp(ret)')} AS std, {rnd('stddev_samp(ret) * sqrt(252)')} AS annual_vol, {rnd('skewness(ret)', 4)} AS skew, {rnd('kurtosis(ret)', 4)} AS kurt,
        stddev_samp(ret) = 0 AS zero_volatility FROM rets GROUP BY 1"""
    )
)
def returns_summary(spark, sf):
    return rounded(risk.returns_summary(mrets(spark, sf), ["asset"]), skew=4, kurt=4)
