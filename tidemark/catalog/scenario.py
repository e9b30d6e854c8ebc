"""Resampling, scenarios and significance tests: queries and their SQL, with the same draws on both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.base import BARS, PANEL, RETS, mrets, panel, portfolio, rnd, rounded, sql, with_mrets
from tidemark.functions.draws import poisson1_sql, uniform_sql
from tidemark.operators import resample as rs
from tidemark.operators import validate as va
from tidemark.session import checkpoint

QUERIES, ORACLES = {}, {}
SMALL = "port AS (SELECT substr(asset, 3, 1) AS portfolio, ts, avg(ret) / 50 AS ret FROM rets GROUP BY 1, 2)"
SEQ = "sq AS (SELECT portfolio, ret, row_number() OVER (PARTITION BY portfolio ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY portfolio) AS n FROM port)"
BOOTS = 1000


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def small(spark, sf):
    return portfolio(spark, sf).withColumn("ret", F.col("ret") / 50)


IDX = f"""bs AS (SELECT d.portfolio, d.b AS boot_id, d.i AS slot, h.ret FROM (SELECT portfolio, i, b, CAST(floor({uniform_sql(42, 'i', 'b')} * n) AS BIGINT) AS pick FROM sq, range({BOOTS}) t(b)) d
  JOIN sq h ON h.portfolio = d.portfolio AND h.i = d.pick)"""
POI = f"""pw AS (SELECT portfolio, boot_id, sum(w) AS n, sum(w * ret) AS s FROM (SELECT portfolio, b AS boot_id, ret, {poisson1_sql('u')} AS w FROM (
  SELECT portfolio, ret, b, {uniform_sql(42, 'i', 'b')} AS u FROM sq, range({BOOTS}) t(b))) GROUP BY 1, 2)"""


def with_boot(select, *more):
    return sql(select, BARS, RETS, SMALL, SEQ, *more)


@query(with_boot(f"SELECT portfolio, CAST(boot_id AS INT) AS boot_id, {rnd('avg(ret)')} AS value FROM bs GROUP BY 1, 2", IDX))
def bootstrap_mean(spark, sf):
    return rounded(rs.bootstrap(small(spark, sf), "mean", "ret", BOOTS, ["portfolio"]))


@query(with_boot(f"SELECT portfolio, CAST(boot_id AS INT) AS boot_id, {rnd('s / n')} AS value FROM pw", POI))
def bootstrap_poisson(spark, sf):
    return rounded(rs.bootstrap(small(spark, sf), "mean", "ret", BOOTS, ["portfolio"], method="poisson"))


DOWNSIDE = rs.Metric(lambda x: np.column_stack((x, np.minimum(x, 0) ** 2)), lambda w, s: s[:, 0] / w / np.sqrt(s[:, 1] / w))


@query(
    with_boot(
        f"SELECT portfolio, CAST(boot_id AS INT) AS boot_id, {rnd('s / n / sqrt(d / n)')} AS value FROM pw",
        POI.replace("sum(w * ret) AS s", "sum(w * ret) AS s, sum(w * pow(least(ret, 0), 2)) AS d"),
    )
)
def bootstrap_user_metric(spark, sf):
    """Resamples of a metric written by the user: the mean over the root mean square of the losses."""
    return rounded(rs.bootstrap(small(spark, sf), DOWNSIDE, "ret", BOOTS, ["portfolio"]))


@query(with_boot(f"SELECT portfolio, {rnd('quantile_cont(s / n, 0.05)')} AS var FROM pw GROUP BY 1", POI.replace(f"range({BOOTS})", "range(10000)")))
def var_bootstrap(spark, sf):
    return rounded(rs.var_bootstrap(small(spark, sf)))


@query(
    with_boot(
        f"""SELECT portfolio, {rnd('quantile_cont(s, 0.025)')} AS sharpe_lower, {rnd('quantile_cont(s, 0.975)')} AS sharpe_upper, {rnd('quantile_cont(v, 0.025)')} AS var_lower, {rnd('quantile_cont(v, 0.975)')} AS var_upper,
        {rnd('quantile_cont(m, 0.025)')} AS dd_lower, {rnd('quantile_cont(m, 0.975)')} AS dd_upper FROM (
        SELECT portfolio, boot_id, avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252) AS s, quantile_cont(ret, 0.05) AS v FROM bs GROUP BY 1, 2) JOIN (
        SELECT portfolio, boot_id, min(cum / peak - 1) AS m FROM (SELECT *, max(cum) OVER (PARTITION BY portfolio, boot_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS peak FROM (
          SELECT *, product(1 + ret) OVER (PARTITION BY portfolio, boot_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cum FROM bs)) GROUP BY 1, 2) USING (portfolio, boot_id) GROUP BY 1""",
        IDX,
    )
)
def bootstrap_ci(spark, sf):
    d = rs.bootstrap_ci(small(spark, sf), BOOTS)
    return rounded(
        d.select(
            "portfolio", *[F.col(f"{c}_ci")[i].alias(f"{n}_{e}") for c, n in (("sharpe", "sharpe"), ("var_95", "var"), ("max_drawdown", "dd")) for i, e in enumerate(("lower", "upper"))]
        )
    )


# --- scenarios: 200 paths of 100 days in blocks of 21

SIMS, DAYS, BLOCK = 200, 100, 21
HIST = """hist AS (SELECT asset, ln(1 + ret) AS log_ret, dense_rank() OVER (ORDER BY ts) - 1 AS d FROM panel)"""
PATHS = f"""paths AS (SELECT sim AS sim_id, blk * {BLOCK} + off AS step, asset, log_ret FROM (
  SELECT sim, blk, CAST(floor({uniform_sql(42, 'sim', 'blk')} * ((SELECT max(d) + 1 FROM hist) - {BLOCK} + 1)) AS BIGINT) AS st FROM range({SIMS}) a(sim), range({-(-DAYS // BLOCK)}) b(blk)), range({BLOCK}) c(off)
  JOIN hist ON hist.d = st + off WHERE blk * {BLOCK} + off < {DAYS})"""
WEIGHTS = {"A-F": 0.3, "A-O": 0.1, "N-F": 0.1, "N-O": 0.2, "R-F": 0.2, "R-O": 0.1}
_WV = "w(asset, weight) AS (VALUES " + ", ".join(f"('{a}', CAST({w} AS DOUBLE))" for a, w in WEIGHTS.items()) + ")"
PP = """pp AS (SELECT sim_id, step, log_ret, exp(sum(log_ret) OVER (PARTITION BY sim_id ORDER BY step ROWS UNBOUNDED PRECEDING)) AS value FROM (
  SELECT sim_id, step, sum(weight * log_ret) AS log_ret FROM paths JOIN w USING (asset) GROUP BY 1, 2))"""
STATS = """stt AS (SELECT sim_id, max_by(value, step) AS final_value, max_by(value, step) - 1 AS total_return, exp(avg(log_ret) * 252) - 1 AS ann_ret, stddev_pop(log_ret) * sqrt(252) AS ann_vol, min(value / peak - 1) AS max_dd
  FROM (SELECT *, max(value) OVER (PARTITION BY sim_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS peak FROM pp) GROUP BY 1)"""


# squashed returns, so that a hundred days compound to something readable
SQUASH = "panel AS (SELECT asset, ts, 0.02 * tanh(ret) AS ret FROM panel0)"
PANEL0 = PANEL.replace("panel AS", "panel0 AS", 1)


def with_paths(select, *more):
    return sql(select, BARS, RETS, PANEL0, SQUASH, HIST, PATHS, _WV, *more)


def history(spark, sf):
    return panel(spark, sf).select("asset", "ts", (0.02 * F.tanh("ret")).alias("ret"))


def paths(spark, sf):
    return rs.block_bootstrap(history(spark, sf), SIMS, DAYS, BLOCK)


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "asset string, weight double")


def stats(spark, sf):
    return checkpoint(rs.path_statistics(rs.portfolio_paths(paths(spark, sf), weights(spark))))


@query(with_paths(f"SELECT sim_id, step, asset, {rnd('log_ret')} AS log_ret FROM paths"))
def block_bootstrap(spark, sf):
    return rounded(paths(spark, sf))


@query(with_paths(f"SELECT sim_id, step, {rnd('log_ret')} AS log_ret, {rnd('value')} AS value FROM pp", PP))
def portfolio_paths(spark, sf):
    return rounded(rs.portfolio_paths(paths(spark, sf), weights(spark)))


@query(
    with_paths(
        f"""SELECT sim_id, step, {rnd('ln(value) - coalesce(ln(lag(value) OVER (PARTITION BY sim_id ORDER BY step)), 0)')} AS log_ret, {rnd('value')} AS value FROM (
        SELECT sim_id, step, sum(weight * p) AS value FROM (SELECT *, exp(sum(log_ret) OVER (PARTITION BY sim_id, asset ORDER BY step ROWS UNBOUNDED PRECEDING)) AS p FROM paths) JOIN w USING (asset) GROUP BY 1, 2)"""
    )
)
def portfolio_paths_held(spark, sf):
    return rounded(rs.portfolio_paths(paths(spark, sf), weights(spark), "none"))


@query(
    with_paths(
        f"SELECT sim_id, {rnd('final_value')} AS final_value, {rnd('total_return')} AS total_return, {rnd('ann_ret')} AS ann_ret, {rnd('ann_vol')} AS ann_vol, {rnd('max_dd')} AS max_dd, {rnd('(ann_ret - 0.05) / ann_vol')} AS sharpe FROM stt",
        PP, STATS,
    )
)
def path_statistics(spark, sf):
    return rounded(stats(spark, sf))


@query(
    with_paths(
        f"""SELECT level, {rnd('quantile_cont(total_return, 0.05)')} AS value FROM stt, (SELECT CAST(0.05 AS DOUBLE) AS level) GROUP BY 1 UNION ALL
        SELECT level, {rnd('quantile_cont(total_return, 0.5)')} FROM stt, (SELECT CAST(0.5 AS DOUBLE) AS level) GROUP BY 1 UNION ALL
        SELECT level, {rnd('quantile_cont(total_return, 0.95)')} FROM stt, (SELECT CAST(0.95 AS DOUBLE) AS level) GROUP BY 1""",
        PP, STATS,
    )
)
def percentile_fan(spark, sf):
    return rounded(rs.percentile_fan(stats(spark, sf), [0.05, 0.5, 0.95]))


@query(
    with_paths(
        f"""SELECT {rnd('-any_value(v95)')} AS var95, {rnd('-coalesce(avg(-total_return) FILTER (-total_return > v95), max(-total_return))')} AS cvar95, {rnd('-any_value(v99)')} AS var99,
        {rnd('-coalesce(avg(-total_return) FILTER (-total_return > v99), max(-total_return))')} AS cvar99, {rnd('avg(CASE WHEN total_return > 0 THEN 1 ELSE 0 END) * 100')} AS win_rate, {rnd('avg(total_return)')} AS expected,
        {rnd('avg(ann_ret)')} AS annualized_ret, {rnd('avg(ann_vol)')} AS annualized_vol, {rnd('avg((ann_ret - 0.05) / ann_vol)')} AS sharpe
        FROM stt, (SELECT quantile_cont(-total_return, 0.95) AS v95, quantile_cont(-total_return, 0.99) AS v99 FROM stt)""",
        PP, STATS,
    )
)
def scenario_risk(spark, sf):
    return rounded(rs.scenario_risk(stats(spark, sf)))


@query(
    with_paths(
        f"SELECT {rnd('avg(final_value)')} AS mean, {rnd('stddev_pop(final_value)')} AS std, {rnd('skewness(final_value)')} AS skew, {rnd('kurtosis(final_value)')} AS kurt, {rnd('median(final_value)')} AS median FROM stt",
        PP, STATS,
    )
)
def terminal_moments(spark, sf):
    return rounded(rs.terminal_moments(stats(spark, sf)))


@query(
    with_paths(
        f"""SELECT {rnd('any_value(md)')} AS mean_diff, {rnd('any_value(sd)')} AS std_diff, {rnd('avg(abs(x.c - y.c))')} AS corr_diff FROM
        (SELECT p.asset AS a, q.asset AS b, corr(p.log_ret, q.log_ret) AS c FROM paths p JOIN paths q USING (sim_id, step) GROUP BY 1, 2) x JOIN
        (SELECT p.asset AS a, q.asset AS b, corr(p.log_ret, q.log_ret) AS c FROM hist p JOIN hist q USING (d) GROUP BY 1, 2) y USING (a, b),
        (SELECT avg(abs(m - hm)) AS md, avg(abs(s - hs)) AS sd FROM (SELECT asset, avg(log_ret) AS m, stddev_pop(log_ret) AS s FROM paths GROUP BY 1)
          JOIN (SELECT asset, avg(log_ret) AS hm, stddev_samp(log_ret) AS hs FROM hist GROUP BY 1) USING (asset))"""
    )
)
def moment_validation(spark, sf):
    return rounded(rs.moment_validation(paths(spark, sf), history(spark, sf)))


REG = "reg AS (SELECT ts, CASE WHEN avg(ret) < 0 THEN 'down' ELSE 'up' END AS label FROM panel GROUP BY ts)"


def day_regimes(spark, sf):
    return history(spark, sf).groupBy("ts").agg(F.when(F.avg("ret") < 0, "down").otherwise("up").alias("label"))


def with_reg(select, *more):
    return sql(select, BARS, RETS, PANEL0, SQUASH, REG, *more)


@query(with_reg(f"SELECT label, asset, {rnd('avg(ln(1 + ret))')} AS mean, {rnd('stddev_samp(ln(1 + ret))')} AS std FROM panel JOIN reg USING (ts) GROUP BY 1, 2"))
def regime_moments(spark, sf):
    return rounded(rs.regime_moments(history(spark, sf), day_regimes(spark, sf))["moments"])


@query(
    with_reg(
        f"SELECT x.label, x.asset AS a, y.asset AS b, {rnd('corr(ln(1 + x.ret), ln(1 + y.ret))')} AS corr, count(*) AS n FROM (SELECT * FROM panel JOIN reg USING (ts)) x JOIN panel y USING (ts) GROUP BY 1, 2, 3"
    )
)
def regime_moment_correlation(spark, sf):
    return rounded(rs.regime_moments(history(spark, sf), day_regimes(spark, sf))["correlation"])


@query(
    with_reg(
        f"""SELECT f AS from_state, t AS to_state, count(*) AS count, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY f)')} AS prob FROM (
        SELECT label AS f, lead(label) OVER (ORDER BY ts) AS t FROM reg) WHERE t IS NOT NULL GROUP BY 1, 2"""
    )
)
def regime_moment_transitions(spark, sf):
    return rounded(rs.regime_moments(history(spark, sf), day_regimes(spark, sf))["transitions"])


RB = f"""rg0 AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS step, CASE WHEN lag(label) OVER (ORDER BY ts) <> label THEN 1 ELSE 0 END AS ch, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM reg),
rg1 AS (SELECT *, min(step) OVER (PARTITION BY run) AS run0 FROM (SELECT *, sum(ch) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM rg0)),
rb AS (SELECT sim, step, label, (CAST(floor({uniform_sql(42, 'sim', 'run')} * n) AS BIGINT) + step - run0) % n AS pos FROM rg1, range(10) t(sim))"""


@query(
    with_reg(
        f"SELECT sim AS sim_id, rb.step, asset, rb.label, {rnd('ln(1 + ret)')} AS log_ret FROM rb JOIN rg1 ON rg1.label = rb.label AND rg1.pos = rb.pos JOIN panel ON panel.ts = rg1.ts", RB
    )
)
def regime_block_bootstrap(spark, sf):
    return rounded(rs.regime_block_bootstrap(history(spark, sf), day_regimes(spark, sf), 10))


# --- significance


@query(
    with_mrets(
        f"""SELECT asset, {rnd('avg(CASE WHEN a = b THEN 1 ELSE 0 END)')} AS accuracy, {rnd('1 / count(DISTINCT a)')} AS null_accuracy, count(*) AS n FROM (
        SELECT asset, CASE WHEN ret < 0 THEN 'down' ELSE 'up' END AS a, CASE WHEN volume < 80 THEN 'down' ELSE 'up' END AS b FROM rets) GROUP BY 1"""
    )
)
def accuracy_test(spark, sf):
    d = mrets(spark, sf).select("asset", F.when(F.col("ret") < 0, "down").otherwise("up").alias("a"), F.when(F.col("volume") < 80, "down").otherwise("up").alias("b"))
    return rounded(va.accuracy_test(d, "a", "b", ["asset"]).select("asset", "accuracy", "null_accuracy", "n"))


@query()
def accuracy_test_p_values(spark, sf):
    d = mrets(spark, sf).select("asset", F.when(F.col("ret") < 0, "down").otherwise("up").alias("a"), F.when(F.col("volume") < 80, "down").otherwise("up").alias("b"))
    return rounded(va.accuracy_test(d, "a", "b", ["asset"]), 4)


EXCESS = "ex AS (SELECT asset, ret - b AS x, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i FROM rets JOIN (SELECT ts, avg(ret) AS b FROM rets GROUP BY 1) USING (ts))"
RATIOS = f"""ir AS (SELECT asset, b, sum(w * x) / sum(w) AS m, greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)), 0) AS v
  FROM (SELECT asset, x, b, {poisson1_sql('u')} AS w FROM (SELECT asset, x, b, {uniform_sql(42, 'i', 'b')} AS u FROM ex, range({BOOTS}) t(b))) GROUP BY 1, 2 HAVING sum(w) > 0),
ci AS (SELECT asset, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (SELECT asset, CASE WHEN v > 0 THEN m / sqrt(v) * sqrt(252) END AS r FROM ir) GROUP BY 1)"""


@query(
    with_mrets(
        f"""SELECT asset, {rnd('avg(x) * 252', 4)} AS excess_return_mean, {rnd('avg(x) / stddev_samp(x) * sqrt(252)', 4)} AS information_ratio,
        {rnd('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 4)} AS t_statistic, count(*) AS n, {rnd('any_value(lo)', 4)} AS ir_lower, {rnd('any_value(hi)', 4)} AS ir_upper FROM ex JOIN ci USING (asset) GROUP BY 1""",
        EXCESS, RATIOS,
    )
)
def outperformance_test(spark, sf):
    r = mrets(spark, sf)
    d = r.join(r.groupBy("ts").agg(F.avg("ret").alias("b")), "ts")
    return rounded(va.outperformance_test(d, "ret", "b", ["asset"], n=BOOTS, method="poisson").select("asset", "excess_return_mean", "information_ratio", "t_statistic", "n", "ir_lower", "ir_upper"), 4)


@query(
    with_mrets(
        f"""SELECT asset, {rnd('avg(ret - b)')} AS mean_difference, {rnd('avg(ret - b) / (stddev_samp(ret - b) / sqrt(count(*)))')} AS t_statistic, count(*) AS n FROM rets JOIN (SELECT ts, avg(ret) AS b FROM rets GROUP BY 1) USING (ts) GROUP BY 1"""
    )
)
def paired_t_test(spark, sf):
    r = mrets(spark, sf)
    d = r.join(r.groupBy("ts").agg(F.avg("ret").alias("b")), "ts")
    return rounded(va.paired_t_test(d, "ret", "b", ["asset"]).drop("p_value", "is_significant"))
