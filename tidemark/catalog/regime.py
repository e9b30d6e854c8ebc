"""Regime labels, statistics and fusion: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import BARS, MANY, RETS, mrets, rets, rnd, rounded, sql, with_mrets
from tidemark.operators import regime as rg

QUERIES, ORACLES = {}, {}
A = ["asset"]
W = "PARTITION BY asset ORDER BY ts"

LAB = f"""lab0 AS (SELECT asset, ts, ret, CASE WHEN count(ret) OVER ({W} ROWS 20 PRECEDING) = 21 THEN stddev_samp(ret) OVER ({W} ROWS 20 PRECEDING) END AS vol FROM rets),
lab AS (SELECT l.asset, l.ts, l.ret, l.vol, CASE WHEN vol IS NULL THEN NULL WHEN vol <= q[1] THEN 'Low Vol' WHEN vol <= q[2] THEN 'Medium Vol' ELSE 'High Vol' END AS label
  FROM lab0 l JOIN (SELECT asset, quantile_cont(vol, [CAST(1 AS DOUBLE) / 3, CAST(2 AS DOUBLE) / 3]) AS q FROM lab0 GROUP BY 1) USING (asset)),
labs AS (SELECT * FROM lab WHERE label IS NOT NULL)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def with_labels(select, *more):
    return sql(select, MANY, RETS, LAB, *more)


def labels(spark, sf):
    return rg.vol_regime(mrets(spark, sf)).filter(F.col("label").isNotNull()).select("asset", "ts", "ret", "vol", "label")


@query(with_labels(f"SELECT asset, ts, {rnd('vol')} AS vol, label FROM lab"))
def vol_regime(spark, sf):
    return rounded(rg.vol_regime(mrets(spark, sf)).select("asset", "ts", "vol", "label"))


SMOOTH = f"""n AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY asset) AS cnt FROM labs),
vote AS (SELECT a.asset, a.ts, b.label, count(*) AS c FROM n a JOIN n b ON a.asset = b.asset AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY 1, 2, 3),
win AS (SELECT asset, ts, label AS m FROM (SELECT *, row_number() OVER (PARTITION BY asset, ts ORDER BY c DESC, label) AS r FROM vote) WHERE r = 1)"""


@query(with_labels("SELECT n.asset, n.ts, CASE WHEN i > 5 AND i <= cnt - 5 THEN m ELSE label END AS label FROM n JOIN win USING (asset, ts)", SMOOTH))
def smooth_mode(spark, sf):
    return rg.smooth_mode(labels(spark, sf), 5, A).select("asset", "ts", "label")


TRANS = f"""tr AS (SELECT asset, label AS f, lead(label) OVER ({W}) AS t FROM labs)"""


@query(
    with_labels(
        f"""SELECT asset, f AS from_state, t AS to_state, count(*) AS count, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY asset, f)')} AS prob FROM tr WHERE t IS NOT NULL GROUP BY 1, 2, 3""",
        TRANS,
    )
)
def transition_matrix(spark, sf):
    return rounded(rg.transition_matrix(labels(spark, sf), A))


STATS = """grid AS (SELECT asset, label FROM (SELECT DISTINCT asset FROM labs) CROSS JOIN (VALUES ('Low Vol'), ('Medium Vol'), ('High Vol'), ('None')) v(label)),
st AS (SELECT asset, label, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS s, count(*) AS n FROM labs GROUP BY 1, 2)"""


@query(
    with_labels(
        f"""SELECT g.asset, g.label, {rnd('m')} AS mean_return, {rnd('s')} AS volatility, {rnd('coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.asset)')} AS frequency, {rnd('m / s')} AS sharpe
        FROM grid g LEFT JOIN st ON st.asset = g.asset AND st.label = g.label""",
        STATS,
    )
)
def regime_stats(spark, sf):
    d = labels(spark, sf)
    return rounded(rg.regime_stats(d.select("asset", "ts", "ret"), d, (*rg.LABELS, "None"), A))


@query(with_labels(f"SELECT g.asset, g.label, {rnd('m / s')} AS information_ratio FROM grid g LEFT JOIN st ON st.asset = g.asset AND st.label = g.label WHERE g.label <> 'None'", STATS))
def information_ratio_by_regime(spark, sf):
    d = labels(spark, sf)
    return rounded(rg.information_ratio_by_regime(d.select("asset", "ts", "ret"), d, key=A))


CH = f"""ch AS (SELECT *, CASE WHEN lag(label) OVER ({W}) <> label THEN 1 ELSE 0 END AS changed FROM labs),
rn AS (SELECT *, sum(changed) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM ch)"""


@query(with_labels(f"SELECT asset, {rnd('1 - sum(changed) / count(*)')} AS persistence FROM ch GROUP BY 1", CH))
def regime_persistence(spark, sf):
    return rounded(rg.regime_persistence(labels(spark, sf), A))


@query(
    with_labels(
        "SELECT asset, CAST(run AS BIGINT) AS run, any_value(label) AS label, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM rn GROUP BY 1, 2", CH
    )
)
def regime_runs(spark, sf):
    return rg.regime_runs(labels(spark, sf), A)


@query(with_labels(f"SELECT asset, {rnd('count(*) / count(DISTINCT run)')} AS avg_duration FROM rn GROUP BY 1", CH))
def average_duration(spark, sf):
    return rounded(rg.average_duration(labels(spark, sf), A))


@query(
    with_labels(
        f"""SELECT asset, CAST(any_value(tc) AS BIGINT) AS transition_count, any_value(label) AS current_regime, count(*) AS time_since_last_transition, count(*) AS current_regime_duration,
        {rnd('min(cum / peak - 1)')} AS drawdown_since_last_regime FROM (SELECT *, max(cum) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM (
          SELECT *, product(1 + ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, max(run) OVER (PARTITION BY asset) + 1 AS tc FROM rn) WHERE run = tc - 1)) GROUP BY 1""",
        CH,
    )
)
def regime_path_features(spark, sf):
    d = labels(spark, sf)
    return rounded(rg.regime_path_features(d.select("asset", "ts", "ret"), d, A))


@query(
    with_labels(
        f"""SELECT asset, current_regime, {rnd('1 - (sum(c) + 1) / count(*)')} AS stability, {rnd('avg(confidence)')} AS average_confidence,
        {rnd('avg(CASE WHEN label = current_regime THEN 1 ELSE 0 END)')} AS persistence, count(*) AS sample_size, {rnd('any_value(prob)')} AS transition_stability
        FROM (SELECT *, max_by(label, ts) OVER (PARTITION BY asset) AS current_regime FROM (
          SELECT asset, ts, label, 1 / (1 + abs(ret)) AS confidence, CASE WHEN lag(label) OVER ({W}) <> label THEN 1 ELSE 0 END AS c
          FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS rn FROM labs) WHERE rn <= 63))
        LEFT JOIN (SELECT asset AS ta, f, count(*) FILTER (t = f) / count(*) AS prob FROM tr WHERE t IS NOT NULL GROUP BY 1, 2) ON ta = asset AND f = current_regime GROUP BY 1, 2""",
        TRANS,
    )
)
def confidence_metrics(spark, sf):
    d = labels(spark, sf)
    h = d.select("asset", "ts", "label", (1 / (1 + F.abs("ret"))).alias("confidence"))
    return rounded(rg.confidence_metrics(h, rg.transition_matrix(d, A), 63, A))


# --- fusion: two distributions over three states derived from price and volume

P = """pr AS (SELECT asset, ts, [1 / (1 + abs(ret)), 0.5, CASE WHEN ret > 0.5 THEN 0.9 ELSE 0.1 END] AS a0, [volume / (volume + 100), 0.3, CASE WHEN volume > 900 THEN NULL ELSE 0.2 END] AS b0 FROM rets),
pa AS (SELECT asset, ts, [CAST(x AS DOUBLE) / list_sum(a0) FOR x IN a0] AS a, b0 FROM pr),
pn AS (SELECT asset, ts, a, [CAST(x AS DOUBLE) / list_sum(b0) FOR x IN b0] AS b FROM pa WHERE b0[3] IS NOT NULL)"""
FUSE = """fe AS (SELECT *, [w * a[1] + (1 - w) * b[1], w * a[2] + (1 - w) * b[2], w * a[3] + (1 - w) * b[3]] AS p FROM (
  SELECT *, least(greatest(sa / (sa + sb + 1e-8), 0.05), 0.95) AS w FROM (
    SELECT *, list_max(a) / greatest(-(a[1] * ln(a[1]) + a[2] * ln(a[2]) + a[3] * ln(a[3])), 0.02) AS sa,
              list_max(b) / greatest(-(b[1] * ln(b[1]) + b[2] * ln(b[2]) + b[3] * ln(b[3])), 0.02) AS sb FROM pn)))"""


def with_probs(select, *more):
    return sql(select, MANY, RETS, P, *more)


def probs(spark, sf):
    r = mrets(spark, sf)
    norm = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
    a = F.array(1 / (1 + F.abs("ret")), F.lit(0.5), F.when(F.col("ret") > 0.5, 0.9).otherwise(0.1))
    b = F.array(F.col("volume") / (F.col("volume") + 100), F.lit(0.3), F.when(F.col("volume") > 900, None).otherwise(0.2))
    d = r.withColumns({"_a": a, "_b": b})
    ok = F.col("_b")[2].isNotNull()
    return d.select("asset", "ts", norm(F.col("_a")).alias("p")), d.select("asset", "ts", F.when(ok, norm(F.col("_b"))).otherwise(F.col("_b")).alias("p"))


def spread(d, *more):
    return d.select("asset", "ts", *[F.col("p")[i].alias(f"p{i}") for i in range(3)], *more)


PS = ", ".join(f"{rnd(f'p[{i + 1}]')} AS p{i}" for i in range(3))


@query(with_probs(f"SELECT asset, ts, {PS}, {rnd('w')} AS w FROM fe", FUSE))
def fuse_entropy(spark, sf):
    a, b = probs(spark, sf)
    return rounded(spread(rg.fuse_entropy(a, b.filter(F.col("p")[2].isNotNull()), A), "w"))


@query(
    with_probs(
        f"SELECT asset, ts, {PS} FROM (SELECT asset, ts, [x / list_sum(r) FOR x IN r] AS p FROM (SELECT asset, ts, [pow(a[1], 0.7) * pow(b[1], 1.3), pow(a[2], 0.7) * pow(b[2], 1.3), pow(a[3], 0.7) * pow(b[3], 1.3)] AS r FROM pn))"
    )
)
def fuse_product(spark, sf):
    a, b = probs(spark, sf)
    return rounded(spread(rg.fuse_product(a, b.filter(F.col("p")[2].isNotNull()), 0.7, 1.3, A)))


@query(
    with_probs(
        f"""SELECT {rnd('sa / (sa + sb)')} AS weight_a, {rnd('sb / (sa + sb)')} AS weight_b FROM (
        SELECT avg(list_max(a)) / least(greatest(avg(-list_sum([x * ln(x + 1e-8) FOR x IN a])), 0.1), 2) AS sa,
               avg(list_max(b)) / least(greatest(avg(-list_sum([x * ln(x + 1e-8) FOR x IN b])), 0.1), 2) AS sb FROM pn)"""
    )
)
def global_model_weights(spark, sf):
    a, b = probs(spark, sf)
    return rounded(rg.global_model_weights(a, b.filter(F.col("p")[2].isNotNull()), A))


@query(
    with_probs(
        """SELECT pa.asset, pa.ts, ['Low Vol', 'Medium Vol', 'High Vol'][list_position(coalesce(p, pa.a), list_max(coalesce(p, pa.a)))] AS label FROM pa LEFT JOIN fe USING (asset, ts)""",
        FUSE,
    )
)
def fuse_labels(spark, sf):
    a, b = probs(spark, sf)
    return rg.fuse_labels(a, b, key=A)


@query(with_probs(f"SELECT asset, ts, {PS} FROM fe", FUSE))
def ensemble_probabilities(spark, sf):
    a, b = probs(spark, sf)
    return rounded(spread(rg.ensemble_probabilities(a, b, A)))


# --- sequences and baselines


@query(
    sql(
        f"""SELECT asset, ts, {rnd('list_sum(x)')} AS total, {rnd('x[1]')} AS oldest, CAST(len(x) AS INT) AS n FROM (
        SELECT asset, ts, list(ret) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS x FROM rets) WHERE len(x) = 20""",
        BARS, RETS,
    )
)
def sequence_windows(spark, sf):
    d = rg.sequence_windows(rets(spark, sf), ["ret"], 20)
    return rounded(d.select("asset", "ts", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("x")[0].alias("oldest"), F.size("x").alias("n")))


@query(
    with_mrets(
        f"""SELECT asset, {rnd('avg(ret)')} AS mean_return, {rnd('avg(b)')} AS baseline_mean_return, {rnd('avg(ret - b)')} AS mean_difference,
        {rnd('avg(ret - b) / (stddev_samp(ret - b) / sqrt(count(*)))')} AS t_statistic, count(*) AS n
        FROM (SELECT *, avg(ret) OVER ({W} ROWS 9 PRECEDING) AS b FROM rets) GROUP BY 1"""
    )
)
def compare_to_benchmark(spark, sf):
    d = rg.compare_to_benchmark(mrets(spark, sf), "moving_average", key=A)
    return rounded(d.drop("p_value", "is_significant"))


