"""Sources, preparation, cross-section: queries and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.catalog.base import (
    BARS, MACRO, MANY, PANEL, RETS, bars, macro, many, mrets, panel, r6, rets, rnd, rounded, sql, with_mrets, with_panel, with_rets,
)
from tidemark.operators import cross, features, prep, risk
from tidemark.sources import market
from tidemark.session import work_path

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- sources and sinks


@query(sql(f"SELECT asset, ts, {rnd('close')} AS close, volume FROM bars", BARS))
def read_write_bars(spark, sf):
    """Bars written partitioned by asset, and read back with the declared schema."""
    path = work_path(spark, "bars")
    market.write_bars(bars(spark, sf), path)
    return rounded(market.read_bars(spark, path, schema=market.BARS).select("asset", "ts", "close", "volume"))


@query(sql(f"SELECT asset, ts, {rnd('close')} AS close, volume FROM bars", BARS))
def read_write_bars_csv(spark, sf):
    path = work_path(spark, "bars")
    market.write_bars(bars(spark, sf), path, fmt="csv")
    return rounded(market.read_bars(spark, path, fmt="csv", schema=bars(spark, sf).drop("asset").schema.add("asset", "string")).select("asset", "ts", "close", "volume"))


@query(
    """SELECT 'PART' AS asset, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS close, l_quantity AS volume FROM lineitem"""
)
def normalize_columns(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Adj Close PART"), F.col("l_tax").alias("Close"), F.col("l_quantity").alias("Volume")
    )
    return market.normalize_columns(raw, "PART")


ASSETS = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]


@query(
    sql(
        "SELECT ts, " + ", ".join(f"max(close) FILTER (asset = '{a}') AS \"{a}\"" for a in ASSETS) + " FROM bars GROUP BY ts",
        BARS,
    )
)
def long_to_wide(spark, sf):
    return prep.long_to_wide(bars(spark, sf), "close", ASSETS)


@query(
    sql(
        f"""SELECT ts, asset, {rnd('ret')} AS ret FROM panel""",
        BARS, RETS, PANEL,
    )
)
def wide_to_long(spark, sf):
    wide = prep.long_to_wide(panel(spark, sf), "ret", ASSETS)
    return rounded(prep.wide_to_long(wide, "ret").select("ts", "asset", "ret"))


@query(
    sql(
        """SELECT g.asset, g.ts, close, volume
        FROM (SELECT CAST(d AS DATE) AS ts, asset FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d),
              (VALUES ('A-F'), ('A-O'), ('N-F'), ('N-O'), ('R-F'), ('R-O'), ('NONE')) a(asset)) g
        LEFT JOIN bars b ON b.asset = g.asset AND b.ts = g.ts""",
        BARS,
    )
)
def calendar_fill(spark, sf):
    return prep.calendar_fill(bars(spark, sf), "1995-01-01", "2001-12-31", [*ASSETS, "NONE"])


@query(sql(f"SELECT series, ts, {rnd('value')} AS value FROM macro WHERE series IN ('1-URGENT', '2-HIGH')", MACRO))
def read_macro(spark, sf):
    """Macro levels from a file whose level column is called Price."""
    path = work_path(spark, "results")
    market.write_results({"macro": macro(spark, sf).withColumnRenamed("value", "Price")}, path)
    return rounded(market.read_macro(spark, f"{path}/macro", ["1-URGENT", "2-HIGH"]))


@query(sql("SELECT asset, count(*) AS rows, count(ret) AS written FROM rets GROUP BY 1", BARS, RETS))
def write_results(spark, sf):
    """JSON and CSV outputs, counted after reading back."""
    path = work_path(spark, "results")
    summary = prep.quality_summary(rets(spark, sf))
    market.write_results({"summary": summary}, path, "json")
    market.write_results({"returns": rets(spark, sf).select("asset", "ts", "ret")}, path, "csv")
    a = spark.read.json(f"{path}/summary", schema="asset string, rows long").select("asset", "rows")
    b = spark.read.schema("asset string, ts date, ret double").option("header", "true").csv(f"{path}/returns")
    return a.join(b.groupBy("asset").agg(F.count("ret").alias("written")), "asset")


@query(
    sql(
        f"""SELECT a.n AS returns_rows, {rnd('a.m')} AS returns_mean, b.n AS macro_rows, c.n AS panel_dates
        FROM (SELECT count(*) AS n, avg(ret) AS m FROM rets) a, (SELECT count(*) AS n FROM macro) b,
             (SELECT count(DISTINCT ts) AS n FROM panel) c""",
        BARS, RETS, PANEL, MACRO,
    )
)
def summary_record(spark, sf):
    r = rets(spark, sf).agg(F.count("ret").alias("rows"), F.avg("ret").alias("mean"))
    m = macro(spark, sf).agg(F.count("value").alias("rows"))
    p = panel(spark, sf).agg(F.count_distinct("ts").alias("dates"))
    return rounded(market.summary_record(returns=r, macro=m, panel=p))


# --- fills, returns, resampling

_GRID = """grid AS (
  SELECT a.asset, d.ts, b.close FROM (SELECT DISTINCT asset FROM bars) a
  CROSS JOIN (SELECT DISTINCT ts FROM bars) d LEFT JOIN bars b ON b.asset = a.asset AND b.ts = d.ts)"""


def _grid(spark, sf):
    b = bars(spark, sf)
    days = b.select("ts").distinct().withColumn("asset", F.explode(F.array(*[F.lit(a) for a in ASSETS])))
    return days.join(b.select("asset", "ts", "close"), ["asset", "ts"], "left")


@query(
    sql(
        """SELECT asset, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS close FROM grid""",
        BARS, _GRID,
    )
)
def ffill(spark, sf):
    return prep.ffill(_grid(spark, sf), ["close"])


@query(
    sql(
        """SELECT asset, ts, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING),
          first_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS close
        FROM grid""",
        BARS, _GRID,
    )
)
def fill_all(spark, sf):
    return prep.fill_all(_grid(spark, sf), ["close"])


@query(with_mrets(f"SELECT asset, ts, {rnd('ret')} AS ret FROM rets"))
def pct_change(spark, sf):
    return rounded(mrets(spark, sf).select("asset", "ts", "ret"))


@query(with_panel(f"SELECT asset, ts, {rnd('ret')} AS ret FROM panel"))
def pct_change_any_asset(spark, sf):
    return rounded(panel(spark, sf).select("asset", "ts", "ret"))


@query(with_mrets(f"SELECT asset, ts, {rnd('ln(1 + ret)')} AS log_ret FROM rets"))
def log_return(spark, sf):
    return rounded(prep.log_return(mrets(spark, sf)).select("asset", "ts", "log_ret"))


for _f, _e in (
    ("W", "CAST(date_trunc('week', ts) AS DATE) + 6"),
    ("M", "last_day(ts)"),
):

    def _resample(spark, sf, f=_f):
        return rounded(prep.resample_last(rets(spark, sf), f, ["close", "ret"]))

    QUERIES[f"resample_last_{_f.lower()}"] = _resample
    ORACLES[f"resample_last_{_f.lower()}"] = with_rets(
        f"SELECT asset, CAST({_e} AS DATE) AS ts, max_by(close, ts) AS close, {rnd('max_by(ret, ts)')} AS ret FROM rets GROUP BY 1, CAST({_e} AS DATE)"
    )


@query(
    with_rets(
        f"""SELECT asset, CAST(last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) AS DATE) AS ts, {rnd('sum(ret)')} AS ret FROM rets GROUP BY 1, 2"""
        .replace("GROUP BY 1, 2", "GROUP BY 1, CAST(last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) AS DATE)")
    )
)
def resample_sum_q(spark, sf):
    return rounded(prep.resample_sum(rets(spark, sf), "Q"))


# --- joins

_MW = """mw AS (SELECT ts, max(value) FILTER (series = '1-URGENT') AS u, max(value) FILTER (series = '2-HIGH') AS h FROM macro GROUP BY ts)"""
_MJ = """mj AS (
  SELECT asset, r.ts, last_value(u IGNORE NULLS) OVER (PARTITION BY asset ORDER BY r.ts ROWS UNBOUNDED PRECEDING) AS u
  FROM rets r LEFT JOIN mw ON mw.ts = r.ts)"""


@query(
    with_rets(
        f"""SELECT asset, ts, {rnd('u')} AS urgent,
        {rnd("CASE WHEN count(u) OVER (PARTITION BY asset ORDER BY ts ROWS 20 PRECEDING) = 21 THEN avg(u) OVER (PARTITION BY asset ORDER BY ts ROWS 20 PRECEDING) END", 4)} AS urgent_ma,
        {rnd("CASE WHEN count(u) OVER (PARTITION BY asset ORDER BY ts ROWS 251 PRECEDING) = 252 THEN u - avg(u) OVER (PARTITION BY asset ORDER BY ts ROWS 251 PRECEDING) END", 4)} AS urgent_spread
        FROM mj""",
        MACRO, _MW, _MJ,
    )
)
def macro_join(spark, sf):
    d = prep.macro_join(rets(spark, sf), macro(spark, sf), ["1-URGENT"])
    return d.select(
        "asset", "ts", r6("1-URGENT_yield").alias("urgent"), r6("1-URGENT_yield_ma", 4).alias("urgent_ma"), r6("1-URGENT_yield_spread", 4).alias("urgent_spread")
    )


@query(
    with_rets(
        f"""SELECT r.asset, r.ts, {rnd('u')} AS u, {rnd('h')} AS h FROM rets r ASOF LEFT JOIN
        (SELECT ts, last_value(u IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS u,
                last_value(h IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS h FROM mw) m ON r.ts >= m.ts""",
        MACRO, _MW,
    )
)
def asof_macro_join(spark, sf):
    d = prep.asof_macro_join(rets(spark, sf).select("asset", "ts"), macro(spark, sf), ["1-URGENT", "2-HIGH"])
    return rounded(d.select("asset", "ts", F.col("1-URGENT").alias("u"), F.col("2-HIGH").alias("h")))


@query(with_rets(f"SELECT asset, ts, {rnd('ret')} AS ret, {rnd('value')} AS value FROM rets JOIN macro USING (ts) WHERE series = '1-URGENT'", MACRO))
def align(spark, sf):
    m = macro(spark, sf).filter("series = '1-URGENT'").select("ts", "value")
    return rounded(prep.align(rets(spark, sf).select("asset", "ts", "ret"), m, ["ts"]))


@query(
    sql(
        "SELECT asset, count(*) AS n FROM bars WHERE asset IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
        MANY,
    )
)
def common_assets(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("asset"))
    return prep.common_assets(many(spark, sf), s).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        "SELECT asset, count(*) FILTER (close IS NULL) AS nulls, max(close) > min(close) AS varies, "
        "count(*) FILTER (close IS NULL) = 0 AND count(DISTINCT close) > 1 AS ok FROM bars GROUP BY 1",
        MANY,
    )
)
def integrity_check(spark, sf):
    return prep.integrity_check(many(spark, sf))


@query(
    with_mrets(
        f"""SELECT asset, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ret IS NULL) AS nulls,
        count(*) FILTER (ret = 0) AS zeros, {rnd('avg(ret) * 252')} AS annual_return, {rnd('stddev_samp(ret) * sqrt(252)')} AS annual_vol,
        {rnd('avg(ret) * 252 / (stddev_samp(ret) * sqrt(252))')} AS sharpe FROM rets GROUP BY asset"""
    )
)
def quality_summary(spark, sf):
    return rounded(prep.quality_summary(mrets(spark, sf)))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 7 = 1 THEN 0.0 ELSE value END AS value,
    CASE WHEN try_cast(event_type AS DOUBLE) IS NULL THEN CAST(0 AS DOUBLE) END AS event_type FROM events"""
)
def sanitize(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    broken = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("-inf")).otherwise(F.col("value"))
    return prep.sanitize(e.select("event_id", broken.alias("value"), "event_type"), ["value", "event_type"])


@query(with_rets(f"SELECT ts, {rnd('avg(ret)')} AS ret FROM rets GROUP BY ts"))
def equal_weight_portfolio(spark, sf):
    return rounded(prep.equal_weight_portfolio(rets(spark, sf)))


WEIGHTS = {"A-F": 0.3, "A-O": 0.1, "N-F": 0.1, "N-O": 0.2, "R-F": 0.2, "R-O": 0.1}
_WV = "w(asset, weight) AS (VALUES " + ", ".join(f"('{a}', CAST({w} AS DOUBLE))" for a, w in WEIGHTS.items()) + ")"


@query(with_rets(f"SELECT ts, {rnd('sum(weight * ret)')} AS ret FROM rets JOIN w USING (asset) GROUP BY ts", _WV))
def weighted_portfolio(spark, sf):
    return rounded(prep.weighted_portfolio(rets(spark, sf), WEIGHTS))


# --- scaling


@query(
    with_mrets(
        f"""SELECT asset, ts, {rnd('(ret - avg(ret) OVER (PARTITION BY asset)) / (stddev_samp(ret) OVER (PARTITION BY asset) + 1e-8)')} AS ret FROM rets"""
    )
)
def zscore(spark, sf):
    return rounded(prep.zscore(mrets(spark, sf).select("asset", "ts", "ret"), ["ret"]))


@query(
    with_mrets(
        f"""SELECT asset, ts, {rnd('greatest(least(ret, q[2]), q[1])')} AS ret FROM rets,
        (SELECT quantile_cont(ret, [0.01, 0.99]) AS q FROM rets)"""
    )
)
def winsorize(spark, sf):
    return rounded(prep.winsorize(mrets(spark, sf).select("asset", "ts", "ret"), ["ret"]))


@query(
    with_mrets(
        f"""SELECT asset, ts, {rnd('greatest(least(ret, q[2]), q[1])')} AS ret FROM rets JOIN
        (SELECT asset, quantile_cont(ret, [0.01, 0.99]) AS q FROM rets GROUP BY asset) USING (asset)"""
    )
)
def winsorize_by_asset(spark, sf):
    return rounded(prep.winsorize(mrets(spark, sf).select("asset", "ts", "ret"), ["ret"], key=["asset"]))


@query(with_mrets(f"SELECT asset, ts, {rnd('(ret - (SELECT avg(ret) FROM rets)) / (SELECT stddev_pop(ret) FROM rets)')} AS ret FROM rets"))
def standard_scale(spark, sf):
    return rounded(prep.standard_scale(mrets(spark, sf).select("asset", "ts", "ret"), ["ret"]))


@query(
    with_mrets(
        f"""SELECT asset, ts, {rnd('greatest(least((ret - q[2]) / (q[3] - q[1]), 10), -10)')} AS ret FROM rets,
        (SELECT quantile_cont(ret, [0.25, 0.5, 0.75]) AS q FROM rets)"""
    )
)
def robust_scale(spark, sf):
    return rounded(prep.robust_scale(mrets(spark, sf).select("asset", "ts", "ret"), ["ret"]))


@query("SELECT event_id, value FROM events")
def drop_constant_features(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", F.lit(3.0).alias("flat"))
    return prep.drop_constant_features(e, ["value", "flat"])[0]


@query(
    with_mrets(
        """SELECT asset, count(*) FILTER (ret IS NULL) AS nulls, count(*) FILTER (abs((ret - m) / s) > 5) AS extremes
        FROM rets JOIN (SELECT asset, avg(ret) AS m, stddev_pop(ret) AS s FROM rets GROUP BY asset) USING (asset) GROUP BY asset"""
    )
)
def extreme_flag(spark, sf):
    return prep.extreme_flag(mrets(spark, sf))


@query(
    with_mrets(
        """SELECT asset, ts, CASE WHEN rn > n - ceil(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS role FROM (
        SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn, count(*) OVER (PARTITION BY asset) AS n FROM rets)"""
    )
)
def chrono_split(spark, sf):
    return prep.chrono_split(mrets(spark, sf)).select("asset", "ts", "role")


@query(
    with_mrets(
        """SELECT asset, CAST(fold AS INT) AS fold, count(*) FILTER (i < n - (5 - fold) * size) AS train_rows,
          count(*) FILTER (i >= n - (5 - fold) * size AND i < n - (4 - fold) * size) AS test_rows
        FROM (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n,
              count(*) OVER (PARTITION BY asset) // 6 AS size FROM rets), range(5) t(fold) GROUP BY 1, 2"""
    )
)
def time_series_folds(spark, sf):
    d = prep.time_series_folds(mrets(spark, sf), 5)
    return d.groupBy("asset", "fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows")
    )


# --- cross-section, sort, top-k

_MOM = """mom AS (SELECT asset, ts, CASE WHEN count(ret) OVER w = 20 THEN avg(ret) OVER w END AS m FROM rets
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING))"""


@query(
    with_mrets(
        f"""SELECT asset, ts, {rnd('''CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY m)
          + (count(*) OVER (PARTITION BY ts, m) - 1) / 2) / count(m) OVER (PARTITION BY ts) END''')} AS momentum_rank
        FROM mom""",
        _MOM,
    )
)
def cross_sectional_rank_pct(spark, sf):
    m = cross.rolling_momentum(mrets(spark, sf))
    return rounded(features.cross_sectional_rank_pct(m).select("asset", "ts", "momentum_rank"))


@query(
    with_panel(
        f"""SELECT ts, {rnd('avg(ret)')} AS ret FROM (
          SELECT ts, ret, row_number() OVER (PARTITION BY ts ORDER BY p DESC, asset) AS rn, count(*) OVER (PARTITION BY ts) AS n FROM (
            SELECT asset, ts, ret, count(*) OVER w AS c, product(1 + ret) OVER w - 1 AS p FROM panel
            WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE c = 20)
        WHERE rn <= n // 2 GROUP BY ts"""
    )
)
def top_half_momentum(spark, sf):
    return rounded(cross.top_half_momentum(panel(spark, sf)))


@query(with_mrets(f"SELECT asset, ts, {rnd('lead(ret) OVER (PARTITION BY asset ORDER BY ts)')} AS forward_ret FROM rets"))
def forward_return(spark, sf):
    return rounded(cross.forward_return(mrets(spark, sf)).select("asset", "ts", "forward_ret"))


@query(
    with_mrets(
        f"""SELECT x.asset AS a, y.asset AS b, {rnd('corr(x.ret, y.ret)')} AS corr, count(*) AS n FROM rets x JOIN rets y ON x.ts = y.ts GROUP BY 1, 2"""
    )
)
def correlation(spark, sf):
    return rounded(cross.correlation(mrets(spark, sf)))


STRONG = """c AS (SELECT x.asset AS a, y.asset AS b, corr(x.ret, y.ret) AS corr, count(*) AS n FROM rets x JOIN rets y ON x.ts = y.ts AND x.asset < y.asset
  GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(x.ret, y.ret)) >= 0.15)"""


@query(with_mrets(f"SELECT a, b, {rnd('corr')} AS corr, n FROM c", STRONG))
def strong_pairs(spark, sf):
    """Only the pairs of suppliers whose returns go together."""
    return rounded(cross.strong_pairs(mrets(spark, sf), 0.15))


@query(
    with_mrets(
        f"""SELECT asset, CAST(rank AS INT) AS rank, other, {rnd('corr')} AS corr, n FROM (
        SELECT *, row_number() OVER (PARTITION BY asset ORDER BY abs(corr) DESC, other) AS rank FROM (SELECT a AS asset, b AS other, corr, n FROM c UNION ALL SELECT b, a, corr, n FROM c)) WHERE rank <= 3""",
        STRONG,
    )
)
def strongest_partners(spark, sf):
    return rounded(cross.strong_pairs(mrets(spark, sf), 0.15, top=3))


@query(
    with_rets(
        f"""SELECT x.asset AS a, y.asset AS b, {rnd('covar_samp(x.ret, y.ret) * 252')} AS cov, count(*) AS n FROM rets x JOIN rets y ON x.ts = y.ts GROUP BY 1, 2"""
    )
)
def covariance(spark, sf):
    return rounded(cross.covariance(rets(spark, sf)))


@query(
    with_rets("SELECT asset, ts, close, CAST(year(ts) AS INT) AS window_id FROM rets WHERE year(ts) % 2 = 0 UNION ALL SELECT asset, ts, close, CAST(year(ts) AS INT) FROM rets WHERE year(ts) % 2 = 1")
)
def union_windows(spark, sf):
    """Results of several windows put back together by name."""
    d = rets(spark, sf).withColumn("window_id", F.year("ts")).select("asset", "ts", "close", "window_id")
    return d.filter("window_id % 2 = 0").unionByName(d.filter("window_id % 2 = 1"))


@query(
    with_mrets(f"SELECT asset, ts, {rnd('ret')} AS ret FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS rn FROM rets) WHERE rn <= 63")
)
def last_n(spark, sf):
    return rounded(cross.last_n(mrets(spark, sf).select("asset", "ts", "ret"), 63))


@query("SELECT event_type, count(*) AS count, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def distribution(spark, sf):
    return cross.distribution(spark.read.parquet(f"{sf}/events.parquet"), "event_type")


@query(
    with_mrets(
        """SELECT CAST(least(floor((ret - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS count
        FROM rets, (SELECT min(ret) AS lo, max(ret) AS hi FROM rets) GROUP BY 1"""
    )
)
def histogram(spark, sf):
    return cross.histogram(mrets(spark, sf))


@query(sql(f"SELECT asset, ts, {rnd('close / first_value(close) OVER (PARTITION BY asset ORDER BY ts)')} AS price_index FROM bars", MANY))
def price_index(spark, sf):
    return rounded(cross.price_index(many(spark, sf)).select("asset", "ts", "price_index"))


# --- flagship


@query(
    with_rets(
        f"""SELECT s.asset, days, {rnd('annual_return')} AS annual_return, {rnd('annual_vol')} AS annual_vol, {rnd('sharpe')} AS sharpe,
          {rnd('max_drawdown')} AS max_drawdown, {rnd('v')} AS var_95,
          {rnd('(SELECT avg(ret) FROM rets r WHERE r.asset = s.asset AND r.ret <= s.v)')} AS es_95
        FROM (SELECT asset, count(*) AS days, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol,
              avg(ret) / (stddev_samp(ret) + 1e-8) * sqrt(252) AS sharpe, quantile_cont(ret, 0.05) AS v FROM rets GROUP BY asset) s
        JOIN (SELECT asset, min(cum / peak - 1) AS max_drawdown FROM (
              SELECT asset, cum, max(cum) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (
              SELECT asset, ts, product(1 + ret) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM rets)) GROUP BY asset) d
        ON d.asset = s.asset"""
    )
)
def asset_performance(spark, sf):
    """Lines to bars to returns to annual return, risk and drawdown per asset."""
    return rounded(risk.asset_performance(rets(spark, sf)))
