"""Inputs of the catalogued queries, on Spark and as SQL.

Bars come from order lines: ``bars`` by (return flag, line status) and day, ``many`` by supplier and week,
whose number of series grows with the data. Macro levels are mean order totals by priority and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prep import pct_change
from tidemark.sources.market import bars_from_trades


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", "l_returnflag", "l_linestatus")
    return bars_from_trades(li, name, F.col("l_shipdate").cast("date"), F.col("l_extendedprice"), F.col("l_quantity"))


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    week = F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date")
    return bars_from_trades(li, F.col("l_suppkey").cast("string"), week, F.col("l_extendedprice"), F.col("l_quantity"))


def rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pct_change(bars(spark, sf_dir))


def mrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pct_change(many(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the dates on which every class of lines has one."""
    return pct_change(bars(spark, sf_dir), dropna="any_asset")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("_c")
    )
    g = o.groupBy("series", "ts").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return g.select("series", "ts", (F.expr("_c div _n").cast("double") / F.lit(100.0)).alias("value"))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight portfolio of each line status (O and F), so that several portfolios run at once."""
    r = rets(spark, sf_dir)
    return r.groupBy(F.substring("asset", 3, 1).alias("portfolio"), "ts").agg(F.avg("ret").alias("ret"))


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero as zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all double columns."""
    out = []
    for f in df.schema:
        out.append(r6(f.name, special.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------------------------------------------------
# SQL side

BARS = """bars AS (
  SELECT concat(l_returnflag, '-', l_linestatus) AS asset, CAST(l_shipdate AS DATE) AS ts,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)
           / CAST(100 AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""
MANY = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)
           / CAST(100 AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""
RETS = """rets AS (
  SELECT * FROM (SELECT asset, ts, close, volume, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM bars)
  WHERE ret IS NOT NULL)"""
PANEL = """panel AS (
  SELECT * FROM rets WHERE ts IN (
    SELECT ts FROM rets GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT asset) FROM rets)))"""
MACRO = """macro AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ts,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / CAST(100 AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)"""
PORT = """port AS (
  SELECT substr(asset, 3, 1) AS portfolio, ts, avg(ret) AS ret FROM rets GROUP BY 1, 2)"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def with_rets(select: str, *more: str) -> str:
    return sql(select, BARS, RETS, *more)


def with_mrets(select: str, *more: str) -> str:
    return sql(select, MANY, RETS, *more)


def with_panel(select: str, *more: str) -> str:
    return sql(select, BARS, RETS, PANEL, *more)


def with_port(select: str, *more: str) -> str:
    return sql(select, BARS, RETS, PORT, *more)


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def full(expr: str, x: str, n: int, w: str, need: int | None = None) -> str:
    """SQL of a rolling value with the full-window rule; ``w`` names a window with PARTITION/ORDER."""
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {need or n} THEN {expr} {frame} END"


W = "PARTITION BY asset ORDER BY ts"
