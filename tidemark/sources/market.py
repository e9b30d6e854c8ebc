"""Reading and writing bars, macro series and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("asset", T.StringType()),
        T.StructField("ts", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
FREQUENCIES = ("D", "W", "M")


def check_portfolio(
    assets: Sequence[str], start: str, end: str, weights: Sequence[float] | None = None, frequency: str = "D"
) -> None:
    """Raise ``ValueError`` for an unusable portfolio definition."""
    if not assets:
        raise ValueError("assets must not be empty")
    if not start or not end:
        raise ValueError("start and end are required")
    if frequency not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}")
    if weights is not None:
        check_weights(weights, len(assets))


def check_weights(weights: Sequence[float], n: int | None = None) -> None:
    if n is not None and len(weights) != n:
        raise ValueError("one weight per asset is required")
    if any(w < 0 or w > 1 for w in weights):
        raise ValueError("weights must lie in [0, 1]")
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Bars under ``path``, partitioned by asset (``asset=X/``) or holding an asset column.

    CSV files need the file's own schema (``schema``), as no inference pass is made; the asset partition
    column is added to it. Use ``normalize_columns`` on files with vendor column names.
    """
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true").option("enforceSchema", "false")
        r = r.schema(schema or T.StructType(BARS.fields[1:] + BARS.fields[:1]))
    elif schema is not None:
        r = r.schema(schema)
    return r.load(path)


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "asset", order: str = "ts") -> None:
    """Write bars partitioned by asset.

    Rows are range-partitioned by (asset, time), so that a large asset is written by as many tasks as its rows need, each
    with a stretch of its time, and small ones share a task. There are no more files than assets and tasks together.
    """
    w = df
    if by:
        w = df.repartitionByRange(by, order)
    out = w.write.mode("overwrite").format(fmt)
    if by:
        out = out.partitionBy(by)
    if fmt == "csv":
        out = out.option("header", "true")
    out.save(path)


def flatten_name(*parts: str) -> str:
    """Join the levels of a two-row column header, skipping empty ones."""
    return " ".join(p for p in parts if p)


def normalize_columns(
    df: DataFrame, asset: str | None = None, price_priority: Sequence[str] = ("Adj Close", "Close"), date_col: str = "Date"
) -> DataFrame:
    """Vendor columns to ``asset, ts, close, volume``.

    A price column named after the asset (``Adj Close X``) wins over the plain names; within each form the
    order of ``price_priority`` decides. Volume is optional.
    """
    names = set(df.columns)
    forms = [f"{p} {asset}" for p in price_priority] if asset else []
    price = next((c for c in [*forms, *price_priority] if c in names), None)
    if price is None:
        raise ValueError(f"no price column among {sorted(names)}")
    volume = next((c for c in ([f"Volume {asset}"] if asset else []) + ["Volume"] if c in names), None)
    return df.select(
        (F.lit(asset) if asset else F.col("asset")).alias("asset"),
        F.col(date_col).cast("date").alias("ts"),
        F.col(f"`{price}`").cast("double").alias("close"),
        (F.col(f"`{volume}`").cast("double") if volume else F.lit(None).cast("double")).alias("volume"),
    )


def read_macro(spark: SparkSession, path: str, series: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Macro levels as ``series, ts, value``; ``Close`` wins over ``Price``."""
    df = spark.read.format(fmt).option("header", "true").load(path)
    return macro_from_columns(df, series)


def macro_from_columns(df: DataFrame, series: Sequence[str] | None = None, date_col: str = "ts") -> DataFrame:
    """Choose the level column of a macro table; a row with neither ``Close`` nor ``Price`` is skipped."""
    found = [F.col(c).cast("double") for c in ("Close", "Price") if c in df.columns]
    if not found:
        raise ValueError("macro input has neither Close nor Price")
    out = df.select("series", F.col(date_col).cast("date").alias("ts"), F.coalesce(*found).alias("value"))
    if series is not None:
        out = out.filter(F.col("series").isin(list(series)))
    return out.filter(F.col("value").isNotNull())


def write_results(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write each result table under ``path/name``; ``csv`` and ``json`` give readable files."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        w.save(f"{path}/{name}")


def json_summary(df: DataFrame) -> DataFrame:
    """Each row of a summary as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("summary"))


def summary_record(**stages: DataFrame) -> DataFrame:
    """One record from the one-row summaries of all stages; columns get the stage name as prefix.

    Each stage is counted as it is read: one of no row or of several raises when the record is evaluated. What is joined
    is an ungrouped aggregate, so that the keyless joins see one row each.
    """
    out: DataFrame | None = None
    for stage, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_s"))
        wrong = F.raise_error(F.concat(F.lit(f"stage {stage} has "), F.col("_n").cast("string"), F.lit(" rows, not one")))
        one = one.select(F.when(F.col("_n") == 1, F.col("_s")).otherwise(wrong.cast(one.schema["_s"].dataType)).alias("_s"))
        one = one.select([F.col("_s")[c].alias(f"{stage}_{c}") for c in df.columns])
        out = one if out is None else out.join(F.broadcast(one))
    if out is None:
        raise ValueError("no stages given")
    return out


# ---------------------------------------------------------------------------------------------------------
# Bars from other tables


def bars_from_trades(trades: DataFrame, asset: Column, ts: Column, amount: Column, quantity: Column) -> DataFrame:
    """Volume-weighted bars: one row per (asset, ts) with the mean price in whole cents and the volume.

    Amounts are summed as whole cents, so the result does not depend on the order of the rows.
    """
    t = trades.select(
        asset.alias("asset"), ts.alias("ts"), F.round(amount * 100).cast("long").alias("_c"), quantity.cast("long").alias("_q")
    )
    g = t.groupBy("asset", "ts").agg(F.sum("_c").alias("_c"), F.sum("_q").alias("_q"))
    return g.select(
        "asset", "ts", (F.expr("_c div _q").cast("double") / F.lit(100.0)).alias("close"), F.col("_q").cast("double").alias("volume")
    )
