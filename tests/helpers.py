"""Small series for tests: daily (bounded) and time-stamped (chunked) forms of the same values."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def daily(spark, columns: dict, start="2020-01-01"):
    """``asset, ts, <columns>`` from ``{asset: {column: values}}``."""
    rows = []
    for a, cols in columns.items():
        n = len(next(iter(cols.values())))
        for i, t in enumerate(pd.date_range(start, periods=n)):
            rows.append((a, t.date(), *[None if v[i] is None or v[i] != v[i] else float(v[i]) for v in cols.values()]))
    names = list(next(iter(columns.values())))
    return spark.createDataFrame(rows, "asset string, ts date, " + ", ".join(f"{c} double" for c in names))


def stamped(df):
    """The same series with a TIMESTAMP order, which takes the chunked plan."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def by(df, col, asset="a"):
    """Values of a column of one asset in time order."""
    return [r[col] for r in df.filter(F.col("asset") == asset).orderBy("ts").collect()]


def same(got, want, tol=1e-9):
    got = np.array([np.nan if v is None else v for v in got], dtype=float)
    np.testing.assert_allclose(got, np.asarray(want, dtype=float), rtol=1e-8, atol=tol)


def noise(n, seed=0, scale=0.01):
    return np.random.default_rng(seed).normal(0, scale, n)
