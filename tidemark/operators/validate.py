"""Significance tests. Sums come from one aggregate; tail probabilities are evaluated on its rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prep import YEAR
from tidemark.plans.attach import attach


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    half = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial count."""
    return 1.0 if k <= 0 else beta_cdf(k, n - k + 1, p)


def binomial_quantile(q: float, n: int, p: float) -> int:
    """Smallest k with P(X <= k) >= q, by bisection."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        if 1 - binomial_sf(mid + 1, n, p) >= q:
            hi = mid
        else:
            lo = mid + 1
    return lo


def t_p_value(t: float, n: float, alternative: str) -> float:
    if t is None or n is None or n < 2 or math.isnan(t):
        return float("nan")
    up = t_sf(t, n - 1)
    return {"greater": up, "less": 1 - up}.get(alternative, 2 * min(up, 1 - up))


def with_t_p_value(df: DataFrame, alternative: str = "two-sided", t: str = "t_statistic", n: str = "n", out: str = "p_value") -> DataFrame:
    """Add the p value of t statistics, batch by batch on the aggregated rows."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([t_p_value(a, b, alternative) for a, b in zip(ts, ns)])

    return df.withColumn(out, p(F.col(t), F.col(n).cast("double")))


def paired_t_test(df: DataFrame, a: str, b: str, key: Sequence[str] = (), alternative: str = "greater", alpha: float = 0.05) -> DataFrame:
    """t test of a - b per key: ``mean_difference, t_statistic, n, p_value, is_significant``."""
    if alternative not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown alternative {alternative!r}")
    d = F.col(a) - F.col(b)
    g = df.groupBy(*key).agg(
        F.avg(d).alias("mean_difference"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t_statistic"), F.count(d).alias("n")
    )
    return with_t_p_value(g, alternative).withColumn("is_significant", F.col("p_value") < alpha)


def accuracy_test(df: DataFrame, truth: str, pred: str, key: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Share of equal labels against chance (1 / number of true labels): one-sided binomial test and interval.

    Counts are aggregated per true label first, so the number of labels needs no distinct pass over rows.
    """
    per = df.groupBy(*key, truth).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(truth) == F.col(pred)).alias("_hit"))
    g = per.groupBy(*key).agg(F.sum("_n").alias("n"), F.sum("_hit").alias("correct"), (1 / F.count(F.lit(1))).alias("null_accuracy"))
    g = g.withColumn("accuracy", F.col("correct") / F.col("n"))

    @F.pandas_udf("p_value double, ci_lower double, ci_upper double")
    def tails(k: pd.Series, n: pd.Series, p0: pd.Series) -> pd.DataFrame:
        rows = []
        for ki, ni, pi in zip(k, n, p0):
            acc = ki / ni
            rows.append((binomial_sf(int(ki), int(ni), pi), binomial_quantile(alpha / 2, int(ni), acc) / ni, binomial_quantile(1 - alpha / 2, int(ni), acc) / ni))
        return pd.DataFrame(rows, columns=["p_value", "ci_lower", "ci_upper"])

    g = g.withColumn("_t", tails("correct", "n", "null_accuracy"))
    return g.select(*key, "accuracy", "null_accuracy", "n", "_t.*").withColumn("is_significant", F.col("p_value") < alpha)


def outperformance_test(df: DataFrame, strategy: str, benchmark: str, key: Sequence[str] = (), order="ts", n: int = 1000, seed: int = 42, alpha: float = 0.05, method: str = "index") -> DataFrame:
    """Mean excess return, information ratio, two-sided t test, and the bootstrap interval of the ratio.

    ``method`` is that of ``bootstrap``: ``poisson`` copies no rows, for many or long series.
    """
    from tidemark.operators.resample import bootstrap_interval

    d = df.withColumn("_x", F.col(strategy) - F.col(benchmark)).filter(F.col("_x").isNotNull())
    s = F.stddev_samp("_x")
    g = d.groupBy(*key).agg(
        (F.avg("_x") * YEAR).alias("excess_return_mean"), (F.try_divide(F.avg("_x"), s) * YEAR**0.5).alias("information_ratio"),
        F.try_divide(F.avg("_x"), s / F.sqrt(F.count("_x"))).alias("t_statistic"), F.count("_x").alias("n"),
    )
    g = with_t_p_value(g, "two-sided").withColumn("is_significant", F.col("p_value") < alpha)
    ci = bootstrap_interval(d, "ir", "_x", n, key, order, seed, method).withColumnsRenamed({"lower": "ir_lower", "upper": "ir_upper"})
    return g.join(ci, list(key)) if key else attach(g, []).join(F.broadcast(ci))
