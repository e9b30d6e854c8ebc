"""Column expressions over the rolling windows of a prepared series.

All follow the full-window rule: the result is NULL until the window holds ``need`` non-null values
(the window length unless given).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.series import Series


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _agg(s: Series, kind: str, x: Column | str, n: int, value: Column) -> Column:
    return s.shared(f"{kind}_{x}_{n}", value.over(s.rows(n)))


def _full(s: Series, x: Column | str, n: int, value: Column, need: int | None) -> Column:
    return F.when(_agg(s, "count", x, n, F.count(_col(x))) >= (need or n), value)


def mean(s: Series, x: Column | str, n: int, need: int | None = None) -> Column:
    return _full(s, x, n, _agg(s, "mean", x, n, F.avg(_col(x))), need)


def std(s: Series, x: Column | str, n: int, need: int | None = None) -> Column:
    return _full(s, x, n, _agg(s, "std", x, n, F.stddev_samp(_col(x))), need)


def var(s: Series, x: Column | str, n: int) -> Column:
    return _full(s, x, n, _agg(s, "var", x, n, F.var_samp(_col(x))), None)


def cov(s: Series, x: Column | str, y: Column | str, n: int) -> Column:
    both = F.when(_col(x).isNotNull() & _col(y).isNotNull(), _col(x))
    count = _agg(s, "count", f"{x}_{y}", n, F.count(both))
    return F.when(count >= n, _agg(s, "cov", f"{x}_{y}", n, F.covar_samp(_col(x), _col(y))))


def low(s: Series, x: Column | str, n: int) -> Column:
    return _full(s, x, n, _agg(s, "low", x, n, F.min(_col(x))), None)


def high(s: Series, x: Column | str, n: int) -> Column:
    return _full(s, x, n, _agg(s, "high", x, n, F.max(_col(x))), None)


def skew(s: Series, x: Column | str, n: int) -> Column:
    """Bias-corrected skewness (the built-in one is the population form)."""
    return _full(s, x, n, sample_skew(_agg(s, "skew", x, n, F.skewness(_col(x))), F.lit(float(n))), None)


def kurt(s: Series, x: Column | str, n: int) -> Column:
    """Bias-corrected excess kurtosis (the built-in one is the population form)."""
    return _full(s, x, n, sample_kurt(_agg(s, "kurt", x, n, F.kurtosis(_col(x))), F.lit(float(n))), None)


def sample_skew(population: Column, n: Column) -> Column:
    return population * F.try_divide(F.sqrt(n * (n - 1)), n - 2)


def sample_kurt(population: Column, n: Column) -> Column:
    return F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * population + 6)


def lag(s: Series, x: str, n: int = 1) -> Column:
    return s.shared(f"lag_{x}_{n}", F.lag(x, n).over(s.ordered()))


def change(s: Series, x: str, n: int = 1) -> Column:
    return F.col(x) - lag(s, x, n)


def ratio_change(s: Series, x: str, n: int) -> Column:
    return F.try_divide(F.col(x), lag(s, x, n)) - 1
