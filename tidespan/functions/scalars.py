"""Null-safe scalar building blocks.  NULL is the only missing marker; nothing here raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Fixed value: added to denominators by ratios that must not blow up.
EPS = 1e-6


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """x, or null if it is NaN or infinite."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite_columns(df: DataFrame) -> DataFrame:
    """Every floating column through finite(): done once, at the scan."""
    return df.select(*[finite(f.name).alias(f.name) if isinstance(f.dataType, DoubleType | FloatType) else F.col(f.name) for f in df.schema.fields])


def at_least(x: Column | str, low: float) -> Column:
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def clip(x: Column | str, low: float, high: float) -> Column:
    """x limited to [low, high]; null stays null (greatest and least would skip it)."""
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den, null where the denominator is within EPS of zero."""
    n, d = col(num), col(den)
    return F.when(F.abs(d) > EPS, n / d)


def eps_ratio(num: Column | str, den: Column | str) -> Column:
    """num / (|den| + EPS)."""
    return col(num) / (F.abs(col(den)) + EPS)


def corr0(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; 0 where either side is constant.  Rows with a null side don't count."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def quantile(x: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(x), F.lit(p))


def std_or_zero(x: Column | str) -> Column:
    """Sample standard deviation, 0 for a single value, null for none."""
    c = col(x)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))
