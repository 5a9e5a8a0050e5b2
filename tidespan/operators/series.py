"""Regular daily series: mean per day, common grid, gap filling, smoothing, rolling means, consecutive changes.

All steps work on long rows (entity, date, value) and partition by entity alone, so one shuffle serves them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, col, eps_ratio, finite


def daily_mean(df: DataFrame, keys: list[str], day: str = "date", value: str = "value") -> DataFrame:
    """Mean of the finite values per keys and day; days without one drop out."""
    return df.groupBy(*keys, day).agg(F.avg(finite(value)).alias(value)).where(F.col(value).isNotNull())


def enough_days(daily: DataFrame, entity: str, least: int = 3) -> DataFrame:
    """Rows of entities with at least `least` days."""
    n = F.count("value").over(Window.partitionBy(entity))
    return daily.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def on_grid(daily: DataFrame, entity: str, day: str = "date", every: int = 1) -> DataFrame:
    """Every entity with every `every`-th day of the whole table's range, value null where there is none.

    Observations off the grid are lost, as with any exact reindexing.
    """
    ends = daily.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))  # one row
    grid = daily.select(entity).distinct().join(F.broadcast(ends)).select(entity, "_lo", F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {every} day"))).alias(day))
    return grid.join(daily, [entity, day], "left").select(entity, day, F.datediff(day, "_lo").alias("i"), "value")


def interpolated(grid: DataFrame, entity: str, day: str = "date") -> DataFrame:
    """Fill gaps linearly by day; before the first and after the last value the nearest one holds."""
    back = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(entity).orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    df = grid.select(
        entity,
        day,
        "i",
        "value",
        F.last("value", ignorenulls=True).over(back).alias("_v0"),
        F.last(at, ignorenulls=True).over(back).alias("_i0"),
        F.first("value", ignorenulls=True).over(ahead).alias("_v1"),
        F.first(at, ignorenulls=True).over(ahead).alias("_i1"),
    )
    filled = (
        F.when(F.col("_i0").isNull(), F.col("_v1"))
        .when(F.col("_i1").isNull() | (F.col("_i0") == F.col("_i1")), F.col("_v0"))
        .otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col("i") - F.col("_i0"), F.col("_i1") - F.col("_i0")))
    )
    return df.select(entity, day, "i", filled.alias("value"))


def smoothing_matrix(window: int, order: int) -> np.ndarray:
    """Row r gives a least-squares polynomial's value at place r of `window` equally spaced points."""
    x = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return x @ np.linalg.pinv(x)


def smoothing_weights(n: int, window: int, order: int) -> list[tuple[int, int, float]]:
    """(i, j, weight) over a grid of n points: interior points use the window's centre row, the edges fit the first
    or last window.  Empty if the window can't carry the polynomial."""
    window = min(window, n)
    window -= 1 - window % 2
    if window < order + 2:
        return []
    m = smoothing_matrix(window, order)
    out = []
    for i in range(n):
        start = min(max(i - window // 2, 0), n - window)
        out += [(i, start + k, float(m[i - start, k])) for k in range(window)]
    return out


def smoothed(filled: DataFrame, entity: str, n: int, window: int, order: int, day: str = "date") -> DataFrame:
    """Polynomial smoothing of complete grids of n points: each entity's points in one array, one weighted sum each."""
    window = min(window, n)
    window -= 1 - window % 2
    if window < order + 2:
        return filled
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in smoothing_matrix(window, order)])
    packed = filled.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("i", day, "value"))).alias("_s"))

    def at(p: Column, k: Column) -> Column:
        start = F.least(F.greatest(k - window // 2, F.lit(0)), F.lit(n - window))
        part = F.slice("_s", start + 1, F.lit(window))
        terms = F.zip_with(part, F.get(rows, k - start), lambda a, w: a["value"] * w)
        return F.struct(p["i"].alias("i"), p[day].alias(day), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("value"))

    return packed.select(entity, F.inline(F.transform("_s", at))).select(entity, day, "i", "value")


def smoothing_pipeline(df: DataFrame, entity: str, day: str = "date", resample_days: int = 5, window: int = 7, order: int = 2, daily: bool = True) -> DataFrame:
    """Mean per day, entities with three days at least, common grid, filled, smoothed; every resample_days-th day.

    daily: the grid is daily, smoothed over 3 * window days and then thinned; otherwise the grid itself has one
    point in resample_days.
    """
    series = enough_days(daily_mean(df, [entity], day), entity)
    filled = interpolated(on_grid(series, entity, day, 1 if daily else resample_days), entity, day)
    lo, hi = series.agg(F.min(day), F.max(day)).first()
    if lo is None:
        return filled
    span = (hi - lo).days
    n = span + 1 if daily else span // resample_days + 1
    out = smoothed(filled, entity, n, window * 3 if daily else window, order, day)
    return out.where(F.col("i") % resample_days == 0) if daily else out


def rolling_zero_padded(df: DataFrame, entity: str, order: str = "i", value: str = "value", width: int = 5) -> Column:
    """Centred mean that counts missing neighbours at the edges as zero."""
    half = width // 2
    return F.sum(value).over(Window.partitionBy(entity).orderBy(order).rowsBetween(-half, half)) / float(width)


def changes(df: DataFrame, keys: list[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """change, ratio and roc against the period before (ord less by one): null where that period is absent."""
    w = Window.partitionBy(*keys).orderBy(ord_col)
    before = F.when(F.lag(ord_col).over(w) == F.col(ord_col) - 1, F.lag(value).over(w))
    df = df.withColumn("_before", before)
    now, was = col(value), F.col("_before")
    return df.withColumns(
        {"change": now - was, "ratio": clip(eps_ratio(now, was), -10, 10), "roc": clip(eps_ratio(now - was, was), -10, 10)}
    ).where(F.col("_before").isNotNull()).drop("_before")


def seasonal(long: DataFrame, keys: list[str], periods: int, ord_col: str = "ord", value: str = "value") -> DataFrame:
    """cv, range and slope over the periods of keys; needs `periods` >= 3 available periods.  slope: against the
    period's index (0, 1, ...) among the periods that the feature (keys but the first) has for any entity, null with
    fewer than two finite values."""
    v = finite(value)
    if periods < 3:
        return long.select(*keys).limit(0).withColumns({c: F.lit(None).cast("double") for c in ("cv", "range", "slope")})
    shared = keys[1:]
    have = long.select(*shared, ord_col).distinct()  # features times periods: small, whatever the number of entities
    index = F.row_number().over(Window.partitionBy(*shared).orderBy(ord_col)) - 1
    have = have.select(*[F.col(c).alias(f"_{c}") for c in shared], F.col(ord_col).alias("_o"), index.cast("double").alias("_i"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared]
    ranked = long.join(F.broadcast(have), [*same, F.col(ord_col) == F.col("_o")])
    return ranked.groupBy(*keys).agg(
        (F.stddev_samp(v) / (F.abs(F.avg(v)) + 1e-6)).alias("cv"),
        (F.max(v) - F.min(v)).alias("range"),
        F.when(F.count(v) >= 2, F.regr_slope(v, F.when(v.isNotNull(), F.col("_i")))).alias("slope"),
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys in an order fixed by the seed."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
