"""Statistics of pixel tables (one row per pixel) by field and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quantile


def terrain_statistics(pixels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """min, max, mean, std, median, p10, p25, p75, p90, range of each column, and the number of pixels."""
    aggs = [F.count("*").alias("pixel_count")]
    for c in columns:
        aggs += [
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            quantile(c, 0.5).alias(f"{c}_median"),
            *[quantile(c, q / 100).alias(f"{c}_p{q}") for q in (10, 25, 75, 90)],
            (F.max(c) - F.min(c)).alias(f"{c}_range"),
        ]
    return pixels.groupBy(key).agg(*aggs)


def monthly_weather(daily: DataFrame, key: str, month: str = "month", hot: float = 30.0) -> DataFrame:
    """Monthly reductions of daily weather: mean, min and max temperature, rain, hot days and the sum of warmth."""
    return daily.groupBy(key, month).agg(
        F.avg("t2m_mean").alias("t2m_mean"),
        F.min("t2m_min").alias("t2m_min"),
        F.max("t2m_max").alias("t2m_max"),
        F.sum("precip").alias("precip_sum"),
        F.sum((F.col("t2m_max") >= hot).cast("int")).alias("hot_days"),
        F.sum(F.when(F.col("t2m_mean").isNotNull(), F.greatest("t2m_mean", F.lit(0.0)))).alias("warmth"),
    )
