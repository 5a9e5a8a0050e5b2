"""Sweeps over contiguous runs of periods, resumable from a table of finished ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statics import unfinished


def runs(periods: DataFrame) -> DataFrame:
    """start_ord, end_ord, start_period, end_period, n_periods of every contiguous run (start <= end).

    periods: ord, period; a control table of a few dozen rows.
    """
    a = periods.select(F.col("ord").alias("start_ord"), F.col("period").alias("start_period"))
    b = periods.select(F.col("ord").alias("end_ord"), F.col("period").alias("end_period"))
    return a.join(F.broadcast(b), F.col("start_ord") <= F.col("end_ord")).withColumn("n_periods", F.col("end_ord") - F.col("start_ord") + 1)


def sweep(todo: DataFrame, path: str, one: Callable[[dict], DataFrame]) -> DataFrame:
    """Run one() for every run that the table at path doesn't hold yet, appending each result as it is done."""
    spark = todo.sparkSession
    keys = ["start_period", "end_period"]
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no result yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    left = todo if done is None else unfinished(todo, done, keys)
    for row in left.orderBy("start_ord", "end_ord").collect():  # n (n + 1) / 2 control rows
        one(row.asDict()).withColumns({k: F.lit(row[k]) for k in keys}).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def pivoted(results: DataFrame, periods: list[str], value: str) -> DataFrame:
    """start x end table of the mean value."""
    return results.groupBy("start_period").pivot("end_period", periods).agg(F.avg(value))


def best_per_run(results: DataFrame, value: str = "value") -> DataFrame:
    """The greatest value of each run and its model (the first by name on a tie)."""
    best = F.min_by(F.struct("model", value), F.struct(-F.col(value), F.col("model")))
    return results.groupBy("start_period", "end_period").agg(best.alias("_b")).select("start_period", "end_period", F.col("_b.model").alias("best_model"), F.col(f"_b.{value}").alias("best_value"))


def by_length(results: DataFrame, value: str = "value") -> DataFrame:
    return results.groupBy("n_periods").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def by_start(results: DataFrame, value: str = "value") -> DataFrame:
    return results.groupBy("start_period").agg(F.avg(value).alias("mean"))
