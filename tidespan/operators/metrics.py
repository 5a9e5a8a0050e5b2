"""Agreement metrics of predictions, each from one pass of moments, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("R2", "CCC", "RMSE", "RRMSE", "MBE", "PLA", "PLP", "KGE")


def agreement(df: DataFrame, by: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row per group with the eight metrics; rows with a null on either side don't count."""
    t, p = F.col(true), F.col(pred)
    m = (
        df.where(t.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.avg(t).alias("_t"),
            F.avg(p).alias("_p"),
            F.var_pop(t).alias("_vt"),
            F.var_pop(p).alias("_vp"),
            F.covar_pop(t, p).alias("_c"),
            F.avg((t - p) * (t - p)).alias("_mse"),
        )
    )
    t, p, vt, vp, c, mse = (F.col(f"_{x}") for x in ("t", "p", "vt", "vp", "c", "mse"))
    st, sp = F.sqrt(vt), F.sqrt(vp)
    r = F.coalesce(F.try_divide(c, st * sp), F.lit(0.0))
    slope = F.try_divide(c, vt)
    base = p - slope * t
    second = vt + t * t  # mean of squares
    pla = (slope - 1) * (slope - 1) * second + (slope - 1) * base * t * 2 + base * base
    plp = F.greatest(vp - slope * c, F.lit(0.0))
    alpha, beta = sp / (st + 1e-10), p / (t + 1e-10)
    out: dict[str, Column] = {
        "R2": 1 - F.try_divide(mse, vt),
        "CCC": r * st * sp * 2 / (vt + vp + (t - p) * (t - p) + 1e-10),
        "RMSE": F.sqrt(mse),
        "RRMSE": F.try_divide(F.sqrt(mse), t) * 100,
        "MBE": p - t,
        "PLA": F.try_divide(F.sqrt(F.when(pla >= 0, pla).otherwise(F.lit(0.0))), t) * 100,
        "PLP": F.try_divide(F.sqrt(plp), t) * 100,
        "KGE": 1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)),
    }
    return m.select(*by, *[v.alias(k) for k, v in out.items()])


def melted(wide: DataFrame, by: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def summary(long: DataFrame, by: tuple[str, ...] = ("model", "metric")) -> DataFrame:
    """mean and std (0 for a single fold) of value, and both as one text."""
    out = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.when(F.count("value") == 1, F.lit(0.0)).otherwise(F.stddev_samp("value")).alias("std"))
    return out.withColumn("text", F.format_string("%.4f ± %.4f", "mean", "std"))


def ensemble(oof: DataFrame, models: list[str], name: str = "Ensemble") -> DataFrame:
    """Mean prediction of the base models per fold and sample, as rows of a model of its own."""
    mean = oof.where(F.col("model").isin(*models)).groupBy("fold", "id").agg(F.max("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    return mean.select("fold", "id", F.lit(name).alias("model"), "y_true", "y_pred")


def bands(df: DataFrame, by: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Half widths of prediction bands: RMSE, 1.96 RMSE, a tenth and a fifth of the mean."""
    rmse, mean = F.sqrt(F.avg((F.col(true) - F.col(pred)) * (F.col(true) - F.col(pred)))), F.avg(true)
    return df.groupBy(*by).agg(rmse.alias("rmse"), (rmse * 1.96).alias("interval_95"), (mean * 0.1).alias("tenth"), (mean * 0.2).alias("fifth"))


def best_fold(long: DataFrame) -> DataFrame:
    """The model of least mean RMSE and its fold of greatest R2."""
    mean = long.where("metric = 'RMSE'").groupBy("model").agg(F.avg("value").alias("rmse"))
    best = mean.orderBy("rmse", "model").limit(1)
    return long.where("metric = 'R2'").join(F.broadcast(best), "model").orderBy(F.desc("value"), "fold").limit(1).select("model", "fold", "rmse", F.col("value").alias("r2"))


def top(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(n)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins) and n of the values within [low, high]; the last bin is closed."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
