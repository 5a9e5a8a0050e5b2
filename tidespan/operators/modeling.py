"""Regression models under nested cross-validation.

A fold, a candidate and an inner split make a task row; closed-form models run as tasks in parallel over a
broadcast matrix (bounded, see screening.matrix), tree models are pyspark.ml estimators fitted on DataFrames.
"""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from .metrics import agreement, ensemble, melted
from .screening import group_folds, imputed, matrix, rmse, scaled, select_features, unsupervised_prescreen

#: Hyper-parameter grids of the supported models (trees deeper than pyspark.ml allows are cut to 30).
GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {"n_estimators": [100, 200, 400, 500], "max_depth": [5, 10, 15, 20, 30], "min_samples_leaf": [1, 2, 4]},
    "LightGBM": {"n_estimators": [100, 300, 500, 600], "learning_rate": [0.01, 0.03, 0.05, 0.1], "max_depth": [5, 10, 15, 20, 30], "subsample": [0.7, 0.8, 0.9]},
    "XGBoost": {"n_estimators": [100, 300, 500, 600], "learning_rate": [0.01, 0.03, 0.05, 0.1], "max_depth": [3, 4, 5, 6, 7, 8, 10], "subsample": [0.7, 0.8, 0.9]},
    "CatBoost": {"n_estimators": [250, 500, 1000], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [4, 5, 6, 8, 10]},
    "ElasticNet": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]},
}
CLOSED_FORM = ("ElasticNet", "Ridge")


def candidates(model: str, grid: dict[str, list] | None = None, most: int = 15, seed: int = 42) -> list[dict]:
    """The whole grid if it has at most `most` points, else that many drawn with a seed."""
    if model not in GRIDS and grid is None:
        raise ValueError(f"unknown model: {model}")
    g = grid or GRIDS[model]
    points = [dict(zip(g, v, strict=True)) for v in itertools.product(*g.values())]
    return points if len(points) <= most else random.Random(seed).sample(points, most)


def estimator(model: str, params: dict, seed: int = 42):
    """A pyspark.ml regressor; boosted trees stand in for LightGBM, XGBoost and CatBoost."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if model == "RandomForest":
        return RandomForestRegressor(
            numTrees=params.get("n_estimators", 200), maxDepth=min(params.get("max_depth", 10), 30), minInstancesPerNode=params.get("min_samples_leaf", 1), seed=seed
        )
    if model in ("LightGBM", "XGBoost", "CatBoost"):
        return GBTRegressor(
            maxIter=params.get("n_estimators", 200),
            maxDepth=min(params.get("max_depth", 6), 30),
            stepSize=params.get("learning_rate", 0.05),
            subsamplingRate=params.get("subsample", 0.8),
            seed=seed,
        )
    if model == "ElasticNet":
        return LinearRegression(regParam=params.get("alpha", 0.01), elasticNetParam=params.get("l1_ratio", 0.5), standardization=False, maxIter=200)
    raise ValueError(f"unknown model: {model}")


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Coordinate descent for 1/(2n) |y - xw|^2 + alpha (l1 |w|_1 + (1 - l1)/2 |w|^2); (w, intercept)."""
    mx, my, n = x.mean(axis=0), y.mean(), len(y)
    c = x - mx
    gram, xy = c.T @ c / n, c.T @ (y - my) / n
    w, l1, l2 = np.zeros(x.shape[1]), alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(steps):
        moved = 0.0
        for j in range(len(w)):
            old, rho = w[j], xy[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
            moved = max(moved, abs(w[j] - old))
        if moved < 1e-6:
            break
    return w, my - mx @ w


def fit_closed(model: str, params: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    if model == "Ridge":
        mx, my = x.mean(axis=0), y.mean()
        w = np.linalg.solve((x - mx).T @ (x - mx) + params.get("alpha", 1.0) * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return w, my - mx @ w
    return elastic_net(x, y, params.get("alpha", 0.01), params.get("l1_ratio", 0.5))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct exact quantile edges."""
    got = quantiles(df, [], column, [i / bins for i in range(bins + 1)]).first()
    return sorted({e for e in (got or ()) if e is not None})


def quantile_bin(edges: list[float], column: Column | str) -> Column:
    """0-based bin, each closed on the right, the first on both sides."""
    c = F.col(column) if isinstance(column, str) else column
    inner = edges[1:-1]
    return F.when(c.isNotNull(), sum(((c > e).cast("int") for e in inner), F.lit(0)))


def stratified_folds(df: DataFrame, target: str, k: int, bins: int = 5, seed: int = 42) -> DataFrame:
    """df with bin and fold (0..k-1): within each target bin a seeded order deals the rows out in turn.

    Rows are ranked in 64 hashed parts of a bin, each starting at a fold of its own, so no task holds a whole bin.
    """
    binned = df.withColumn("bin", quantile_bin(quantile_edges(df, target, bins), target))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    part = F.conv(F.substring(key, 1, 2), 16, 10).cast("int") % 64
    w = Window.partitionBy("bin", "_part").orderBy("_key", "id")
    dealt = binned.withColumns({"_key": key, "_part": part}).withColumn("fold", F.pmod(F.row_number().over(w) + F.col("_part"), F.lit(k)).cast("int"))
    return dealt.drop("_key", "_part")


def standardized(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """value minus the group's mean over its population deviation (1 if that is 0)."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(m, by).withColumn(value, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_m", "_s")


def fold_median_fill(cells: DataFrame, folds: int) -> DataFrame:
    """(id, fold, idx, value) rows with, for every outer fold, gaps filled by the training rows' median (0 if none):
    id, outer, idx, value, train."""
    each = cells.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("train", F.col("fold") != F.col("outer"))
    med = each.groupBy("outer", "idx").agg(F.percentile(F.when(F.col("train"), F.col("value")), F.lit(0.5)).alias("_m"))
    return each.join(med, ["outer", "idx"]).select("id", "outer", "idx", F.coalesce("value", "_m", F.lit(0.0)).alias("value"), "train")


def search_closed(x: np.ndarray, y: np.ndarray, model: str, points: list[dict], splits: int, repeats: int, seed: int) -> dict:
    """The candidate of least mean inner error over repeated shuffled splits."""
    errors = np.zeros(len(points))
    for r in range(repeats):
        fold = group_folds(len(y), splits, seed=seed + r)
        for f in range(splits):
            tr, va = x[fold != f], x[fold == f]
            for i, p in enumerate(points):
                w, b = fit_closed(model, p, tr, y[fold != f])
                errors[i] += float(np.sqrt(((y[fold == f] - va @ w - b) ** 2).mean()))
    return points[int(np.argmin(errors))]


def _vectors(df: DataFrame, cols: list[int]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select("id", array_to_vector(F.array(*[F.get("features", F.lit(i)).cast("double") for i in cols])).alias("features"), F.col("y").cast("double").alias("label"))


def tree_predictions(train: DataFrame, test: DataFrame, cols: list[int], model: str, points: list[dict], splits: int, repeats: int, seed: int) -> DataFrame:
    """id, y_pred of test by the candidate of least mean inner error over repeated splits (a single candidate needs no
    search)."""
    data = _vectors(train, cols).persist()
    best = points[0]
    if len(points) > 1:

        def error(task: tuple[dict, int, int]) -> float:
            p, r, f = task
            fold = F.pmod(F.xxhash64(F.lit(seed + r), "id"), F.lit(splits))
            fit = estimator(model, p, seed).fit(data.where(fold != f))
            return rmse(fit.transform(data.where(fold == f))) or 0.0

        tasks = [(p, r, f) for p in points for r in range(repeats) for f in range(splits)]
        with ThreadPoolExecutor(4) as pool:
            errors = np.array(list(pool.map(error, tasks))).reshape(len(points), -1)
        best = points[int(np.argmin(errors.mean(axis=1)))]
    out = estimator(model, best, seed).fit(data).transform(_vectors(test, cols)).select("id", F.col("prediction").alias("y_pred"))
    data.unpersist()
    return out


def nested_cv(
    df: DataFrame,
    models: dict[str, list[dict]],
    outer: int = 5,
    inner: int = 5,
    repeats: int = 3,
    select: str | None = None,
    prescreen: bool = True,
    stacking: bool = False,
    stack: dict | None = None,
    seed: int = 42,
    **select_options,
) -> DataFrame:
    """Out-of-fold rows (fold, id, model, y_true, y_pred) of df (id, features, y).

    models: candidates of each model (see candidates()).  Per outer fold: optional selection on the training rows,
    median fill and scaling by the training rows, a search per model (inner folds, repeated), refit and prediction; then
    the mean ensemble and, if asked for, a stack (see stacked(); stack: its options) that is fitted on the outer fold's
    training rows alone.
    """
    df = stratified_folds(df.where("y is not null"), "y", outer, seed=seed).persist()
    cols = unsupervised_prescreen(df)[0] if prescreen else list(range(df.select(F.size("features")).first()[0]))
    parts: list[DataFrame] = []
    spark = df.sparkSession
    small = any(m in CLOSED_FORM for m in models)
    ids, x_all, y_all = matrix(df.select("id", "features", "y")) if small else (np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    fold_of = {r["id"]: r["fold"] for r in df.select("id", "fold").collect()} if small else {}  # matrix() has bounded the rows
    folds = np.array([fold_of[i] for i in ids.tolist()]) if fold_of else np.zeros(0, int)
    chosen: dict[int, list[int]] = {}
    for f in range(outer):
        train = df.where(F.col("fold") != f)
        chosen[f] = select_features(imputed(train)[0] if select else train, select, cols, **select_options) if select else cols
    closed = {m: p for m, p in models.items() if m in CLOSED_FORM}
    if closed:
        data = spark.sparkContext.broadcast((ids, x_all, y_all, folds, chosen, closed))

        def run(batches):
            for b in batches:
                for f, model in zip(b["fold"], b["model"], strict=True):
                    ids, x, y, folds, chosen, closed = data.value
                    tr, te = folds != f, folds == f
                    part = np.where(np.isfinite(x[:, chosen[f]]), x[:, chosen[f]], np.nan)
                    gap = np.all(np.isnan(part[tr]), axis=0)
                    med = np.zeros(part.shape[1])
                    med[~gap] = np.nanmedian(part[tr][:, ~gap], axis=0)
                    part = np.where(np.isnan(part), med, part)
                    a, z = scaled(part[tr], part[te])
                    w, c = fit_closed(model, search_closed(a, y[tr], model, closed[model], inner, repeats, seed), a, y[tr])
                    yield pd.DataFrame({"fold": f, "id": ids[te], "model": model, "y_true": y[te], "y_pred": z @ w + c})

        tasks = spark.createDataFrame([(f, m) for f in range(outer) for m in closed], "fold int, model string").repartition(outer * len(closed))
        parts.append(tasks.mapInPandas(run, "fold int, id long, model string, y_true double, y_pred double"))
    for model, points in models.items():
        if model in CLOSED_FORM:
            continue
        for f in range(outer):
            train, fill = imputed_pair(df.where(F.col("fold") != f), df.where(F.col("fold") == f), chosen[f])
            got = tree_predictions(train, fill, list(range(len(chosen[f]))), model, points, inner, repeats, seed)
            test = df.where(F.col("fold") == f).select("id", F.col("y").cast("double").alias("y_true"))
            parts.append(test.join(got, "id").select(F.lit(f).alias("fold"), "id", F.lit(model).alias("model"), "y_true", "y_pred"))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    out = oof
    if len(models) > 1:
        out = out.unionByName(ensemble(oof, list(models)))
    if stacking:
        for f in range(outer):
            train, fill = imputed_pair(df.where(F.col("fold") != f), df.where(F.col("fold") == f), chosen[f])
            got = stacked(train, fill, list(range(len(chosen[f]))), seed=seed, **(stack or {}))
            test = df.where(F.col("fold") == f).select("id", F.col("y").cast("double").alias("y_true"))
            out = out.unionByName(test.join(got, "id").select(F.lit(f).alias("fold"), "id", F.lit("Stacking").alias("model"), "y_true", "y_pred"))
    return out


def imputed_pair(train: DataFrame, test: DataFrame, cols: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both with the columns chosen and gaps filled by the training medians (0 where there is none)."""
    pick = F.array(*[F.get("features", F.lit(i)).cast("double") for i in cols])
    a, b = train.withColumn("features", pick), test.withColumn("features", pick)
    from .screening import medians

    fill = {r["idx"]: 0.0 if r["median"] is None else r["median"] for r in medians(a).collect()}
    fill = {i: fill.get(i, 0.0) for i in range(len(cols))}
    return imputed(a, fill)[0], imputed(b, fill)[0]


#: The base models of the stack.
STACK_BASES: dict[str, dict] = {"RandomForest": {"n_estimators": 300, "max_depth": 10}, "LightGBM": {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.05, "subsample": 1.0}}


def stacked(
    train: DataFrame,
    test: DataFrame,
    cols: list[int],
    bases: dict[str, dict] | None = None,
    splits: int = 5,
    alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0),
    seed: int = 42,
) -> DataFrame:
    """id, y_pred of test (id, features, y) by a ridge over base models.

    Every base predicts each training row from a fit on the other folds of the training rows; the ridge is fitted on
    these predictions, its penalty chosen by exact leave-one-out error.  The bases are then fitted on all training rows
    and the ridge applied to their predictions of test.  Targets of test are never read.  The ridge needs the cross
    products of as many columns as there are bases: two small aggregates.
    """
    bases = bases or STACK_BASES
    data, new = _vectors(train, cols).persist(), _vectors(test, cols)
    fold = F.pmod(F.xxhash64(F.lit(seed + 7), "id"), F.lit(splits))

    def inner(task: tuple[str, int]) -> DataFrame:
        name, f = task
        fit = estimator(name, bases[name], seed).fit(data.where(fold != f))
        return fit.transform(data.where(fold == f)).select("id", "label", F.lit(name).alias("base"), "prediction")

    def outer(name: str) -> DataFrame:
        return estimator(name, bases[name], seed).fit(data).transform(new).select("id", F.lit(name).alias("base"), "prediction")

    names = list(bases)
    with ThreadPoolExecutor(4) as pool:
        parts, last = list(pool.map(inner, [(n, f) for n in names for f in range(splits)])), list(pool.map(outer, names))
    own = [F.max(F.when(F.col("base") == n, F.col("prediction"))).alias(f"p{i}") for i, n in enumerate(names)]
    held = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("label").alias("label"), *own).persist()
    weights, base = ridge_loo(held, [f"p{i}" for i in range(len(names))], "label", alphas)
    held.unpersist()
    data.unpersist()
    wide = reduce(DataFrame.unionByName, last).groupBy("id").agg(*own)
    value = reduce(lambda a, b: a + b, (F.col(f"p{i}") * w for i, w in enumerate(weights)), F.lit(base))
    return wide.select("id", value.alias("y_pred"))


def ridge_loo(df: DataFrame, columns: list[str], target: str, alphas: tuple[float, ...]) -> tuple[list[float], float]:
    """(weights, intercept) of a ridge with a free intercept, of the penalty with the least leave-one-out error: a row's
    own influence on its fit follows from the cross products, so one pass gives the sums and one the errors."""
    k = len(columns)
    x = [F.col(c) for c in columns] + [F.col(target)]
    first = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k + 1) for j in range(i + 1)]).first()
    n, mean = first["n"], np.array([first[f"m{i}"] or 0.0 for i in range(k + 1)])
    cov = np.array([[first[f"c{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)]) * n
    fits = []
    for a in alphas:
        inverse = np.linalg.pinv(cov[:k, :k] + a * np.eye(k))
        fits.append((inverse @ cov[:k, k], inverse))
    centred = [x[i] - float(mean[i]) for i in range(k + 1)]
    errors = []
    for i, (w, inverse) in enumerate(fits):
        residual = centred[k] - reduce(lambda a, b: a + b, (centred[j] * float(w[j]) for j in range(k)))
        own = reduce(lambda a, b: a + b, (centred[p] * centred[q] * float(inverse[p, q]) for p in range(k) for q in range(k)), F.lit(1.0 / n))
        errors.append(F.avg(F.pow(residual / (F.lit(1.0) - own), 2)).alias(f"e{i}"))
    got = df.agg(*errors).first()
    w = fits[int(np.argmin([got[f"e{i}"] for i in range(len(alphas))]))][0]
    return [float(v) for v in w], float(mean[k] - w @ mean[:k])


def score(oof: DataFrame) -> DataFrame:
    """fold, model, metric, value."""
    return melted(agreement(oof, ["fold", "model"]), ["fold", "model"])
