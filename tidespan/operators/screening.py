"""Feature screening and selection over a matrix table (id, features: array<double>, y: double).

Moments of all features come from one pass: every task adds up its own cross products in NumPy and sends p * p
numbers.  What reaches the driver is p * p numbers at most (p: features), never rows of the table, except in the
estimators marked `bounded`, which need a whole matrix: they refuse one over MATRIX_BYTES.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

MATRIX_BYTES = 256 << 20
#: Parts of cross products that one task merges.
FAN_IN = 16
#: Rows among which a shadow feature is permuted, at least, where there are so many.
SHADOW_ROWS = 2_000


def exploded(df: DataFrame, features: str = "features") -> DataFrame:
    """id, idx, value, one row per cell; values that aren't finite are null."""
    return df.select("id", F.posexplode(features).alias("idx", "value")).withColumn(
        "value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value").cast("double"))
    )


def medians(df: DataFrame) -> DataFrame:
    """idx, median (exact) of each feature; null if it has no value."""
    return quantiles(exploded(df), ["idx"], "value", [0.5]).select("idx", F.col("q0").alias("median"))


def imputed(df: DataFrame, fill: dict[int, float | None] | None = None) -> tuple[DataFrame, list[int]]:
    """features with gaps filled by the feature's median, and the features that were kept (those with a value)."""
    fill = {r["idx"]: r["median"] for r in medians(df).collect()} if fill is None else fill
    kept = sorted(i for i, m in fill.items() if m is not None)
    cell = lambda i: F.get("features", F.lit(i)).cast("double")
    good = [F.coalesce(F.when(~F.isnan(cell(i)) & (F.abs(cell(i)) < float("inf")), cell(i)), F.lit(float(fill[i]))) for i in kept]
    return df.withColumn("features", F.array(*good)), kept


def moments(df: DataFrame, target: str | None = "y") -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, covariances of population) of the features, with the target as the last column if given.

    Each task centres on its own mean, so large offsets lose no digits.  The parts are merged by tasks, FAN_IN at a
    time, until one is left: the driver gets one matrix, however many tasks there were.
    """
    cols = ["features", *([F.col(target).cast("double").alias("y")] if target else [])]
    schema = "n long, mean array<double>, cross binary"

    def out(n, mean, cross):
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([cross.tobytes()])], ["n", "mean", "cross"])

    def each(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
            if target:
                x = np.column_stack([x, batch.column(1).to_numpy()])
            part = (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
            total = part if total is None else _merge(total, part)
        if total:
            yield out(*total)

    def both(batches):
        total = None
        for batch in batches:
            for n, mean, cross in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = (n, np.array(mean), np.frombuffer(cross).reshape(len(mean), -1))
                total = part if total is None else _merge(total, part)
        if total:
            yield out(*total)

    parts = df.select(*cols)
    width = parts.rdd.getNumPartitions()
    parts = parts.mapInArrow(each, schema)
    while width > 1:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInArrow(both, schema)  # not coalesce: the reading tasks stay as they are
    r = parts.first()
    if r is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    return r["n"], np.array(r["mean"]), np.frombuffer(r["cross"]).reshape(len(r["mean"]), -1) / r["n"]


def _merge(a, b):
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * a[0] * b[0] / n


def correlations(cov: np.ndarray) -> np.ndarray:
    """Pearson correlations; 0 for a constant."""
    s = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale = np.outer(s, s)
    return np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)


def variance_filter(df: DataFrame, least: float = 1e-6) -> DataFrame:
    """idx, variance (of the sample) of features that vary at least so much."""
    return exploded(df).groupBy("idx").agg(F.var_samp("value").alias("variance")).where(F.col("variance") >= least)


def target_correlations(df: DataFrame, target: Column | str = "y") -> DataFrame:
    """idx, r: correlation of each feature with the target, 0 where undefined."""
    from ..functions.scalars import corr0

    cells = df.select("id", F.col(target).cast("double").alias("y") if isinstance(target, str) else target.alias("y"), F.posexplode("features").alias("idx", "value"))
    return cells.groupBy("idx").agg(corr0("value", "y").alias("r"))


def correlated_pairs(df: DataFrame, above: float) -> list[tuple[int, int, float]]:
    """(a, b, r) with a < b and |r| over the limit."""
    r = correlations(moments(df, None)[2])
    a, b = np.nonzero(np.triu(np.abs(r) > above, 1))
    return [(int(i), int(j), float(r[i, j])) for i, j in zip(a, b, strict=True)]


def drop_collinear(pairs: list[tuple[int, int, float]], score: dict[int, float]) -> list[int]:
    """Features to drop: pairs in order, the one of smaller score goes (on a tie the earlier); a pair with a dropped
    side no longer counts."""
    gone: set[int] = set()
    for a, b, _ in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(b if score[a] > score[b] else a)
    return sorted(gone)


def unsupervised_prescreen(df: DataFrame, least_variance: float = 1e-6, above: float = 0.9) -> tuple[list[int], dict[str, int]]:
    """Features left after imputation, the variance filter and the collinearity filter (higher variance stays)."""
    full, kept = imputed(df)
    n, _, cov = moments(full, None)
    var = np.diag(cov) * n / max(n - 1, 1)
    varied = [i for i in range(len(kept)) if var[i] >= least_variance]
    r = correlations(cov)
    pairs = [(a, b, float(r[a, b])) for i, a in enumerate(varied) for b in varied[i + 1 :] if abs(r[a, b]) > above]
    gone = set(drop_collinear(pairs, dict(enumerate(var.tolist()))))
    left = [kept[i] for i in varied if i not in gone]
    return left, {"n_input": len(kept), "n_after_variance": len(varied), "n_after_collinear": len(left)}


def matrix(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, X, y) ordered by id, for estimators that need a whole matrix; bounded."""
    n = df.count()
    first = df.select(F.size("features")).first()
    if first and n * (first[0] + 2) * 8 > MATRIX_BYTES:
        raise ValueError(f"a matrix of {n} rows is over the bound of {MATRIX_BYTES} bytes: use the estimators of pyspark.ml")
    t = df.select("id", "features", F.col("y").cast("double").alias("y")).orderBy("id").toArrow()
    x = np.array(t.column("features").to_pylist(), float) if n else np.zeros((0, 0))
    return t.column("id").to_numpy(), x, t.column("y").to_numpy()


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive x: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    inv = 1 / x**2
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def kth_radius(x: np.ndarray, y: np.ndarray, k: int, block: int = 2048) -> np.ndarray:
    """Distance of every point to its k-th neighbour, the greater of both coordinates' distances counting.

    Points are taken in order of x.  Neighbours are looked for within `reach` places on either side; a point is done
    when all points beyond these are further off in x alone than what was found, the others look twice as far."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    out, todo, reach = np.empty(n), np.arange(n), max(32, 2 * k)
    while len(todo):
        left = []
        for lo in range(0, len(todo), block):
            at = todo[lo : lo + block]
            near = at[:, None] + np.arange(-reach, reach + 1)
            inside = (near >= 0) & (near < n)
            near = np.clip(near, 0, n - 1)
            d = np.where(inside, np.maximum(np.abs(xs[near] - xs[at, None]), np.abs(ys[near] - ys[at, None])), np.inf)
            r = np.partition(d, k, axis=1)[:, k]
            edge = np.minimum(np.where(at - reach > 0, xs[at] - xs[np.maximum(at - reach, 0)], np.inf), np.where(at + reach < n - 1, xs[np.minimum(at + reach, n - 1)] - xs[at], np.inf))
            out[at] = r
            left.append(at[r > edge])
        todo, reach, block = np.concatenate(left), 2 * reach, max(1, block // 2)
    back = np.empty(n)
    back[order] = out
    return back


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Nearest-neighbour estimate (Kraskov, first kind) of two continuous variables, not below 0."""
    n = len(x)
    if n <= k or x.std() == 0 or y.std() == 0:
        return 0.0
    rng = np.random.default_rng(seed)
    x, y = (v / v.std() + 1e-10 * max(1.0, np.abs(v / v.std()).mean()) * rng.standard_normal(n) for v in (x, y))
    radius = np.nextafter(kth_radius(x, y, k), 0)
    near = lambda v: np.searchsorted(np.sort(v), v + radius, "right") - np.searchsorted(np.sort(v), v - radius, "left")
    est = digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - digamma(near(x)).mean() - digamma(near(y)).mean()
    return max(0.0, float(est))


def mutual_informations(df: DataFrame, k: int = 3) -> DataFrame:
    """idx, mi of every feature with the target.  Each feature is estimated by a task of its own, from its column and
    the target's alone; one of over MATRIX_BYTES is refused (16 million rows)."""
    n = df.count()
    if n * 16 > MATRIX_BYTES:
        raise ValueError(f"{n} rows are over the bound of {MATRIX_BYTES} bytes for a feature")
    cells = df.where("y is not null").select("id", F.col("y").cast("double").alias("y"), F.posexplode("features").alias("idx", "x")).select("id", "y", "idx", F.col("x").cast("double").alias("x"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"idx": [part["idx"].iloc[0]], "mi": [mutual_information(part["x"].to_numpy(), part["y"].to_numpy(), k)]})

    return cells.groupBy("idx").applyInPandas(one, "idx int, mi double")


def prescreen(df: DataFrame, corr_percentile: float = 85, mi_percentile: float = 80, above: float = 0.9, k: int = 3) -> list[int]:
    """Features in the top shares of both |r| and mutual information with the target, then the collinearity filter
    (the higher |r| stays)."""
    _, _, cov = moments(df)
    r = correlations(cov)
    strength = np.abs(r[:-1, -1])
    mi = np.zeros(len(strength))
    for row in mutual_informations(df, k).collect():
        mi[row["idx"]] = row["mi"]
    both = [i for i in range(len(strength)) if strength[i] >= np.percentile(strength, 100 - corr_percentile) and mi[i] >= np.percentile(mi, 100 - mi_percentile)]
    pairs = [(a, b, float(r[a, b])) for n, a in enumerate(both) for b in both[n + 1 :] if abs(r[a, b]) > above]
    gone = set(drop_collinear(pairs, dict(enumerate(strength.tolist()))))
    return [i for i in both if i not in gone]


def mrmr(n: int, cov: np.ndarray, k: int) -> list[int]:
    """Greedy ranking: F statistic with the target over the mean |r| with what is chosen.  cov: target last."""
    r = correlations(cov)
    rt = np.clip(r[:-1, -1] ** 2, 0, 1 - 1e-12)
    relevance = rt / (1 - rt) * max(n - 2, 1)
    redundancy = np.zeros(len(rt))
    chosen: list[int] = []
    for step in range(min(k, len(rt))):
        score = relevance / np.maximum(redundancy / step if step else 1.0, 1e-3)
        score[chosen] = -np.inf
        best = int(np.argmax(score))
        chosen.append(best)
        redundancy += np.abs(r[:-1, best])
    return chosen


def group_folds(n: int, k: int, groups: np.ndarray | None = None, seed: int = 42) -> np.ndarray:
    """Fold of every sample; samples of a group share one, larger groups are dealt first to the emptiest fold."""
    if groups is None:
        return np.random.default_rng(seed).permutation(n) % k
    names, number, size = np.unique(groups, return_inverse=True, return_counts=True)
    fold_of, load = np.zeros(len(names), int), np.zeros(k, int)
    for g in np.argsort(-size, kind="stable"):
        fold_of[g] = np.argmin(load)
        load[fold_of[g]] += size[g]
    return fold_of[number]


class Pls:
    """Partial least squares for one target from cross products: the deflation of NIPALS, applied to these instead of
    to the rows.  xx, xy: centred sums of products of the inputs, and with the target."""

    def __init__(self, xx: np.ndarray, xy: np.ndarray, components: int):
        self.size = len(xy)
        xx, xy = xx.copy(), xy.copy()
        w_, p_, q_, t_ = [], [], [], []
        for _ in range(components):
            norm = np.linalg.norm(xy)
            if norm < 1e-12:
                break
            w = xy / norm
            tt = w @ xx @ w
            if tt <= 1e-12:
                break
            p, q = xx @ w / tt, xy @ w / tt
            xx -= tt * np.outer(p, p)
            xy -= tt * q * p
            w_.append(w), p_.append(p), q_.append(q), t_.append(tt)
        self.w, self.p, self.q, self.tt = (np.array(v) for v in (w_, p_, q_, t_))

    def coefficients(self, components: int) -> np.ndarray:
        c = min(components, len(self.w))
        if not c:
            return np.zeros(self.size)
        w, p, q = self.w[:c].T, self.p[:c].T, self.q[:c]
        return w @ np.linalg.solve(p.T @ w, q)

    def vip(self) -> np.ndarray:
        """Importance of each input in the projection; ones if nothing is explained."""
        if not len(self.w):
            return np.ones(self.size)
        ss = self.tt * self.q**2
        return np.ones(self.size) if ss.sum() == 0 else np.sqrt(self.size * (self.w.T**2 @ ss) / ss.sum())


def _standardised(part: tuple[float, np.ndarray, np.ndarray], cols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(columns, deviations, cross products of standardised columns, the same with the target) from moments()."""
    n, _, cov = part
    cols = np.arange(len(cov) - 1) if cols is None else np.array(cols)
    std = np.sqrt(np.clip(np.diag(cov)[cols], 0, None))
    std[std == 0] = 1
    return cols, std, n * cov[np.ix_(cols, cols)] / np.outer(std, std), n * cov[cols, -1] / std


def held_out_error(train, held, cols: np.ndarray, w: np.ndarray) -> float:
    """RMSE on the held-out part of a linear model (weights w of raw columns, through the training means)."""
    _, mean, _ = train
    _, mean_v, cov_v = held
    off = (mean_v[-1] - mean[-1]) - w @ (mean_v[cols] - mean[cols])  # mean residual
    var = cov_v[-1, -1] - 2 * w @ cov_v[cols, -1] + w @ cov_v[np.ix_(cols, cols)] @ w
    return float(np.sqrt(max(off**2 + var, 0.0)))


def fold_moments(df: DataFrame, folds: int, groups: str | None = None, seed: int = 42) -> list[tuple[tuple, tuple]]:
    """(moments of the other folds, moments of the fold) of every fold that has samples on both sides."""
    data = with_fold(df.where("y is not null"), folds, groups, seed)
    parts = [moments(data.where(F.col("_fold") == f)) for f in range(folds)]
    out = []
    for f, held in enumerate(parts):
        rest = [p for g, p in enumerate(parts) if g != f and p[0]]
        if held[0] and rest:
            out.append((_merged(rest), held))
    return out


def scaled(train: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Standardised by train's mean and population deviation; a constant is divided by 1."""
    mean, std = train.mean(axis=0), train.std(axis=0)
    std[std == 0] = 1
    return [(x - mean) / std for x in (train, *more)]


def pls_vip(df: DataFrame, most: int = 20, threshold: float = 1.8, folds: int = 5, fallback: int = 10, groups: str | None = None) -> tuple[list[int], np.ndarray, int]:
    """(selected, VIP of all features, components): components by cross-validated RMSE, features of VIP >= threshold
    in falling order, the top `fallback` if there are fewer.  Only the cross products of each fold leave the tasks."""
    sides = fold_moments(df, folds, groups)
    whole = _merged([sides[0][0], sides[0][1]])
    most = min(most, len(whole[1]) - 1, int(whole[0]) - 1)
    errors = np.zeros((len(sides), most))
    for k, (train, held) in enumerate(sides):
        cols, std, xx, xy = _standardised(train)
        model = Pls(xx, xy, most)
        errors[k] = [held_out_error(train, held, cols, model.coefficients(c) / std) for c in range(1, most + 1)]
    best = int(np.argmin(errors.mean(axis=0))) + 1
    vip = Pls(*_standardised(whole)[2:], best).vip()
    order = np.argsort(-vip, kind="stable")
    chosen = [int(i) for i in order if vip[i] >= threshold]
    return chosen if len(chosen) >= fallback else order[:fallback].tolist(), vip, best


def forest(model: str, trees: int, depth: int, seed: int = 42, rate: float | None = None):
    """The pyspark.ml regressor for a model's name; boosted trees stand in for the boosting libraries."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if model == "RandomForest":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    if model in ("LightGBM", "XGBoost", "CatBoost", "GBT"):
        return GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, stepSize=rate or (0.1 if model == "XGBoost" else 0.05))
    raise ValueError(f"unknown model: {model}")


def labelled(df: DataFrame, features: list[int], *keep: str) -> DataFrame:
    """features (a vector of the chosen ones), label, and the columns to keep."""
    from pyspark.ml.functions import array_to_vector

    return df.select(array_to_vector(F.array(*[F.get("features", F.lit(i)).cast("double") for i in features])).alias("features"), F.col("y").cast("double").alias("label"), *keep)


def spark_importances(df: DataFrame, features: list[int], model: str, trees: int, depth: int, seed: int = 42) -> np.ndarray:
    """Importances of the chosen features in a pyspark.ml forest or boosted trees."""
    return forest(model, trees, depth, seed).fit(labelled(df, features)).featureImportances.toArray()


def with_fold(df: DataFrame, folds: int, groups: str | None = None, seed: int = 42) -> DataFrame:
    """df with _fold (0..folds-1) by a seeded hash of the id, or of the group, whose samples then share a fold."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), groups or "id"), F.lit(folds)).cast("int"))


def rmse(predicted: DataFrame) -> float | None:
    """None without rows."""
    return predicted.agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0]


def weakest(left: list[int], weight: np.ndarray, n: int) -> list[int]:
    """left without its n least important features (of equal ones the first go)."""
    out = {left[i] for i in np.argsort(weight, kind="stable")[:n]}
    return [f for f in left if f not in out]


def rfe(df: DataFrame, features: list[int], model: str, keep: int, step: int, trees: int = 20, depth: int = 5) -> list[int]:
    """Recursive elimination: the `step` least important features go until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        left = weakest(left, spark_importances(df, left, model, trees, depth), min(step, len(left) - keep))
    return left


def rfe_cv(
    df: DataFrame, features: list[int], model: str, least: int = 20, step: int = 5, folds: int = 5, trees: int = 20, depth: int = 5, groups: str | None = None, seed: int = 42
) -> tuple[list[int], dict[int, float]]:
    """(features, mean error by number of features): recursive elimination inside every fold gives the error of each
    number of features on the fold's own samples; the number of least mean error (of equal ones the smaller) is then
    kept by an elimination on all samples.  Samples of a group share a fold."""
    data = with_fold(df, folds, groups, seed).persist()

    def one(fold: int) -> dict[int, float]:
        train, test = data.where(F.col("_fold") != fold), data.where(F.col("_fold") == fold)
        left, errors = list(features), {}
        while True:
            fit = forest(model, trees, depth, seed).fit(labelled(train, left))
            errors[len(left)] = rmse(fit.transform(labelled(test, left)))
            if len(left) <= least:
                return errors
            left = weakest(left, fit.featureImportances.toArray(), min(step, len(left) - least))

    with ThreadPoolExecutor(4) as pool:
        each = list(pool.map(one, range(folds)))
    data.unpersist()
    mean = {n: float(np.mean([e[n] for e in each if e[n] is not None] or [np.inf])) for n in each[0]}
    best = min(mean, key=lambda n: (mean[n], n))
    return rfe(df, features, model, best, step, trees, depth), mean


def consensus(votes: DataFrame, models: int, rule: str = "all") -> DataFrame:
    """feature, n_models of votes (model, feature) that all models, or two of them at least ("majority"), chose."""
    need = models if rule == "all" else 2
    return votes.groupBy("feature").agg(F.count_distinct("model").alias("n_models")).where(F.col("n_models") >= need)


def _binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """P(X >= hits)."""
    return sum(math.comb(n, i) for i in range(hits, n + 1)) * p**n


def with_shadows(df: DataFrame, parts: int, seed: int) -> DataFrame:
    """id, features and as many shadows, y: each shadow is its feature, permuted independently of the others among the
    rows of an Arrow batch of a hashed part."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
            rng = np.random.default_rng([seed, abs(int(batch.column(0)[0].as_py()))])
            both = np.hstack([x, rng.permuted(x, axis=0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(both)), batch.column(2)], ["id", "features", "y"])

    rows = df.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.col("y").cast("double").alias("y"))
    order = F.xxhash64(F.lit(seed), "id")
    dealt = rows.repartition(parts, order).sortWithinPartitions(order, "id")
    return dealt.mapInArrow(run, "id long, features array<double>, y double")


def boruta(df: DataFrame, rounds: int = 20, alpha: float = 0.05, trees: int = 20, depth: int = 5, tentative: bool = True, seed: int = 42) -> dict[str, list[int]]:
    """confirmed, tentative, rejected features: a feature scores a hit in a round when its forest importance is over
    that of every shadow (a permuted copy); hits are judged by two-sided binomial tests, corrected for all features.

    Every shadow is permuted on its own, within parts of the rows that a seeded hash of the id makes anew each round.
    """
    p = df.select(F.size("features")).first()[0]
    parts = max(1, df.count() // SHADOW_ROWS)
    hits = np.zeros(p, int)
    alive = list(range(p))
    confirmed: list[int] = []
    rejected: list[int] = []
    for n in range(1, rounds + 1):
        data = with_shadows(df, parts, seed + n).persist()
        weight = spark_importances(data, [*alive, *range(p, 2 * p)], "RandomForest", trees, depth, seed + n)
        data.unpersist()
        bar = weight[len(alive) :].max()
        for i, f in enumerate(alive):
            hits[f] += weight[i] > bar
        limit = alpha / p
        confirmed += [f for f in alive if _binomial_tail(hits[f], n) <= limit]
        rejected += [f for f in alive if _binomial_tail(n - hits[f], n) <= limit]
        alive = [f for f in alive if f not in confirmed and f not in rejected]
        if not alive:
            break
    chosen = sorted(confirmed + (alive if tentative else [])) or [int(np.argmax(hits))]
    return {"selected": chosen, "confirmed": sorted(confirmed), "tentative": sorted(alive), "rejected": sorted(rejected)}


def select_features(df: DataFrame, method: str, screened: list[int] | None = None, k: int = 20, **options) -> list[int]:
    """One selection: boruta, pls_vip or mrmr, on the screened features (by default all)."""
    p = df.select(F.size("features")).first()[0]
    cols = screened if screened is not None else list(range(p))
    part = df.withColumn("features", F.array(*[F.get("features", F.lit(i)).cast("double") for i in cols]))
    if method == "boruta":
        got = boruta(part, **options)["selected"]
    elif method == "pls_vip":
        got = pls_vip(part, **options)[0]
    elif method == "mrmr" and "ks" in options:
        got = mrmr_best(part, **options)["features"]
    elif method == "mrmr":
        n, _, cov = moments(part)
        got = mrmr(n, cov, k)
    else:
        raise ValueError(f"unknown selection method: {method}")
    return [cols[i] for i in got]


def selection_pipeline(df: DataFrame, config: dict) -> list[int]:
    """Imputation, then as configured: unsupervised prescreening, supervised prescreening, one selection method, and
    after mRMR recursive elimination with a vote of models.

    config keys: unsupervised {least_variance, above} or None, supervised {corr_percentile, mi_percentile} or None,
    method, options of the method, rfe {models, keep, step, rule, folds, groups} or None.  With folds, `keep` is the
    least number of features and cross-validation chooses it (rfe_cv).  After mRMR without rfe, options may give ks: the
    number of features is then the best of a grid (mrmr_best).
    """
    left = unsupervised_prescreen(df, **config["unsupervised"])[0] if config.get("unsupervised") else None
    full, kept = imputed(df)
    cols = [kept.index(i) for i in left] if left is not None else list(range(len(kept)))
    if config.get("supervised"):
        part = full.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in cols]))
        cols = [cols[i] for i in prescreen(part, **config["supervised"])]
    cols = select_features(full, config["method"], cols, **config.get("options", {}))
    if config["method"] == "mrmr" and (r := config.get("rfe")):
        votes = []
        for m in r["models"]:
            if r.get("folds"):
                chosen, _ = rfe_cv(full, cols, m, r["keep"], r["step"], r["folds"], r.get("trees", 20), r.get("depth", 5), r.get("groups"))
            else:
                chosen = rfe(full, cols, m, r["keep"], r["step"], r.get("trees", 20), r.get("depth", 5))
            votes += [(m, f) for f in chosen]
        table = df.sparkSession.createDataFrame(votes, "model string, feature int")
        cols = sorted(x["feature"] for x in consensus(table, len(r["models"]), r.get("rule", "all")).collect())
    return [kept[i] for i in cols]


def mrmr_grid(
    df: DataFrame, ks: list[int], folds: int = 5, model: str = "Ridge", groups: str | None = None, ridge: float = 1.0, trees: int = 100, depth: int = 6, rate: float | None = None, seed: int = 42
) -> tuple[list[int], DataFrame]:
    """(ranking, table of k, rmse_mean, rmse_std over folds) for prefixes of one mRMR ranking.

    model: the judge, Ridge (from cross products of each fold, so rows never leave their tasks) or a tree model (see
    forest()).  Samples of a group share a fold; folds without samples don't count.
    """
    n, mean, cov = moments(df)
    order = mrmr(n, cov, max(ks))
    rows: list[tuple[int, float]] = []
    if model == "Ridge":
        for train, held in fold_moments(df, folds, groups, seed):
            for k in ks:
                cols, std, xx, xy = _standardised(train, order[:k])
                rows.append((k, held_out_error(train, held, cols, np.linalg.solve(xx + ridge * np.eye(len(cols)), xy) / std)))
    else:
        data = with_fold(df.where("y is not null"), folds, groups, seed).persist()

        def one(task: tuple[int, int]) -> tuple[int, float | None]:
            k, f = task
            fit = forest(model, trees, depth, seed, rate).fit(labelled(data.where(F.col("_fold") != f), order[:k]))
            return k, rmse(fit.transform(labelled(data.where(F.col("_fold") == f), order[:k])))

        with ThreadPoolExecutor(4) as pool:
            rows = [x for x in pool.map(one, [(k, f) for k in ks for f in range(folds)]) if x[1] is not None]
        data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "k int, rmse double")
    return order, table.groupBy("k").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"))


def mrmr_best(df: DataFrame, ks: list[int], **options) -> dict:
    """k of least mean error (the first of equal ones), its error, its features, the whole ranking and the grid."""
    order, table = mrmr_grid(df, ks, **options)
    grid = {r["k"]: (r["rmse_mean"], r["rmse_std"]) for r in table.collect()}  # a row per k
    best = min((k for k in ks if k in grid), key=lambda k: grid[k][0])
    return {"k": min(best, len(order)), "rmse": grid[best][0], "features": order[:best], "ranking": order, "grid": grid}


def _merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """moments() of the union of tables."""
    sums = [(n, mean, cov * n) for n, mean, cov in parts]
    total = sums[0]
    for p in sums[1:]:
        total = _merge(total, p)
    return total[0], total[1], total[2] / total[0]
