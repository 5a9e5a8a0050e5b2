import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.functions import agronomy, scalars
from tidespan.operators import features, metrics, modeling, peaks, periods, screening, statics, sweep
from tidespan.sources import rasters, tables


def test_window_endpoints(spark):
    bw = {p: (a, b) for p, a, b in periods.window_rows("biweekly")}
    assert (bw["bw_m18"], bw["bw_m1"], bw["bw_peak"], bw["bw_p1"], bw["bw_p5"]) == ((-277, -263), (-22, -8), (-7, 7), (8, 22), (68, 82))
    mo = {p: (a, b) for p, a, b in periods.window_rows("monthly")}
    assert (mo["mo_m9"], mo["mo_m1"], mo["mo_p3"]) == ((-285, -256), (-45, -16), (76, 105))
    assert len(periods.window_rows("calendar_biweekly")) == 24
    assert periods.window_rows("calendar_monthly")[7] == ("feb", dt.date(2025, 2, 1), dt.date(2025, 2, 28))
    with pytest.raises(ValueError):
        periods.window_rows("weekly")
    with pytest.raises(ValueError):
        periods.statistic("mode", "x")


def test_overlapping_windows_repeat_rows(spark):
    w = periods.window_table(spark, [("a", 0, 10), ("b", 10, 20), ("c", 5, 12)], "int")
    df = spark.createDataFrame([(1, d, 1.0) for d in range(25)], "id int, day int, value double")
    got = {r["period"]: r["sum"] for r in periods.aggregate(df, w, "day", ["id"], ["sum"]).collect()}
    assert got == {"a": 11.0, "b": 11.0, "c": 8.0}


def test_single_value_and_empty_cells(spark):
    w = periods.window_table(spark, [("a", 0, 1), ("b", 5, 9)], "int")
    df = spark.createDataFrame([(1, 0, 4.0), (1, 1, float("nan"))], "id int, day int, value double")
    got = {r["period"]: r for r in periods.aggregate(df, w, "day", ["id"], ["mean", "std", "cv", "slope", "sum"], cells=True).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["cv"], got["a"]["slope"]) == (4.0, 0.0, 0.0, 0.0)
    assert got["b"]["sum"] is None


def test_windows_are_broadcast(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 50).cast("int").alias("day"), F.lit(1.0).alias("value"))
    plan = periods.in_periods(df, periods.windows(spark, "phenological"), "day")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double").select(scalars.clip("x", -1, 1).alias("x"))
    assert sorted((r["x"] is None, r["x"] or 0) for r in df.collect()) == [(False, -1.0), (False, 1.0), (True, 0)]


def test_soil_null_inputs(spark):
    df = spark.createDataFrame([(40.0, 20.0, 2.5), (None, 20.0, 2.5)], "s double, c double, o double")
    a, b = agronomy.with_soil_water(df, "s", "c", "o").collect()
    assert all(b[f"saxton_{k}"] is None for k in agronomy.SOIL_OUTPUTS)
    assert 0.05 < a["saxton_LL15"] < a["saxton_DUL"] < a["saxton_SAT"] < 0.6
    assert math.isclose(a["saxton_B"] * a["saxton_lambda"], 1.0)


def test_indices_have_all_names(spark):
    assert tuple(agronomy.spectral_indices()) == agronomy.INDEX_NAMES


def test_metrics_closed_forms(spark):
    df = spark.createDataFrame([("same", float(i), float(i)) for i in range(1, 9)] + [("off", float(i), i + 2.0) for i in range(1, 9)] + [("flat", float(i), 3.0) for i in range(1, 9)], "m string, y_true double, y_pred double")
    got = {r["m"]: r for r in metrics.agreement(df, ["m"]).collect()}
    assert all(math.isclose(got["same"][k], 1.0, abs_tol=1e-6) for k in ("R2", "CCC", "KGE"))
    assert got["same"]["PLA"] < 1e-6 and got["same"]["PLP"] < 1e-6
    assert math.isclose(got["off"]["MBE"], 2.0) and got["off"]["PLP"] < 1e-4
    assert got["flat"]["CCC"] == 0.0


def test_features(spark):
    long = spark.createDataFrame([(1, 0, "p", "a", "mean", 2.0), (1, 0, "p", "b", "mean", 4.0), (1, 0, "p", "r", "sum", 3.0)], "id int, ord int, period string, feature string, stat string, value double")
    keys = ["id", "ord", "period"]
    assert [(r["feature"], round(r["value"], 4)) for r in features.pairs(long, [("a", "b"), ("a", "zz")], "ratio", keys).collect()] == [("a_div_b", 0.5)]
    assert [(r["feature"], r["value"]) for r in features.weather_pairs(long, ["a"], ["r"], keys).collect()] == [("a_x_r", 6.0)]
    assert features.critical_periods(["bw_m10", "bw_m1"]) == ["bw_m1"]
    assert features.critical_periods(["bw_m10", "bw_m1"], parity=True) == ["bw_m10", "bw_m1"]
    assert features.critical_periods(["q", "r", "s", "t"]) == ["r", "s", "t"]
    assert features.kind_of("p_water_deficit_mean") == "raw" and features.kind_of("p_water_deficit_mean", True) == "derived"


def test_collinear_greedy(spark):
    pairs = [(0, 1, 0.95), (1, 2, 0.95), (0, 2, 0.2)]
    assert screening.drop_collinear(pairs, {0: 1.0, 1: 2.0, 2: 3.0}) == [0, 1]
    assert screening.drop_collinear([(0, 1, 0.99)], {0: 1.0, 1: 1.0}) == [0]


def test_moments_and_selection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) + 1000
    x[:, 5] = 7.0
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, row.tolist(), float(v)) for i, (row, v) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, y double")
    n, mean, cov = screening.moments(df)
    assert n == 200 and np.allclose(mean[:6], x.mean(axis=0)) and np.allclose(cov[:6, :6], np.cov(x.T, ddof=0))
    assert screening.mrmr(n, cov, 2)[0] == 0
    left, _ = screening.unsupervised_prescreen(df)
    assert left == [0, 1, 2, 3, 4]
    _, vip, _ = screening.pls_vip(df.withColumn("features", F.slice("features", 1, 5)))
    assert set(np.argsort(-vip)[:2]) == {0, 1}
    mi = {r["idx"]: r["mi"] for r in screening.mutual_informations(df).collect()}
    assert mi[0] > mi[3] and mi[5] == 0.0
    oof = modeling.nested_cv(df, {"ElasticNet": [{"alpha": 0.001, "l1_ratio": 0.5}], "Ridge": [{"alpha": 0.1}]}, outer=2, inner=3, repeats=1, stacking=True, stack={"bases": {"RandomForest": {"n_estimators": 15, "max_depth": 5}, "LightGBM": {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.2, "subsample": 1.0}}, "splits": 2})
    r2 = {r["model"]: r["value"] for r in modeling.score(oof).where("metric = 'R2' and fold = 0").collect()}
    assert set(r2) == {"ElasticNet", "Ridge", "Ensemble", "Stacking"} and r2["Stacking"] > 0.7 and min(v for m, v in r2.items() if m != "Stacking") > 0.95


def test_imputation_drops_empty_features(spark):
    df = spark.createDataFrame([(1, [1.0, None, float("inf")], 0.0), (2, [3.0, None, 5.0], 1.0), (3, [None, None, 7.0], 1.0)], "id long, features array<double>, y double")
    full, kept = screening.imputed(df)
    assert kept == [0, 2]
    assert sorted(r["features"] for r in full.collect()) == [[1.0, 6.0], [2.0, 7.0], [3.0, 5.0]]


def test_digamma_and_mutual_information():
    assert np.allclose(screening.digamma(np.array([1.0, 10.0])), [-0.5772156649, 2.2517525891])
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    e = rng.normal(size=2000)
    want = -0.5 * math.log(1 - 0.5)
    assert abs(screening.mutual_information(x, (x + e) / math.sqrt(2)) - want) < 0.08


def feature_table(spark, x, y, extra=()):
    rows = [(i, row.tolist(), float(v), *e) for i, (row, v, *e) in enumerate(zip(x, y, *extra, strict=True))]
    return spark.createDataFrame(rows, "id long, features array<double>, y double" + "".join(f", g{k} int" for k in range(len(extra))))


def test_moments_of_many_parts(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)) * 10 + 500, rng.normal(size=300)
    n, mean, cov = screening.moments(feature_table(spark, x, y).repartition(40))
    both = np.column_stack([x, y])
    assert n == 300 and np.allclose(mean, both.mean(axis=0)) and np.allclose(cov, np.cov(both.T, ddof=0))
    assert screening.moments(feature_table(spark, x, y).limit(0))[0] == 0


@pytest.mark.parametrize("gathered", [10, 10**6])
def test_exact_quantiles(spark, gathered, monkeypatch):
    """Narrowed by histograms and gathered, both equal NumPy's; groups with ties, one value, none."""
    from tidespan.functions import quantiles as qs

    monkeypatch.setattr(qs, "SORTED", 20)
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=900), 1: rng.integers(0, 3, 500).astype(float), 2: np.array([7.0]), 3: np.array([]), 4: np.full(300, 2.5), 5: rng.exponential(size=801) ** 4}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(3, None), (0, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    shares = [0.0, 0.15, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in qs.quantiles(df, ["g"], "v", shares, gathered).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for i, p in enumerate(shares):
            assert got[g][f"q{i}"] is None if not len(vs) else math.isclose(got[g][f"q{i}"], np.quantile(vs, p), rel_tol=1e-12, abs_tol=1e-12)
    whole = qs.quantiles(df, [], "v", [0.5], gathered).first()["q0"]
    assert math.isclose(whole, np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_neighbour_distances_against_brute_force():
    rng = np.random.default_rng(4)
    for n, k in ((5, 3), (40, 3), (700, 3), (700, 1)):
        for x, y in ((rng.normal(size=n), rng.normal(size=n)), (rng.normal(size=n), rng.integers(0, 3, n) + 1e-9 * rng.normal(size=n)), (np.round(rng.normal(size=n), 1), rng.normal(size=n))):
            d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
            assert np.allclose(screening.kth_radius(x, y, k), np.sort(d, axis=1)[:, k], rtol=0, atol=0)


def nipals(x, y, components):
    """Plain NIPALS on rows: coefficients by number of components, and VIP."""
    e, f = x - x.mean(axis=0), y - y.mean()
    w_, p_, q_, t_ = [], [], [], []
    for _ in range(components):
        w = e.T @ f / np.linalg.norm(e.T @ f)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        w_.append(w), p_.append(p), q_.append(q), t_.append(t @ t)
    w, p, q, tt = (np.array(v) for v in (w_, p_, q_, t_))
    coefficients = [w[:c].T @ np.linalg.solve(p[:c] @ w[:c].T, q[:c]) for c in range(1, components + 1)]
    ss = tt * q**2
    return coefficients, np.sqrt(x.shape[1] * (w.T**2 @ ss) / ss.sum())


def test_projection_importances_against_rows(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(90, 6)) * [1, 5, 2, 1, 3, 1] + 10
    y = x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=90)
    df = feature_table(spark, x, y)
    chosen, vip, best = screening.pls_vip(df, most=4, folds=3, threshold=1.0, fallback=1)
    fold = {r["id"]: r["_fold"] for r in screening.with_fold(df, 3).collect()}
    fold = np.array([fold[i] for i in range(90)])
    errors = np.zeros((3, 4))
    for f in range(3):
        tr, va = screening.scaled(x[fold != f], x[fold == f])
        b, _ = nipals(tr, y[fold != f], 4)
        errors[f] = [np.sqrt(((y[fold == f] - y[fold != f].mean() - (va - tr.mean(axis=0)) @ c) ** 2).mean()) for c in b]
    assert best == int(np.argmin(errors.mean(axis=0))) + 1
    want = nipals(screening.scaled(x)[0], y, best)[1]
    assert np.allclose(vip, want) and chosen == [i for i in np.argsort(-want) if want[i] >= 1.0]


def test_empty_fit_window_is_an_error(spark):
    df = spark.createDataFrame([(1, dt.date(2025, 1, 1), 1.0)], "entity int, date date, value double")
    with pytest.raises(ValueError, match="no rows"):
        peaks.fit_window(df, "2024-01-01", "2024-02-01")
    flagged = df.withColumn("peak_anomalous", F.lit(True))
    assert peaks.without_anomalies(flagged).count() == 0 and peaks.without_anomalies(flagged, exclude=False).count() == 1


def test_ridge_by_leave_one_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    y = 2 * x[:, 0] + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    alphas = (0.01, 1.0, 100.0)

    def fit(x, y, alpha):
        c = x - x.mean(axis=0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (y - y.mean()))
        return w, y.mean() - x.mean(axis=0) @ w

    def error(alpha):
        out = []
        for i in range(40):
            k = np.arange(40) != i
            w, b = fit(x[k], y[k], alpha)
            out.append((y[i] - x[i] @ w - b) ** 2)
        return np.mean(out)

    best = min(alphas, key=error)
    w, b = modeling.ridge_loo(df, ["a", "b"], "y", alphas)
    assert np.allclose(w, fit(x, y, best)[0]) and math.isclose(b, fit(x, y, best)[1])


def test_stack_learns_and_does_not_leak(spark):
    """On a target of pure noise nothing can be predicted: a stack that had seen test targets would look good there."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))
    bases = {"RandomForest": {"n_estimators": 10, "max_depth": 6}, "LightGBM": {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3, "subsample": 1.0}}

    def r2(y):
        df = feature_table(spark, x, y)
        got = modeling.stacked(df.where("id % 3 > 0"), df.where("id % 3 = 0"), list(range(4)), bases, splits=3)
        pred = {r["id"]: r["y_pred"] for r in got.collect()}
        assert sorted(pred) == list(range(0, 150, 3))
        t, p = y[::3], np.array([pred[i] for i in range(0, 150, 3)])
        return 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()

    assert r2(5 * x[:, 0] + rng.normal(size=150) * 0.1) > 0.6
    assert r2(rng.normal(size=150)) < 0.15


def test_repeated_search_uses_every_repeat(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = feature_table(spark, rng.normal(size=(60, 2)), rng.normal(size=60))
    fitted = []
    real = modeling.estimator
    monkeypatch.setattr(modeling, "estimator", lambda m, p, s: fitted.append(p["max_depth"]) or real(m, p, s))
    points = [{"n_estimators": 2, "max_depth": 1}, {"n_estimators": 2, "max_depth": 2}]
    got = modeling.tree_predictions(df, df, [0, 1], "RandomForest", points, splits=2, repeats=3, seed=1)
    assert got.count() == 60 and len(fitted) == 2 * 2 * 3 + 1


def test_elimination_with_cross_validation(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 8))
    df = feature_table(spark, x, 4 * x[:, 2] - 3 * x[:, 5] + 0.1 * rng.normal(size=200), [rng.integers(0, 12, 200).tolist()])
    chosen, errors = screening.rfe_cv(df, list(range(8)), "RandomForest", least=2, step=2, folds=3, trees=10, depth=5, groups="g0")
    assert set(errors) == {8, 6, 4, 2} and len(chosen) == min(errors, key=lambda n: (errors[n], n))
    assert {2, 5} <= set(chosen)
    folds = screening.with_fold(df, 3, "g0").groupBy("g0").agg(F.count_distinct("_fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in folds)


def test_boruta_tells_signal_from_noise(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(250, 6))
    df = feature_table(spark, x, 3 * x[:, 1] + 3 * x[:, 4] + 0.2 * rng.normal(size=250))
    got = screening.boruta(df, rounds=12, alpha=0.1, trees=15, depth=5)
    assert {1, 4} <= set(got["confirmed"]) and {0, 2, 3, 5} <= set(got["rejected"]) | set(got["tentative"])


def test_shadows_are_permuted_one_by_one(spark):
    x = np.tile(np.arange(400.0)[:, None], (1, 3))
    rows = screening.with_shadows(feature_table(spark, x, x[:, 0]), 1, 3).collect()
    both = np.array([r["features"] for r in rows])
    assert all(sorted(both[:, i]) == x[:, 0].tolist() for i in range(6))
    r = np.corrcoef(both.T)
    assert np.abs(r[3:, 3:][~np.eye(3, dtype=bool)]).max() < 0.25 and np.abs(r[:3, 3:]).max() < 0.25


def test_feature_grid_against_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(180, 10)) * 3 + 7
    y = x[:, 0] - 2 * x[:, 3] + x[:, 7] + rng.normal(size=180)
    df = feature_table(spark, x, y, [rng.integers(0, 20, 180).tolist()])
    best = screening.mrmr_best(df, [1, 3, 6, 10], folds=4, groups="g0", ridge=2.0)
    fold = {r["id"]: r["_fold"] for r in screening.with_fold(df, 4, "g0").collect()}
    fold = np.array([fold[i] for i in range(180)])
    for k in (1, 3, 6, 10):
        errors = []
        for f in range(4):
            tr, va = screening.scaled(x[fold != f][:, best["ranking"][:k]], x[fold == f][:, best["ranking"][:k]])
            my = y[fold != f].mean()
            w = np.linalg.solve(tr.T @ tr + 2.0 * np.eye(k), tr.T @ (y[fold != f] - my))
            errors.append(np.sqrt(((y[fold == f] - va @ w - my) ** 2).mean()))
        assert math.isclose(best["grid"][k][0], np.mean(errors), rel_tol=1e-9) and math.isclose(best["grid"][k][1], np.std(errors), rel_tol=1e-6)
    assert best["k"] == min(best["grid"], key=lambda k: best["grid"][k][0]) and best["features"] == best["ranking"][: best["k"]]
    forest = screening.mrmr_best(df, [1, 3], folds=2, model="RandomForest", trees=5, depth=4)
    assert forest["k"] == 3


def test_selection_pipeline_finds_the_signal(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 7))
    x[:, 6] = x[:, 0] * 1.001
    df = feature_table(spark, x, 3 * x[:, 0] - 2 * x[:, 2] + 0.1 * rng.normal(size=160))
    config = {
        "unsupervised": {"least_variance": 1e-6, "above": 0.9},
        "supervised": {"corr_percentile": 85, "mi_percentile": 80},
        "method": "mrmr",
        "options": {"k": 4},
        "rfe": {"models": ["RandomForest", "XGBoost"], "keep": 2, "step": 1, "folds": 2, "trees": 5, "depth": 4, "rule": "all"},
    }
    got = screening.selection_pipeline(df, config)
    assert 2 in got and {0, 6} & set(got) and not {0, 6} <= set(got)
    assert screening.selection_pipeline(df, {"method": "mrmr", "options": {"ks": [1, 2, 3]}})


def test_nested_cv_of_trees(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 3))
    df = feature_table(spark, x, 2 * x[:, 1] + 0.1 * rng.normal(size=120))
    models = {"RandomForest": [{"n_estimators": 8, "max_depth": 2}, {"n_estimators": 8, "max_depth": 6}], "ElasticNet": [{"alpha": 0.01, "l1_ratio": 0.5}]}
    oof = modeling.nested_cv(df, models, outer=3, inner=2, repeats=1).collect()
    assert {m: sorted(r["id"] for r in oof if r["model"] == m) for m in ("RandomForest", "ElasticNet", "Ensemble")} == dict.fromkeys(("RandomForest", "ElasticNet", "Ensemble"), list(range(120)))
    by = {(r["model"], r["id"]): r["y_pred"] for r in oof}
    assert all(math.isclose(by["Ensemble", i], (by["RandomForest", i] + by["ElasticNet", i]) / 2) for i in range(120))
    y = {r["id"]: r["y_true"] for r in oof}
    assert np.corrcoef([by["RandomForest", i] for i in range(120)], [y[i] for i in range(120)])[0, 1] > 0.8


def test_stratified_folds_are_balanced(spark):
    df = spark.range(1000).withColumn("y", F.rand(3))
    n = [r["count"] for r in modeling.stratified_folds(df, "y", 5).groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) - min(n) < 80


def test_candidates(spark):
    assert len(modeling.candidates("ElasticNet")) == 15
    assert len(modeling.candidates("ElasticNet", {"alpha": [1, 2]})) == 2
    with pytest.raises(ValueError):
        modeling.candidates("Prophet")


def test_county_fill(spark):
    ring = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    counties = spark.createDataFrame([("Box", "KS", ring)], "NAME string, STATE_NAME string, ring array<struct<lon: double, lat: double>>")
    f = spark.createDataFrame([(1, 1.0, 1.0, None, "NE"), (2, 9.0, 9.0, None, None), (3, 1.0, 2.0, "Own", "OK")], "id int, centroid_lon double, centroid_lat double, county string, state string")
    got = {r["id"]: (r["county"], r["state"]) for r in statics.fill_counties(f, counties).collect()}
    assert got == {1: ("Box", "NE"), 2: (None, None), 3: ("Own", "OK")}
    assert {r["id"]: r["state"] for r in statics.fill_counties(f, counties, parity=True).collect()}[1] == "KS"


def test_sweep_resumes(spark, tmp_path):
    runs = sweep.runs(spark.createDataFrame([(0, "a"), (1, "b")], "ord int, period string"))
    seen = []

    def one(row):
        seen.append((row["start_period"], row["end_period"]))
        return spark.createDataFrame([(row["n_periods"], 0.5)], "n_periods int, value double")

    path = str(tmp_path / "sweep")
    assert sweep.sweep(runs, path, one).count() == 3
    assert sweep.sweep(runs, path, one).count() == 3
    assert len(seen) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "farm_daily_meteo_1.csv").write_text("field_key,date,precip,t2m_mean\na,2025-01-01,1.5,NaN\n")
    (tmp_path / "farm_daily_meteo_2.csv").write_text("date,field_key,t2m_mean\n2025-01-02,a,3.0\n")
    got = {str(r["date"]): (r["precip"], r["t2m_mean"]) for r in tables.read_weather(spark, str(tmp_path)).collect()}
    assert got == {"2025-01-01": (1.5, None), "2025-01-02": (None, 3.0)}
    with pytest.raises(FileNotFoundError):
        tables.read_spectral(spark, str(tmp_path))
    (tmp_path / "static.csv").write_text("field_key,soil_a,protein_pct\nx,1.0,12.5\ny,2.0,\n")
    static, target = tables.read_static(spark, str(tmp_path / "static.csv"), ["soil_a", "soil_a", "absent"])
    assert static.columns == ["field_key", "soil_a"] and target.count() == 1
    (tmp_path / "terrain.csv").write_text("field_key,elev_mean,junk\nx,100.5,1\n")
    assert tables.read_terrain(spark, str(tmp_path / "terrain.csv")).columns == ["field_key", "elevation"]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.load_config(tmp_path / "c.json") == {"a": 1}
    with pytest.raises(FileNotFoundError):
        tables.load_config(tmp_path / "none.yaml")
    tables.write_csv(target, str(tmp_path / "out_csv"))
    tables.write_json(target, str(tmp_path / "out_json"))
    assert spark.read.json(str(tmp_path / "out_json")).count() == 1
    long = tables.melted(static, ["field_key"])
    assert long.columns == ["field_key", "feature", "value"]
    assert rasters.terrain_statistics(spark.createDataFrame([(1, 2.0), (1, 4.0)], "k int, e double"), "k", ["e"]).first()["e_median"] == 3.0


def test_streaming_daily_means(spark, tmp_path):
    from tidespan.streaming.daily import daily_means

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", dt.datetime(2025, 1, 1, 1), 1.0), ("a", dt.datetime(2025, 1, 1, 9), 3.0), ("a", dt.datetime(2025, 1, 9), 0.0)], "k string, ts timestamp, value double").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, value double").parquet(src)
    q = daily_means(stream, ["k"]).writeStream.format("memory").queryName("daily_means_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {str(r["date"]): r["value"] for r in spark.table("daily_means_test").collect()} == {"2025-01-01": 2.0, "2025-01-09": 0.0}
