import datetime as dt

import numpy as np
import pytest

from tidespan.operators import peaks, series


def rows(spark, values, entity="a"):
    day = dt.date(2025, 1, 1)
    return [(entity, day + dt.timedelta(i), float(v)) for i, v in values]


def test_smoothing_reproduces_quadratics():
    w = series.smoothing_weights(40, 21, 2)
    y = np.array([3 + 2 * i - 0.5 * i * i for i in range(40)])
    got = np.zeros(40)
    for i, j, v in w:
        got[i] += v * y[j]
    assert np.allclose(got, y)


def test_smoothing_too_short():
    assert series.smoothing_weights(3, 21, 2) == []


def test_gap_fill_matches_numpy(spark):
    pts = [(2, 5.0), (3, 7.0), (7, -1.0), (12, 4.0)]
    other = [(0, 1.0), (14, 2.0), (5, 3.0)]
    df = spark.createDataFrame(rows(spark, pts) + rows(spark, other, "b"), "entity string, date date, value double")
    got = series.interpolated(series.on_grid(df, "entity"), "entity").where("entity = 'a'").orderBy("i").collect()
    assert len(got) == 15
    assert np.allclose([r["value"] for r in got], np.interp(range(15), *zip(*pts, strict=True)))


def test_entities_with_few_days_drop_out(spark):
    df = spark.createDataFrame(rows(spark, [(0, 1), (1, 2)]) + rows(spark, [(0, 1), (1, 2), (4, 3)], "b"), "entity string, date date, value double")
    assert {r["entity"] for r in series.smoothing_pipeline(df, "entity").collect()} == {"b"}


def test_non_finite_values_do_not_count(spark):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), v) for v in (1.0, float("nan"), float("inf"), 3.0)], "entity string, date date, value double")
    assert series.daily_mean(df, ["entity"]).first()["value"] == 2.0


def test_changes_need_the_period_before(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 3, 9.0)], "entity string, ord int, value double")
    got = series.changes(df, ["entity"]).collect()
    assert [(r["ord"], r["change"]) for r in got] == [(1, 2.0)]


def test_seasonal_needs_three_periods(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0)], "entity string, ord int, value double")
    assert series.seasonal(df, ["entity"], 2).count() == 0
    assert series.seasonal(df, ["entity"], 3).first()["range"] == 2.0


def test_fit_recovers_seasons():
    rng = np.random.default_rng(1)
    t = np.arange(0, 250, 5.0)
    errors = []
    for _ in range(30):
        p = np.array([0.3, rng.uniform(2, 4), rng.uniform(60, 80), rng.uniform(6, 12), rng.uniform(140, 170), rng.uniform(8, 14), 0.0])
        y = peaks._curves(t[None], p[None])[0][0] + rng.normal(0, 0.05, len(t))
        x, r2 = peaks.fit_curve(t, y)
        fine = np.linspace(0, 245, 1000)
        errors.append(abs(fine[np.argmax(peaks._curves(fine[None], x[None])[0][0])] - fine[np.argmax(peaks._curves(fine[None], p[None])[0][0])]))
        assert r2 > 0.99
    assert np.percentile(errors, 95) < 6


def test_fits_are_as_good_as_many_random_starts():
    """Noisy seasons of several shapes: the fit's R2 against the best of 40 starts anywhere in the box."""
    rng = np.random.default_rng(5)
    seasons = []
    for i in range(24):
        t = np.arange(1.0, 31.0) if i % 2 else np.arange(1.0, 366.0, 5.0)
        span = t[-1] - t[0]
        p = np.array([0.3, rng.uniform(0.5, 4), t[0] + span * rng.uniform(0.1, 0.5), span * rng.uniform(0.02, 0.1), t[0] + span * rng.uniform(0.55, 0.9), span * rng.uniform(0.02, 0.1), 0.0])
        seasons.append((t, peaks._curves(t[None], p[None])[0][0] + rng.normal(0, 0.2, len(t))))
    got = peaks.fit_seasons(seasons)
    starts = peaks._starts
    best = np.full(len(seasons), -np.inf)
    try:
        for _ in range(40):
            peaks._starts = lambda t, y, here, lo, hi: rng.uniform(lo, hi)
            best = np.maximum(best, [g[1] for g in peaks.fit_seasons(seasons)])
    finally:
        peaks._starts = starts
    short = [b - g[1] for g, b in zip(got, best, strict=True)]
    assert np.median(short) < 1e-3 and np.mean(np.array(short) < 0.02) > 0.85


def test_detected_peaks_agree_with_their_curves(spark):
    """Whole driver: the peak is the fitted curve's first maximum over 1000 points; entities without a curve fall back."""
    rng = np.random.default_rng(8)
    rows = []
    for e in range(12):
        for i in range(0, 120, 1 + e % 3):
            value = 1.0 if e == 11 else 0.3 + 3 / (1 + np.exp((40 - i) / 6)) - 3 / (1 + np.exp((80 - i) / 7)) + float(rng.normal(0, 0.05))
            rows.append((e, dt.date(2025, 1, 1) + dt.timedelta(i), float(value)))
    found, params = peaks.detect_peaks(spark.createDataFrame(rows, "entity int, date date, value double"), "entity", "2025-01-01", "2025-04-30", months=(1, 5), resample_days=1)
    got, fits = {r["entity"]: r for r in found.collect()}, {r["entity"]: r for r in params.collect()}
    assert set(got) == set(range(12)) == set(fits)
    assert got[11]["fit_method"] == "fallback" and got[11]["fit_r2"] is None and fits[11]["m1"] is None
    for e in range(11):
        m = np.array([fits[e][f"m{i}"] for i in range(1, 8)])
        t = np.linspace(1, 120, 1000)
        curve = peaks._curves(t[None], m[None])[0][0]
        r = got[e]
        assert r["fit_method"] == "double_logistic" and r["fit_r2"] > 0.98 and r["amplitude"] == m[1]
        assert abs(r["peak_doy"] - t[np.argmax(curve)]) < 1.5 and abs(r["peak_gcvi"] - curve.max()) < 1e-3 and 50 < r["peak_doy"] < 72
        assert r["peak_date"] == dt.date(2025, 1, 1) + dt.timedelta(int(np.floor(r["peak_doy"])) - 1)


def test_curve_bundle_has_raw_smoothed_and_fitted_points(spark):
    rows = [("a", dt.date(2025, 1, 1) + dt.timedelta(i), float(1 + 2 * np.exp(-(((i - 30) / 10) ** 2)))) for i in range(60)]
    got = peaks.curve_bundle(spark.createDataFrame(rows, "entity string, date date, value double"), "entity", "a", "2025-01-01", "2025-03-01", points=50).collect()
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("raw", "smoothed", "fitted")}
    assert len(kinds["raw"]) == 60 and len(kinds["fitted"]) == 50 and kinds["smoothed"]
    assert min(r["t"] for r in kinds["fitted"]) == min(r["t"] for r in kinds["smoothed"])
    assert abs(max(r["value"] for r in kinds["fitted"]) - 3.0) < 0.2


def test_jacobian():
    t, p = np.linspace(1, 200, 20), np.array([0.3, 3.0, 70, 9, 150, 11, 0.003])
    value, jac = (a[0] for a in peaks._curves(t[None], p[None]))
    for k in range(7):
        q = p.copy()
        q[k] += 1e-6
        assert np.allclose((peaks._curves(t[None], q[None])[0][0] - value) / 1e-6, jac[:, k], atol=1e-4)


def test_flat_or_short_series_have_no_curve():
    t = np.arange(20.0)
    assert peaks.fit_curve(t, np.ones(20)) is None
    assert peaks.fit_curve(t[:7], t[:7]) is None


@pytest.mark.parametrize(("values", "doy", "top"), [([1, 5, 2], 1.0, 5.0), ([1, 2], 0.5, 2.0), ([0, 9, 9, 9, 9, 9, 0], 3.0, 9.0)])
def test_fallback_peak(spark, values, doy, top):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "entity string, t int, value double")
    r = peaks.fallback_peak(df, "entity").first()
    assert (r["peak_doy"], r["peak_gcvi"]) == (doy, top)


def test_quality_flags(spark):
    d = dt.date
    df = spark.createDataFrame([(1, None, 1.0, 1.0, 0.9), (2, d(2025, 4, 3), 1.0, 1.0, 0.2), (3, d(2025, 7, 1), 0.1, 1.0, None)], "id int, peak_date date, peak_gcvi double, amplitude double, fit_r2 double")
    got = {r["id"]: r["anomaly_reasons"] for r in peaks.quality_flags(df, min_peak=0.5, min_fit_r2=0.5).collect()}
    assert got == {1: ["no_peak_date"], 2: ["poor_fit"], 3: ["peak_outside_season", "low_peak_gcvi"]}
    off = peaks.quality_flags(df, (1, 12), min_fit_r2=0).where("peak_anomalous").collect()
    assert [r["id"] for r in off] == [1]
