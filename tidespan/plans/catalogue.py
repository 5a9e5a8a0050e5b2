"""The registered queries of the time-series engine, each with DuckDB SQL that computes the same rows.

The benchmark tables stand in for the domain: events are daily channels of entities (channel = event_type), orders
carry anchor dates, lineitem dated measures, part soil texture, embeddings a feature matrix with a target.  Doubles
are rounded on both sides by the same arithmetic after adding a ten-thousandth of the last digit, because means of
two-decimal numbers often lie on a rounding tie; `+ 0.0` turns a negative zero into zero.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agronomy as ag
from ..functions.scalars import corr0, finite_columns, safe_div
from ..operators import features as ft
from ..operators import metrics as me
from ..operators import modeling as mo
from ..operators import peaks as pk
from ..operators import periods as pe
from ..operators import screening as sc
from ..operators import series as se
from ..operators import statics as st
from ..operators import sweep as sw
from ..sources import rasters, tables
from ..sources.session import importable, shared_dir
from ..streaming import daily as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    importable(spark)
    return finite_columns(spark.read.parquet(f"{d}/{name}.parquet"))


def r(c: Column | str, n: int = 4) -> Column:
    scale = float(10**n)
    return F.floor(((F.col(c) if isinstance(c, str) else c) + float(f"1e-{n + 4}")) * scale + 0.5) / scale


def rounded(df: DataFrame, *cols: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in cols})


def rs(x: str, name: str | None = None, n: int = 4) -> str:
    return f"floor((CAST({x} AS DOUBLE) + 1e-{n + 4}) * 1e{n} + 0.5) / 1e{n} + 0.0 AS {name or x}"


# ------------------------------------------------------------------ daily series
def events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), F.col("event_type").alias("feature"), "value")


_EVENTS = "events_d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_type AS feature, value FROM events)"
_DAILY = f"{_EVENTS}, daily AS (SELECT entity, date, avg(value) AS value FROM events_d GROUP BY ALL)"
_GRID = f"""{_DAILY}, enough AS (SELECT entity FROM daily GROUP BY entity HAVING count(*) >= 3),
    series AS (SELECT d.* FROM daily d JOIN enough USING (entity)),
    ends AS (SELECT min(date) AS lo, max(date) AS hi FROM series),
    days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, lo FROM ends),
    grid AS (SELECT e.entity, days.date, CAST(date_diff('day', days.lo, days.date) AS INTEGER) AS i, s.value
             FROM (SELECT DISTINCT entity FROM series) e CROSS JOIN days LEFT JOIN series s ON s.entity = e.entity AND s.date = days.date),
    marks AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS spot FROM grid),
    near AS (SELECT entity, date, i,
        last_value(value IGNORE NULLS) OVER b AS v0, last_value(spot IGNORE NULLS) OVER b AS i0,
        first_value(value IGNORE NULLS) OVER f AS v1, first_value(spot IGNORE NULLS) OVER f AS i1
      FROM marks WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT entity, date, i, CASE WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL OR i0 = i1 THEN v0
                      ELSE v0 + (v1 - v0) * ((i - i0) / CAST(i1 - i0 AS DOUBLE)) END AS value FROM near)"""


@query(f"WITH {_DAILY} SELECT entity, date, {rs('value')} FROM daily")
def daily_mean(spark, d):
    return rounded(se.daily_mean(events(spark, d), ["entity"]), "value")


@query(f"WITH {_EVENTS} SELECT feature, date, {rs('avg(value)', 'value')} FROM events_d GROUP BY feature, date")
def stream_daily_mean(spark, d):
    df = t(spark, d, "events").select(F.col("event_type").alias("feature"), "ts", "value")
    return rounded(stream.daily_means(df, ["feature"]), "value")


def _filled(spark, d):
    series = se.enough_days(se.daily_mean(events(spark, d), ["entity"]), "entity")
    return se.interpolated(se.on_grid(series, "entity"), "entity")


@query(f"WITH {_GRID} SELECT entity, date, i, {rs('value')} FROM filled")
def grid_gapfill(spark, d):
    return rounded(_filled(spark, d), "value")


@query(
    f"""WITH {_GRID}, g5 AS (SELECT entity, date, i, value FROM grid WHERE i % 5 = 0)
    SELECT entity, date, CAST(i AS INTEGER) AS i, {rs("value")} FROM g5"""
)
def grid_every_fifth(spark, d):
    """Exact reindexing on a coarse grid: observations between its points are lost."""
    series = se.enough_days(se.daily_mean(events(spark, d), ["entity"]), "entity")
    return rounded(se.on_grid(series, "entity", every=5), "value")


#: Length of the events' daily grid, and smoothing settings.
GRID_DAYS, SG_WINDOW, SG_ORDER = 30, 21, 2
_WEIGHTS = ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in se.smoothing_weights(GRID_DAYS, SG_WINDOW, SG_ORDER))
_SMOOTH = f"""{_GRID}, weights(i, j, w) AS (VALUES {_WEIGHTS}),
    smooth AS (SELECT f.entity, w.i, sum(w.w * f.value) AS value FROM filled f JOIN weights w ON w.j = f.i GROUP BY f.entity, w.i)"""


@query(f"WITH {_SMOOTH} SELECT entity, CAST(i AS INTEGER) AS i, {rs('value')} FROM smooth")
def sg_smooth(spark, d):
    return rounded(se.smoothed(_filled(spark, d), "entity", GRID_DAYS, SG_WINDOW, SG_ORDER).select("entity", "i", "value"), "value")


@query(f"WITH {_SMOOTH} SELECT entity, CAST(i AS INTEGER) AS i, {rs('value')} FROM smooth WHERE i % 5 = 0")
def smoothing_pipeline(spark, d):
    return rounded(se.smoothing_pipeline(events(spark, d), "entity", resample_days=5, window=7, order=2).select("entity", "i", "value"), "value")


_COARSE_WEIGHTS = ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in se.smoothing_weights(GRID_DAYS // 3, 7, SG_ORDER))


@query(
    f"""WITH {_DAILY}, enough AS (SELECT entity FROM daily GROUP BY entity HAVING count(*) >= 3), series AS (SELECT d.* FROM daily d JOIN enough USING (entity)),
    ends AS (SELECT min(date) AS lo, max(date) AS hi FROM series), days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS DATE) AS date, lo FROM ends),
    grid AS (SELECT e.entity, CAST(date_diff('day', days.lo, days.date) AS INTEGER) AS i, s.value FROM (SELECT DISTINCT entity FROM series) e CROSS JOIN days LEFT JOIN series s ON s.entity = e.entity AND s.date = days.date),
    near AS (SELECT g.entity, g.i, (SELECT max(h.i) FROM grid h WHERE h.entity = g.entity AND h.i <= g.i AND h.value IS NOT NULL) AS i0, (SELECT min(h.i) FROM grid h WHERE h.entity = g.entity AND h.i >= g.i AND h.value IS NOT NULL) AS i1 FROM grid g),
    filled AS (SELECT n.entity, n.i, CASE WHEN i0 IS NULL THEN b.value WHEN i1 IS NULL OR i0 = i1 THEN a.value ELSE a.value + (b.value - a.value) * ((n.i - i0) / CAST(i1 - i0 AS DOUBLE)) END AS value
      FROM near n LEFT JOIN grid a ON a.entity = n.entity AND a.i = i0 LEFT JOIN grid b ON b.entity = n.entity AND b.i = i1),
    weights(k, j, w) AS (VALUES {_COARSE_WEIGHTS})
    SELECT f.entity, CAST(3 * k AS INTEGER) AS i, {rs("sum(w * f.value)", "value")} FROM filled f JOIN weights ON f.i = 3 * j GROUP BY f.entity, k"""
)
def smoothing_coarse(spark, d):
    """The path without a daily grid: every third day, filled and smoothed on that grid."""
    return rounded(se.smoothing_pipeline(events(spark, d), "entity", resample_days=3, window=7, order=SG_ORDER, daily=False).select("entity", "i", "value"), "value")


_ROLL = f"{_GRID}, roll AS (SELECT entity, i, value, sum(value) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS k FROM filled)"


@query(f"WITH {_ROLL} SELECT entity, i, {rs('k', 'value')} FROM roll")
def rolling5_zero_pad(spark, d):
    df = _filled(spark, d)
    return rounded(df.select("entity", "i", se.rolling_zero_padded(df, "entity").alias("value")), "value")


@query(
    f"""WITH {_ROLL}, top AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k DESC, i) AS n FROM roll)
    SELECT entity, CAST(i AS DOUBLE) AS peak_doy, {rs("value", "peak_gcvi")} FROM top WHERE n = 1"""
)
def fallback_peak(spark, d):
    return rounded(pk.fallback_peak(_filled(spark, d), "entity", "i"), "peak_gcvi")


# ------------------------------------------------------------------ curves and peaks
_M = (0.4, 3.2, 70.0, 9.0, 150.0, 12.0, 0.004)


def _curve_sql(x: str, m=_M) -> str:
    a, b, c, e, f, g, h = m
    return f"({a} + ({b} - {h} * {x}) * (1.0 / (1.0 + exp(({c} - {x}) / ({e} + 1e-8))) - 1.0 / (1.0 + exp(({f} - {x}) / ({g} + 1e-8)))))"


@query(f"SELECT CAST(i AS INTEGER) AS day, {rs(_curve_sql('CAST(i AS DOUBLE)'), 'value')} FROM range(0, 365) x(i)")
def double_logistic_eval(spark, d):
    day = F.col("day").cast("double")
    return spark.range(365).select(F.col("id").cast("int").alias("day")).withColumn("value", r(ag.double_logistic(day, [F.lit(x) for x in _M])))


_PART_M = "SELECT p_partkey, CAST(0.3 AS DOUBLE) AS m1, 1.0 + p_size / 25.0 AS m2, 60.0 + p_size AS m3, 8.0::DOUBLE AS m4, 150.0 + p_size / 2.0 AS m5, 11.0::DOUBLE AS m6, 0.002::DOUBLE AS m7 FROM part"


def _part_params(spark, d):
    s = F.col("p_size").cast("double")
    return t(spark, d, "part").select(
        "p_partkey", F.lit(0.3).alias("m1"), (s / 25 + 1.0).alias("m2"), (s + 60.0).alias("m3"), F.lit(8.0).alias("m4"), (s / 2 + 150.0).alias("m5"), F.lit(11.0).alias("m6"), F.lit(0.002).alias("m7")
    )


@query(
    f"""WITH p AS ({_PART_M}), x AS (SELECT i, 20.0 + 240.0 * i / 999.0 AS x FROM range(0, 1000) g(i)),
    v AS (SELECT p_partkey, i, x, m1 + (m2 - m7 * x) * (1.0 / (1.0 + exp((m3 - x) / (m4 + 1e-8))) - 1.0 / (1.0 + exp((m5 - x) / (m6 + 1e-8)))) AS y FROM p, x)
    SELECT p_partkey, {rs("max(y)", "peak_gcvi", 6)} FROM v GROUP BY p_partkey"""
)
def peak_argmax_grid(spark, d):
    """The greatest curve value over 1000 points (the place itself can differ where neighbours agree to rounding)."""
    got = pk.curve_peak(_part_params(spark, d), "p_partkey", F.lit(20.0), F.lit(260.0))
    return got.select("p_partkey", r("peak_gcvi", 6).alias("peak_gcvi"))


@query(
    f"""WITH p AS ({_PART_M}) SELECT p_partkey, {rs("m1", "pheno_baseline")}, {rs("m2", "pheno_amplitude")}, {rs("m4", "pheno_greenup_steepness")}, {rs("m6", "pheno_senescence_steepness")},
    {rs("m3", "pheno_greenup_inflection")}, {rs("m5", "pheno_senescence_inflection")}, {rs("m5 - m3", "pheno_season_length")}, {rs("m7", "pheno_trend")},
    {rs("m4 / (m6 + 1e-6)", "pheno_greenup_senescence_ratio")} FROM p"""
)
def pheno_features(spark, d):
    df = ft.phenology(_part_params(spark, d), "p_partkey")
    return rounded(df, *[c for c in df.columns if c != "p_partkey"])


@query()
def double_logistic_fit(spark, d):
    smooth = se.smoothing_pipeline(events(spark, d), "entity", resample_days=1)
    return pk.fit_curves(smooth, "entity")


@query()
def detect_peaks(spark, d):
    return pk.detect_peaks(events(spark, d), "entity", "2024-01-01", "2024-01-30", resample_days=1, months=(1, 1))[0]


@query()
def curve_bundle(spark, d):
    return pk.curve_bundle(events(spark, d), "entity", 1, "2024-01-01", "2024-01-30")


#: Peak rows for the quality checks: day of the year from the order date, value and fit from price and key.
_PEAKS = """peaks AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS peak_date,
    CAST(dayofyear(o_orderdate) AS DOUBLE) AS peak_doy, o_totalprice / 100000.0 AS peak_gcvi, (o_orderkey % 37) / 10.0 AS amplitude,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0 END AS fit_r2, CASE WHEN o_orderkey % 7 = 0 THEN 'fallback' ELSE 'double_logistic' END AS fit_method FROM orders),
  flags AS (SELECT *, CAST(month(peak_date) AS INTEGER) AS peak_month, list_filter([
      CASE WHEN peak_date IS NULL THEN 'no_peak_date' WHEN month(peak_date) NOT BETWEEN 4 AND 5 THEN 'peak_outside_season' END,
      CASE WHEN peak_gcvi < 1.0 THEN 'low_peak_gcvi' END, CASE WHEN amplitude < 0.5 THEN 'low_amplitude' END, CASE WHEN fit_r2 < 0.5 THEN 'poor_fit' END], lambda x: x IS NOT NULL) AS reasons FROM peaks)"""


def _peaks(spark, d):
    k = F.col("o_orderkey")
    df = t(spark, d, "orders").select(
        k.alias("id"),
        F.when(k % 50 != 0, F.to_date("o_orderdate")).alias("peak_date"),
        F.dayofyear("o_orderdate").cast("double").alias("peak_doy"),
        (F.col("o_totalprice") / 100000.0).alias("peak_gcvi"),
        ((k % 37) / 10.0).alias("amplitude"),
        F.when(k % 7 != 0, (k % 100) / 100.0).alias("fit_r2"),
        F.when(k % 7 != 0, "double_logistic").otherwise("fallback").alias("fit_method"),
    )
    return pk.quality_flags(df, (4, 5), min_peak=1.0, min_amplitude=0.5, min_fit_r2=0.5)


@query(f"WITH {_PEAKS} SELECT id, peak_month, len(reasons) > 0 AS peak_anomalous, array_to_string(reasons, ';') AS anomaly_reason FROM flags")
def peak_qc_flags(spark, d):
    return _peaks(spark, d).select("id", "peak_month", "peak_anomalous", F.array_join("anomaly_reasons", ";").alias("anomaly_reason"))


@query(f"WITH {_PEAKS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM flags) GROUP BY reason")
def reason_breakdown(spark, d):
    return pk.reason_breakdown(_peaks(spark, d))


def _counts_sql(key: str, source: str, name: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {key} AS k, count(*) AS n FROM {source} GROUP BY 1) WHERE k IS NOT NULL) AS {name}"


@query(
    f"""WITH {_PEAKS} SELECT count(*) AS n_total, CAST(sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_anomalous,
    {rs("100.0 * sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) / count(*)", "pct_anomalous", 2)}, 'Month 4 to 5' AS valid_peak_range,
    CAST(1.0 AS DOUBLE) AS min_peak_gcvi, CAST(0.5 AS DOUBLE) AS min_amplitude, CAST(0.5 AS DOUBLE) AS min_fit_r2,
    {_counts_sql("unnest(reasons)", "flags", "anomaly_reasons")}, {_counts_sql("peak_month", "flags", "peak_months")}, {_counts_sql("fit_method", "flags", "fit_methods")},
    {", ".join(rs(f"{f}(peak_doy)", f"doy_{n}") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))},
    {", ".join(rs(f"{f}(fit_r2)", f"r2_{n}") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))} FROM flags"""
)
def qc_report(spark, d):
    df = pk.quality_report(_peaks(spark, d), (4, 5), min_peak=1.0, min_amplitude=0.5, min_fit_r2=0.5)
    listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    df = df.withColumns({c: listed(c) for c in ("anomaly_reasons", "peak_months", "fit_methods")})
    return rounded(rounded(df, *[c for c in df.columns if c[:3] in ("doy", "r2_")]), "pct_anomalous", n=2)


@query(f"WITH {_PEAKS} SELECT peak_month, count(*) AS n FROM flags GROUP BY peak_month")
def month_distribution(spark, d):
    return _peaks(spark, d).groupBy("peak_month").agg(F.count("*").alias("n"))


@query(f"WITH {_PEAKS} SELECT CASE WHEN len(reasons) > 0 THEN 'anomalous' ELSE 'normal' END AS status, count(*) AS n FROM flags GROUP BY 1")
def peak_status(spark, d):
    return _peaks(spark, d).groupBy(F.when(F.col("peak_anomalous"), "anomalous").otherwise("normal").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_PEAKS} SELECT id, {rs('peak_gcvi')} FROM flags WHERE len(reasons) = 0")
def exclude_anomalous(spark, d):
    return rounded(pk.without_anomalies(_peaks(spark, d)).select("id", "peak_gcvi"), "peak_gcvi")


@query(f"WITH {_PEAKS} SELECT id, peak_doy, {rs('peak_gcvi')}, {rs('fit_r2')}, CASE WHEN len(reasons) > 0 THEN 'anomalous' ELSE 'normal' END AS status, array_to_string(reasons, ';') AS reason FROM flags")
def peak_scatter(spark, d):
    return rounded(pk.plot_points(_peaks(spark, d), "id"), "peak_gcvi", "fit_r2")


@query("SELECT user_id AS entity, count(*) AS n FROM events GROUP BY user_id")
def rows_per_entity(spark, d):
    return events(spark, d).groupBy("entity").agg(F.count("*").alias("n"))


@query(f"SELECT s_nationkey, {rs('avg(s_acctbal)', 'elevation')} FROM supplier GROUP BY s_nationkey")
def sample_terrain(spark, d):
    """The mean over a field's samples, the field's elevation."""
    got = rasters.terrain_statistics(t(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("elev")), "s_nationkey", ["elev"])
    return rounded(got.select("s_nationkey", F.col("elev_mean").alias("elevation")), "elevation")


@query(f"WITH {_PEAKS} SELECT CAST(least(floor((peak_doy - 1.0) / ((366.0 - 1.0) / 30)) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM flags WHERE peak_doy BETWEEN 1 AND 366 GROUP BY 1")
def peak_histogram(spark, d):
    return me.histogram(_peaks(spark, d), "peak_doy", 1.0, 366.0, 30)


@query("SELECT o_orderkey AS id, make_date(2025, 1, 1) + CAST(floor(1.0 + o_totalprice / 2000.0) AS INTEGER) - 1 AS peak_date FROM orders")
def doy_to_date(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pk.peak_date(F.col("o_totalprice") / 2000.0 + 1.0, 2025).alias("peak_date"))


# ------------------------------------------------------------------ alignment and periods
_REL = """rel AS (SELECT o.o_orderpriority AS entity, l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice AS value, CAST(l.l_shipdate AS DATE) AS date,
    CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS normalized_day
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def _relative(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("date"))
    anchors = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("peak_date"), F.col("o_orderpriority").alias("entity"))
    return pe.relative_days(lines, anchors, "l_orderkey", "date", "peak_date", carry=("entity",))


def _values(rows: list[tuple], date: bool = False) -> str:
    q = lambda v: f"DATE '{v}'" if date else str(v)
    return ", ".join(f"({i}, '{p}', {q(a)}, {q(b)})" for i, (p, a, b) in enumerate(rows))


@query(f"WITH {_REL} SELECT normalized_day, count(*) AS n FROM rel GROUP BY normalized_day")
def relative_day(spark, d):
    return _relative(spark, d).groupBy("normalized_day").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def fit_window_filter(spark, d):
    return pk.fit_window(events(spark, d), "2024-01-05", "2024-01-20").groupBy("date").agg(F.count("*").alias("n"))


def _register_windows() -> None:
    for mode in (*pe.RELATIVE_MODES, *pe.DATE_MODES):
        QUERIES[f"windows_{mode}"] = lambda spark, d, m=mode: pe.windows(spark, m)


_register_windows()
# the generated tables again from their rules, in SQL
ORACLES["windows_biweekly"] = """SELECT CAST(i AS INTEGER) AS ord, CASE WHEN i < 18 THEN 'bw_m' || (18 - i) WHEN i = 18 THEN 'bw_peak' ELSE 'bw_p' || (i - 18) END AS period,
    CAST(-7 + (i - 18) * 15 AS INTEGER) AS lo, CAST(7 + (i - 18) * 15 AS INTEGER) AS hi FROM range(0, 24) x(i)"""
ORACLES["windows_monthly"] = """SELECT CAST(i AS INTEGER) AS ord, CASE WHEN i < 9 THEN 'mo_m' || (9 - i) WHEN i = 9 THEN 'mo_peak' ELSE 'mo_p' || (i - 9) END AS period,
    CAST(CASE WHEN i < 9 THEN -15 - (9 - i) * 30 WHEN i = 9 THEN -15 ELSE 16 + (i - 10) * 30 END AS INTEGER) AS lo,
    CAST(CASE WHEN i < 9 THEN -16 - (8 - i) * 30 WHEN i = 9 THEN 15 ELSE 15 + (i - 9) * 30 END AS INTEGER) AS hi FROM range(0, 13) x(i)"""
_MONTHS_SQL = "SELECT i, DATE '2024-07-01' + to_months(CAST(i AS INTEGER)) AS lo FROM range(0, 12) x(i)"
ORACLES["windows_calendar_monthly"] = f"SELECT CAST(i AS INTEGER) AS ord, lower(strftime(lo, '%b')) AS period, CAST(lo AS DATE) AS lo, CAST(last_day(lo) AS DATE) AS hi FROM ({_MONTHS_SQL})"
ORACLES["windows_calendar_biweekly"] = f"""SELECT CAST(2 * i + h AS INTEGER) AS ord, lower(strftime(lo, '%b')) || '_' || (h + 1) AS period,
    CAST(lo + INTERVAL (15 * h) DAY AS DATE) AS lo, CAST(CASE WHEN h = 0 THEN lo + INTERVAL 14 DAY ELSE last_day(lo) END AS DATE) AS hi FROM ({_MONTHS_SQL}), range(0, 2) y(h)"""
# the stages are settings: plain values here, written out apart from the library's own table
ORACLES["windows_phenological"] = """SELECT * FROM (VALUES (0, 'tillering', -120, -75), (1, 'stem_elongation', -75, -40), (2, 'booting', -40, -15), (3, 'heading_anthesis', -15, 10),
    (4, 'grain_filling', 10, 40), (5, 'maturity', 40, 70)) v(ord, period, lo, hi)"""
ORACLES["windows_peak_stages"] = "SELECT * FROM (VALUES (0, 'cp1', -300, -121), (1, 'cp2', -120, -60), (2, 'cp3', -59, -14), (3, 'cp4', -15, 15), (4, 'cp5', 16, 36)) v(ord, period, lo, hi)"
ORACLES["windows_custom"] = """SELECT ord, period, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM (VALUES (0, 'cp1', '2024-07-01', '2024-12-31'), (1, 'cp2', '2025-01-01', '2025-02-28'),
    (2, 'cp3', '2025-03-01', '2025-04-15'), (3, 'cp4', '2025-04-16', '2025-05-15'), (4, 'cp5', '2025-05-16', '2025-06-30')) v(ord, period, lo, hi)"""

_PHENO_W = f"w(ord, period, lo, hi) AS (VALUES {_values(pe.window_rows('phenological'))})"
_STAT_SQL = {
    "mean": "avg(value)",
    "sum": "sum(value)",
    "min": "min(value)",
    "max": "max(value)",
    "std": "CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END",
    "p10": "quantile_cont(value, 0.1)",
    "p90": "quantile_cont(value, 0.9)",
    "range": "max(value) - min(value)",
    "cv": "CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END / (abs(avg(value)) + 1e-6)",
    "slope": "CASE WHEN count(value) = 1 THEN 0.0 ELSE regr_slope(value, pos) END",
}


def _period_sql(stats: list[str], w: str, axis: str = "normalized_day", n: int = 4) -> str:
    cols = ", ".join(rs(_STAT_SQL[s], s, n) for s in stats)
    return f"""WITH {_REL}, {w}, hit AS (SELECT rel.*, w.ord, w.period, CAST(row_number() OVER (PARTITION BY entity, ord ORDER BY {axis}, l_orderkey, l_linenumber) AS DOUBLE) AS pos
        FROM rel JOIN w ON rel.{axis} BETWEEN w.lo AND w.hi)
      SELECT entity, ord, period, {cols} FROM hit GROUP BY entity, ord, period"""


def _period_agg(spark, d, stats, control, axis="normalized_day"):
    df = pe.aggregate(_relative(spark, d), control, axis, ["entity"], stats, order=[axis, "l_orderkey", "l_linenumber"])
    return rounded(df.select("entity", "ord", "period", *stats), *stats)


@query(_period_sql(["mean", "std", "p10", "p90"], _PHENO_W))
def period_agg_vi(spark, d):
    return _period_agg(spark, d, ["mean", "std", "p10", "p90"], pe.windows(spark, "phenological"))


@query(_period_sql(["sum", "min", "max"], _PHENO_W, n=2))
def period_agg_sum(spark, d):
    return rounded(_period_agg(spark, d, ["sum", "min", "max"], pe.windows(spark, "phenological")), "sum", "min", "max", n=2)


@query(_period_sql(["range", "cv", "slope"], _PHENO_W))
def period_agg_range_cv_slope(spark, d):
    return _period_agg(spark, d, ["range", "cv", "slope"], pe.windows(spark, "phenological"))


@query(_period_sql(["mean", "sum"], f"w(ord, period, lo, hi) AS (VALUES {_values(pe.window_rows('peak_stages'))})", n=2))
def period_agg_overlap(spark, d):
    return rounded(_period_agg(spark, d, ["mean", "sum"], pe.windows(spark, "peak_stages")), "mean", "sum", n=2)


_HALF_1998 = [(p, lo.replace(year=1998 + (lo.year - 2024)), hi.replace(year=1998 + (hi.year - 2024))) for p, lo, hi in pe.half_months()]


@query(_period_sql(["mean", "p90"], f"w(ord, period, lo, hi) AS (VALUES {_values(_HALF_1998, True)})", "date"))
def period_agg_calendar(spark, d):
    return _period_agg(spark, d, ["mean", "p90"], pe.window_table(spark, _HALF_1998, "date"), "date")


_WEEKS = [("w1", "2024-01-01", "2024-01-07"), ("w2", "2024-01-08", "2024-01-14"), ("w3", "2024-01-15", "2024-01-21"), ("w4", "2024-01-22", "2024-01-30")]
_WEEK_W = f"w(ord, period, lo, hi) AS (VALUES {_values(_WEEKS, True)})"
_PERIODS = f"""{_EVENTS}, {_WEEK_W}, wide AS (SELECT entity, feature, ord, period, avg(value) AS mean, sum(value) AS sum FROM events_d JOIN w ON date BETWEEN lo AND hi GROUP BY ALL),
    long AS (SELECT entity, feature, ord, period, 'mean' AS stat, mean AS value FROM wide UNION ALL SELECT entity, feature, ord, period, 'sum', sum FROM wide)"""


def weeks(spark):
    return pe.window_table(spark, pe.parsed({p: (a, b) for p, a, b in _WEEKS}), "date")


def long_periods(spark, d, names: dict[str, str] | None = None):
    df = events(spark, d)
    if names:
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        df = df.withColumn("feature", m[F.col("feature")])
    wide = pe.aggregate(df, weeks(spark), "date", ["entity", "feature"], ["mean", "sum"])
    return pe.long_statistics(wide, ["entity", "feature", "ord", "period"], ["mean", "sum"])


@query(f"WITH {_PERIODS} SELECT entity, feature, ord, period, stat, {rs('value')} FROM long")
def period_long(spark, d):
    return rounded(long_periods(spark, d), "value")


@query(
    f"""WITH {_EVENTS}, {_WEEK_W}, f AS (SELECT DISTINCT entity, feature FROM events_d), c AS (SELECT entity, feature, ord, period, lo, hi FROM f, w)
    SELECT c.entity, c.feature, c.ord, c.period, {rs("avg(e.value)", "mean")} FROM c LEFT JOIN events_d e ON e.entity = c.entity AND e.feature = c.feature AND e.date BETWEEN c.lo AND c.hi
    GROUP BY c.entity, c.feature, c.ord, c.period"""
)
def period_cells(spark, d):
    """Empty cells stay as rows without a value."""
    df = pe.aggregate(events(spark, d), weeks(spark), "date", ["entity", "feature"], ["mean"], cells=True)
    return rounded(df.select("entity", "feature", "ord", "period", "mean"), "mean")


_CHANNELS = {"view": "NDVI", "error": "B8", "purchase": "precip", "signup": "pet", "click": "t2m_max"}
_NAMED = f"""{_PERIODS}, names(feature, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _CHANNELS.items())}),
    named AS (SELECT entity, ord, period, name AS feature, stat, value FROM long JOIN names USING (feature))"""


@query(
    f"""WITH {_EVENTS}, {_WEEK_W}, names(feature, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _CHANNELS.items())}),
    a AS (SELECT entity, name AS feature, ord, period, avg(value) AS mean, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(value) END AS std,
      quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, sum(value) AS sum FROM events_d JOIN names USING (feature) JOIN w ON date BETWEEN lo AND hi GROUP BY ALL),
    u AS (SELECT entity, feature, ord, period, unnest(['mean', 'std', 'p10', 'p90', 'sum']) AS stat, unnest([mean, std, p10, p90, sum]) AS value FROM a)
    SELECT entity, feature, ord, period, stat, {rs("value")} FROM u
    WHERE (feature = 'NDVI' AND stat <> 'sum') OR (feature IN ('B8', 't2m_max') AND stat = 'mean') OR (feature IN ('precip', 'pet') AND stat = 'sum')"""
)
def routed_statistics(spark, d):
    m = F.create_map(*[F.lit(x) for kv in _CHANNELS.items() for x in kv])
    df = pe.routed(events(spark, d).withColumn("feature", m[F.col("feature")]), weeks(spark), "date", ["entity"], list(_CHANNELS.values()))
    return rounded(df.select("entity", "feature", "ord", "period", "stat", "value"), "value")


_WIDE = [(p, f, s) for p, _, _ in _WEEKS for f in ("view", "error", "click") for s in ("mean", "sum")]


@query(
    f"""WITH {_PERIODS} SELECT entity, {", ".join(rs(f"max(CASE WHEN period = '{p}' AND feature = '{f}' AND stat = '{s}' THEN value END)", f"{p}_{f}_{s}") for p, f, s in _WIDE)}
    FROM long GROUP BY entity"""
)
def period_pivot_wide(spark, d):
    df = pe.pivot_wide(long_periods(spark, d), "entity", _WIDE)
    return rounded(df, *["_".join(c) for c in _WIDE])


# ------------------------------------------------------------------ scalar formulas
_WEATHER = """weather AS (SELECT event_id, value / 10.0 AS t2m_mean, value / 10.0 + 5.0 AS t2m_max, value / 10.0 - 6.0 AS t2m_min, value / 12.0 AS dewpoint,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 50.0 END AS precip, value / 40.0 AS pet FROM events)"""


def _weather(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select(
        "event_id",
        (v / 10.0).alias("t2m_mean"),
        (v / 10.0 + 5.0).alias("t2m_max"),
        (v / 10.0 - 6.0).alias("t2m_min"),
        (v / 12.0).alias("dewpoint"),
        F.when(F.col("event_id") % 11 != 0, v / 50.0).alias("precip"),
        (v / 40.0).alias("pet"),
    )


def _es(x: str) -> str:
    return f"0.6108 * exp(17.27 * {x} / ({x} + 237.3))"


@query(
    f"""WITH {_WEATHER} SELECT event_id, {rs(f"greatest({_es('t2m_mean')} - {_es('dewpoint')}, 0.0)", "vpd", 6)}, {rs("greatest((t2m_max + t2m_min) / 2 - 4.0, 0.0)", "gdd", 6)},
    {rs("pet - precip", "water_deficit", 6)} FROM weather"""
)
def derived_meteo(spark, d):
    df = ag.with_derived_weather(_weather(spark, d), 4.0).select("event_id", "vpd", "gdd", "water_deficit")
    return rounded(df, "vpd", "gdd", "water_deficit", n=6)


@query("SELECT p_partkey, CASE WHEN abs(p_size - 25) > 1e-6 THEN floor((p_retailprice / (p_size - 25) + 1e-10) * 1e6 + 0.5) / 1e6 + 0.0 END AS ratio, greatest(0.0, least(1.0, p_retailprice * 1e-3)) AS clamped FROM part")
def safe_division(spark, d):
    from ..functions.scalars import clip

    p = t(spark, d, "part")
    return p.select("p_partkey", r(safe_div("p_retailprice", F.col("p_size").cast("double") - 25.0), 6).alias("ratio"), clip(F.col("p_retailprice") * 1e-3, 0, 1).alias("clamped"))


@query(f"SELECT event_id, {rs('value + 250.0 - 273.15', 'celsius')}, {rs('abs((value - 100.0) / 1000.0 * 1000.0)', 'mm')} FROM events")
def unit_conversions(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", r(ag.kelvin_to_celsius(v + 250.0)).alias("celsius"), r(ag.metres_to_mm((v - 100.0) / 1000.0)).alias("mm"))


_BAND_ROWS = "bands AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"((l_partkey * {7 + i} + l_orderkey * {3 + i} + l_linenumber) % 10007) * 1e-4 AS {b}" for i, b in enumerate(ag.BANDS)) + " FROM lineitem)"


def _bands(spark, d):
    k = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    cols = [(((k[0] * (7 + i) + k[1] * (3 + i) + k[2]) % 10007) * F.lit(1e-4)).alias(b) for i, b in enumerate(ag.BANDS)]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)


def _index_sql() -> dict[str, str]:
    sd = lambda a, b: f"(CASE WHEN abs({b}) > 1e-6 THEN ({a}) / ({b}) END)"
    c = lambda a, b: sd(f"{a} - {b}", f"({a} + {b})")
    x = {
        "NDVI": (c("B8", "B4"), -1, 1),
        "EVI2": (sd("2.5 * (B8 - B4)", "(B8 + 2.4 * B4 + 1.0)"), -1, 3),
        "GNDVI": (c("B8", "B3"), -1, 1),
        "NDRE": (c("B8A", "B5"), -1, 1),
        "CIre": (f"{sd('B8A', 'B5')} - 1.0", -1, 20),
        "IRECI": (sd("B7 - B4", sd("B5", "B6")), -50, 50),
        "NDWI": (c("B8", "B11"), -1, 1),
        "MSI": (sd("B11", "B8"), 0, 10),
        "GCVI": (f"{sd('B8', 'B3')} - 1.0", -1, 20),
        "MNDWI": (c("B3", "B11"), -1, 1),
        "NBR": (c("B8", "B12"), -1, 1),
        "NBR2": (c("B11", "B12"), -1, 1),
        "GVI": ("-0.2848 * B3 - 0.2435 * B4 + 0.5436 * B8 + 0.7243 * B11 + 0.0840 * B12", -1, 1),
        "DGCI": (f"(1.0 - {sd('B3 - B4', '(B3 + B4 + B2)')}) / 3.0", 0, 1),
        "NDSWIR1RedEdge1": (c("B5", "B11"), -1, 1),
        "TCARI": (f"3.0 * (B5 - B4) - 0.2 * (B5 - B3) * {sd('B5', 'B4')}", -10, 10),
        "OSAVI": (sd("1.16 * (B8 - B4)", "(B8 + B4 + 0.16)"), -1, 2),
        "CCCI": (f"greatest(-1.0, least(1.0, {c('B8A', 'B5')})) / nullif({c('B8A', 'B4')} + 1e-6, 0)", -5, 5),
        "mARI": (f"({sd('1.0', 'B3')} - {sd('1.0', 'B5')}) * B8", -5, 20),
        "ExG": (sd("2.0 * B3 - B4 - B2", "(B2 + B3 + B4 + 1e-6)"), -2, 2),
        "DBSI": (f"{c('B11', 'B3')} - {c('B8', 'B4')}", -2, 2),
        "SMMI": (c("B8A", "B11"), -1, 1),
        "MIRBI": ("10.0 * B12 - 9.8 * B11 + 2.0", -50, 50),
        "CVI": (sd("B8 * B4", "(B3 * B3 + 1e-6)"), 0, 50),
        "S2REP": (f"705.0 + 35.0 * {sd('(B4 + B7) / 2.0 - B5', '(B6 - B5 + 1e-6)')}", 700, 750),
        "PVI": ("(B8 - 0.355 * B4 - 0.149) / 1.061", -1, 1),
        "MTCI": (sd("B6 - B5", "(B5 - B4 + 1e-6)"), -30, 30),
        "SAVI": (f"1.5 * {sd('B8 - B4', '(B8 + B4 + 0.5)')}", -1, 3),
        "NDRE2": (c("B7", "B5"), -1, 1),
        "RE_ratio": (sd("B7", "B5"), 0, 10),
        "PSRI": (sd("B4 - B2", "(B6 + 1e-6)"), -10, 10),
        "LSWI": (c("B8", "B11"), -1, 1),
    }
    return {k: f"CASE WHEN ({e}) IS NOT NULL THEN greatest({lo}.0, least({hi}.0, {e})) END" for k, (e, lo, hi) in x.items()}


@query(f"WITH {_BAND_ROWS} SELECT l_orderkey, l_linenumber, {', '.join(rs(e, k) for k, e in _index_sql().items())} FROM bands")
def spectral_indices(spark, d):
    return _bands(spark, d).select("l_orderkey", "l_linenumber", *[r(e).alias(k) for k, e in ag.spectral_indices().items()])


@query(f"WITH {_BAND_ROWS} SELECT l_linenumber, count(*) AS n, {rs('avg(greatest(0.0, least(1.0, (B8 * 12000) * 1e-4)))', 'B8', 6)} FROM bands WHERE l_orderkey % 12 NOT IN (0, 1, 2, 3, 8, 9, 10, 11) GROUP BY 1")
def cloud_mask_reflectance(spark, d):
    df = ag.clear_pixels(_bands(spark, d).withColumn("scl", F.col("l_orderkey") % 12))
    return df.groupBy("l_linenumber").agg(F.count("*").alias("n"), r(F.avg(ag.reflectance(F.col("B8") * 12000)), 6).alias("B8"))


def _soil_sql(prefix: str = "saxton_") -> str:
    term = lambda k: " + ".join(f"({c}) * {v}" for c, v in zip(ag.SOIL_TERMS[k], ("s", "c", "o", "s * o", "c * o", "s * c", "1.0"), strict=True))
    out = {
        "LL15": "ll",
        "DUL": "dul",
        "SAT": "sat",
        "BD": "(1 - sat) * 2.65",
        "KSAT": "ks",
        "AWC": "dul - ll",
        "SWCON": "CASE WHEN ks IS NOT NULL THEN 0.15 + least(ks, 75.0) / 100.0 END",
        "lambda": "lam",
        "B": "1.0 / lam",
        "psi_e": "-21.67 * s - 27.93 * c - 81.97 * gap + 71.12 * s * gap + 8.29 * c * gap + 14.05 * s * c + 27.16",
        "PAW_mm_cm": "(dul - ll) * 10.0",
    }
    return f"""WITH x AS (SELECT p_partkey, (20.0 + p_size) / 100.0 AS s, (p_retailprice - 895.0) / 400.0 AS c, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (1.0 + p_size / 20.0) / 100.0 END AS o FROM part),
      y AS (SELECT p_partkey, CASE WHEN o IS NOT NULL THEN s END AS s, CASE WHEN o IS NOT NULL THEN c END AS c, o FROM x),
      a AS (SELECT *, {term("wilting")} AS w, {term("field")} AS f, {term("saturated")} AS g FROM y),
      b AS (SELECT *, w + (0.14 * w - 0.02) AS ll, f + (1.283 * f * f - 0.374 * f - 0.015) AS dul, g + (0.636 * g - 0.107) AS gap FROM a),
      e AS (SELECT *, dul + gap - 0.097 * s + 0.043 AS sat, CASE WHEN dul > 0 AND ll > 0 THEN greatest((ln(dul) - ln(ll)) / (ln(33.0) - ln(1500.0)), 0.01) END AS lam FROM b),
      z AS (SELECT *, CASE WHEN sat - dul > 0 THEN 1930 * pow(sat - dul, 3 - lam) END AS ks FROM e)
      SELECT p_partkey, {", ".join(rs(v, prefix + k) for k, v in out.items())} FROM z"""


@query(_soil_sql())
def saxton(spark, d):
    s = F.col("p_size").cast("double")
    df = t(spark, d, "part").select("p_partkey", (s + 20.0).alias("sand"), ((F.col("p_retailprice") - 895.0) / 4.0).alias("clay"), F.when(F.col("p_partkey") % 13 != 0, s / 20.0 + 1.0).alias("om"))
    return rounded(ag.with_soil_water(df, "sand", "clay", "om").drop("sand", "clay", "om"), *[f"saxton_{c}" for c in ag.SOIL_OUTPUTS])


# ------------------------------------------------------------------ features
_CLIP10 = "greatest(-10.0, least(10.0, {}))"


@query(
    f"""WITH {_PERIODS}, m AS (SELECT entity, feature, ord, value, lag(value) OVER x AS v1, lag(ord) OVER x AS o1 FROM long WHERE stat = 'mean' WINDOW x AS (PARTITION BY entity, feature ORDER BY ord))
    SELECT entity, feature, ord, {rs("value - v1", "change")}, {rs(_CLIP10.format("value / (abs(v1) + 1e-6)"), "ratio")}, {rs(_CLIP10.format("(value - v1) / (abs(v1) + 1e-6)"), "roc")}
    FROM m WHERE o1 = ord - 1"""
)
def temporal_derivatives(spark, d):
    df = se.changes(long_periods(spark, d).where("stat = 'mean'").drop("stat", "period"), ["entity", "feature"])
    return rounded(df.select("entity", "feature", "ord", "change", "ratio", "roc"), "change", "ratio", "roc")


@query(
    f"""WITH {_PERIODS} SELECT entity, feature, {rs("stddev_samp(value) / (abs(avg(value)) + 1e-6)", "cv")}, {rs("max(value) - min(value)", "range")},
    CASE WHEN count(value) >= 2 THEN floor((regr_slope(value, ord) + 1e-8) * 1e4 + 0.5) / 1e4 + 0.0 END AS slope FROM long WHERE stat = 'mean' GROUP BY entity, feature"""
)
def seasonal_aggregates(spark, d):
    df = se.seasonal(long_periods(spark, d).where("stat = 'mean'"), ["entity", "feature"], 4)
    return rounded(df, "cv", "range", "slope")


@query(
    f"""WITH {_PERIODS}, gap AS (SELECT * FROM long WHERE stat = 'mean' AND ord <> 1 AND (ord <> 2 OR feature <> 'click')), seen AS (SELECT DISTINCT feature, ord FROM gap),
    i AS (SELECT feature, ord, row_number() OVER (PARTITION BY feature ORDER BY ord) - 1 AS i FROM seen)
    SELECT entity, feature, CASE WHEN count(value) >= 2 THEN floor((regr_slope(value, i) + 1e-8) * 1e4 + 0.5) / 1e4 + 0.0 END AS slope FROM gap JOIN i USING (feature, ord) GROUP BY entity, feature"""
)
def seasonal_with_gaps(spark, d):
    """The slope runs over the places of the periods that a feature has, not over their numbers."""
    long = long_periods(spark, d).where("stat = 'mean' and ord <> 1 and (ord <> 2 or feature <> 'click')")
    return rounded(se.seasonal(long, ["entity", "feature"], 3).select("entity", "feature", "slope"), "slope")


_KEYS = ["entity", "ord", "period"]


def _pair_sql(wanted: list[tuple[str, str]], how: str, a_stat: str = "mean", b_stat: str = "mean", where: str = "true") -> str:
    name, value = ("_div_", "greatest(-100.0, least(100.0, a.value / (abs(b.value) + 1e-6)))") if how == "ratio" else ("_x_", "a.value * b.value")
    return f"""WITH {_NAMED}, want(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in wanted)})
      SELECT a.entity, a.ord, a.period, want.a || '{name}' || want.b AS feature, {rs(value, "value")} FROM want JOIN named a ON a.feature = want.a AND a.stat = '{a_stat}'
      JOIN named b ON b.feature = want.b AND b.stat = '{b_stat}' AND b.entity = a.entity AND b.ord = a.ord WHERE {where}"""


def named_periods(spark, d):
    return long_periods(spark, d, _CHANNELS)


@query(_pair_sql([("B8", "NDVI"), ("NDVI", "B8"), ("B8", "t2m_max")], "ratio"))
def band_ratio(spark, d):
    return rounded(ft.pairs(named_periods(spark, d), [("B8", "NDVI"), ("NDVI", "B8"), ("B8", "t2m_max")], "ratio", _KEYS), "value")


@query(_pair_sql([("NDVI", "B8"), ("NDVI", "t2m_max")], "product"))
def vi_product(spark, d):
    return rounded(ft.pairs(named_periods(spark, d), [("NDVI", "B8"), ("NDVI", "t2m_max")], "product", _KEYS), "value")


@query(_pair_sql([("B8", "NDVI")], "product", where="a.period IN ('w2', 'w3', 'w4')"))
def band_vi(spark, d):
    long = named_periods(spark, d)
    last = ft.critical_periods([p for p, _, _ in _WEEKS])
    return rounded(ft.pairs(long.where(F.col("period").isin(*last)), [("B8", "NDVI")], "product", _KEYS), "value")


@query(
    f"""WITH {_NAMED}, wide1 AS (SELECT entity, ord, period, max(CASE WHEN feature = 'precip' AND stat = 'sum' THEN value END) AS p, max(CASE WHEN feature = 'pet' AND stat = 'sum' THEN value END) AS e,
      max(CASE WHEN feature = 't2m_max' AND stat = 'mean' THEN value END) AS x FROM named GROUP BY ALL), wide2 AS (SELECT entity, ord, period, p, e, x FROM wide1),
    u AS (SELECT entity, ord, period, 'aridity' AS feature, p / (abs(e) + 1e-6) AS value FROM wide2 UNION ALL SELECT entity, ord, period, 'water_deficit', e - p FROM wide2
      UNION ALL SELECT entity, ord, period, 'heat_stress', CASE WHEN x IS NOT NULL THEN greatest(x - 30.0, 0.0) END FROM wide2)
    SELECT entity, ord, period, feature, {rs("value")} FROM u WHERE value IS NOT NULL"""
)
def agronomic(spark, d):
    return rounded(ft.agronomic(named_periods(spark, d), _KEYS), "value")


@query(_pair_sql([("NDVI", "precip"), ("NDVI", "t2m_max")], "product"))
def vi_meteo(spark, d):
    return rounded(ft.weather_pairs(named_periods(spark, d), ["NDVI"], ["precip", "t2m_max"], _KEYS), "value")


@query(_pair_sql([("B8", "precip"), ("B8", "t2m_max")], "product"))
def band_meteo(spark, d):
    return rounded(ft.weather_pairs(named_periods(spark, d), ["B8"], ["precip", "t2m_max"], _KEYS), "value")


_SOIL = "soil AS (SELECT c_custkey AS entity, c_acctbal / 1000.0 AS soil_top_clay, CAST(c_nationkey AS DOUBLE) AS soil_top_om FROM customer)"


def _soil(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 1000.0).alias("soil_top_clay"), F.col("c_nationkey").cast("double").alias("soil_top_om"))


def _static_sql(left: list[str]) -> str:
    names = ", ".join(f"'{x}'" for x in left)
    return f"""WITH {_NAMED}, {_SOIL}, props AS (SELECT entity, unnest(['soil_top_clay', 'soil_top_om']) AS prop, unnest([soil_top_clay, soil_top_om]) AS level FROM soil)
      SELECT n.entity, n.ord, n.period, n.feature || '_x_' || p.prop AS feature, {rs("n.value * p.level", "value")} FROM named n JOIN props p USING (entity)
      WHERE n.stat = 'mean' AND n.feature IN ({names}) AND p.level IS NOT NULL"""


def _static(spark, d, left):
    return rounded(ft.static_pairs(named_periods(spark, d), _soil(spark, d), left, ["soil_top_clay", "soil_top_om"], _KEYS, "entity"), "value")


@query(_static_sql(["NDVI"]))
def vi_soil(spark, d):
    return _static(spark, d, ["NDVI"])


@query(_static_sql(["B8"]))
def band_soil(spark, d):
    return _static(spark, d, ["B8"])


@query(_static_sql(["precip", "t2m_max"]))
def meteo_soil(spark, d):
    long = ft.with_priority(named_periods(spark, d), _KEYS, ["precip", "t2m_max"])
    return rounded(ft.static_pairs(long, _soil(spark, d), ["precip", "t2m_max"], ["soil_top_clay", "soil_top_om"], _KEYS, "entity"), "value")


_TRAITS = """SELECT entity, unnest(['pheno_baseline', 'pheno_amplitude', 'pheno_greenup_steepness', 'pheno_senescence_steepness', 'pheno_greenup_inflection', 'pheno_senescence_inflection',
      'pheno_season_length', 'pheno_trend', 'pheno_greenup_senescence_ratio']) AS feature, unnest([0.3, 1.0 + c, 8.0, 11.0, 60.0 + c, 150.0 + c / 2, 150.0 + c / 2 - (60.0 + c), 0.002, 8.0 / (11.0 + 1e-6)]) AS value
    FROM (SELECT c_custkey AS entity, CAST(c_nationkey AS DOUBLE) AS c FROM customer)"""


def _met_sql(a: str, b: str, source: str, how: str = "x") -> str:
    value = "a.value * b.value" if how == "x" else "greatest(-100.0, least(100.0, a.value / (abs(b.value) + 1e-6)))"
    return f"SELECT a.entity, a.ord, a.period, '{a}_{how}_{b}' AS feature, {value} AS value FROM {source} a JOIN {source} b USING (entity, ord) WHERE a.feature = '{a}' AND b.feature = '{b}' AND a.stat = 'mean' AND b.stat = 'mean'"


@query(
    f"""WITH {_NAMED}, {_SOIL}, crit AS (SELECT * FROM named WHERE period IN ('w2', 'w3', 'w4')),
    mv AS (SELECT entity, feature, ord, period, value, lag(value) OVER x AS v1, lag(ord) OVER x AS o1 FROM named WHERE stat = 'mean' WINDOW x AS (PARTITION BY entity, feature ORDER BY ord)),
    moved AS (SELECT * FROM mv WHERE o1 = ord - 1 AND v1 IS NOT NULL),
    seen AS (SELECT DISTINCT feature, ord FROM named WHERE stat = 'mean'), place AS (SELECT feature, ord, row_number() OVER (PARTITION BY feature ORDER BY ord) - 1 AS i FROM seen),
    agro AS (SELECT entity, ord, period, max(CASE WHEN feature = 'precip' AND stat = 'sum' THEN value END) AS p, max(CASE WHEN feature = 'pet' AND stat = 'sum' THEN value END) AS e,
      max(CASE WHEN feature = 't2m_max' AND stat = 'mean' THEN value END) AS x FROM named GROUP BY ALL),
    season AS (SELECT entity, feature, stddev_samp(value) / (abs(avg(value)) + 1e-6) AS cv, max(value) - min(value) AS width, CASE WHEN count(value) >= 2 THEN regr_slope(value, i) END AS slope
      FROM named JOIN place USING (feature, ord) WHERE stat = 'mean' AND feature IN ('NDVI', 'B8') GROUP BY entity, feature),
    u AS (SELECT entity, ord, period, feature || '_change' AS feature, value - v1 AS value FROM moved
      UNION ALL SELECT entity, ord, period, feature || '_ratio', {_CLIP10.format("value / (abs(v1) + 1e-6)")} FROM moved
      UNION ALL SELECT entity, ord, period, feature || '_roc', {_CLIP10.format("(value - v1) / (abs(v1) + 1e-6)")} FROM moved
      UNION ALL {_met_sql("B8", "NDVI", "named", "div")} UNION ALL {_met_sql("NDVI", "t2m_max", "named")}
      UNION ALL SELECT entity, ord, period, 'aridity', p / (abs(e) + 1e-6) FROM agro WHERE p IS NOT NULL AND e IS NOT NULL
      UNION ALL SELECT entity, ord, period, 'water_deficit', e - p FROM agro WHERE p IS NOT NULL AND e IS NOT NULL
      UNION ALL SELECT entity, ord, period, 'heat_stress', greatest(x - 30.0, 0.0) FROM agro WHERE x IS NOT NULL
      UNION ALL SELECT n.entity, ord, period, 'NDVI_x_soil_top_clay', value * soil_top_clay FROM crit n JOIN soil USING (entity) WHERE feature = 'NDVI' AND stat = 'mean' AND soil_top_clay IS NOT NULL
      UNION ALL {_met_sql("NDVI", "precip", "crit")} UNION ALL {_met_sql("NDVI", "t2m_max", "crit")}
      UNION ALL SELECT entity, NULL, NULL, feature, value FROM ({_TRAITS})
      UNION ALL SELECT entity, NULL, NULL, feature || '_seasonal_cv', cv FROM season UNION ALL SELECT entity, NULL, NULL, feature || '_seasonal_range', width FROM season
      UNION ALL SELECT entity, NULL, NULL, feature || '_seasonal_slope', slope FROM season)
    SELECT entity, ord, period, feature, {rs("value")} FROM u"""
)
def engineer_all(spark, d):
    """Every part of the dispatcher: series, pairs, agronomy, static and weather products, curve traits, seasonal."""
    config = {
        "derivatives": True,
        "ratios": [("B8", "NDVI")],
        "products": [("NDVI", "t2m_max")],
        "agronomic": True,
        "static": {"left": ["NDVI"], "props": ["soil_top_clay"]},
        "weather": {"left": ["NDVI"], "vars": ["precip", "t2m_max"]},
        "seasonal": ["NDVI", "B8"],
    }
    return rounded(ft.engineer_all(named_periods(spark, d), config, "entity", [p for p, _, _ in _WEEKS], _soil(spark, d), _traits(spark, d)), "value")


def _traits(spark, d):
    """Curve parameters of every entity."""
    c = F.col("c_nationkey").cast("double")
    m = {"m1": F.lit(0.3), "m2": c + 1.0, "m3": c + 60.0, "m4": F.lit(8.0), "m5": c / 2 + 150.0, "m6": F.lit(11.0), "m7": F.lit(0.002)}
    return t(spark, d, "customer").select(F.col("c_custkey").alias("entity"), *[v.alias(k) for k, v in m.items()])


@query(f"WITH {_NAMED}, {_SOIL} SELECT n.entity, n.ord, n.feature, n.stat, {rs('value')}, {rs('soil_top_clay')}, soil_top_om FROM named n LEFT JOIN soil USING (entity)")
def aggregates_with_static(spark, d):
    """Period statistics with their entity's static attributes."""
    joined = st.left_without_clashes(named_periods(spark, d).drop("period"), _soil(spark, d), "entity")
    return rounded(joined.select("entity", "ord", "feature", "stat", "value", "soil_top_clay", "soil_top_om"), "value", "soil_top_clay")


@query(f"WITH {_PEAKS} SELECT id, array_to_string(reasons, ';') AS anomaly_reason, o_custkey, o_orderstatus FROM flags JOIN orders ON o_orderkey = id WHERE len(reasons) > 0")
def anomalies_with_static(spark, d):
    """Anomalous peaks with the attributes of their entity."""
    static = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    bad = _peaks(spark, d).where("peak_anomalous").select("id", F.array_join("anomaly_reasons", ";").alias("anomaly_reason"))
    return st.with_target(bad, static, "id").select("id", "anomaly_reason", "o_custkey", "o_orderstatus")


_MODES = [(m, i, w[0]) for m in (*pe.RELATIVE_MODES, *pe.DATE_MODES) for i, w in enumerate(pe.window_rows(m))]


@query(
    f"""WITH w(mode, ord, period) AS (VALUES {", ".join(f"('{m}', {i}, '{p}')" for m, i, p in _MODES)}),
    c AS (SELECT *, len(list_intersect(string_split(period, '_'), {list(ft.CRITICAL_PARTS)})) > 0 AS hit FROM w),
    n AS (SELECT mode, bool_or(hit) AS any_hit, max(ord) AS last FROM c GROUP BY mode)
    SELECT c.mode, c.ord, c.period FROM c JOIN n USING (mode) WHERE CASE WHEN any_hit THEN hit ELSE ord > last - 3 END"""
)
def critical_periods(spark, d):
    rows = [(m, i, p) for m, i, p in _MODES if p in ft.critical_periods([x for k, _, x in _MODES if k == m])]
    return spark.createDataFrame(rows, "mode string, ord int, period string")


_KIND_NAMES = ["w1_view_mean", "w1_view_change", "w2_B8_div_B4", "w2_NDVI_x_NDRE", "w2_aridity", "w3_water_deficit_mean", "pheno_trend", "NDVI_seasonal_cv", "w3_heat_stress", "soil_top_clay"]


@query(
    f"""WITH n(feature) AS (VALUES {", ".join(f"('{x}')" for x in _KIND_NAMES)})
    SELECT feature, CASE WHEN regexp_matches(feature, '_(change|ratio|roc)$|_div_|_x_|_(aridity|heat_stress)$|^pheno_|_seasonal_') THEN 'derived' ELSE 'raw' END AS kind FROM n"""
)
def feature_kinds(spark, d):
    return spark.createDataFrame([(x, ft.kind_of(x)) for x in _KIND_NAMES], "feature string, kind string")


@query(
    f"""WITH {_PERIODS}, m AS (SELECT entity, feature, ord, value, lag(value) OVER x AS v1, lag(ord) OVER x AS o1 FROM long WHERE stat = 'mean' WINDOW x AS (PARTITION BY entity, feature ORDER BY ord)),
    every AS (SELECT entity, feature, ord, value FROM m UNION ALL SELECT entity, feature || '_change', ord, value - v1 FROM m WHERE o1 = ord - 1
      UNION ALL SELECT DISTINCT entity, 'soil_level', NULL, CAST(entity % 7 AS DOUBLE) FROM m)
    SELECT entity, feature, ord, {rs("value")} FROM every WHERE feature NOT LIKE '%\\_change' ESCAPE '\\' AND (ord BETWEEN 1 AND 2 OR ord IS NULL)"""
)
def period_subset(spark, d):
    """Raw features of two periods, and the static ones, out of raw, derived and static rows."""
    long = long_periods(spark, d).where("stat = 'mean'").select("entity", "feature", "ord", "value")
    moved = se.changes(long, ["entity", "feature"]).select("entity", F.concat("feature", F.lit("_change")).alias("feature"), "ord", F.col("change").alias("value"))
    static = long.select("entity").distinct().select("entity", F.lit("soil_level").alias("feature"), F.lit(None).cast("int").alias("ord"), (F.col("entity") % 7).cast("double").alias("value"))
    every = long.unionByName(moved).unionByName(static)
    kinds = spark.createDataFrame([(r["feature"], ft.kind_of(r["feature"])) for r in every.select("feature").distinct().collect()], "feature string, kind string")  # a row per feature name
    rows = ft.raw_only(every.join(F.broadcast(kinds), "feature"))
    return rounded(ft.period_subset(rows, 1, 2).select("entity", "feature", "ord", "value"), "value")


_TYPES = [(f, pe.feature_type(f)) for f in ("NDVI", "LSWI", "B2", "B8A", "t2m_min", "dewpoint", "precip", "pet", "gdd", "vpd", "ssrd_MJm2", "water_deficit")]


@query(
    """SELECT * FROM (VALUES ('NDVI', 'vegetation_indices'), ('LSWI', 'vegetation_indices'), ('B2', 'spectral_bands'), ('B8A', 'spectral_bands'), ('t2m_min', 'temperature'), ('dewpoint', 'temperature'),
    ('precip', 'precipitation'), ('pet', 'pet'), ('gdd', 'gdd'), ('vpd', 'vpd'), ('ssrd_MJm2', 'ssrd'), ('water_deficit', 'unknown')) v(feature, ftype)"""
)
def feature_types(spark, d):
    return spark.createDataFrame(_TYPES, "feature string, ftype string")


# ------------------------------------------------------------------ entity tables
@query("SELECT c.c_custkey, c.c_nationkey, n.n_name, r.r_name, round(c.c_acctbal, 2) AS c_acctbal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def static_merge(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name", "n_regionkey")
    cust = t(spark, d, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    merged = st.merge_static(cust, nation, None, "key").withColumnRenamed("key", "c_nationkey")
    region = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return st.left_without_clashes(merged, region, "n_regionkey").select("c_custkey", "c_nationkey", "n_name", "r_name", "c_acctbal")


@query("SELECT n.n_nationkey, s.s_suppkey AS sample_s_suppkey, round(s.s_acctbal, 2) AS sample_s_acctbal FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def sample_left_join(spark, d):
    sup = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    return st.with_samples(t(spark, d, "nation").select("n_nationkey"), sup, "n_nationkey")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def key_intersection(spark, d):
    return st.common_keys(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), t(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


def _written(spark: SparkSession, tables_: dict[str, DataFrame]) -> str:
    """A folder below the shared one with each table as CSV."""
    folder = f"{shared_dir(spark)}/tidespan_csv_{uuid.uuid4().hex}"
    for name, df in tables_.items():
        tables.write_csv(df, f"{folder}/{name}")
    return folder


@query(
    """SELECT CAST(user_id AS VARCHAR) AS field_key, CAST(ts AS DATE) AS date, CASE WHEN event_id % 2 = 0 THEN value END AS precip, CASE WHEN event_id % 7 > 0 THEN value / 10 END AS t2m_mean FROM events"""
)
def union_files(spark, d):
    """Daily files of two headers, one of them without a column and with values that aren't finite, as one table."""
    e = t(spark, d, "events")
    key, day = F.col("user_id").cast("string").alias("field_key"), F.to_date("ts").alias("date")
    mean = F.when(F.col("event_id") % 7 > 0, F.col("value") / 10).otherwise(F.lit(float("nan"))).alias("t2m_mean")
    folder = _written(spark, {"a_daily_meteo_1.csv": e.where("event_id % 2 = 0").select(key, day, F.col("value").alias("precip"), mean), "b_daily_meteo_2.csv": e.where("event_id % 2 = 1").select(day, mean, key)})
    return tables.read_weather(spark, folder).select("field_key", "date", "precip", "t2m_mean")


@query("SELECT c_custkey AS field_key, c_acctbal AS soil_top_clay, c_mktsegment AS county, CAST(c_nationkey AS DOUBLE) AS protein_pct FROM customer WHERE c_custkey % 5 > 0")
def static_csv(spark, d):
    """Static attributes and target of one file: wanted columns once, absent ones skipped, null targets dropped."""
    c = t(spark, d, "customer")
    target = F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")).alias("protein_pct")
    folder = _written(spark, {"static.csv": c.select(F.col("c_custkey").alias("field_key"), F.col("c_acctbal").alias("soil_top_clay"), F.col("c_mktsegment").alias("county"), target, "c_name")})
    static, y = tables.read_static(spark, f"{folder}/static.csv", ["soil_top_clay", "county", "soil_top_clay", "absent"])
    return st.with_target(static, y, "field_key").select(F.col("field_key").cast("long").alias("field_key"), "soil_top_clay", "county", "protein_pct")


@query("SELECT n_nationkey AS field_key, n_nationkey * 2.5 AS elevation, n_regionkey * 1.0 AS slope, s_acctbal AS sample_elevation FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def terrain_csv(spark, d):
    """Terrain file under its raw names, with the samples of each field."""
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    key = F.col("n_nationkey").alias("field_key")
    folder = _written(
        spark,
        {"terrain.csv": n.select(key, (key * 2.5).alias("elev_mean"), (F.col("n_regionkey") * 1.0).alias("slope_mean"), F.col("n_name").alias("junk")), "samples.csv": s.select(F.col("s_nationkey").alias("field_key"), F.col("s_acctbal").alias("elevation"))},
    )
    got = tables.read_terrain(spark, f"{folder}/terrain.csv", f"{folder}/samples.csv")
    return got.select(F.col("field_key").cast("int").alias("field_key"), "elevation", "slope", "sample_elevation")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def checkpoint_anti(spark, d):
    return st.unfinished(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_RINGS = {"A": [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.0), (5.0, 10.0), (0.0, 10.0)], "B": [(5.0, 5.0), (25.0, 5.0), (15.0, 20.0)]}


def _inside_sql(ring) -> str:
    edges = zip(ring, ring[1:] + ring[:1], strict=True)
    hit = lambda a, b: f"CASE WHEN ({a[1]} > lat) <> ({b[1]} > lat) AND lon < {a[0]} + (lat - {a[1]}) * ({b[0] - a[0]}) / nullif({b[1] - a[1]}, 0) THEN 1 ELSE 0 END"
    return "(" + " + ".join(hit(a, b) for a, b in edges) + ") % 2 = 1"


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_nationkey + 0.37 AS lon, (c_custkey % 200) / 10.0 + 0.013 AS lat FROM customer)
    SELECT p.id, a.name AS county FROM p LEFT JOIN (VALUES ('A'), ('B')) a(name) ON CASE WHEN a.name = 'A' THEN {_inside_sql(_RINGS["A"])} ELSE {_inside_sql(_RINGS["B"])} END"""
)
def spatial_point_in_polygon(spark, d):
    pts = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 0.37).alias("lon"), ((F.col("c_custkey") % 200) / 10.0 + 0.013).alias("lat"))
    areas = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in v]) for k, v in _RINGS.items()], "name string, ring array<struct<lon: double, lat: double>>")
    return st.locate(pts, areas, "lon", "lat").select("id", F.col("name").alias("county"))


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_nationkey + 0.37 AS lon, (c_custkey % 200) / 10.0 + 0.013 AS lat, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS county, CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS state FROM customer),
    a(name, st) AS (VALUES ('A', 'SA'), ('B', 'SB'))
    SELECT p.id, coalesce(p.county, a.name) AS county, CASE WHEN p.county IS NULL THEN coalesce(p.state, a.st) ELSE p.state END AS state
    FROM p LEFT JOIN a ON CASE WHEN a.name = 'A' THEN {_inside_sql(_RINGS["A"])} ELSE {_inside_sql(_RINGS["B"])} END"""
)
def county_fill(spark, d):
    k = F.col("c_custkey")
    pts = t(spark, d, "customer").select(
        k.alias("id"),
        (F.col("c_nationkey") + 0.37).alias("centroid_lon"),
        ((k % 200) / 10.0 + 0.013).alias("centroid_lat"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("county"),
        F.when(k % 2 == 0, F.lit("own")).alias("state"),
    )
    rows = [(n, f"S{n}", [{"lon": x, "lat": y} for x, y in v]) for n, v in _RINGS.items()]
    areas = spark.createDataFrame(rows, "NAME string, STATE_NAME string, ring array<struct<lon: double, lat: double>>")
    return st.fill_counties(pts, areas).select("id", "county", "state")


@query("SELECT entity FROM (SELECT DISTINCT user_id AS entity FROM events) ORDER BY md5('42:' || entity), entity LIMIT 12")
def sample_fields(spark, d):
    return se.seeded_sample(events(spark, d), "entity", 12)


@query(
    "SELECT l_suppkey, "
    + ", ".join(
        [
            "count(*) AS pixel_count",
            *[rs(f"{f}(l_quantity)", f"q_{n}") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"), ("median", "median"))],
            *[rs(f"quantile_cont(l_quantity, {p / 100})", f"q_p{p}") for p in (10, 25, 75, 90)],
            rs("max(l_quantity) - min(l_quantity)", "q_range"),
        ]
    )
    + " FROM lineitem GROUP BY l_suppkey"
)
def terrain_statistics(spark, d):
    df = rasters.terrain_statistics(t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q")), "l_suppkey", ["q"])
    return rounded(df, *[c for c in df.columns if c.startswith("q_")])


@query(
    f"""WITH {_WEATHER} SELECT event_id % 20 AS field, event_id % 3 AS month, {rs("avg(t2m_mean)", "t2m_mean")}, {rs("min(t2m_min)", "t2m_min")}, {rs("max(t2m_max)", "t2m_max")},
    {rs("sum(precip)", "precip_sum")}, CAST(sum(CASE WHEN t2m_max >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS hot_days, {rs("sum(greatest(t2m_mean, 0.0))", "warmth")} FROM weather GROUP BY ALL"""
)
def monthly_weather(spark, d):
    df = _weather(spark, d).withColumns({"field": F.col("event_id") % 20, "month": F.col("event_id") % 3})
    return rounded(rasters.monthly_weather(df, "field"), "t2m_mean", "t2m_min", "t2m_max", "precip_sum", "warmth")


@query("SELECT count(DISTINCT user_id) AS n_fields, count(DISTINCT CAST(ts AS DATE)) AS n_dates, count(*) AS n_rows, floor((avg(CASE WHEN value > 300 THEN 1 ELSE 0 END) + 1e-10) * 1e6 + 0.5) / 1e6 + 0.0 AS null_rate FROM events")
def coverage(spark, d):
    df = events(spark, d).withColumn("value", F.when(F.col("value") <= 300, F.col("value")))
    return df.agg(F.count_distinct("entity").alias("n_fields"), F.count_distinct("date").alias("n_dates"), F.count("*").alias("n_rows"), r(F.avg(F.col("value").isNull().cast("int")), 6).alias("null_rate"))


# ------------------------------------------------------------------ screening
def vectors(spark, d):
    """id, features (every 17th cell of a few rows missing), y."""
    importable(spark)
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda v, i: F.when((F.col("vec_id") * 7 + i) % 17 != 0, v.cast("double"))).alias("features"), F.col("label").cast("double").alias("y")
    )


_CELLS = """raw AS (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(label AS DOUBLE) AS y FROM embeddings),
    cells AS (SELECT id, idx, CASE WHEN (id * 7 + idx) % 17 <> 0 THEN v END AS value, y FROM raw),
    med AS (SELECT idx, quantile_cont(value, 0.5) AS median FROM cells GROUP BY idx),
    full_cells AS (SELECT id, idx, coalesce(value, median) AS value, y FROM cells JOIN med USING (idx))"""


@query(f"WITH {_CELLS} SELECT idx, {rs('median', n=6)} FROM med")
def median_impute(spark, d):
    return rounded(sc.medians(vectors(spark, d)), "median", n=6)


@query(f"WITH {_CELLS} SELECT idx, {rs('var_samp(value)', 'variance', 6)} FROM cells GROUP BY idx HAVING var_samp(value) >= 1e-6")
def variance_filter(spark, d):
    return rounded(sc.variance_filter(vectors(spark, d)), "variance", n=6)


@query(f"WITH {_CELLS} SELECT idx, {rs('coalesce(corr(value, y), 0)', 'r', 6)} FROM full_cells GROUP BY idx")
def target_correlation(spark, d):
    return rounded(sc.target_correlations(sc.imputed(vectors(spark, d))[0]), "r", n=6)


@query(f"WITH {_CELLS} SELECT a.idx AS a, b.idx AS b, {rs('corr(a.value, b.value)', 'r', 5)} FROM full_cells a JOIN full_cells b ON a.id = b.id AND a.idx < b.idx GROUP BY a.idx, b.idx HAVING abs(corr(a.value, b.value)) > 0.2")
def correlated_pairs(spark, d):
    rows = sc.correlated_pairs(sc.imputed(vectors(spark, d))[0], 0.2)
    return rounded(spark.createDataFrame(rows, "a int, b int, r double"), "r", n=5)


_CORR = f"""{_CELLS}, var AS (SELECT idx, var_samp(value) AS v FROM full_cells GROUP BY idx),
    pair AS (SELECT a.idx AS a, b.idx AS b, coalesce(corr(a.value, b.value), 0) AS r FROM full_cells a JOIN full_cells b USING (id) GROUP BY a.idx, b.idx)"""


@query(
    f"""WITH RECURSIVE {_CORR}, hard AS (SELECT row_number() OVER (ORDER BY a, b) AS k, a, b, va.v AS va, vb.v AS vb FROM pair JOIN var va ON va.idx = a JOIN var vb ON vb.idx = b WHERE a < b AND abs(r) > 0.3 AND va.v >= 1e-6 AND vb.v >= 1e-6),
    s(k, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL
      SELECT hard.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN va > vb THEN b ELSE a END) END FROM s JOIN hard ON hard.k = s.k + 1),
    last AS (SELECT gone FROM s ORDER BY k DESC LIMIT 1)
    SELECT var.idx FROM var, last WHERE var.v >= 1e-6 AND NOT list_contains(gone, var.idx)"""
)
def collinear_drop(spark, d):
    left, counts = sc.unsupervised_prescreen(vectors(spark, d), above=0.3)
    return spark.createDataFrame([(i,) for i in left], "idx int")


@query(
    f"""WITH {_CELLS}, r AS (SELECT idx, abs(coalesce(corr(value, y), 0)) AS strength FROM full_cells GROUP BY idx), q AS (SELECT quantile_cont(strength, 0.15) AS cut FROM r)
    SELECT idx FROM r, q WHERE strength >= cut"""
)
def prescreen_percentile(spark, d):
    df = sc.target_correlations(sc.imputed(vectors(spark, d))[0]).withColumn("strength", F.abs("r"))
    cut = df.agg(F.percentile("strength", F.lit(0.15)).alias("cut"))
    return df.join(F.broadcast(cut)).where("strength >= cut").select("idx")


@query()
def mutual_info(spark, d):
    return sc.mutual_informations(sc.imputed(vectors(spark, d))[0])


@query()
def prescreen(spark, d):
    return spark.createDataFrame([(i,) for i in sc.prescreen(sc.imputed(vectors(spark, d))[0])], "idx int")


def _mrmr_sql(k: int) -> str:
    """Greedy choice, a step at a time: chosen is the list so far."""
    steps = [f"""{_CORR}, target AS (SELECT idx, least(pow(coalesce(corr(value, y), 0), 2), 1 - 1e-12) AS t2 FROM full_cells GROUP BY idx), rows_n AS (SELECT count(DISTINCT id) AS n FROM cells),
      rel AS (SELECT idx, t2 / (1 - t2) * greatest(n - 2, 1) AS f FROM target, rows_n), c0 AS (SELECT CAST([] AS INTEGER[]) AS chosen)"""]
    for i in range(k):
        redundancy = "1.0" if i == 0 else f"greatest((SELECT sum(abs(r)) FROM pair WHERE pair.a = rel.idx AND list_contains(chosen, pair.b)) / {float(i)}, 1e-3)"
        steps.append(f"s{i} AS MATERIALIZED (SELECT rel.idx, f / {redundancy} AS score FROM rel, c{i} WHERE NOT list_contains(chosen, rel.idx)), c{i + 1} AS MATERIALIZED (SELECT list_append(chosen, (SELECT idx FROM s{i} ORDER BY score DESC, idx LIMIT 1)) AS chosen FROM c{i})")
    return f"WITH {', '.join(steps)} SELECT CAST(unnest(range(0, {k})) AS INTEGER) AS rank, unnest(chosen) AS idx FROM c{k}"


@query(_mrmr_sql(15))
def mrmr(spark, d):
    n, _, cov = sc.moments(sc.imputed(vectors(spark, d))[0])
    return spark.createDataFrame(list(enumerate(sc.mrmr(n, cov, 15))), "rank int, idx int")


@query()
def mrmr_grid(spark, d):
    return sc.mrmr_grid(sc.imputed(vectors(spark, d))[0], [5, 10, 20, 40])[1]


@query()
def mrmr_best(spark, d):
    best = sc.mrmr_best(sc.imputed(vectors(spark, d))[0], [5, 10, 20, 40], model="Ridge")
    return spark.createDataFrame([(best["k"], i, f) for i, f in enumerate(best["features"])], "k int, rank int, idx int")


@query()
def pls_vip(spark, d):
    chosen, vip, _ = sc.pls_vip(sc.imputed(vectors(spark, d))[0])
    return spark.createDataFrame([(i, float(v), i in set(chosen)) for i, v in enumerate(vip)], "idx int, vip double, selected boolean")


@query()
def boruta(spark, d):
    got = sc.boruta(sc.imputed(vectors(spark, d))[0], rounds=5, trees=10, depth=4)
    kind = {i: k for k in ("confirmed", "tentative", "rejected") for i in got[k]}
    return spark.createDataFrame(sorted(kind.items()), "idx int, verdict string")


@query()
def rfe(spark, d):
    df = sc.imputed(vectors(spark, d))[0]
    votes = [(m, f) for m in ("LightGBM", "RandomForest", "XGBoost") for f in sc.rfe_cv(df, list(range(64)), m, least=20, step=22, folds=3, trees=5, depth=4)[0]]
    return sc.consensus(spark.createDataFrame(votes, "model string, feature int"), 3, "majority")


_VOTES = [(m, f"f{i}") for k, m in enumerate(("a", "b", "c")) for i in range(20) if i % (k + 2) == 0]


@query(f"WITH v(model, feature) AS (VALUES {', '.join(str(x) for x in _VOTES)}) SELECT feature, count(DISTINCT model) AS n_models FROM v GROUP BY feature HAVING count(DISTINCT model) >= 2")
def rfe_consensus(spark, d):
    return sc.consensus(spark.createDataFrame(_VOTES, "model string, feature string"), 3, "majority")


@query()
def selection_pipeline(spark, d):
    config = {
        "unsupervised": {"least_variance": 1e-6, "above": 0.9},
        "supervised": {"corr_percentile": 85, "mi_percentile": 80},
        "method": "mrmr",
        "options": {"k": 12},
        "rfe": {"models": ["RandomForest", "XGBoost"], "keep": 6, "step": 6, "folds": 2, "trees": 5, "depth": 3, "rule": "majority"},
    }
    return spark.createDataFrame([(i,) for i in sc.selection_pipeline(vectors(spark, d), config)], "idx int")


# ------------------------------------------------------------------ folds, scaling, metrics
@query(
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.2) AS q1, quantile_cont(p_retailprice, 0.4) AS q2, quantile_cont(p_retailprice, 0.6) AS q3, quantile_cont(p_retailprice, 0.8) AS q4 FROM part)
    SELECT CAST((p_retailprice > q1)::INT + (p_retailprice > q2)::INT + (p_retailprice > q3)::INT + (p_retailprice > q4)::INT AS INTEGER) AS bin, count(*) AS n FROM part, q GROUP BY 1"""
)
def qcut_bins(spark, d):
    p = t(spark, d, "part")
    edges = mo.quantile_edges(p, "p_retailprice", 5)
    return p.groupBy(mo.quantile_bin(edges, "p_retailprice").alias("bin")).agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.2) AS q1, quantile_cont(p_retailprice, 0.4) AS q2, quantile_cont(p_retailprice, 0.6) AS q3, quantile_cont(p_retailprice, 0.8) AS q4 FROM part),
    k AS (SELECT p_partkey AS id, CAST((p_retailprice > q1)::INT + (p_retailprice > q2)::INT + (p_retailprice > q3)::INT + (p_retailprice > q4)::INT AS INTEGER) AS bin, md5('42:' || p_partkey) AS key FROM part, q),
    h AS (SELECT *, (instr('0123456789abcdef', key[1]) - 1) % 4 * 16 + instr('0123456789abcdef', key[2]) - 1 AS part FROM k)
    SELECT id, bin, CAST((row_number() OVER (PARTITION BY bin, part ORDER BY key, id) + part) % 5 AS INTEGER) AS fold FROM h"""
)
def stratified_folds(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return mo.stratified_folds(p, "p_retailprice", 5).select("id", "bin", "fold")


@query(f"WITH {_CELLS}, m AS (SELECT idx, avg(value) AS m, stddev_pop(value) AS s FROM full_cells GROUP BY idx) SELECT id, idx, {rs('(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 'value')} FROM full_cells JOIN m USING (idx)")
def standardize(spark, d):
    return rounded(mo.standardized(sc.exploded(sc.imputed(vectors(spark, d))[0]), ["idx"]).select("id", "idx", "value"), "value")


@query(
    f"""WITH {_CELLS}, folds AS (SELECT id, idx, value, CAST(id % 5 AS INTEGER) AS fold FROM cells), o AS (SELECT unnest([0, 1, 2, 3, 4]) AS outer_fold),
    e AS (SELECT f.*, o.outer_fold, fold <> outer_fold AS train FROM folds f, o), m AS (SELECT outer_fold, idx, quantile_cont(value, 0.5) AS m FROM e WHERE train GROUP BY ALL)
    SELECT e.id, e.outer_fold AS "outer", e.idx, {rs("coalesce(e.value, m.m, 0)", "value", 6)}, e.train FROM e LEFT JOIN m USING (outer_fold, idx)"""
)
def fold_median_fill(spark, d):
    cells = sc.exploded(vectors(spark, d)).withColumn("fold", (F.col("id") % 5).cast("int"))
    return rounded(mo.fold_median_fill(cells, 5), "value", n=6)


def _pred(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("y_true"), (F.col("l_quantity") * 0.8 + F.col("l_tax") * 50.0 + F.col("l_discount") * 20.0).alias("y_pred"))


_PRED = "pred AS (SELECT l_returnflag, l_linestatus, l_quantity AS t, l_quantity * 0.8 + l_tax * 50.0 + l_discount * 20.0 AS p FROM lineitem)"


def _metric_sql(by: str) -> str:
    return f"""WITH {_PRED}, m AS (SELECT {by}, avg(t) AS mt, avg(p) AS mp, var_pop(t) AS vt, var_pop(p) AS vp, covar_pop(t, p) AS c, avg((t - p) * (t - p)) AS mse, corr(t, p) AS r FROM pred GROUP BY {by}),
      k AS (SELECT *, c / vt AS a, mp - c / vt * mt AS b, sqrt(vt) AS st, sqrt(vp) AS sp FROM m)
      SELECT {by}, {rs("1 - mse / vt", "R2", 6)}, {rs("2 * r * st * sp / (vt + vp + (mt - mp) * (mt - mp) + 1e-10)", "CCC", 6)}, {rs("sqrt(mse)", "RMSE", 6)}, {rs("sqrt(mse) / mt * 100", "RRMSE", 6)},
        {rs("mp - mt", "MBE", 6)}, {rs("sqrt(greatest((a - 1) * (a - 1) * (vt + mt * mt) + 2 * (a - 1) * b * mt + b * b, 0)) / mt * 100", "PLA", 4)}, {rs("sqrt(greatest(vp - a * c, 0)) / mt * 100", "PLP", 4)},
        {rs("1 - sqrt((r - 1) * (r - 1) + (sp / (st + 1e-10) - 1) * (sp / (st + 1e-10) - 1) + (mp / (mt + 1e-10) - 1) * (mp / (mt + 1e-10) - 1))", "KGE", 6)} FROM k"""


def _rounded_metrics(df):
    return rounded(rounded(df, "R2", "CCC", "RMSE", "RRMSE", "MBE", "KGE", n=6), "PLA", "PLP")


@query(_metric_sql("l_returnflag"))
def metrics_by_group(spark, d):
    return _rounded_metrics(me.agreement(_pred(spark, d), ["l_returnflag"]))


@query(_metric_sql("l_returnflag, l_linestatus"))
def metrics_all(spark, d):
    return _rounded_metrics(me.agreement(_pred(spark, d), ["l_returnflag", "l_linestatus"]))


def _fold_values(spark, d):
    df = t(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 5).cast("int").alias("fold"), F.col("l_returnflag").alias("model"))
    return df.agg(F.avg("l_quantity").alias("RMSE"), F.avg("l_discount").alias("R2"))


_FOLDS = """fold_rows AS (SELECT CAST(l_linenumber % 5 AS INTEGER) AS fold, l_returnflag AS model, avg(l_quantity) AS RMSE, avg(l_discount) AS R2 FROM lineitem GROUP BY ALL),
    fold_long AS (SELECT fold, model, unnest(['RMSE', 'R2']) AS metric, unnest([RMSE, R2]) AS value FROM fold_rows)"""


@query(
    f"""WITH {_FOLDS}, m AS (SELECT model, metric, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END AS std FROM fold_long GROUP BY model, metric)
    SELECT model, metric, {rs("mean", n=6)}, {rs("std", n=6)}, printf('%.4f ± %.4f', mean, std) AS text FROM m"""
)
def results_summary(spark, d):
    return rounded(me.summary(me.melted(_fold_values(spark, d), ["fold", "model"], ("RMSE", "R2"))), "mean", "std", n=6)


@query(
    f"""WITH {_FOLDS}, b AS (SELECT model, avg(value) AS rmse FROM fold_long WHERE metric = 'RMSE' GROUP BY model ORDER BY rmse, model LIMIT 1)
    SELECT model, fold, {rs("rmse", n=6)}, {rs("value", "r2", 6)} FROM fold_long JOIN b USING (model) WHERE metric = 'R2' ORDER BY value DESC, fold LIMIT 1"""
)
def best_model_fold(spark, d):
    return rounded(me.best_fold(me.melted(_fold_values(spark, d), ["fold", "model"], ("RMSE", "R2"))), "rmse", "r2", n=6)


@query(
    """WITH o AS (SELECT l_linenumber AS fold, l_orderkey * 10 + l_linenumber AS id, l_quantity AS y_true, [l_quantity * 0.9, l_quantity + l_tax * 10, l_quantity * 1.05] AS preds FROM lineitem)
    SELECT fold, id, 'Ensemble' AS model, max(y_true) AS y_true, floor(((max(preds[1]) + max(preds[2]) + max(preds[3])) / 3 + 1e-8) * 1e4 + 0.5) / 1e4 + 0.0 AS y_pred FROM o GROUP BY fold, id"""
)
def ensemble_mean(spark, d):
    base = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("fold"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("y_true"), "l_tax")
    base = base.groupBy("fold", "id").agg(F.max("y_true").alias("y_true"), F.max(F.col("y_true") + F.col("l_tax") * 10).alias("b"))
    preds = F.array(
        *[F.struct(F.lit(m).alias("model"), p.alias("y_pred")) for m, p in (("a", F.col("y_true") * 0.9), ("b", F.col("b")), ("c", F.col("y_true") * 1.05))]
    )
    return rounded(me.ensemble(base.select("fold", "id", "y_true", F.inline(preds)), ["a", "b", "c"]), "y_pred")


@query(f"WITH {_PRED} SELECT l_returnflag, {rs('sqrt(avg((t - p) * (t - p)))', 'rmse', 6)}, {rs('1.96 * sqrt(avg((t - p) * (t - p)))', 'interval_95', 6)}, {rs('0.1 * avg(t)', 'tenth', 6)}, {rs('0.2 * avg(t)', 'fifth', 6)} FROM pred GROUP BY l_returnflag")
def prediction_bands(spark, d):
    return rounded(me.bands(_pred(spark, d), ["l_returnflag"]), "rmse", "interval_95", "tenth", "fifth", n=6)


@query(f"WITH {_CELLS} SELECT idx, {rs('abs(coalesce(corr(value, y), 0))', 'importance', 6)} FROM full_cells GROUP BY idx ORDER BY abs(coalesce(corr(value, y), 0)) DESC, idx LIMIT 15")
def top_importance(spark, d):
    df = sc.target_correlations(sc.imputed(vectors(spark, d))[0]).select("idx", F.abs("r").alias("importance"))
    return rounded(me.top(df, "importance", "idx", 15), "importance", n=6)


@query("SELECT p_type AS feature, count(DISTINCT p_size % 5) AS n_folds FROM part GROUP BY p_type")
def feature_stability(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.count_distinct(F.col("p_size") % 5).alias("n_folds"))


# ------------------------------------------------------------------ sweeps
_PERIOD_NAMES = [p for p, _, _ in _WEEKS]
_RUNS = f"""{_EVENTS}, {_WEEK_W}, runs AS (SELECT a.ord AS start_ord, a.period AS start_period, b.ord AS end_ord, b.period AS end_period, CAST(b.ord - a.ord + 1 AS INTEGER) AS n_periods FROM w a JOIN w b ON a.ord <= b.ord),
    results AS (SELECT runs.*, feature AS model, avg(value) AS value FROM runs JOIN w a ON a.ord = start_ord JOIN w b ON b.ord = end_ord JOIN events_d ON date BETWEEN a.lo AND b.hi GROUP BY ALL)"""


def _run_windows(spark):
    """Contiguous runs with their first and last day."""
    w = weeks(spark)
    first, last = w.select(F.col("ord").alias("start_ord"), "lo"), w.select(F.col("ord").alias("end_ord"), "hi")
    return sw.runs(w.select("ord", "period")).join(F.broadcast(first), "start_ord").join(F.broadcast(last), "end_ord")


def _results(spark, d):
    """A value of every run and channel: the mean over the run's days, all runs in one pass over the events."""
    runs = F.broadcast(_run_windows(spark))
    hit = events(spark, d).join(runs, F.col("date").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("start_ord", "start_period", "end_ord", "end_period", "n_periods", F.col("feature").alias("model")).agg(F.avg("value").alias("value"))


@query(f"WITH {_RUNS} SELECT start_period, end_period, n_periods, model, {rs('value', n=6)} FROM results")
def sweep_run(spark, d):
    """The resumable sweep itself: half of the runs are done, then the rest."""
    path = f"{shared_dir(spark)}/tidespan_sweep_{uuid.uuid4().hex}"
    rows = events(spark, d)

    def one(run: dict) -> DataFrame:
        inside = rows.where(F.col("date").between(F.lit(run["lo"]), F.lit(run["hi"])))
        return inside.groupBy(F.col("feature").alias("model")).agg(F.avg("value").alias("value")).withColumn("n_periods", F.lit(run["n_periods"]))

    todo = _run_windows(spark)
    sw.sweep(todo.where("n_periods <= 2"), path, one)
    return rounded(sw.sweep(todo, path, one).select("start_period", "end_period", "n_periods", "model", "value"), "value", n=6)


@query(f"WITH {_RUNS} SELECT * FROM runs")
def contiguous_runs(spark, d):
    return sw.runs(weeks(spark).select("ord", "period")).select("start_ord", "start_period", "end_ord", "end_period", "n_periods")


@query(f"WITH {_RUNS} SELECT start_period, {', '.join(rs(f'''avg(CASE WHEN end_period = '{p}' THEN value END)''', f'{p}', 6) for p in _PERIOD_NAMES)} FROM results GROUP BY start_period")
def sweep_pivot(spark, d):
    return rounded(sw.pivoted(_results(spark, d), _PERIOD_NAMES, "value"), *_PERIOD_NAMES, n=6)


@query(
    f"""WITH {_RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY start_period, end_period ORDER BY value DESC, model) AS k FROM results)
    SELECT start_period, end_period, model AS best_model, {rs("value", "best_value", 6)} FROM n WHERE k = 1"""
)
def best_per_run(spark, d):
    return rounded(sw.best_per_run(_results(spark, d)), "best_value", n=6)


@query(f"WITH {_RUNS} SELECT n_periods, {rs('avg(value)', 'mean', 6)}, {rs('stddev_pop(value)', 'std', 6)} FROM results GROUP BY n_periods")
def sweep_by_length(spark, d):
    return rounded(sw.by_length(_results(spark, d)), "mean", "std", n=6)


@query(f"WITH {_RUNS} SELECT start_period, {rs('avg(value)', 'mean', 6)} FROM results GROUP BY start_period")
def sweep_by_start(spark, d):
    return rounded(sw.by_start(_results(spark, d)), "mean", n=6)


# ------------------------------------------------------------------ models
@query()
def nested_cv_small(spark, d):
    models = {"ElasticNet": mo.candidates("ElasticNet", {"alpha": [0.01, 0.1], "l1_ratio": [0.25, 0.75]}), "RandomForest": [{"n_estimators": 10, "max_depth": 5}, {"n_estimators": 10, "max_depth": 3}]}
    return mo.score(mo.nested_cv(vectors(spark, d), models, outer=3, inner=2, repeats=2))


@query()
def stacking_small(spark, d):
    """The stack of a forest and boosted trees (smaller ones than the defaults)."""
    bases = {"RandomForest": {"n_estimators": 20, "max_depth": 5}, "LightGBM": {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0}}
    models = {"Ridge": [{"alpha": 1.0}]}
    return mo.nested_cv(vectors(spark, d), models, outer=3, inner=3, repeats=1, stacking=True, stack={"bases": bases, "splits": 3}).where("model = 'Stacking'")


@query(f"WITH {_EVENTS} SELECT feature, {rs('coalesce(corr(value, dayofmonth(date)), 0)', 'r', 6)} FROM events_d GROUP BY feature")
def day_correlation(spark, d):
    return events(spark, d).groupBy("feature").agg(r(corr0("value", F.dayofmonth("date").cast("double")), 6).alias("r"))
