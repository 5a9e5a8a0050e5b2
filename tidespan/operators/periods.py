"""Period windows as small control tables, and the overlap-safe aggregation of series over them."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.agronomy import INDEX_NAMES
from ..functions.scalars import col, finite, quantile, std_or_zero

# Stages of days around the peak, and calendar stages.
PHENOLOGICAL = {
    "tillering": (-120, -75),
    "stem_elongation": (-75, -40),
    "booting": (-40, -15),
    "heading_anthesis": (-15, 10),
    "grain_filling": (10, 40),
    "maturity": (40, 70),
}
PEAK_STAGES = {"cp1": (-300, -121), "cp2": (-120, -60), "cp3": (-59, -14), "cp4": (-15, 15), "cp5": (16, 36)}
CUSTOM = {
    "cp1": ("2024-07-01", "2024-12-31"),
    "cp2": ("2025-01-01", "2025-02-28"),
    "cp3": ("2025-03-01", "2025-04-15"),
    "cp4": ("2025-04-16", "2025-05-15"),
    "cp5": ("2025-05-16", "2025-06-30"),
}
SEASON_START = (2024, 7)

RELATIVE_MODES = ("biweekly", "monthly", "phenological", "peak_stages")
DATE_MODES = ("custom", "calendar_monthly", "calendar_biweekly")


def stepped(prefix: str, peak: tuple[int, int], step: int, before: int, after: int) -> list[tuple[str, int, int]]:
    """Equal windows that adjoin the peak window on both sides, earliest first."""
    early = [(f"{prefix}_m{i}", peak[0] - i * step, peak[0] - (i - 1) * step - 1) for i in range(before, 0, -1)]
    late = [(f"{prefix}_p{i}", peak[1] + (i - 1) * step + 1, peak[1] + i * step) for i in range(1, after + 1)]
    return [*early, (f"{prefix}_peak", *peak), *late]


def months(start: tuple[int, int] = SEASON_START, n: int = 12) -> list[tuple[str, date, date]]:
    out = []
    for i in range(n):
        y, m = divmod(start[0] * 12 + start[1] - 1 + i, 12)
        first = date(y, m + 1, 1)
        out.append((first.strftime("%b").lower(), first, date(y, m + 1, monthrange(y, m + 1)[1])))
    return out


def half_months(start: tuple[int, int] = SEASON_START, n: int = 12) -> list[tuple[str, date, date]]:
    return [w for name, lo, hi in months(start, n) for w in ((f"{name}_1", lo, lo + timedelta(14)), (f"{name}_2", lo + timedelta(15), hi))]


def parsed(stages: dict[str, tuple[str, str]]) -> list[tuple[str, date, date]]:
    return [(name, date.fromisoformat(a), date.fromisoformat(b)) for name, (a, b) in stages.items()]


def window_rows(mode: str, config: dict | None = None) -> list[tuple]:
    """(period, lo, hi) in order; days for the relative modes, dates for the others.  config overrides a mode's
    own settings (peak_window, step, n_before, n_after, or stages)."""
    c = (config or {}).get(mode, {})
    if mode == "biweekly":
        return stepped("bw", tuple(c.get("peak_window", (-7, 7))), c.get("step", 15), c.get("n_before", 18), c.get("n_after", 5))
    if mode == "monthly":
        return stepped("mo", tuple(c.get("peak_window", (-15, 15))), c.get("step", 30), c.get("n_before", 9), c.get("n_after", 3))
    if mode in ("phenological", "peak_stages"):
        own = PHENOLOGICAL if mode == "phenological" else PEAK_STAGES
        return [(k, *v) for k, v in c.get("stages", own).items()]
    if mode in DATE_MODES and "stages" in c:
        return parsed(c["stages"])
    if mode == "custom":
        return parsed(CUSTOM)
    if mode == "calendar_monthly":
        return months()
    if mode == "calendar_biweekly":
        return half_months()
    raise ValueError(f"unknown aggregation mode: {mode}")


def windows(spark: SparkSession, mode: str, config: dict | None = None) -> DataFrame:
    """ord, period, lo, hi: at most a few dozen rows, so joins may broadcast it."""
    kind = "int" if mode in RELATIVE_MODES else "date"
    return window_table(spark, window_rows(mode, config), kind)


def window_table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, period string, lo {kind}, hi {kind}")


def relative_days(series: DataFrame, anchors: DataFrame, key: str, day: str, anchor: str, name: str = "normalized_day", carry: tuple[str, ...] = ()) -> DataFrame:
    """Days since the entity's anchor; entities without one drop out.  carry: further columns of anchors to keep."""
    known = anchors.where(F.col(anchor).isNotNull()).select(key, anchor, *carry)
    return series.join(known, key).withColumn(name, F.datediff(day, anchor))


STATS = ("mean", "sum", "min", "max", "std", "p10", "p90", "range", "cv", "slope")


def statistic(name: str, x: Column | str, position: Column | str = "_pos") -> Column:
    """One aggregate; values that are null or not finite don't count, and no value at all gives null."""
    v = finite(x)
    simple = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": std_or_zero}
    if name in simple:
        return simple[name](v)
    if name in ("p10", "p90"):
        return quantile(v, int(name[1:]) / 100)
    if name == "range":
        return F.max(v) - F.min(v)
    if name == "cv":
        return std_or_zero(v) / (F.abs(F.avg(v)) + 1e-6)
    if name == "slope":
        return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.regr_slope(v, F.when(v.isNotNull(), col(position))))
    raise ValueError(f"unknown statistic: {name}")


def in_periods(series: DataFrame, control: DataFrame, axis: str) -> DataFrame:
    """A row of series for every window that holds it (both ends included); windows may overlap.

    Days and dates are whole numbers, so the windows are written out by day (a few thousand rows) and a row finds its
    windows in a broadcast hash table instead of trying every one.
    """
    step = "1" if dict(control.dtypes)["lo"] == "int" else "interval 1 day"
    days = control.where("lo <= hi").withColumn("_day", F.explode(F.sequence("lo", "hi", F.expr(step))))
    return series.join(F.broadcast(days), F.col(axis) == F.col("_day")).drop("_day")


def aggregate(
    series: DataFrame, control: DataFrame, axis: str, keys: list[str], stats: list[str], value: str = "value", order: list[str] | None = None, cells: bool = False
) -> DataFrame:
    """Wide statistics per keys and period of a long series: keys, ord, period, one column per statistic.

    order: columns that put a cell's rows in order, needed for slope (position counts valid rows only).  cells adds
    the empty ones: every key of series with every period.
    """
    hit = in_periods(series, control, axis)
    group = [*keys, "ord", "period"]
    if "slope" in stats:
        w = Window.partitionBy(*group).orderBy(finite(value).isNull(), *(order or [axis]))
        hit = hit.withColumn("_pos", F.row_number().over(w).cast("double"))
    out = hit.groupBy(*group).agg(*[statistic(s, value).alias(s) for s in stats])
    if cells:
        every = series.select(*keys).distinct().join(F.broadcast(control.select("ord", "period")))
        out = every.join(out, group, "left")
    return out


def long_statistics(wide: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """keys, stat, value from one column per statistic."""
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats])))


def pivot_wide(long: DataFrame, key: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """One row per key and one column {period}_{feature}_{stat} for each of columns; only for sinks."""
    pick = lambda p, f, s: F.max(F.when((F.col("period") == p) & (F.col("feature") == f) & (F.col("stat") == s), F.col("value")))
    return long.groupBy(key).agg(*[pick(*c).alias("_".join(c)) for c in columns])


# ---- which statistics a feature gets
#: Feature types and their statistics.
TYPE_FEATURES = {
    "spectral_bands": ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"),
    "temperature": ("t2m_mean", "t2m_min", "t2m_max", "dewpoint"),
    "precipitation": ("precip",),
    "pet": ("pet",),
    "gdd": ("gdd",),
    "vpd": ("vpd",),
    "ssrd": ("ssrd_MJm2",),
}
TYPE_STATS = {
    "vegetation_indices": ("mean", "std", "p10", "p90"),
    "spectral_bands": ("mean",),
    "temperature": ("mean",),
    "precipitation": ("sum",),
    "pet": ("sum",),
    "gdd": ("sum",),
    "vpd": ("mean",),
    "ssrd": ("mean",),
    "unknown": ("mean",),
}


def feature_type(name: str) -> str:
    if name in INDEX_NAMES:
        return "vegetation_indices"
    return next((t for t, names in TYPE_FEATURES.items() if name in names), "unknown")


def routed(series: DataFrame, control: DataFrame, axis: str, keys: list[str], features: list[str], order: list[str] | None = None) -> DataFrame:
    """Long statistics of a long series (keys, feature, value): each feature gets the statistics of its type."""
    kinds = {f: feature_type(f) for f in features}
    used = sorted({s for f in features for s in TYPE_STATS[kinds[f]]})
    wide = aggregate(series.where(F.col("feature").isin(*features)), control, axis, [*keys, "feature"], used, order=order)
    rows = long_statistics(wide, [*keys, "ord", "period", "feature"], used)
    wanted = None
    for f in features:
        c = (F.col("feature") == f) & F.col("stat").isin(*TYPE_STATS[kinds[f]])
        wanted = c if wanted is None else wanted | c
    return rows.where(wanted)
