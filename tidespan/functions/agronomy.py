"""Agronomic formulas as Column expressions: weather, soil water, spectral indices, growth curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import at_least, clip, col, safe_div


# ---- weather
def saturation_vapour_pressure(t: Column | str) -> Column:
    """kPa at t degrees Celsius (Tetens)."""
    c = col(t)
    return F.exp(c * 17.27 / (c + 237.3)) * 0.6108


def vapour_pressure_deficit(t_mean: Column | str, dewpoint: Column | str) -> Column:
    return at_least(saturation_vapour_pressure(t_mean) - saturation_vapour_pressure(dewpoint), 0.0)


def growing_degree_days(t_max: Column | str, t_min: Column | str, base: float = 0.0) -> Column:
    return at_least((col(t_max) + col(t_min)) / 2 - base, 0.0)


def with_derived_weather(df: DataFrame, base: float = 0.0) -> DataFrame:
    """Add vpd, gdd and water_deficit as far as their inputs are there."""
    have = set(df.columns)
    if {"t2m_mean", "dewpoint"} <= have:
        df = df.withColumn("vpd", vapour_pressure_deficit("t2m_mean", "dewpoint"))
    if {"t2m_max", "t2m_min"} <= have:
        df = df.withColumn("gdd", growing_degree_days("t2m_max", "t2m_min", base))
    if {"pet", "precip"} <= have:
        df = df.withColumn("water_deficit", F.col("pet") - F.col("precip"))
    return df


def kelvin_to_celsius(t: Column | str) -> Column:
    return col(t) - 273.15


def metres_to_mm(x: Column | str) -> Column:
    return F.abs(col(x) * 1000.0)


# ---- soil water
#: Coefficients of Saxton and Rawls (2006) for sand, clay, organic matter, sand*om, clay*om,
#: sand*clay and the constant.
SOIL_TERMS = {
    "wilting": (-0.024, 0.487, 0.006, 0.005, -0.013, 0.068, 0.031),
    "field": (-0.251, 0.195, 0.011, 0.006, -0.027, 0.452, 0.299),
    "saturated": (0.278, 0.034, 0.022, -0.018, -0.027, -0.584, 0.078),
}
SOIL_OUTPUTS = ("LL15", "DUL", "SAT", "BD", "KSAT", "AWC", "SWCON", "lambda", "B", "psi_e", "PAW_mm_cm")


def _guarded_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def with_soil_water(df: DataFrame, sand: str, clay: str, om: str, prefix: str = "saxton_") -> DataFrame:
    """Add eleven soil water characteristics from texture and organic matter in percent; all null if any is null."""
    s, c, o = (F.when(F.col(sand).isNotNull() & F.col(clay).isNotNull() & F.col(om).isNotNull(), F.col(x) / 100.0) for x in (sand, clay, om))
    df = df.withColumns({"_s": s, "_c": c, "_o": o})
    s, c, o = F.col("_s"), F.col("_c"), F.col("_o")
    terms = (s, c, o, s * o, c * o, s * c, F.lit(1.0))
    raw = {f"_{name}": sum((t * k for t, k in zip(terms, ks, strict=True)), F.lit(0.0)) for name, ks in SOIL_TERMS.items()}
    df = df.withColumns(raw)
    w, f, d = F.col("_wilting"), F.col("_field"), F.col("_saturated")
    df = df.withColumns({"_t1500": w + (w * 0.14 - 0.02), "_t33": f + (f * f * 1.283 - f * 0.374 - 0.015), "_ts33": d + (d * 0.636 - 0.107)})
    low, dul, gap = F.col("_t1500"), F.col("_t33"), F.col("_ts33")
    df = df.withColumn("_sat", dul + gap - s * 0.097 + 0.043)
    slope = (_guarded_ln(dul) - _guarded_ln(low)) / (F.ln(F.lit(33.0)) - F.ln(F.lit(1500.0)))
    df = df.withColumn("_lam", at_least(slope, 0.01))
    room = F.col("_sat") - dul
    df = df.withColumn("_ksat", F.when(room > 0, F.pow(room, F.lit(3.0) - F.col("_lam")) * 1930.0))
    out = {
        "LL15": low,
        "DUL": dul,
        "SAT": F.col("_sat"),
        "BD": (F.lit(1.0) - F.col("_sat")) * 2.65,
        "KSAT": F.col("_ksat"),
        "AWC": dul - low,
        "SWCON": F.when(F.col("_ksat").isNotNull(), F.least(F.col("_ksat"), F.lit(75.0)) / 100.0 + 0.15),
        "lambda": F.col("_lam"),
        "B": F.lit(1.0) / F.col("_lam"),
        "psi_e": s * -21.67 - c * 27.93 - gap * 81.97 + s * gap * 71.12 + c * gap * 8.29 + s * c * 14.05 + 27.16,
        "PAW_mm_cm": (dul - low) * 10.0,
    }
    return df.withColumns({prefix + k: v for k, v in out.items()}).drop(*[x for x in ("_s", "_c", "_o", *raw, "_t1500", "_t33", "_ts33", "_sat", "_lam", "_ksat")])


# ---- reflectance and spectral indices
#: Scene classes that are no clear ground.
BAD_CLASSES = (0, 1, 2, 3, 8, 9, 10, 11)
BANDS = ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12")


#: The names of the indices.
INDEX_NAMES = (
    "NDVI",
    "EVI2",
    "GNDVI",
    "NDRE",
    "CIre",
    "IRECI",
    "NDWI",
    "MSI",
    "GCVI",
    "MNDWI",
    "NBR",
    "NBR2",
    "GVI",
    "DGCI",
    "NDSWIR1RedEdge1",
    "TCARI",
    "OSAVI",
    "CCCI",
    "mARI",
    "ExG",
    "DBSI",
    "SMMI",
    "MIRBI",
    "CVI",
    "S2REP",
    "PVI",
    "MTCI",
    "SAVI",
    "NDRE2",
    "RE_ratio",
    "PSRI",
    "LSWI",
)


def reflectance(x: Column | str) -> Column:
    return clip(col(x) * 1e-4, 0.0, 1.0)


def clear_pixels(df: DataFrame, scene_class: str = "scl") -> DataFrame:
    return df.where(~F.col(scene_class).isin(*BAD_CLASSES))


def _contrast(a: Column, b: Column) -> Column:
    return safe_div(a - b, a + b)


def index_table() -> dict[str, tuple[Column, float, float]]:
    """The 32 indices over columns named as BANDS: formula and the range that it is clamped to."""
    b2, b3, b4, b5, b6, b7, b8, b8a, b11, b12 = (F.col(b) for b in BANDS)
    # Published index formulas with their ranges.
    return {
        "NDVI": (_contrast(b8, b4), -1, 1),
        "EVI2": (safe_div((b8 - b4) * 2.5, b8 + b4 * 2.4 + 1.0), -1, 3),
        "GNDVI": (_contrast(b8, b3), -1, 1),
        "NDRE": (_contrast(b8a, b5), -1, 1),
        "CIre": (safe_div(b8a, b5) - 1.0, -1, 20),
        "IRECI": (safe_div(b7 - b4, safe_div(b5, b6)), -50, 50),
        "NDWI": (_contrast(b8, b11), -1, 1),
        "MSI": (safe_div(b11, b8), 0, 10),
        "GCVI": (safe_div(b8, b3) - 1.0, -1, 20),
        "MNDWI": (_contrast(b3, b11), -1, 1),
        "NBR": (_contrast(b8, b12), -1, 1),
        "NBR2": (_contrast(b11, b12), -1, 1),
        "GVI": (b3 * -0.2848 - b4 * 0.2435 + b8 * 0.5436 + b11 * 0.7243 + b12 * 0.0840, -1, 1),
        "DGCI": ((F.lit(1.0) - safe_div(b3 - b4, b3 + b4 + b2)) / 3.0, 0, 1),
        "NDSWIR1RedEdge1": (_contrast(b5, b11), -1, 1),
        "TCARI": ((b5 - b4) * 3.0 - (b5 - b3) * 0.2 * safe_div(b5, b4), -10, 10),
        "OSAVI": (safe_div((b8 - b4) * 1.16, b8 + b4 + 0.16), -1, 2),
        "CCCI": (F.try_divide(clip(_contrast(b8a, b5), -1, 1), _contrast(b8a, b4) + 1e-6), -5, 5),
        "mARI": ((safe_div(F.lit(1.0), b3) - safe_div(F.lit(1.0), b5)) * b8, -5, 20),
        "ExG": (safe_div(b3 * 2.0 - b4 - b2, b2 + b3 + b4 + 1e-6), -2, 2),
        "DBSI": (_contrast(b11, b3) - _contrast(b8, b4), -2, 2),
        "SMMI": (_contrast(b8a, b11), -1, 1),
        "MIRBI": (b12 * 10.0 - b11 * 9.8 + 2.0, -50, 50),
        "CVI": (safe_div(b8 * b4, b3 * b3 + 1e-6), 0, 50),
        "S2REP": (safe_div((b4 + b7) / 2.0 - b5, b6 - b5 + 1e-6) * 35.0 + 705.0, 700, 750),
        "PVI": ((b8 - b4 * 0.355 - 0.149) / 1.061, -1, 1),
        "MTCI": (safe_div(b6 - b5, b5 - b4 + 1e-6), -30, 30),
        "SAVI": (safe_div(b8 - b4, b8 + b4 + 0.5) * 1.5, -1, 3),
        "NDRE2": (_contrast(b7, b5), -1, 1),
        "RE_ratio": (safe_div(b7, b5), 0, 10),
        "PSRI": (safe_div(b4 - b2, b6 + 1e-6), -10, 10),
        "LSWI": (_contrast(b8, b11), -1, 1),
    }


def spectral_indices() -> dict[str, Column]:
    """Each index clamped to its range.  Many in one projection need spark.sql.codegen.hugeMethodLimit=8000: a longer
    generated method is only interpreted by the JVM, ten times slower than the plan without whole-stage code."""
    return {name: clip(x, lo, hi) for name, (x, lo, hi) in index_table().items()}


# ---- growth curve
def double_logistic(t: Column, m: list[Column]) -> Column:
    """m1 + (m2 - m7 t)(rise - fall) with logistic rise at m3 (rate m4) and fall at m5 (rate m6)."""
    step = lambda at, rate: F.lit(1.0) / (F.exp((at - t) / (rate + 1e-8)) + 1.0)
    return m[0] + (m[1] - m[6] * t) * (step(m[2], m[3]) - step(m[4], m[5]))
