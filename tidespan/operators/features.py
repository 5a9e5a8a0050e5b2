"""Feature algebra over long rows (key, ord, period, feature, stat, value): pairs, agronomy, phenology, dispatcher."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_least, clip, eps_ratio
from .series import changes, seasonal

#: Which statistic stands for a weather variable, first that exists.
WEATHER_PRIORITY = ("mean", "sum", "")
#: Name parts of critical periods.
CRITICAL_PARTS = ("peak", "p1", "p2", "m1", "m2", "m3", "m4", "heading", "grain", "anthesis", "booting", "elongation")


def pairs(long: DataFrame, wanted: list[tuple[str, str]], how: str, keys: list[str], stat: str = "mean") -> DataFrame:
    """Combine two features of the same keys: how is ratio (b1 / (|b2| + eps), within 100) or product.

    One pass: a feature is copied to every pair that it takes part in, and each pair meets in one aggregate.  Pairs
    with a missing side drop out.
    """
    name = {"ratio": "{}_div_{}", "product": "{}_x_{}"}[how]
    table = [F.struct(F.lit(name.format(a, b)).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted]
    sides = sorted({x for p in wanted for x in p})
    rows = long.where((F.col("stat") == stat) & F.col("feature").isin(*sides))
    each = rows.select(*keys, "feature", "value", F.inline(F.array(*table))).where("feature = a or feature = b")
    met = each.groupBy(*keys, "pair").agg(
        F.max(F.when(F.col("feature") == F.col("a"), F.col("value"))).alias("x"), F.max(F.when(F.col("feature") == F.col("b"), F.col("value"))).alias("y")
    )
    value = clip(eps_ratio("x", "y"), -100, 100) if how == "ratio" else F.col("x") * F.col("y")
    return met.where("x is not null and y is not null").select(*keys, F.col("pair").alias("feature"), value.alias("value"))


def with_priority(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One value per weather variable: of its mean, sum or bare column the first that exists, as stat `mean`."""
    rank = F.coalesce(*[F.when(F.col("stat") == s, F.lit(i)) for i, s in enumerate(WEATHER_PRIORITY)])
    rows = long.where(F.col("feature").isin(*names)).withColumn("_r", rank).where("_r is not null")
    return rows.groupBy(*keys, "feature").agg(F.min_by("value", "_r").alias("value")).withColumn("stat", F.lit("mean"))


def weather_pairs(long: DataFrame, left: list[str], weather: list[str], keys: list[str]) -> DataFrame:
    """Products of left features with weather variables chosen by priority."""
    both = long.where(F.col("feature").isin(*left) & (F.col("stat") == "mean")).select(*keys, "feature", "stat", "value")
    both = both.unionByName(with_priority(long, keys, weather).select(*keys, "feature", "stat", "value"))
    return pairs(both, [(a, b) for a in left for b in weather], "product", keys)


def static_pairs(long: DataFrame, static: DataFrame, left: list[str], props: list[str], keys: list[str], entity: str) -> DataFrame:
    """Products of left features with static properties of the entity (static: one row per entity, wide)."""
    rows = long.where(F.col("feature").isin(*left)).groupBy(*keys, "feature").agg(F.max(F.when(F.col("stat") == "mean", F.col("value"))).alias("value"))
    wide = static.select(entity, F.inline(F.array(*[F.struct(F.lit(p).alias("prop"), F.col(p).cast("double").alias("level")) for p in props])))
    both = rows.where("value is not null").join(wide.where("level is not null"), entity)
    return both.select(*keys, F.concat_ws("_x_", "feature", "prop").alias("feature"), (F.col("value") * F.col("level")).alias("value"))


def agronomic(long: DataFrame, keys: list[str], hot: float = 30.0) -> DataFrame:
    """aridity, water_deficit and heat_stress from summed precipitation and evaporation and mean greatest heat."""
    take = lambda f, s: F.max(F.when((F.col("feature") == f) & (F.col("stat") == s), F.col("value")))
    wide = long.groupBy(*keys).agg(take("precip", "sum").alias("p"), take("pet", "sum").alias("e"), take("t2m_max", "mean").alias("t"))
    out = F.array(
        F.struct(F.lit("aridity").alias("feature"), eps_ratio("p", "e").alias("value")),
        F.struct(F.lit("water_deficit").alias("feature"), (F.col("e") - F.col("p")).alias("value")),
        F.struct(F.lit("heat_stress").alias("feature"), at_least(F.col("t") - hot, 0.0).alias("value")),
    )
    return wide.select(*keys, F.inline(out)).where("value is not null")


def phenology(params: DataFrame, key: str) -> DataFrame:
    """Named traits of the fitted curve."""
    m = {i: F.col(f"m{i}") for i in range(1, 8)}
    return params.select(
        key,
        m[1].alias("pheno_baseline"),
        m[2].alias("pheno_amplitude"),
        m[4].alias("pheno_greenup_steepness"),
        m[6].alias("pheno_senescence_steepness"),
        m[3].alias("pheno_greenup_inflection"),
        m[5].alias("pheno_senescence_inflection"),
        (m[5] - m[3]).alias("pheno_season_length"),
        m[7].alias("pheno_trend"),
        F.try_divide(m[4], m[6] + 1e-6).alias("pheno_greenup_senescence_ratio"),
    )


def is_critical(period: str, parity: bool = False) -> bool:
    """Whether a period's name marks it as critical.  By default a part must be a whole word of the name (so bw_m10
    isn't m1); parity takes any substring."""
    if parity:
        return any(p in period for p in CRITICAL_PARTS)
    parts = set(period.split("_"))
    return any(p in parts for p in CRITICAL_PARTS)


def critical_periods(periods: list[str], parity: bool = False) -> list[str]:
    """The critical ones of ordered period names, the last three if none is."""
    return [p for p in periods if is_critical(p, parity)] or periods[-3:]


#: How names of derived columns look.
DERIVED = re.compile(r"_(change|ratio|roc)$|_div_|_x_|_(aridity|heat_stress)$|^pheno_|_seasonal_")


def kind_of(name: str, parity: bool = False) -> str:
    """raw or derived, by name; parity also counts the aggregated raw water deficit as derived."""
    return "derived" if DERIVED.search(name) or (parity and "_water_deficit" in name) else "raw"


def raw_only(long: DataFrame, kind: str = "kind") -> DataFrame:
    return long.where(F.col(kind) == "raw")


def period_subset(long: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of a contiguous run of periods, and those without a period (static)."""
    return long.where(F.col("ord").between(first, last) | F.col("ord").isNull())


def engineer_all(long: DataFrame, config: dict, key: str, periods: list[str], static: DataFrame | None = None, params: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """All derived features of the configuration as rows (key, ord, period, feature, value).

    config keys: derivatives (bool), ratios, products (pairs), agronomic (bool), static {left, props}, weather {left,
    vars}, band_vi, band_soil, band_weather, weather_soil (same shapes; absent ones are off), seasonal (features).
    """
    keys = [key, "ord", "period"]
    critical = long.where(F.col("period").isin(*critical_periods(periods, parity)))
    out: list[DataFrame] = []
    if config.get("derivatives"):
        moved = changes(long.where("stat = 'mean'"), [key, "feature"])
        kinds = F.array(*[F.struct(F.concat_ws("_", "feature", F.lit(k)).alias("feature"), F.col(k).alias("value")) for k in ("change", "ratio", "roc")])
        out.append(moved.select(*keys, F.inline(kinds)))
    if config.get("ratios"):
        out.append(pairs(long, config["ratios"], "ratio", keys))
    if config.get("products"):
        out.append(pairs(long, config["products"], "product", keys))
    if config.get("agronomic"):
        out.append(agronomic(long, keys))
    for name in ("static", "band_soil"):
        if static is not None and (c := config.get(name)):
            out.append(static_pairs(critical, static, c["left"], c["props"], keys, key))
    for name in ("weather", "band_weather"):
        if c := config.get(name):
            out.append(weather_pairs(critical, c["left"], c["vars"], keys))
    if c := config.get("band_vi"):
        out.append(pairs(critical, [(a, b) for a in c["left"] for b in c["vars"]], "product", keys))
    if static is not None and (c := config.get("weather_soil")):
        out.append(static_pairs(with_priority(critical, keys, c["left"]), static, c["left"], c["props"], keys, key))
    none = {"ord": F.lit(None).cast("int"), "period": F.lit(None).cast("string")}
    if params is not None:
        wide = phenology(params, key)
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in wide.columns if c != key])
        out.append(wide.select(key, F.inline(rows)).withColumns(none).select(*keys, "feature", "value"))
    if config.get("seasonal"):
        flat = seasonal(long.where(F.col("feature").isin(*config["seasonal"][:10]) & (F.col("stat") == "mean")), [key, "feature"], len(periods))
        rows = F.array(*[F.struct(F.concat(F.col("feature"), F.lit(f"_seasonal_{k}")).alias("feature"), F.col(k).alias("value")) for k in ("cv", "range", "slope")])
        out.append(flat.select(key, F.inline(rows)).withColumns(none).select(*keys, "feature", "value"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def feature_name(period: Column, feature: Column, stat: Column | None = None) -> Column:
    return F.concat_ws("_", period, feature, *([stat] if stat is not None else []))
