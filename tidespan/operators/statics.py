"""Joins of entity-level tables: static attributes, terrain, county lookup, key sets, finished keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_target(static: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return static.join(target, key)


def left_without_clashes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; columns that left already has are dropped from right."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key, "left")


def merge_static(static: DataFrame, target: DataFrame, terrain: DataFrame | None, key: str) -> DataFrame:
    out = with_target(static, target, key)
    return out if terrain is None else left_without_clashes(out, terrain, key)


def with_samples(fields: DataFrame, samples: DataFrame, key: str, prefix: str = "sample_") -> DataFrame:
    """Left join of sample-level columns, all renamed with the prefix."""
    return fields.join(samples.select(key, *[F.col(c).alias(prefix + c) for c in samples.columns if c != key]), key, "left")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_names(wanted: list[str], df: DataFrame) -> list[str]:
    have = set(df.columns)
    return [c for c in dict.fromkeys(wanted) if c not in have]


def unfinished(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys aren't finished: what a resumed run still has to do."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies in the polygon (array of lon, lat; closed or not): an odd number of edges cross the
    ray to its east."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > y) != (b["lat"] > y)
        at = a["lon"] + F.try_divide((y - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return F.coalesce(spans & (x < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def locate(points: DataFrame, areas: DataFrame, lon: str, lat: str, ring: str = "ring") -> DataFrame:
    """Left join of points with the areas that hold them.

    Grid cells of one degree are the join key (an area is listed under every cell of its bounding box), so no pair
    outside a shared cell is made; bounding box and polygon are then tested.
    """
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    box = areas.withColumns({"_x0": F.array_min(lons), "_x1": F.array_max(lons), "_y0": F.array_min(lats), "_y1": F.array_max(lats)})
    cells = box.withColumn("_cx", F.explode(F.sequence(F.floor("_x0"), F.floor("_x1")))).withColumn("_cy", F.explode(F.sequence(F.floor("_y0"), F.floor("_y1"))))
    here = points.withColumns({"_px": F.floor(lon), "_py": F.floor(lat)})
    on = (
        (F.col("_px") == F.col("_cx"))
        & (F.col("_py") == F.col("_cy"))
        & F.col(lon).between(F.col("_x0"), F.col("_x1"))
        & F.col(lat).between(F.col("_y0"), F.col("_y1"))
        & inside_ring(F.col(lon), F.col(lat), F.col(ring))
    )
    return here.join(cells, on, "left").drop("_x0", "_x1", "_y0", "_y1", "_cx", "_cy", "_px", "_py", ring)


def fill_counties(fields: DataFrame, counties: DataFrame, lon: str = "centroid_lon", lat: str = "centroid_lat", parity: bool = False) -> DataFrame:
    """County and state of fields without a county, from the polygon that holds the centroid.  An existing state
    stays; parity overwrites it."""
    found = locate(fields, counties.select("NAME", "STATE_NAME", "ring"), lon, lat)
    lacking = F.col("county").isNull()
    state = F.coalesce("STATE_NAME", "state") if parity else F.coalesce("state", "STATE_NAME")
    return found.withColumn("state", F.when(lacking, state).otherwise(F.col("state"))).withColumn("county", F.coalesce("county", "NAME")).drop("NAME", "STATE_NAME")
