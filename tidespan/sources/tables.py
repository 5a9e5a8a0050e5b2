"""Scans with declared schemas, sinks and configuration."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.agronomy import BANDS, INDEX_NAMES
from ..functions.scalars import finite_columns

WEATHER = ("t2m_mean", "t2m_min", "t2m_max", "precip", "pet", "dewpoint", "ssrd_MJm2")
#: Raw names of terrain columns and what they become.
TERRAIN_NAMES = {"elev_mean": "elevation", "slope_mean": "slope", "aspect_mean": "aspect", "centroid_l": "centroid_lon", "centroid_1": "centroid_lat"}
TERRAIN_KEEP = ("elevation", "slope", "aspect", "elev_std", "elev_range")

#: Patterns of the daily files' names.
SPECTRAL_FILES, WEATHER_FILES = "*_daily_s2_*.csv", "*_daily_meteo_*.csv"

log = logging.getLogger("tidespan")


def setup_logging(level: int = logging.INFO) -> logging.Logger:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    return log


def daily_schema(columns: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([T.StructField("field_key", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in columns]])


SPECTRAL_SCHEMA = daily_schema([*INDEX_NAMES, *BANDS])
WEATHER_SCHEMA = daily_schema(WEATHER)


def _found(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, its first line) of all files that a path or pattern stands for (those inside, for a folder), by Spark's own
    file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, files = list(system.globStatus(p) or []), []
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += [x for x in system.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        else:
            files.append(s.getPath())
    out = []
    for f in files:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(f), "UTF-8"))
        try:
            out.append((f.toString(), reader.readLine() or ""))
        finally:
            reader.close()
    return sorted(out)


def read_daily_csv(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files of a pattern as one table: columns by header name, those a file lacks are null, values that aren't
    finite are null.  No file is an error.

    Files may order their columns differently; those of one header are one scan, however many they are."""
    files = _found(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    headers: dict[str, list[str]] = {}
    for name, header in files:
        headers.setdefault(header, []).append(name)
    raw = None
    for header, names in headers.items():
        columns = [c.strip().strip('"') for c in header.lstrip("\ufeff").split(",")]
        if len(set(columns)) < len(columns):
            raise ValueError(f"columns of the same name in {names[0]}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        part = spark.read.option("header", True).schema(text).csv(names)
        part = part.select(*[(F.col(f"`{c.name}`") if c.name in columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema.fields])
        raw = part if raw is None else raw.unionByName(part)
    return finite_columns(raw)


def read_spectral(spark: SparkSession, folder: str) -> DataFrame:
    return read_daily_csv(spark, f"{folder}/{SPECTRAL_FILES}", SPECTRAL_SCHEMA)


def read_weather(spark: SparkSession, folder: str) -> DataFrame:
    return read_daily_csv(spark, f"{folder}/{WEATHER_FILES}", WEATHER_SCHEMA)


def read_static(spark: SparkSession, path: str, columns: list[str], target: str = "protein_pct", key: str = "field_key") -> tuple[DataFrame, DataFrame]:
    """(static, target): wanted columns once each, absent ones skipped with a warning; null targets dropped."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    wanted = list(dict.fromkeys([key, *columns]))
    for c in wanted:
        if c not in df.columns:
            log.warning("column %s is absent and skipped", c)
    static = df.select(*[c for c in wanted if c in df.columns and c != target])
    return finite_columns(static), finite_columns(df.select(key, F.col(target).cast("double").alias(target))).where(F.col(target).isNotNull())


def read_terrain(spark: SparkSession, path: str, sample_path: str | None = None, key: str = "field_key") -> DataFrame:
    from ..operators.statics import with_samples

    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = df.withColumnsRenamed({k: v for k, v in TERRAIN_NAMES.items() if k in df.columns})
    df = df.select(key, *[c for c in TERRAIN_KEEP if c in df.columns])
    if sample_path:
        df = with_samples(df, spark.read.option("header", True).option("inferSchema", True).csv(sample_path), key)
    return df


def melted(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Long form: keys, feature, value of the wanted (by default all other) columns."""
    cols = columns or [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))


def numeric_columns(df: DataFrame, excluded: tuple[str, ...] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") and n not in excluded]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_finished(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_config(path: str | Path) -> dict:
    """A YAML or JSON configuration file of the driver."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"configuration file not found: {p}")
    if p.suffix == ".json":
        return json.loads(p.read_text())
    import yaml

    return yaml.safe_load(p.read_text())
