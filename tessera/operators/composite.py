"""Scene selection, season composites and weather reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["tile_id", "window", "row", "col"]


def scene_counts(scenes: DataFrame, keys: list[str], max_cloud: float) -> DataFrame:
    """Found and kept scenes of each key, from one pass."""
    return scenes.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(F.coalesce("cloud_cover", F.lit(0.0)) <= max_cloud).alias("kept"))


def clearest(scenes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` scenes of each key with least cloud; ties by scene_id."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("cloud_cover", F.lit(0.0)), "scene_id")
    return scenes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def newest_year(scenes: DataFrame, keys: list[str]) -> DataFrame:
    latest = scenes.groupBy(*keys).agg(F.max(F.year("ts")).alias("newest"))
    return scenes.join(latest, keys).where(F.year("ts") == F.col("newest")).drop("newest")


def baseline_offset(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Offset of a window's digital numbers, and whether its scenes disagree."""
    new = F.col("processing_baseline") >= 4.0
    return scenes.groupBy(*keys).agg(F.when(F.bool_or(new), 1000.0).otherwise(0.0).alias("offset"), (F.count_distinct(new) > 1).alias("mixed"))


def solar_day_mosaic(observations: DataFrame, keys: list[str], value: str, lon: Column) -> DataFrame:
    """One value for each cell and solar day: the first scene's that has one."""
    day = F.to_date(F.col("ts") + F.make_dt_interval(secs=F.round(lon / 15 * 3600)))
    have = observations.where(F.col(value).isNotNull()).withColumn("solar_day", day)
    return have.groupBy(*keys, "solar_day").agg(F.min_by(value, F.struct("scene_id", value)).alias(value))


def composite(observations: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median of each value over the scenes of a cell, and the number of clear looks."""
    return observations.groupBy(*keys).agg(*[F.median(v).alias(v) for v in values], *[F.count(v).alias(f"{v}_looks") for v in values])


def composite_depth(composites: DataFrame, keys: list[str], looks: str) -> DataFrame:
    """Shallowest and median depth; a shallowest of zero is a warning."""
    return composites.groupBy(*keys).agg(F.min(looks).alias("min_depth"), F.median(looks).alias("median_depth")).withColumn("warns", F.col("min_depth") == 0)


def on_skeleton(cells: DataFrame, windows: DataFrame, data: DataFrame, keys: list[str], count_cols: list[str] = ()) -> DataFrame:
    """Every cell of every window; counts of cells without data are zero.

    The windows are a dimension of a few rows per year; over 10,000 are refused.
    """
    if windows.limit(10_001).count() > 10_000:
        raise ValueError("over 10,000 windows: these are no seasons")
    dense = cells.crossJoin(F.broadcast(windows))
    return dense.join(data, keys, "left").fillna(0, list(count_cols))


def circular_mean(degrees: Column) -> Column:
    """Mean direction, from partial sums that merge."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(360.0))


def overpass_weather(hourly: DataFrame, keys: list[str], values: list[str], direction: str | None = None, hour: int = 10) -> DataFrame:
    """Median of each field at the overpass hour; a direction gets a circular mean."""
    at = hourly.where(F.hour("ts") == hour)
    extra = [circular_mean(F.col(direction)).alias(direction)] if direction else []
    return at.groupBy(*keys).agg(F.count("*").alias("records"), *[F.median(v).alias(v) for v in values], *[F.count(v).alias(f"{v}_kept") for v in values], *extra)
