"""Reading and writing of gridded tables, weather, elements and the build catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURLY = "tile_id string, hourly struct<time array<string>, temperature_2m array<double>, wind_speed_10m array<double>, wind_direction_10m array<double>, relative_humidity_2m array<double>>"
ELEMENTS = (
    "elements array<struct<type string, tags map<string,string>, geometry array<struct<lon double, lat double>>, lon double, lat double, "
    "bounds struct<minlon double, minlat double, maxlon double, maxlat double>>>"
)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """One row per hour from parallel arrays."""
    table = spark.read.schema(HOURLY).json(path)
    zipped = "arrays_zip(hourly.time, hourly.temperature_2m, hourly.wind_speed_10m, hourly.wind_direction_10m, hourly.relative_humidity_2m)"
    rows = table.select("tile_id", F.expr(f"inline({zipped})").alias("time", "temperature", "wind_speed", "wind_direction", "humidity"))
    return rows.withColumn("ts", F.to_timestamp("time"))


def read_elements(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Roads of the given classes and everything that is no road; an input without
    elements is refused."""
    table = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    out = table.select(F.explode("elements").alias("e")).select("e.*")
    if out.limit(1).count() == 0:
        raise ValueError("no elements: an inventory of them would read as zero everywhere")
    road = F.col("tags")["highway"]
    return out.where(road.isNull() | road.rlike("^(" + "|".join(classes) + ")(_link)?$"))


def read_points(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, value: str) -> DataFrame:
    """Points in a box; missing values are none."""
    table = spark.read.parquet(path).where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return table.withColumn(value, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(0.0)))


def read_observations(spark: SparkSession, path: str, bands: list[str], keys: tuple[str, ...] = ("tile_id", "scene_id", "ts", "row", "col")) -> DataFrame:
    """Only the bands asked for reach the scan."""
    return spark.read.parquet(path).select(*keys, *bands)


def write_cube(table: DataFrame, path: str, keys: tuple[str, ...] = ("tile_id", "window")) -> None:
    """Partitions in ``table`` are replaced as a whole, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_cube(spark: SparkSession, path: str, window: str | None = None) -> DataFrame:
    """All windows or one; a window that is not there is an error that names those that are."""
    table = spark.read.option("mergeSchema", True).parquet(path)
    if window is None:
        return table
    if not table.where(F.col("window") == window).limit(1).count():
        some = [str(r[0]) for r in table.select("window").distinct().orderBy("window").limit(50).collect()]
        raise ValueError(f"no window {window}; there are {', '.join(some)}" + (" and others" if len(some) == 50 else ""))
    return table.where(F.col("window") == window)


def graft(cube: DataFrame, layer: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values where there are any, old ones elsewhere."""
    old = cube.select(*keys, *[c for c in cube.columns if c not in keys])
    new = layer.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = old.join(new, keys, "full_outer")
    rest = [c for c in old.columns if c not in keys and c not in values]
    return joined.select(*keys, *rest, *[F.coalesce(f"_{v}", v).alias(v) if v in old.columns else F.col(f"_{v}").alias(v) for v in values])


def record_build(builds: DataFrame, path: str) -> None:
    """Idempotent: a build's rows replace earlier rows of the same build."""
    builds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id").parquet(path)


def read_builds(spark: SparkSession, path: str) -> DataFrame:
    """All builds; columns that earlier ones did not have yet are null there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def latest_build(builds: DataFrame, build_sources: DataFrame) -> DataFrame:
    """The report of the latest build; the session's views stay as they are."""
    return builds.sparkSession.sql(LATEST_BUILD, builds=builds, build_sources=build_sources)


LATEST_BUILD = """
SELECT build_id, built_at, collection, window, found, kept
FROM {builds} JOIN {build_sources} USING (build_id)
WHERE built_at = (SELECT max(built_at) FROM {builds})
ORDER BY collection, window NULLS FIRST
"""
