"""Coverage, summaries and problems of gridded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return table.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "variable", "value")


def valid_fractions(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Share of rows with a value, for each variable and key."""
    return unpivot(table, keys, values).groupBy(*keys, "variable").agg((F.count("value") / F.count("*")).alias("fraction"))


def summarise(table: DataFrame, values: list[str], window: str = "window") -> DataFrame:
    """Populated cells, valid fraction and range of each variable, for each window
    and over all (window null)."""
    long = unpivot(table, [window], values)
    sets = long.groupingSets([["variable"], ["variable", window]], "variable", window)
    return sets.agg(
        F.count("value").alias("populated"), (F.count("value") / F.count("*")).alias("valid_fraction"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.avg("value").alias("vmean")
    )


def problems(table: DataFrame, values: list[str], least: float, window: str = "window") -> DataFrame:
    """Variables that are absent, empty or too thin in a window, each with its remedy."""
    present = [v for v in values if v in table.columns]
    absent = [v for v in values if v not in table.columns]
    thin = valid_fractions(table, [window], present).select(
        F.when(F.col("fraction") == 0, "empty").when(F.col("fraction") < least, "thin").alias("problem"), "variable", window, "fraction"
    ).where("problem IS NOT NULL")
    if absent:
        names = F.explode(F.array(*[F.lit(a) for a in absent]))
        thin = thin.unionByName(table.select(window).distinct().select(F.lit("absent").alias("problem"), names.alias("variable"), window, F.lit(0.0).alias("fraction")))
    remedy = F.when(F.col("problem") == "absent", "add the layer").when(F.col("problem") == "empty", "build the window again").otherwise("widen the window or the cloud limit")
    return thin.withColumn("remedy", remedy)


def structure(table: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Whether each key's cells are all there, once each and inside the grid."""
    return table.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_distinct("row", "col").alias("distinct_cells"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col")
    ).withColumn("complete", (F.col("cells") == height * width) & (F.col("distinct_cells") == height * width) & (F.col("min_row") == 0) & (F.col("max_row") == height - 1) & (F.col("min_col") == 0) & (F.col("max_col") == width - 1))


def usable_windows(fractions: DataFrame, least: float = 0.5, window: str = "window") -> DataFrame:
    """Each window with its worst variable; usable if that has enough coverage."""
    return fractions.groupBy(window).agg(F.min_by("variable", F.struct("fraction", "variable")).alias("worst"), F.min("fraction").alias("fraction")).withColumn("usable", F.col("fraction") >= least)


def conservation(before: DataFrame, after: DataFrame, value: str, tolerance_pct: float = 5.0) -> DataFrame:
    """Totals of a quantity before and after regridding and their drift: one row."""
    a, b = before.agg(F.sum(value).alias("source_total")), after.agg(F.sum(value).alias("grid_total"))
    drift = F.try_divide((F.col("grid_total") - F.col("source_total")) * 100, F.col("source_total"))
    return a.crossJoin(b).withColumn("drift_pct", drift).withColumn("warns", F.abs("drift_pct") > tolerance_pct)


def shares(table: DataFrame, key: Column | str) -> DataFrame:
    """Count and share of each class."""
    counts = table.groupBy(key).agg(F.count("*").alias("cells"))
    return counts.crossJoin(counts.agg(F.sum("cells").alias("all_cells"))).withColumn("share", F.col("cells") / F.col("all_cells")).drop("all_cells")
