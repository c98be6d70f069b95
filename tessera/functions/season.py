"""Season windows: Apr-Jun summers, Nov-Jan winters that carry their first year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def season_label(ts: Column) -> Column:
    """``YYYY-summer``, ``YYYY-winter`` or null outside both seasons."""
    m, y = F.month(ts), F.year(ts)
    return (
        F.when(m.isin(4, 5, 6), F.concat(y.cast("string"), F.lit("-summer")))
        .when(m.isin(11, 12), F.concat(y.cast("string"), F.lit("-winter")))
        .when(m == 1, F.concat((y - 1).cast("string"), F.lit("-winter")))
    )


def season_of(label: Column) -> Column:
    return F.split_part(label, F.lit("-"), F.lit(2))


def window_start(label: Column) -> Column:
    """First day of a window."""
    year = F.split_part(label, F.lit("-"), F.lit(1)).cast("int")
    return F.when(season_of(label) == "summer", F.make_date(year, F.lit(4), F.lit(1))).otherwise(F.make_date(year, F.lit(11), F.lit(1)))


def window_end(label: Column) -> Column:
    """Last day of a window."""
    year = F.split_part(label, F.lit("-"), F.lit(1)).cast("int")
    return F.when(season_of(label) == "summer", F.make_date(year, F.lit(6), F.lit(30))).otherwise(F.make_date(year + 1, F.lit(1), F.lit(31)))


def with_midpoint(windows: DataFrame) -> DataFrame:
    """``windows(window)`` with season, start, end, the middle day and the interval as text."""
    start, end = window_start(F.col("window")), window_end(F.col("window"))
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return windows.select(
        "window", season_of(F.col("window")).alias("season"), start.alias("start_day"), end.alias("end_day"), middle.alias("midpoint"),
        F.concat_ws("/", start.cast("string"), end.cast("string")).alias("interval"),
    )


def season_windows(spark: SparkSession, years: list[int]) -> DataFrame:
    """Both windows of each year, in time order."""
    labels = [f"{y}-{s}" for y in sorted(years) for s in ("summer", "winter")]
    return with_midpoint(spark.createDataFrame([(x,) for x in labels], "window string"))


def resolve_windows(plans: DataFrame, windows: DataFrame) -> DataFrame:
    """``plans(plan_id, asked, season)`` with the window each runs in, or a reason.

    The window asked for if it exists, else the season's latest, else the latest
    summer, else the latest.  A window asked for that does not exist is refused.
    """
    start = window_start(F.col("window"))
    one = windows.select("window", start.alias("s"), season_of(F.col("window")).alias("kind"))
    latest = one.groupBy("kind").agg(F.max_by("window", "s").alias("w"), F.max("s").alias("s"))
    pick = latest.agg(
        F.max(F.when(F.col("kind") == "summer", F.col("w"))).alias("summer"),
        F.max(F.when(F.col("kind") == "winter", F.col("w"))).alias("winter"),
        F.max_by("w", "s").alias("any"),
    )  # one row
    joined = plans.join(one.select(F.col("window").alias("found")), F.col("asked") == F.col("found"), "left").crossJoin(F.broadcast(pick))
    by_season = F.when(F.col("season") == "summer", F.col("summer")).when(F.col("season") == "winter", F.col("winter"))
    chosen = F.when(F.col("asked").isNotNull(), F.col("found")).otherwise(F.coalesce(by_season, "summer", "any"))
    return joined.select(
        "plan_id", chosen.alias("window"), F.when(chosen.isNull(), F.concat(F.lit("no window "), F.coalesce("asked", F.lit("at all")))).alias("reason")
    )
