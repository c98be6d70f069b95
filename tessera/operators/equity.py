"""Who benefits: groups of equal population and how a change spreads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = 10
CONCENTRATED = 0.5
RELIABLE = 0.2


def population_groups(cells: DataFrame, keys: list[str], people: str = "population", by: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Inhabited cells with ``group`` 1..groups: cells sorted by the stratifier (people
    unless ``by`` is given; ties by row and col), cut where the middle of a cell's
    people falls in the running total.

    Running sums go over slices of the sorted cells first, as many as the session has
    shuffle partitions: a slice is a range of the sort key, found by a range
    partitioning, so no tile is sorted by one task.
    """
    stratifier = by or people
    inhabited = cells.where(F.col(people) > 0)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = inhabited.repartitionByRange(n, *keys, stratifier, "row", "col").withColumn("_slice", F.spark_partition_id())
    return _cumulate(_frozen(ranged), keys, people, stratifier, groups)


def _frozen(df: DataFrame) -> DataFrame:
    """Slices must not move between the two passes that use them."""
    from tessera.operators.raster import checkpointed

    return checkpointed(df)


def _cumulate(ranged: DataFrame, keys: list[str], people: str, stratifier: str, groups: int) -> DataFrame:
    slices = ranged.groupBy(*keys, "_slice").agg(F.sum(people).alias("_in"))
    up = Window.partitionBy(*keys).orderBy("_slice")
    offsets = slices.select(*keys, "_slice", (F.sum("_in").over(up) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(stratifier, "row", "col").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, [*keys, "_slice"]).withColumn("_upto", F.col("_before") + F.sum(people).over(inside))
    middle = F.col("_upto") - F.col(people) / 2
    group = F.least(F.floor(middle / F.col("_total") * groups), F.lit(groups - 1)) + 1
    return placed.withColumn("group", group.cast("int")).drop("_slice", "_before", "_total", "_upto")


def benefit(grouped: DataFrame, keys: list[str], delta: str = "delta", people: str = "population") -> DataFrame:
    """People, cells, weighted mean change and share of the benefit of each group."""
    degrees = -F.col(delta) * F.col(people)
    by = grouped.where(F.col(delta).isNotNull()).groupBy(*keys, "group").agg(F.sum(people).alias("people"), F.count("*").alias("cells"), F.sum(degrees).alias("person_degrees"))
    total = F.sum("person_degrees").over(Window.partitionBy(*keys))
    return by.withColumn("mean_delta", F.coalesce(F.try_divide(-F.col("person_degrees"), F.col("people")), F.lit(0.0))).withColumn("share", F.coalesce(F.try_divide("person_degrees", total), F.lit(0.0)))


def totals(cells: DataFrame, keys: list[str], delta: str = "delta", people: str = "population") -> DataFrame:
    """Net and gross person-degrees, and cooling on land with and without residents."""
    usable = cells.where(F.col(delta).isNotNull() & F.col(people).isNotNull())
    degrees = -F.col(delta) * F.greatest(F.col(people), F.lit(0.0))
    home = F.col(people) > 0
    return usable.groupBy(*keys).agg(
        F.sum(F.when(home, degrees).otherwise(0.0)).alias("net"), F.sum(F.abs(degrees)).alias("gross"), F.sum(F.when(home, F.col(people)).otherwise(0.0)).alias("population_covered"),
        F.sum(F.when(home, -F.col(delta)).otherwise(0.0)).alias("inhabited_cooling"), F.sum(F.when(~home, -F.col(delta)).otherwise(0.0)).alias("uninhabited_cooling"),
    )


def measures(shares: DataFrame, total: DataFrame, keys: list[str]) -> DataFrame:
    """Reliability, concentration, best and worst served groups, waste on empty land."""
    top = shares.groupBy(*keys).agg(
        F.aggregate(F.slice(F.sort_array(F.collect_list("share"), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x).alias("top_three_share"),
        F.max_by("group", F.struct("share", -F.col("group"))).alias("best_served"), F.min_by("group", F.struct("share", "group")).alias("worst_served"),
    )
    joined = top.join(total, keys)
    ratio = F.coalesce(F.try_divide("net", "gross"), F.lit(0.0))
    all_cooling = F.col("inhabited_cooling") + F.col("uninhabited_cooling")
    return joined.withColumn("net_to_gross", ratio).withColumn("reliable", (F.col("net") > 0) & (ratio >= RELIABLE)).withColumn("concentrated", F.col("top_three_share") > CONCENTRATED).withColumn(
        "uninhabited_fraction", F.when(all_cooling > 0, F.col("uninhabited_cooling") / all_cooling).otherwise(0.0)
    )
