"""Blocks of cells as candidate regions: measures, rankings, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.verdicts import TREE_CANOPY_M2, corrected_cooling

BLOCK = 20
TREE, WATER, BUILT = 10, 80, 50
NEGLIGIBLE = 0.005


def region_id(block: int = BLOCK) -> Column:
    return F.format_string("r%02dc%02d", F.floor(F.col("row") / block), F.floor(F.col("col") / block))


def lattice(cells: DataFrame, keys: list[str], cell_m2: float, block: int = BLOCK) -> DataFrame:
    """One row per block: cells, area, room for canopy, mean temperature over cells that
    have one, people and emissions (missing counts as none)."""
    canopy = F.coalesce(F.sum("headroom"), F.lit(0.0)) * cell_m2
    return cells.withColumn("region_id", region_id(block)).groupBy(*keys, "region_id").agg(
        F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"), F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"), F.count("*").alias("cells"), (F.count("*") * cell_m2).alias("area_m2"),
        canopy.alias("plantable_canopy_m2"), F.floor(canopy / TREE_CANOPY_M2).alias("max_trees"), F.avg("lst_c").alias("mean_lst_c"), F.coalesce(F.sum("population"), F.lit(0.0)).alias("population"), F.coalesce(F.sum("emission"), F.lit(0.0)).alias("emission"),
    )


def measure(regions: DataFrame, chosen: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Cells, area and plantable canopy of each plan's regions; disjoint blocks add up."""
    sums = [F.sum(c).alias(c) for c in ("cells", "area_m2", "plantable_canopy_m2", "population", "emission")]
    return chosen.distinct().join(regions, "region_id").groupBy(plan).agg(*sums)


def unknown_regions(chosen: DataFrame, regions: DataFrame) -> DataFrame:
    return chosen.join(regions, "region_id", "left_anti").withColumn("reason", F.concat(F.lit("no region "), "region_id"))


def cells_of(chosen: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cells of the regions chosen: the block is arithmetic on row and col, so an equi join."""
    return cells.withColumn("region_id", region_id(block)).join(chosen.select("region_id").distinct(), "region_id", "left_semi")


def ranked(regions: DataFrame, keys: list[str], score: Column, top: int | None = None) -> DataFrame:
    """Regions by falling score, ties by region_id."""
    out = regions.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "region_id")))
    return out if top is None else out.where(F.col("rank") <= top)


def untried(regions: DataFrame, tried: DataFrame, keys: list[str], top: int = 24) -> DataFrame:
    """The first ``top`` ranked regions that were not tried yet, in rank order."""
    left = regions.join(tried.select(*keys, "region_id").distinct(), [*keys, "region_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where(F.col("rank") <= top)


def explain(cells: DataFrame, keys: list[str], block: int = BLOCK, most: int = 8) -> DataFrame:
    """Blocks that changed, strongest first: cooling, canopy added, residents, the median
    group of their inhabited cells, tree and water share, inside or spillover.
    ``cells`` has delta, canopy_added, population, group, landcover, inside, near."""
    out = cells.withColumn("region_id", region_id(block)).groupBy(*keys, "region_id").agg(
        corrected_cooling(F.avg("delta")).alias("expected_cooling"), F.avg(F.coalesce("canopy_added", F.lit(0.0))).alias("canopy_added"), F.coalesce(F.sum("population"), F.lit(0.0)).alias("residents"),
        F.median("group").cast("int").alias("population_decile"), F.avg((F.col("landcover") == TREE).cast("double")).alias("tree_fraction"), F.avg((F.col("landcover") == WATER).cast("double")).alias("water_fraction"),
        F.bool_or("inside").alias("inside"), (~F.bool_or("inside") & F.bool_or("near")).alias("spillover"),
    ).where(F.col("expected_cooling") >= NEGLIGIBLE)
    return ranked(out, keys, F.col("expected_cooling"), most).drop("score")


def as_text(explained: DataFrame) -> DataFrame:
    """One line of facts for each explained region."""
    return explained.withColumn("line", F.format_string("%s: %.2f degC, %.1f%% canopy added, %.0f residents", "region_id", "expected_cooling", F.col("canopy_added") * 100, "residents"))
