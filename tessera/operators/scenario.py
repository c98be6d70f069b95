"""What an intervention does: scenarios as differences of predictions, all in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import verdicts
from tessera.operators import regions
from tessera.operators.quantiles import medians
from tessera.operators.raster import dealt, dilation_ring

BARE_NDVI = 0.10
MOVED = ["ndvi", "ndbi", "albedo"]
NEAR = ("ndvi", "ndbi")
SPILLOVER = 2


def tree_reference(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of the moved variables over tree cover, and a reason where there is none."""
    tree = F.col("landcover") == regions.TREE
    out = cells.groupBy(*keys).agg(F.count_if(tree).alias("tree_cells")).join(medians(cells.where(tree), keys, {f"tree_{v}": F.col(v) for v in MOVED}), keys, "left")
    return out.withColumn("reason", F.when(F.col("tree_cells") == 0, "no tree cover to refer to"))


def tree_built_contrast(cells: DataFrame, keys: list[str], value: str = "lst_c") -> DataFrame:
    """Median of built land, of tree cover, and their difference."""
    v, cover = F.col(value), F.col("landcover")
    out = medians(cells, keys, {"built": F.when(cover == regions.BUILT, v), "tree": F.when(cover == regions.TREE, v)})
    return cells.select(*keys).distinct().join(out, keys, "left").withColumn("contrast", F.col("built") - F.col("tree"))


def canopy_fraction(ndvi: Column, tree_ndvi: Column) -> Column:
    share = (ndvi - BARE_NDVI) / F.greatest(tree_ndvi - BARE_NDVI, F.lit(1e-6))
    return F.when(ndvi.isNotNull() & tree_ndvi.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def effective_fraction(asked: Column, inside: Column, ndvi: Column, canopy: Column, landcover: Column) -> Column:
    """What a cell takes: no more than its room, nothing on water, no data or outside."""
    plantable = inside & ndvi.isNotNull() & ~landcover.isin(regions.WATER, 0)
    return F.when(plantable, F.least(asked, 1 - canopy)).otherwise(0.0)


def perturbed(cells: DataFrame, fraction: str) -> DataFrame:
    """Moved variables go that fraction of the way to the tree reference."""
    return cells.withColumns({f"{v}_new": F.col(v) + F.col(fraction) * (F.col(f"tree_{v}") - F.col(v)) for v in MOVED})


def referred(cells: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the tree reference of their tile and window."""
    from tessera.operators.features import with_scalars

    return with_scalars(cells, reference.drop("tree_cells"), keys)


def planted(cells: DataFrame, scenarios: DataFrame, scenario_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of each scenario's mask with canopy, the fraction added and what they become.
    Only masked cells are touched, so the size is that of the masks."""
    own = scenario_cells.join(scenarios, "scenario_id").join(referred(cells, tree_reference(cells, keys), keys), [c for c in ("tile_id", "row", "col") if c in scenario_cells.columns])
    canopy = canopy_fraction(F.col("ndvi"), F.col("tree_ndvi"))
    added = effective_fraction(F.col("canopy_fraction"), F.lit(True), F.col("ndvi"), canopy, F.col("landcover"))
    return perturbed(own.withColumn("canopy", canopy).withColumn("canopy_added", added), "canopy_added")


def affected(touched: DataFrame, keys: list[str], reach: int, height: int, width: int) -> DataFrame:
    """Cells whose features can differ: the square around each touched cell."""
    square = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    sent = touched.select(*keys, "row", "col", F.explode(square).alias("d"))
    return sent.select(*keys, (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def neighbourhood_shift(touched: DataFrame, keys: list[str], variable: str, height: int, width: int, reach: int = 2, total: bool = False) -> DataFrame:
    """Change of the neighbourhood mean around changed cells, over complete squares
    inside the grid, or with ``total`` of the sum; edges repeat, so an edge cell counts for each place it stands in."""
    d = F.col(f"{variable}_new") - F.col(variable)
    n = 1 if total else (2 * reach + 1) ** 2

    def spots(c: str, last: int) -> Column:
        # places of the padded axis that this line fills
        lo = F.when(F.col(c) == 0, F.col(c) - reach).otherwise(F.col(c))
        hi = F.when(F.col(c) == last, F.col(c) + reach).otherwise(F.col(c))
        return F.sequence(lo, hi)

    places = touched.where(d != 0).withColumn("d", d).withColumn("pr", F.explode(spots("row", height - 1))).withColumn("pc", F.explode(spots("col", width - 1)))
    square = places.withColumn("nr", F.explode(F.sequence(F.col("pr") - reach, F.col("pr") + reach))).withColumn("nc", F.explode(F.sequence(F.col("pc") - reach, F.col("pc") + reach)))
    at = square.where(F.col("nr").between(0, height - 1) & F.col("nc").between(0, width - 1))
    return at.groupBy(*keys, F.col("nr").alias("row"), F.col("nc").alias("col")).agg((F.sum("d") / n).alias(f"{variable}_near_shift"))


def after_features(touched: DataFrame, table: DataFrame, keys: list[str], height: int, width: int, near: tuple[str, ...] = NEAR) -> DataFrame:
    """Features of every cell that a scenario touches or whose neighbourhood it touches,
    as they are afterwards: moved variables, and neighbourhood means of the moved field.
    ``table`` holds the features before, of all cells; ``near`` names the variables
    whose neighbourhoods the model looks at."""
    on = ["scenario_id", *keys, "row", "col"]
    out = touched.select(*on, *[f"{v}_new" for v in MOVED])
    for v in near:
        out = out.join(dealt(neighbourhood_shift(touched, ["scenario_id", *keys], v, height, width)), on, "full_outer")
    moved = {v: F.coalesce(f"{v}_new", v) for v in MOVED} | {f"{v}_near": F.col(f"{v}_near") + F.coalesce(f"{v}_near_shift", F.lit(0.0)) for v in near}
    return out.join(dealt(table), [*keys, "row", "col"]).withColumns(moved).drop(*[f"{v}_new" for v in MOVED], *[f"{v}_near_shift" for v in near])


def paired_features(planted: DataFrame, table: DataFrame, keys: list[str], height: int, width: int, near: tuple[str, ...] = NEAR) -> DataFrame:
    """Like :func:`after_features`, with the values before as ``{name}_before`` on the same row,
    and each neighbourhood's change over the values that it really holds (``{name}_near_n`` of ``table``)."""
    on = ["scenario_id", *keys, "row", "col"]
    out = planted.select(*on, *[f"{v}_new" for v in MOVED])
    for v in near:
        out = out.join(dealt(neighbourhood_shift(planted, ["scenario_id", *keys], v, height, width, total=True)), on, "full_outer")
    out = out.join(dealt(table), [*keys, "row", "col"])
    names = [*MOVED, *[f"{v}_near" for v in near]]
    moved = {v: F.coalesce(f"{v}_new", v) for v in MOVED}
    moved |= {f"{v}_near": F.col(f"{v}_near") + F.coalesce(F.try_divide(F.col(f"{v}_near_shift"), F.col(f"{v}_near_n")), F.lit(0.0)) for v in near}
    return out.withColumns({f"{n}_before": F.col(n) for n in names}).withColumns(moved).drop(*[f"{v}_new" for v in MOVED], *[f"{v}_near_shift" for v in near])


def sided(changed: DataFrame, mask: DataFrame, keys: list[str], height: int, width: int, steps: int = SPILLOVER) -> DataFrame:
    """Cells with ``delta``, and whether they lie inside the mask or in the ring of
    ``steps`` around it; masked and ring cells that did not change have delta 0."""
    on = [*keys, "row", "col"]
    inside = mask.select(*on).distinct().withColumn("inside", F.lit(True)).withColumn("ring", F.lit(False))
    around = dilation_ring(mask.select(*on), keys, steps, height, width).select(*on).withColumn("inside", F.lit(False)).withColumn("ring", F.lit(True))
    out = inside.unionByName(around).join(dealt(changed.select(*on, "delta")), on, "full_outer")
    return out.select(*on, F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("ring", F.lit(False)).alias("ring"), F.coalesce("delta", F.lit(0.0)).alias("delta"))


def deltas(after: DataFrame, before: DataFrame, predict: Callable[[DataFrame], DataFrame], on: list[str]) -> DataFrame:
    """Difference of two predictions on the affected cells; every other valid cell is 0
    by construction and is not made a row."""
    a = predict(after).select("scenario_id", *on, F.col("predicted").alias("p1"))
    b = predict(before).select(*on, F.col("predicted").alias("p0"))
    return a.join(b, on).withColumn("delta", F.col("p1") - F.col("p0")).drop("p1", "p0")


def summarise_delta(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells changed, mean inside and in the ring, extremes, from ``delta, inside, ring``;
    an empty side is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.groupBy(*keys).agg(
        F.count_if(F.col("delta") != 0).alias("cells_changed"), zero(F.avg(F.when(F.col("inside"), F.col("delta")))).alias("mean_inside"), zero(F.avg(F.when(F.col("ring"), F.col("delta")))).alias("mean_ring"),
        F.count_if("ring").alias("ring_cells"), zero(F.min("delta")).alias("min_delta"), zero(F.max("delta")).alias("max_delta"),
    )


def outcome(stats: DataFrame, contrast: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of a scenario for people: corrected cooling, impact, ratio to the linear
    expectation, and flags of results that should not be believed."""
    j = stats.join(contrast, keys)
    expected = verdicts.corrected_cooling(F.col("mean_inside"))
    ratio = verdicts.ratio_to_linear(F.col("mean_inside"), F.col("mean_added"), F.col("contrast"))
    return j.withColumn("expected_cooling", expected).withColumn("impact", verdicts.impact(F.col("mean_inside"), F.col("contrast"))).withColumn("ratio_to_linear", ratio).withColumn(
        "flag", F.when(F.col("mean_inside") > 0, "warms").when(-F.col("mean_inside") > F.col("contrast"), "beyond the ceiling").when((ratio < 0.3) | (ratio > 2), "off the linear expectation").when(F.col("mean_ring") == 0, "no spillover")
    )


def score(metric: Column, expected_cooling: Column, person_degrees: Column, delta_pm25: Column) -> Column:
    return F.when(metric == "cooling", expected_cooling).when(metric == "pm25_reduction", F.coalesce(-delta_pm25, F.lit(0.0))).otherwise(person_degrees)


def satisfies(expected_cooling: Column, target: Column) -> Column:
    """Only a stated cooling target can be met."""
    return F.coalesce(expected_cooling >= target, F.lit(False))


def greedy(candidates: DataFrame, outcomes: DataFrame, objective: str = "objective_id") -> DataFrame:
    """The best of the candidates that were run: ``candidates(objective, region_id, rank,
    metric, status)`` against ``outcomes(objective, region_id, expected_cooling,
    person_degrees, delta_pm25)``.  Refused ones are counted and skipped; of equal
    scores the better ranked one wins."""
    run = candidates.join(outcomes, [objective, "region_id"], "left").withColumn("ok", F.col("status") == "ok")
    got = score(F.col("metric"), F.col("expected_cooling"), F.col("person_degrees"), F.col("delta_pm25"))
    scored = run.withColumn("score", F.when(F.col("ok"), F.round(got, 6)))
    first = F.struct("score", -F.col("rank"))
    return scored.groupBy(objective, "metric").agg(
        F.max_by("region_id", F.when(F.col("score").isNotNull(), first)).alias("best_region"), F.max("score").alias("score"), F.count_if("ok").alias("tried"), F.count_if(~F.col("ok")).alias("refused")
    )


def search_trace(scored: DataFrame, search: str, step: str, budget: int) -> DataFrame:
    """Proposals in order with the best so far and why the search stops where it does;
    an unscored proposal never wins."""
    w = Window.partitionBy(search).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("score").over(w)
    stop = F.when(F.col("satisfied"), "target met").when(F.row_number().over(Window.partitionBy(search).orderBy(step)) >= budget, "budget spent")
    return scored.withColumn("best", best).withColumn("improves", F.coalesce(F.col("score") == best, F.lit(False))).withColumn("stop", stop)
