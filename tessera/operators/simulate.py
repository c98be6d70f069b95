"""Many simulations in one plan: drawn masks, planting, temperature, air, who benefits, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import verdicts
from tessera.operators import equity, features, kernel, polygons, scenario
from tessera.operators.raster import checkpointed, dealt

#: Columns of a simulation's row, all null where its status is not ok.
STATS = ["cells_changed", "mean_inside", "mean_ring", "ring_cells", "min_delta", "max_delta"]


def by_trees(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Predictions before and after by saved trees: both on the row itself, so nothing is
    joined or exchanged to take a difference."""
    features.check_features(model)
    moved = [*scenario.MOVED, *[f"{v}_near" for v in scenario.NEAR]]
    made = ["cover_index", "features", "predicted"]

    def predict(rows: DataFrame) -> DataFrame:
        kept = rows.withColumns({f"_{c}": F.col(c) for c in moved}).withColumns({c: F.col(f"{c}_before") for c in moved})
        before = model.transform(kept).withColumn("p0", F.col("predicted")).drop(*made)
        return model.transform(before.withColumns({c: F.col(f"_{c}") for c in moved})).withColumn("p1", F.col("predicted")).drop(*made, *[f"_{c}" for c in moved])

    return predict


def by_line(line: DataFrame, keys: list[str], x: Callable[[str], Column]) -> Callable[[DataFrame], DataFrame]:
    """Predictions of a line for each tile and window; ``x`` gives its feature for a suffix of the columns."""

    def predict(rows: DataFrame) -> DataFrame:
        fitted = features.with_scalars(rows, line, keys)
        at = lambda suffix: F.col("slope") * x(suffix) + F.col("intercept")
        return fitted.withColumn("p0", at("_before")).withColumn("p1", at(""))

    return predict


def planted_cells(cells: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Masked cells (scenario_id, keys, row, col, canopy_fraction_added) with what each takes and becomes."""
    on = [*keys, "row", "col"]
    own = cells.join(dealt(scenario.referred(table.select(*on, *scenario.MOVED, "landcover"), scenario.tree_reference(table, keys), keys)), on)
    added = scenario.effective_fraction(F.col("canopy_fraction_added"), F.lit(True), F.col("ndvi"), scenario.canopy_fraction(F.col("ndvi"), F.col("tree_ndvi")), F.col("landcover"))
    return scenario.perturbed(own.withColumn("canopy_added", added), "canopy_added")


def run(
    scenarios: DataFrame, grid, table: DataFrame, predict: Callable[[DataFrame], DataFrame], keys: list[str], air: DataFrame | None = None, text: str = "geojson", target: str = "lst_c"
) -> DataFrame:
    """One row for each of ``scenarios(scenario_id, keys, geojson, canopy_fraction_added,
    emission_fraction_removed)``: the mask of the drawing, what is planted, the change of
    temperature inside it, in the ring around it and at its extremes, the linear expectation and
    the ratio to it, cooling and its label, person-degrees, how even they are, and the change of PM2.5.

    ``table`` holds the features of every cell (see ``features.features``) with population and
    emission; ``predict`` gives p0 and p1 of rows with values before and after.  ``air`` is a
    kernel (some of keys, dr, dc, weight).  ``status`` refuses drawings
    that are no polygon, invalid or without a cell, windows that the table does not have, and
    tiles without tree cover; figures of refused rows are null.  Planted cells are those that take some canopy;
    cells that the model can't value have no change.  Without emissions to remove or a kernel, ``air_status`` says so.

    Work follows the cells that masks and their surroundings cover; cells out of reach are
    zero by construction and only counted.
    """
    status, runs = polygons.masks(scenarios, ["scenario_id"], grid, text)
    asked = scenarios.select("scenario_id", *keys, "canopy_fraction_added", "emission_fraction_removed")
    area = runs.groupBy("scenario_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"))
    cells = checkpointed(polygons.cells_of(runs, ["scenario_id"]).join(dealt(asked), "scenario_id"))
    masked = checkpointed(planted_cells(cells, table, keys))
    planted = masked.where("canopy_added > 0")
    on = ["scenario_id", *keys]
    paired = scenario.paired_features(planted, table.where("usable"), keys, grid.height, grid.width)
    changed = predict(paired).select(*on, "row", "col", (F.col("p1") - F.col("p0")).alias("delta"))
    spread = scenario.sided(changed, planted, on, grid.height, grid.width).join(dealt(table.where("usable").select(*keys, "row", "col", "population")), [*keys, "row", "col"])
    field = checkpointed(spread)
    usable = table.where("usable").groupBy(*keys).agg(F.count("*").alias("_usable"))
    stats = scenario.summarise_delta(field, on).drop("cells_changed").join(dealt(field.groupBy("scenario_id").agg(F.count("*").alias("_rows"))), "scenario_id")
    stats = features.with_scalars(stats, usable, keys)
    beyond = F.col("_rows") < F.col("_usable")  # cells out of reach, whose change is zero
    for name, pick in (("min_delta", F.least), ("max_delta", F.greatest)):
        stats = stats.withColumn(name, F.when(beyond, pick(F.col(name), F.lit(0.0))).otherwise(F.col(name)))
    took = masked.groupBy("scenario_id").agg(F.count_if(F.col("canopy_added") > 0).alias("cells_changed"), F.avg(F.when(F.col("canopy_added") > 0, F.col("canopy_added"))).alias("mean_canopy_added"))
    out = asked.join(dealt(status.drop("vertices")), "scenario_id").join(dealt(area), "scenario_id", "left").join(dealt(took), "scenario_id", "left")
    out = out.join(dealt(stats.drop("_rows", "_usable", *keys)), "scenario_id", "left").join(dealt(benefit(field, table, keys)), "scenario_id", "left")
    contrast = scenario.tree_built_contrast(table, keys, target).select(*keys, F.col("contrast").alias("tree_built_contrast"))
    reason = scenario.tree_reference(table, keys).select(*keys, F.col("reason").alias("_reason"), F.lit(True).alias("_known"))
    tiles = contrast.join(reason, keys)
    side = F.broadcast(tiles) if tiles.limit(features.BROADCAST_ROWS + 1).count() <= features.BROADCAST_ROWS else tiles
    out = out.join(side, keys, "left")
    missing = F.when(F.col("_known").isNull(), F.concat(F.lit("no window "), F.col(keys[-1])))
    out = out.withColumn("status", F.when(F.col("status") == "ok", F.coalesce(missing, "_reason", F.lit("ok"))).otherwise(F.col("status")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    added = zero("mean_canopy_added")
    figures = {
        "area_m2": F.col("cells") * grid.res * grid.res, "cells_changed": F.coalesce("cells_changed", F.lit(0)), "mean_canopy_added": added,
        **{c: zero(c) for c in ("mean_inside", "mean_ring", "min_delta", "max_delta", "person_degrees", "uninhabited_fraction", "top_three_share", "net_to_gross")}, "ring_cells": F.coalesce("ring_cells", F.lit(0)),
        "tree_built_contrast": F.col("tree_built_contrast"), "linear_expectation": verdicts.linear_expectation(added, F.col("tree_built_contrast")),
        "ratio_to_linear": verdicts.ratio_to_linear(zero("mean_inside"), added, F.col("tree_built_contrast")),
        "expected_cooling": verdicts.corrected_cooling(zero("mean_inside")), "impact": verdicts.impact(zero("mean_inside"), F.col("tree_built_contrast")), "trees": verdicts.trees_for(added, F.col("cells") * grid.res * grid.res),
        "verdict": verdicts.equity_verdict(F.coalesce("reliable", F.lit(False)), zero("uninhabited_fraction"), zero("top_three_share")),
    }
    fine = F.col("status") == "ok"
    told = out.select("scenario_id", *keys, "status", *[F.when(fine, c).alias(n) for n, c in figures.items()], F.when(fine, F.col("emission_fraction_removed")).alias("_removes"))
    return cleaner(told, cells, table, keys, air, grid).drop("_removes")


def benefit(field: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(scenario_id, person_degrees, net_to_gross, reliable, uninhabited_fraction, top_three_share):
    groups of equal population are cut once for each tile and window; a group that no cell of a scenario reaches has a share of zero."""
    groups = equity.population_groups(table.where("usable").select(*keys, "row", "col", "population"), keys).select(*keys, "row", "col", "group")
    grouped = field.join(dealt(groups), [*keys, "row", "col"])
    shares = equity.benefit(grouped, ["scenario_id"]).groupBy("scenario_id").agg(F.collect_list("share").alias("s"))
    padded = F.sort_array(F.concat("s", F.array_repeat(F.lit(0.0), F.lit(equity.GROUPS) - F.size("s"))), asc=False)
    top = shares.select("scenario_id", F.aggregate(F.slice(padded, 1, 3), F.lit(0.0), lambda a, x: a + x).alias("top_three_share"))
    total = equity.totals(field, ["scenario_id"])
    ratio = F.coalesce(F.try_divide("net", "gross"), F.lit(0.0))
    cooled = F.col("inhabited_cooling") + F.col("uninhabited_cooling")
    return total.join(dealt(top), "scenario_id", "left").select(
        "scenario_id", F.col("net").alias("person_degrees"), ratio.alias("net_to_gross"), ((F.col("net") > 0) & (ratio >= equity.RELIABLE)).alias("reliable"),
        F.when(cooled > 0, F.col("uninhabited_cooling") / cooled).otherwise(0.0).alias("uninhabited_fraction"), F.coalesce("top_three_share", F.lit(0.0)).alias("top_three_share"),
    )


def cleaner(told: DataFrame, cells: DataFrame, table: DataFrame, keys: list[str], air: DataFrame | None, grid) -> DataFrame:
    """``told`` with air_status, and the mean (inside the drawing) and strongest change of
    PM2.5 of those that remove emissions: only what is removed is spread."""
    none = F.lit(None).cast("double")
    asks = F.coalesce(F.col("_removes") > 0, F.lit(False))
    if air is None or "emission" not in table.columns:
        return told.withColumns({"air_status": F.when(F.col("status") == "ok", F.when(asks, "no inventory").otherwise("not asked")), "pm25_inside": none, "pm25_strongest": none})
    on = ["scenario_id", *keys]
    mask = cells.where("emission_fraction_removed > 0").select(*on, "row", "col", F.col("emission_fraction_removed").alias("emission_fraction"))
    own = table.select(*keys, "row", "col", "emission")
    removed = checkpointed(kernel.removed_emissions(own, mask, on, on=[*keys, "row", "col"]))
    field = checkpointed(kernel.concentration(removed.where("removed > 0").select(*on, "row", "col", F.col("removed").alias("emission")), air, on, grid.height, grid.width))
    inside = removed.select(*on, "row", "col").join(dealt(field), [*on, "row", "col"], "left").groupBy("scenario_id").agg((-F.avg(F.coalesce("concentration", F.lit(0.0)))).alias("_in"))
    most = field.groupBy("scenario_id").agg((-F.max("concentration")).alias("_most"))
    said = removed.select("scenario_id", F.col("status").alias("_air")).distinct().join(dealt(inside), "scenario_id", "left").join(dealt(most), "scenario_id", "left")
    out = told.join(dealt(said), "scenario_id", "left")
    fine = F.col("status") == "ok"
    answered = fine & (F.col("_air") == "ok")
    return out.withColumn("air_status", F.when(fine, F.when(~asks, "not asked").otherwise(F.coalesce("_air", F.lit("no inventory"))))).withColumn("pm25_inside", F.when(answered, F.col("_in"))).withColumn("pm25_strongest", F.when(answered, F.col("_most"))).drop("_air", "_in", "_most")
