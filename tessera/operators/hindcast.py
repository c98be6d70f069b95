"""Hindcasts of many configurations in one plan: train before, score after, matched controls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import change, features
from tessera.operators.raster import checkpointed, components

SIDES = ["overall", "changed", "unchanged"]
FIGURES = ["n", "mae", "bias", "spatial_r2", "mae_debiased", "spatial_r2_debiased"]


def refused(configs: DataFrame) -> DataFrame:
    """``configs(config_id, before, scored)`` with ``reason``: nothing to train on, or a training
    window that is not strictly before the scored one."""
    late = F.exists("before", lambda w: w >= F.col("scored"))
    return configs.withColumn("reason", F.when(F.coalesce(F.size("before"), F.lit(0)) <= 0, "nothing to train on").when(late, "trained on the window it is scored on, or on a later one"))


def by_line(x: str, target: str = "lst_c") -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """A line of one feature for each configuration and tile, all fitted by one aggregate."""

    def predict(trained: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
        line = features.linear(trained, key, F.col(x), target)
        return features.with_scalars(scored, line, key).withColumn("predicted", F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")

    return predict


def by_trees(groups: int = 4, rounds: int = 20, depth: int = 5, target: str = "lst_c") -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """Boosted trees for each configuration, fitted ``groups`` at a time over one persisted frame."""

    def predict(trained: DataFrame, scored: DataFrame, key: list[str]) -> DataFrame:
        names = sorted(r[0] for r in trained.select(key[0]).distinct().collect())  # one for each configuration
        part = lambda table, name: table.where(F.col(key[0]) == name)
        with features.together(trained, groups) as (frame, submit):
            models = submit(lambda name: features.train(features.training_frame(part(frame, name), target), target, rounds, depth), names)
        out = None
        for name, model in zip(names, models, strict=True):
            one = model.transform(part(scored, name).where("usable")).drop("cover_index", "features")
            out = one if out is None else out.unionByName(one)
        return out

    return predict


def run(
    configs: DataFrame, cells: DataFrame, predict: Callable[[DataFrame, DataFrame, list[str]], DataFrame], tile: str = "tile_id", sigma: float = change.SIGMA, least: int = change.MIN_SITE_CELLS, target: str = "lst_c", value: str = "ndvi"
) -> DataFrame:
    """One row for each of ``configs(config_id, before, scored, bins)`` and tile: how well a model
    trained on the windows ``before`` predicts the window ``scored``, overall, where the
    ground changed and where it did not, and whether it tracked the change.

    ``cells(tile, window, row, col, landcover, ndvi, lst_c, ...)`` is the composited
    cube.  Changed are cells in sites (patches of at least ``least`` cells whose change of
    ``value``, scored window less the median of those before, leaves the tile's spread); unchanged are
    those that were not even flagged.  Matched figures compare them inside strata of land
    cover and ``bins`` quantiles of the value before.  ``status`` refuses leakage and
    configurations without a scored cell or a site; the figures of such rows are null.

    Each step is one grouped plan with the configuration as a key.
    """
    key = ["config_id", tile]
    asked = refused(configs)
    fine = asked.where("reason IS NULL")
    trained = cells.join(F.broadcast(fine.select("config_id", F.explode("before").alias("window"))), "window")  # a few rows for each configuration
    scored = checkpointed(with_past(fine, cells, tile, {"_v0": value, "_t0": target}))
    field = scored.select(*key, "row", "col", (F.col(value) - F.col("_v0")).alias("change"))
    flagged = checkpointed(change.flag_change(field, key, sigma))
    sites = in_sites(flagged, key, least)
    marked = flagged.select(*key, "row", "col", F.col("changed").alias("_flag"), "threshold").join(sites.withColumn("_site", F.lit(True)), [*key, "row", "col"], "left")
    rows = predict(trained, scored, key).join(marked, [*key, "row", "col"]).where(F.col("predicted").isNotNull() & F.col(target).isNotNull())
    rows = checkpointed(rows.withColumn("_site", F.coalesce("_site", F.lit(False))).withColumn("residual", F.col("predicted") - F.col(target)).withColumn("shift", F.col(target) - F.col("_t0")))
    sides = F.filter(F.array(F.lit("overall"), F.when(F.col("_site"), "changed"), F.when(~F.col("_flag"), "unchanged")), lambda s: s.isNotNull())
    scores = change.score(rows.withColumn("side", F.explode(sides)).withColumn("observed", F.col(target)), [*key, "side"])
    wide = scores.groupBy(*key).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in SIDES for c in FIGURES])
    shifts = rows.groupBy(*key).agg(F.avg(F.when(F.col("_site"), F.col("shift"))).alias("changed_shift"), F.avg(F.when(~F.col("_flag"), F.col("shift"))).alias("unchanged_shift"), F.max("threshold").alias("threshold"))
    compared = checkpointed(strata(rows, key, "_v0").where(F.col("_site") | ~F.col("_flag")).select(*key, "stratum", F.col("_site").alias("changed"), "residual", "shift"))
    error = change.matched_difference(compared, key, "residual").select(*key, F.col("value").alias("matched_error"), "matched_cells", "unmatched_cells")
    effect = change.matched_difference(compared.where("shift IS NOT NULL"), key, "shift").select(*key, F.col("value").alias("matched_effect"))
    out = wide.join(shifts, key).join(error, key, "left").join(effect, key, "left")
    told = asked.select("config_id", "scored", "reason").join(out, "config_id", "left")
    status = F.coalesce("reason", F.when(F.col("overall_n").isNull(), "no cell to score").when(F.col("changed_n").isNull(), "no change site to validate against"), F.lit("ok"))
    told = told.withColumn("status", status).withColumn("observed_effect", F.col("changed_shift") - F.col("unchanged_shift")).withColumn("effect_error", F.col("changed_bias") - F.col("unchanged_bias")).drop("reason")
    figures = [c for c in told.columns if c not in ("config_id", tile, "scored", "status", "threshold")]
    return told.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in figures})


def with_past(configs: DataFrame, cells: DataFrame, tile: str, medians: dict[str, str]) -> DataFrame:
    """Cells of each configuration's scored window with medians over its windows before
    (new name: column; null without a value).  The windows of a cell are gathered once for all
    configurations; a list is as long as the cell has windows."""
    rest = [c for c in cells.columns if c not in (tile, "row", "col")]
    gathered = cells.groupBy(tile, "row", "col").agg(F.collect_list(F.struct(*rest)).alias("_w"))
    each = gathered.crossJoin(F.broadcast(configs.select("config_id", "before", "scored", "bins")))  # a row for each configuration

    def median(name: str) -> Column:
        had = F.filter("_w", lambda w: F.array_contains("before", w["window"]) & w[name].isNotNull())
        v = F.array_sort(F.transform(had, lambda w: w[name].cast("double")))
        return 0.5 * F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + 0.5 * F.get(v, F.floor(F.size(v) / 2).cast("int"))

    now = F.filter("_w", lambda w: w["window"] == F.col("scored"))
    told = each.withColumn("_now", now).where(F.size("_now") > 0).select("config_id", "bins", tile, "row", "col", *[median(c).alias(n) for n, c in medians.items()], F.explode("_now").alias("_now"))
    return told.select("config_id", "bins", tile, "row", "col", *[F.col("_now")[c].alias(c) for c in rest], *medians)


def in_sites(flagged: DataFrame, key: list[str], least: int) -> DataFrame:
    """Cells (key, row, col) of patches of change of one sign with at least ``least`` cells."""
    patches = checkpointed(components(flagged.where("changed").select(*key, "sign", "row", "col"), [*key, "sign"]))
    large = patches.groupBy(*key, "sign", "component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return patches.join(large, [*key, "sign", "component"], "left_semi").select(*key, "row", "col")


def strata(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Strata of land cover and the row's own number of quantile bins; one pass for each number in use."""
    out = None
    for (bins,) in sorted(rows.select("bins").distinct().collect()):
        one = change.strata(rows.where(F.col("bins") == bins), key, "landcover", value, bins)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.withColumn("stratum", F.lit(-1).cast("long"))
