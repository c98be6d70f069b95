"""Change detection, matched controls and hindcast scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import medians, quantiles
from tessera.operators.raster import checkpointed

MAD_TO_SIGMA = 1.4826
SIGMA = 3.0
MIN_SITE_CELLS = 9
BINS = 10


def split_windows(usable: DataFrame, key: list[str]) -> DataFrame:
    """Windows in time order, the first half before and the rest after; fewer than four are refused."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key)
    ranked = usable.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("window")))
    side = F.when(F.col("n") < 4, None).when(F.col("rank") <= F.floor(F.col("n") / 2), "before").otherwise("after")
    return ranked.withColumn("side", side).withColumn("reason", F.when(F.col("n") < 4, "fewer than four usable windows"))


def change_field(cells: DataFrame, key: list[str], value: str, before: Column, after: Column) -> DataFrame:
    """Median of a cell's windows after minus before; null where one side has none."""
    return cells.groupBy(*key, "row", "col").agg((F.median(F.when(after, F.col(value))) - F.median(F.when(before, F.col(value)))).alias("change"))


def threshold(field: DataFrame, key: list[str], sigma: float = SIGMA) -> DataFrame:
    """Common drift and the threshold from the tile's own spread, one row per tile."""
    sd = field.groupBy(*key).agg(F.stddev_pop("change").alias("sd"))
    drift = sd.join(medians(field, key, {"drift": F.col("change")}), key, "left")
    mad = medians(field.join(drift.select(*key, "drift"), key), key, {"mad": F.abs(F.col("change") - F.col("drift")) * MAD_TO_SIGMA})
    return drift.join(mad, key, "left").select(*key, "drift", (sigma * F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))).alias("threshold"))


def flag_change(field: DataFrame, key: list[str], sigma: float = SIGMA) -> DataFrame:
    """Cells with ``changed`` and its ``sign``.  The field is checkpointed: the passes
    over it do not compute it again."""
    field = checkpointed(field)
    moved = F.col("change") - F.col("drift")
    return field.join(threshold(field, key, sigma), key).withColumn("changed", F.coalesce(F.abs(moved) > F.col("threshold"), F.lit(False))).withColumn("sign", F.signum(moved).cast("int"))


def sites(flagged: DataFrame, key: list[str], least: int = MIN_SITE_CELLS) -> DataFrame:
    """Patches of change of one sign with at least ``least`` cells."""
    from tessera.operators.raster import components

    patches = components(flagged.where("changed").select(*key, "sign", "row", "col"), [*key, "sign"])
    sized = patches.join(flagged.select(*key, "row", "col", "change"), [*key, "row", "col"])
    return sized.groupBy(*key, "sign", "component").agg(F.count("*").alias("cells"), F.avg("change").alias("mean_change"), F.avg("row").alias("row"), F.avg("col").alias("col")).where(F.col("cells") >= least)


def largest(found: DataFrame, key: list[str], top: int | None = None) -> DataFrame:
    """Sites with their rank in the tile, the largest first, ties by component; the first ``top``."""
    from tessera.operators.regions import ranked

    out = ranked(found.withColumn("region_id", F.concat_ws("|", F.lpad(F.col("component").cast("string"), 20, "0"), F.col("sign").cast("string"))), key, F.col("cells").cast("double"), top)
    return out.drop("region_id", "score")


def strata(cells: DataFrame, key: list[str], cover: str, value: str, bins: int = BINS) -> DataFrame:
    """Stratum of each cell: land cover times (bins + 1) plus the quantile bin of the
    value; -1 without a value."""
    edges = quantiles(cells, key, value, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    return cells.join(edges, key, "left").withColumn("stratum", F.when(F.col(value).isNull(), -1).otherwise(F.col(cover) * (bins + 1) + bin_).cast("long")).drop("edges")


def matched_difference(cells: DataFrame, key: list[str], value: str) -> DataFrame:
    """Changed minus unchanged within strata, weighted by the changed; strata without
    a control are counted.  One conditional aggregate per stratum, no pairs."""
    each = cells.where(F.col("stratum") >= 0).groupBy(*key, "stratum").agg(
        F.count_if("changed").alias("n"), F.count_if(~F.col("changed")).alias("controls"), F.avg(F.when(F.col("changed"), F.col(value))).alias("t"), F.avg(F.when(~F.col("changed"), F.col(value))).alias("c")
    ).where("n > 0")
    on = F.col("controls") > 0
    return each.groupBy(*key).agg(
        F.try_divide(F.sum(F.when(on, F.col("n") * (F.col("t") - F.col("c")))), F.sum(F.when(on, F.col("n")))).alias("value"), F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias("matched_cells"), F.coalesce(F.sum(F.when(~on, F.col("n"))), F.lit(0)).alias("unmatched_cells")
    )


def refuse_leakage(trained: list[str], scored: list[str]) -> None:
    """A hindcast may only be scored on windows after all that it was trained on."""
    late = sorted(w for w in trained if w >= min(scored))
    if not trained or not scored or late:
        raise ValueError(f"trained on {', '.join(late) or 'nothing'}, scored from {min(scored) if scored else 'nothing'} on")


def score(pairs: DataFrame, key: list[str], predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """n, MAE, bias and spatial R2, raw and with the mean residual taken out."""
    both = pairs.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull()).withColumn("r", F.col(predicted) - F.col(observed))
    means = both.groupBy(*key).agg(F.avg("r").alias("bias"), F.avg(observed).alias("mean"))
    sums = both.join(means, key).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(F.abs("r")).alias("mae"), F.first("bias").alias("bias"), F.avg(F.abs(F.col("r") - F.col("bias"))).alias("mae_debiased"),
        F.sum(F.col("r") ** 2).alias("ss"), F.sum((F.col("r") - F.col("bias")) ** 2).alias("ss_debiased"), F.sum((F.col(observed) - F.col("mean")) ** 2).alias("sv"),
    )
    r2 = lambda s: F.when(F.col("sv") > 0, 1 - F.col(s) / F.col("sv"))
    return sums.select(*key, "n", "mae", "bias", r2("ss").alias("spatial_r2"), "mae_debiased", r2("ss_debiased").alias("spatial_r2_debiased"))


def difference_in_differences(cells: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    d = F.col(after) - F.col(before)
    changed, rest = F.avg(F.when(F.col("changed"), d)), F.avg(F.when(~F.col("changed"), d))
    return cells.groupBy(*key).agg(changed.alias("changed_shift"), rest.alias("unchanged_shift"), (changed - rest).alias("effect"))
