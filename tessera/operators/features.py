"""Feature tables of a surface-temperature model, folds and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.raster import checkpointed, neighbourhood_mean

BASE = ["ndvi", "ndbi", "albedo", "elevation_m"]
NEAR = ["ndvi", "ndbi"]
WEATHER = ["air_temp_c", "wind_speed_ms", "relative_humidity_pct"]
NUMERIC = [*BASE, *[f"{n}_near" for n in NEAR], *WEATHER]
BLOCK, FOLDS = 20, 5
#: Scalars up to which a side of one row per tile and window is broadcast.
BROADCAST_ROWS = 100_000


def with_scalars(cells: DataFrame, scalars: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the scalars of their window; a key with two rows of scalars is an error."""
    twice = scalars.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("more than one row of scalars for a window")
    side = F.broadcast(scalars) if scalars.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else scalars
    return cells.join(side, keys)


def features(cells: DataFrame, scalars: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Cells with neighbourhood means and their window's weather; ``usable`` where all
    is known and the land cover is a class."""
    out = cells
    for name in NEAR:
        out = neighbourhood_mean(out, keys, name, height, width)
    out = with_scalars(out, scalars, keys)
    known = F.col("landcover").isNotNull() & (F.col("landcover") != 0)
    for name in NUMERIC:
        known = known & F.col(name).isNotNull()
    return out.withColumn("usable", known)


def training_frame(table: DataFrame, target: str = "lst_c") -> DataFrame:
    return table.where(F.col("usable") & F.col(target).isNotNull())


def block_folds(cells: DataFrame, keys: list[str], n: int = FOLDS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Fold of each block: blocks in hash order, dealt round. Whole blocks share a fold,
    so neighbours do not leak; the block table has one row per block x block cells."""
    blocks = cells.select(*keys, F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col")).distinct()
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("block_row").cast("string"), F.col("block_col").cast("string")))
    order = Window.partitionBy(*keys).orderBy(code) if keys else Window.orderBy(code)
    return blocks.withColumn("fold", (F.row_number().over(order) - 1) % n)


def train(frame: DataFrame, target: str = "lst_c", rounds: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    """Gradient-boosted trees with absolute loss; land cover is a category."""
    stages = [
        StringIndexer(inputCol="landcover", outputCol="cover_index", handleInvalid="keep"),
        VectorAssembler(inputCols=[*NUMERIC, "cover_index"], outputCol="features"),
        GBTRegressor(labelCol=target, featuresCol="features", predictionCol="predicted", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed, maxBins=64),
    ]
    return Pipeline(stages=stages).fit(frame)


def check_features(model: PipelineModel) -> None:
    """Refuse a model whose features are others, or in another order."""
    have = model.stages[1].getInputCols()
    if have != [*NUMERIC, "cover_index"]:
        raise ValueError(f"the model was trained on {have}")


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    check_features(model)
    return sorted(zip([*NUMERIC, "cover_index"], model.stages[2].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def naive_prediction(held: DataFrame, rest: DataFrame, groups: list[str], target: str = "lst_c") -> DataFrame:
    """Mean of the group in the other folds, or their pooled mean."""
    means = rest.groupBy(*groups).agg(F.avg(target).alias("group_mean"))
    pooled = rest.agg(F.avg(target).alias("pooled"))
    return held.join(means, groups, "left").crossJoin(F.broadcast(pooled)).withColumn("naive", F.coalesce("group_mean", "pooled")).drop("group_mean", "pooled")


def fold_means(frame: DataFrame, groups: list[str], target: str = "lst_c") -> DataFrame:
    """Naive predictions of all folds at once: the group's sums less the fold's own."""
    own = frame.groupBy(*groups, "fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    g = own.groupBy(*groups).agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    f = own.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    a = own.agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
    joined = own.join(g, groups).join(f, "fold").crossJoin(F.broadcast(a))
    naive = F.coalesce(F.try_divide(F.col("gs") - F.col("s"), F.col("gn") - F.col("n")), F.try_divide(F.col("as") - F.col("fs"), F.col("an") - F.col("fn")))
    return frame.join(joined.select(*groups, "fold", naive.alias("naive")), [*groups, "fold"])


#: Fits that run beside each other, and rows of a frame that a task of theirs reads.
TOGETHER, ROWS_A_TASK = 4, 50_000


def packed(frame: DataFrame) -> DataFrame:
    """``frame`` written once, in as many partitions as its rows ask for: each level of each tree
    runs a task for every partition, and the step before may have left hundreds of a few rows."""
    written = checkpointed(frame)
    return written.coalesce(written.count() // ROWS_A_TASK + 1)


@contextmanager
def together(frame: DataFrame, at_once: int = TOGETHER) -> Iterator[tuple[DataFrame, Callable]]:
    """(frame, submit): ``frame`` :func:`packed` and persisted while several fits read it, and a function that
    applies another to each item from ``at_once`` threads of the driver, each in a fair pool of its own where the
    session schedules fairly.  Blocks that are lost with an executor are read or computed again."""
    sc = frame.sparkSession.sparkContext
    kept = packed(frame).persist(StorageLevel.MEMORY_AND_DISK)

    def submit(f: Callable, items: list) -> list:
        def one(item):
            sc.setLocalProperty("spark.scheduler.pool", f"fit-{item}")
            try:
                return f(item)
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)

        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(inheritable_thread_target(one), items))

    try:
        yield kept, submit
    finally:
        kept.unpersist()


def cross_validate(frame: DataFrame, groups: list[str], folds: list, target: str = "lst_c", rounds: int = 20, depth: int = 5) -> DataFrame:
    """Held-out predictions of every fold, with the naive ones; one fit per fold, all
    submitted together over one persisted frame."""
    with together(frame) as (kept, submit):
        models = submit(lambda k: train(kept.where(F.col("fold") != k), target, rounds, depth), folds)
    out = None
    for k, model in zip(folds, models, strict=True):
        rest, held = kept.where(F.col("fold") != k), kept.where(F.col("fold") == k)
        scored = naive_prediction(model.transform(held), rest, groups, target)
        out = scored if out is None else out.unionByName(scored)
    return out


def cv_report(scored: DataFrame, target: str = "lst_c") -> DataFrame:
    """MAE of each fold, its mean and population deviation, and skill over the naive one."""
    by = scored.groupBy("fold").agg(F.avg(F.abs(F.col("predicted") - F.col(target))).alias("mae"), F.avg(F.abs(F.col("naive") - F.col(target))).alias("naive_mae"))
    return by.agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("mae_sd"), F.avg("naive_mae").alias("naive_mae")).withColumn("skill", 1 - F.try_divide("mae", "naive_mae"))


def linear_without_fold(frame: DataFrame, x: Column, target: str = "lst_c") -> DataFrame:
    """For each fold the slope, intercept and mean target of all other folds, from the
    sums of each fold: one row per fold, no row is copied."""
    y = F.col(target)
    both = frame.where(x.isNotNull() & y.isNotNull())
    sums = {"n": F.count("*"), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "xy": F.sum(x * y)}
    own = both.groupBy("fold").agg(*[c.cast("double").alias(f"s{k}") for k, c in sums.items()])
    every = Window.partitionBy()  # a row per fold
    n, sx, sy, sxx, sxy = (F.sum(f"s{k}").over(every) - F.col(f"s{k}") for k in sums)
    slope = F.try_divide(sxy - F.try_divide(sx * sy, n), sxx - F.try_divide(sx * sx, n))
    line = own.select("fold", slope.alias("slope"), F.try_divide(sy, n).alias("naive"), F.try_divide(sx, n).alias("_mean"))
    return line.select("fold", "slope", (F.col("naive") - F.col("slope") * F.col("_mean")).alias("intercept"), "naive")


def leave_one_window_out(frame: DataFrame, groups: list[str], windows: list[str], target: str = "lst_c", rounds: int = 20, depth: int = 5) -> DataFrame:
    """Held-out predictions of every window by a model of the others: a fold is a
    window.  One fit per window of the list; fewer than two are refused."""
    if len(windows) < 2:
        raise ValueError("a window can be left out only if there are others")
    return cross_validate(frame.withColumn("fold", F.col("window")).where(F.col("window").isin(windows)), groups, windows, target, rounds, depth)


def save(model: PipelineModel, path: str) -> None:
    check_features(model)
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A saved model; one with other features, or in another order, is refused."""
    model = PipelineModel.load(path)
    check_features(model)
    return model


#: Variables of the cube that have a value in each cell, and those with one for a whole window.
SPATIAL = ["ndvi", "ndbi", "albedo", "lst_c", "landcover", "elevation_m", "population", "emission"]
SCALAR = [*WEATHER, "wind_direction_deg"]


def spatial_variable(name: str) -> str:
    """``name`` if it can be mapped; scalars of a window and unknown names are refused."""
    if name in SCALAR:
        raise ValueError(f"{name} has one value for a window and can't be mapped")
    if name not in SPATIAL:
        raise ValueError(f"no variable {name}; there are {', '.join(SPATIAL)}")
    return name


def linear(frame: DataFrame, keys: list[str], x: Column, target: str = "lst_c") -> DataFrame:
    """Slope and intercept of one feature for each key: a model that SQL can fit too."""
    return frame.withColumn("_x", x).groupBy(*keys).agg(F.regr_slope(target, "_x").alias("slope"), F.regr_intercept(target, "_x").alias("intercept"))
