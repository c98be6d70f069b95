"""Kernel-weighted spatial sums of sources: isotropic and directional kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.raster import dealt

#: Literature values, fixed.
SEASONS = {"winter": (250.0, 0.05), "summer": (800.0, 0.11)}
SIGMA_INITIAL_M, BARE_M_S, CANOPY_M_S, MIN_WIND, MAX_RADIUS, SEASONAL_SIGMA_M, FETCH_M, RADIUS_SIGMAS = 50.0, 0.001, 0.010, 0.5, 200, 1000.0, 20_000.0, 6
TO_MICRO = 1e6
#: Rows of kernels up to which they are broadcast (24 MB), and tasks that a tile's sources are dealt to beyond that.
BROADCAST_WEIGHTS, SALTS = 1_000_000, 64
#: Parts of sums that a task makes, rows of cells whose sources stay together, and blocks that a task convolves.
PARTS_A_TASK, SIDE, BLOCKS_A_TASK = 4_000_000, 32, 8


def season_parameters(windows: DataFrame) -> DataFrame:
    """``windows(season, ...)`` with mixing height and spread; another season is refused in ``reason``."""
    height = F.when(F.col("season") == "winter", SEASONS["winter"][0]).when(F.col("season") == "summer", SEASONS["summer"][0])
    spread = F.when(F.col("season") == "winter", SEASONS["winter"][1]).when(F.col("season") == "summer", SEASONS["summer"][1])
    return windows.withColumn("mixing_height_m", height).withColumn("sigma_y_coefficient", spread).withColumn("reason", F.when(height.isNull(), F.concat(F.lit("no parameters for season "), F.col("season"))))


def deposition(cells: DataFrame, keys: list[str], canopy: str = "canopy") -> DataFrame:
    """One deposition velocity for each tile and window, by its mean canopy."""
    return cells.groupBy(*keys).agg((BARE_M_S + F.coalesce(F.avg(canopy), F.lit(0.0)) * (CANOPY_M_S - BARE_M_S)).alias("deposition"))


def _speed() -> Column:
    """Wind with its floor; without a wind there is no answer."""
    return F.when(F.col("wind_speed").isNotNull() & ~F.isnan(F.col("wind_speed").cast("double")), F.greatest(F.col("wind_speed"), F.lit(MIN_WIND)))


def _offsets(params: DataFrame, radius: Column | int) -> DataFrame:
    r = radius if isinstance(radius, Column) else F.lit(radius)
    line = lambda: F.explode(F.sequence(-r, r))
    return params.withColumn("dr", line()).withColumn("dc", line())


def seasonal_kernel(params: DataFrame, keys: list[str], res: float) -> DataFrame:
    """(keys, dr, dc, weight) of the isotropic kernel of each row of
    ``params(keys, wind_speed, mixing_height_m, deposition)``: a Gaussian with loss
    along the way, whose total before loss is fetch over ventilation and cell area."""
    sigma = SEASONAL_SIGMA_M / res
    radius = int(min(np.ceil(RADIUS_SIGMAS * sigma), MAX_RADIUS))
    ventilation = _speed() * F.col("mixing_height_m")
    d = F.hypot(F.col("dr").cast("double"), F.col("dc").cast("double"))
    line = np.exp(-0.5 * (np.hypot(*np.mgrid[-radius : radius + 1, -radius : radius + 1]) / sigma) ** 2)
    shape = F.exp(-0.5 * (d / sigma) ** 2) * F.exp(-F.col("deposition") * d * res / ventilation)
    return _offsets(params, radius).withColumn("weight", shape * (FETCH_M / (ventilation * res * res) / float(line.sum()))).select(*keys, "dr", "dc", "weight")


def plume_kernel(params: DataFrame, keys: list[str], res: float, radius: int = MAX_RADIUS) -> DataFrame:
    """Directional kernel of receptor minus source offsets: spread grows downwind,
    nothing goes upwind, the own cell counts as half a cell downwind."""
    bearing = F.radians(F.col("wind_direction"))
    east, north = F.col("dc") * res, -F.col("dr") * res
    de, dn = -F.sin(bearing), -F.cos(bearing)
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    along = F.when(own, res / 2).otherwise(east * de + north * dn)
    across = F.abs(east * -dn + north * de)
    ventilation = _speed() * F.col("mixing_height_m")
    ahead = F.greatest(along, F.lit(0.0))
    spread = SIGMA_INITIAL_M + F.col("sigma_y_coefficient") * ahead
    value = F.exp(-0.5 * (across / spread) ** 2) / (float(np.sqrt(2 * np.pi)) * spread * ventilation) * F.exp(-F.col("deposition") * ahead / ventilation)
    return _offsets(params, radius).withColumn("weight", F.when(along > 1e-6, value).otherwise(0.0)).select(*keys, "dr", "dc", "weight")


def concentration(sources: DataFrame, kernel: DataFrame, keys: list[str], height: int, width: int, value: str = "emission") -> DataFrame:
    """Sum of all sources' kernels at each cell they reach, in millionths, as joins and
    a grouped sum: for small radii and as the check of :func:`concentration_blocks`.
    A kernel may have fewer keys than its sources: one for all scenarios of a tile."""
    on, some = [k for k in keys if k in kernel.columns], kernel.where("weight <> 0")
    emitting = sources.where(F.col(value) > 0)
    weights = some.limit(BROADCAST_WEIGHTS + 1).count()
    if weights <= BROADCAST_WEIGHTS:
        # each task makes PARTS_A_TASK parts or so: Spark counts sources, and would give many of them to one
        tasks = emitting.count() * weights // PARTS_A_TASK + 1
        sent = emitting.repartition(tasks, *keys, F.floor(F.col("row") / SIDE)).join(F.broadcast(some), on)
    else:  # a tile's sources go to SALTS tasks, each with a copy of the tile's kernel
        dealt = emitting.withColumn("_salt", F.pmod(F.xxhash64("row", "col"), F.lit(SALTS)))
        sent = dealt.join(some.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*on, "_salt"])
    at = sent.select(*keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.col(value) * F.col("weight")).alias("part"))
    return at.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(*keys, "row", "col").agg((F.greatest(F.sum("part"), F.lit(0.0)) * TO_MICRO).alias("concentration"))


def concentration_blocks(sources: DataFrame, kernel: DataFrame, keys: list[str], height: int, width: int, value: str = "emission", block: int = 256) -> DataFrame:
    """The same by overlap-add: each block of sources is convolved with its kernel by
    FFT inside a task and the overlapping results are summed.  A block has a bounded
    number of cells and a kernel a bounded radius; a block whose side is four radii
    or more sends at most 2.25 times its cells."""
    on = [k for k in keys if k in kernel.columns]
    packed = kernel.groupBy(*on).agg(F.max("dr").alias("radius"), F.sort_array(F.collect_list(F.struct("dr", "dc", "weight"))).alias("k")).select(*on, "radius", F.transform("k", lambda x: x["weight"]).alias("k"))
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    rows = sources.where(F.col(value) > 0).withColumn("_br", br).withColumn("_bc", bc)
    grouped = rows.groupBy(*keys, "_br", "_bc").agg(F.collect_list(F.struct("row", "col", F.col(value).cast("double").alias("v"))).alias("s")).join(packed, on)
    # a batch holds all blocks of a task: so many tasks that these are few
    tasks = rows.select(*keys, "_br", "_bc").distinct().count() // BLOCKS_A_TASK + 1
    grouped = grouped.repartition(tasks, *keys, "_br", "_bc")
    schema = grouped.select(*keys, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(0.0).alias("part")).schema

    def convolve(frames):
        for pdf in frames:
            for rec in pdf.to_dict("records"):
                r, radius = int(rec["radius"]), int(rec["radius"])
                k = np.asarray(rec["k"], float).reshape(2 * r + 1, 2 * r + 1)
                s = rec["s"]
                rr, cc = np.array([x["row"] for x in s]), np.array([x["col"] for x in s])
                r0, c0 = rr.min(), cc.min()
                field = np.zeros((rr.max() - r0 + 1, cc.max() - c0 + 1))
                np.add.at(field, (rr - r0, cc - c0), [x["v"] for x in s])
                shape = [a + b - 1 for a, b in zip(field.shape, k.shape, strict=True)]
                out = np.fft.irfft2(np.fft.rfft2(field, shape) * np.fft.rfft2(k, shape), shape)
                ri, ci = np.meshgrid(np.arange(shape[0]) + r0 - radius, np.arange(shape[1]) + c0 - radius, indexing="ij")
                ok = (ri >= 0) & (ri < height) & (ci >= 0) & (ci < width)
                yield pd.DataFrame({**{key: rec[key] for key in keys}, "row": ri[ok], "col": ci[ok], "part": out[ok]})[[*keys, "row", "col", "part"]]

    parts = grouped.mapInPandas(convolve, schema)
    return parts.groupBy(*keys, "row", "col").agg((F.greatest(F.sum("part"), F.lit(0.0)) * TO_MICRO).alias("concentration"))


def removed_emissions(cells: DataFrame, mask: DataFrame, keys: list[str], fraction: str = "emission_fraction", value: str = "emission", on: list[str] | None = None) -> DataFrame:
    """What each scenario takes away: the change in concentration is linear in it while
    the canopy is unchanged.  ``status`` refuses a scenario without an inventory or
    with no emissions inside its mask."""
    joined = mask.join(dealt(cells), on or [c for c in ("tile_id", "row", "col") if c in cells.columns and c in mask.columns], "left")
    out = joined.withColumn("removed", F.coalesce(F.col(value), F.lit(0.0)) * F.col(fraction))
    status = out.groupBy(*keys).agg(F.count(value).alias("known"), F.coalesce(F.sum(value), F.lit(0.0)).alias("inside")).select(
        *keys, F.when(F.col("known") == 0, "no inventory").when(F.col("inside") == 0, "nothing to remove").otherwise("ok").alias("status")
    )
    return out.join(dealt(status), keys)
