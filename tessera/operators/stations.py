"""Monitors: medians per station and leave-one-station-out validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_DAYS = 14
LEAST_STATIONS = 4


#: Id of fine particulates among the monitors' parameters.
FINE_PARTICLES = 2


def first_sensor(locations: DataFrame, parameter: int = FINE_PARTICLES) -> DataFrame:
    """The first sensor of each location whose parameter has this id."""
    from pyspark.sql import Window

    exploded = locations.select("id", "name", "coordinates", F.posexplode("sensors").alias("nth", "sensor")).where(F.col("sensor.parameter.id") == parameter)
    return exploded.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).where("rank = 1").select("id", "name", "coordinates", F.col("sensor.id").alias("sensor_id"))


def station_medians(daily: DataFrame, keys: list[str], value: str = "value", least: int = LEAST_DAYS) -> DataFrame:
    """Median of real values (negative ones are sentinels), null with a reason for too few days."""
    real = F.when(F.col(value) >= 0, F.col(value))
    out = daily.groupBy(*keys).agg(F.count(real).alias("days"), F.median(real).alias("median"))
    few = F.col("days") < least
    return out.withColumn("median", F.when(~few, F.col("median"))).withColumn("reason", F.when(few, F.format_string("%d of %d days", F.col("days"), F.lit(least))))


def leave_one_out(stations: DataFrame, keys: list[str], x: str = "modelled", y: str = "observed") -> DataFrame:
    """Each station predicted by the line through all others, and by their mean.

    Closed form: sums over all stations less the station's own, about the mean for
    accuracy; O(n), one small row per group joined back.  Where a fold has no slope,
    or fewer than four stations stand, ``status`` says so and predictions are null.
    """
    means = stations.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    centred = stations.join(means, keys).withColumn("dx", F.col(x) - F.col("mx")).withColumn("dy", F.col(y) - F.col("my"))
    sums = centred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
    )
    ends = stations.join(sums.select(*keys, "lo", "hi"), keys).groupBy(*keys).agg(
        F.count_if(F.col(x) == F.col("lo")).alias("n_lo"), F.count_if(F.col(x) == F.col("hi")).alias("n_hi"),
    )
    j = centred.join(sums, keys).join(ends, keys)
    m = F.col("n") - 1
    sx, sy = F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy")
    sxx, sxy = F.col("sxx") - F.col("dx") ** 2, F.col("sxy") - F.col("dx") * F.col("dy")
    # a fold has no spread if all but one station share a value
    flat = (F.col("lo") == F.col("hi")) | ((F.col("n_lo") == m) & (F.col("n_hi") == 1)) | ((F.col("n_hi") == m) & (F.col("n_lo") == 1))
    status = F.when(F.col("n") < LEAST_STATIONS, "too few stations").when(F.col("lo") == F.col("hi"), "no spread").when(flat, "a fold without spread").otherwise("ok")
    slope = F.try_divide(sxy - sx * sy / m, sxx - sx * sx / m)
    base = F.try_divide(sy - slope * sx, m.cast("double"))
    ok = status == "ok"
    return j.withColumn("status", status).withColumn("predicted", F.when(ok, F.col("my") + base + slope * F.col("dx"))).withColumn("null_predicted", F.when(ok, F.col("my") + F.try_divide(sy, m.cast("double")))).select(
        *stations.columns, "status", "predicted", "null_predicted"
    )


def validation_report(scored: DataFrame, keys: list[str], x: str = "modelled", y: str = "observed") -> DataFrame:
    """Pooled line, errors of the folds and of the null model, and whether it is beaten."""
    mae, null_mae = F.avg(F.abs(F.col("predicted") - F.col(y))), F.avg(F.abs(F.col("null_predicted") - F.col(y)))
    return scored.where("status = 'ok'").groupBy(*keys).agg(
        F.count("*").alias("stations"), F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("background"), mae.alias("mae"), null_mae.alias("null_mae"), F.corr("predicted", y).alias("correlation"), (mae < null_mae).alias("beats_null")
    )
