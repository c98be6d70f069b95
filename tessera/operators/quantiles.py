"""Exact quantiles of very large groups: a sketch brackets each, the bracket decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the sketch; a bracket holds about 8 / ACCURACY of a group's rows.
ACCURACY = 10_000


def quantiles(table: DataFrame, keys: list[str], value: str, fractions: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """``keys, q``: the quantiles of each key's values, interpolated between ranks as
    ``percentile`` does.  Null values are left out; a key without a value has no row.

    A sketch of bounded size gives each quantile a lower and an upper neighbour; values
    below the bracket are only counted, map side first, and those inside it are counted
    by value and ranked.  So no task holds the distinct values of a whole group; one of
    at most ``accuracy`` rows is its own bracket.  A bracket that missed its ranks would
    be an error and not a wrong answer.
    """
    valued = table.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    slack = 4 / accuracy
    low, high = [max(p - slack, 0.0) for p in fractions], [min(p + slack, 1.0) for p in fractions]
    ends = lambda extreme, ps: F.when(F.count("*") <= accuracy, F.array_repeat(extreme("_v"), len(ps))).otherwise(F.percentile_approx("_v", ps, accuracy))
    bracket = valued.groupBy(*keys).agg(F.count("*").alias("_n"), ends(F.min, low).alias("_low"), ends(F.max, high).alias("_high"))
    zipped = F.arrays_zip(F.array(*[F.lit(i) for i in range(len(fractions))]).alias("i"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    # below a bracket the value no longer matters: null, which sorts first
    spots = F.transform(F.filter(zipped, lambda e: F.col("_v") <= e["high"]), lambda e: F.struct(e["i"].alias("i"), F.when(F.col("_v") >= e["low"], F.col("_v")).alias("v")))
    counted = valued.join(bracket, keys).select(*keys, "_n", F.explode(spots).alias("s")).groupBy(*keys, "_n", F.col("s.i").alias("_i"), F.col("s.v").alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    place = F.element_at(F.array(*[F.lit(float(p)) for p in fractions]), F.col("_i") + 1) * (F.col("_n") - 1)
    ranked = counted.withColumn("_upto", upto).withColumn("_place", place)

    def at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    each = ranked.groupBy(*keys, "_i").agg(F.first("_place").alias("_place"), at(F.floor("_place")).alias("_a"), at(F.ceil("_place")).alias("_b"))
    down, up = F.floor("_place"), F.ceil("_place")
    between = F.when((down == up) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((up - F.col("_place")) * F.col("_a") + (F.col("_place") - down) * F.col("_b"))
    found = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(between)
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", found.alias("q")))), lambda s: s["q"]).alias("q"))


def medians(table: DataFrame, keys: list[str], values: dict[str, object], accuracy: int = ACCURACY) -> DataFrame:
    """``keys`` and one exact median for each entry of ``values`` (name: column), null
    where it has no value; keys without any value have no row."""
    long = table.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()])).alias("_m")).select(*keys, F.col("_m.name").alias("_name"), F.col("_m.value").alias("_value"))
    each = quantiles(long, [*keys, "_name"], "_value", [0.5], accuracy)
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("q")[0])).alias(n) for n in values])
