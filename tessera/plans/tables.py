"""A deterministic reading of the star-schema tables as gridded observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.season import season_label

WIDTH = 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tile(key: str):
    """The one tile, as a value of the row: a constant key would turn equi joins into cross joins."""
    return F.when(F.col(key).isNotNull(), "t")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: a cell with cover class, elevation, and values of its own."""
    part = read(spark, sf_dir, "part")
    size = F.col("p_size")
    cover = F.when(size <= 10, 10).when(size <= 40, 50).when(size <= 45, 80).otherwise(30)
    return part.select(
        tile("p_partkey").alias("tile_id"), F.floor(F.col("p_partkey") / WIDTH).alias("row"), (F.col("p_partkey") % WIDTH).alias("col"), cover.alias("landcover"), F.col("p_retailprice").alias("elevation_m")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item in a season window: digital numbers of a scene (its day) in a cell."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        tile("l_partkey").alias("tile_id"), season_label(F.col("l_shipdate")).alias("window"), F.floor(F.col("l_partkey") / WIDTH).alias("row"), (F.col("l_partkey") % WIDTH).alias("col"),
        F.to_date("l_shipdate").cast("string").alias("scene_id"), F.col("l_shipdate").alias("ts"), (1000 + F.col("l_quantity") * 20).alias("blue"), (900 + F.col("l_quantity") * 60).alias("red"),
        (1000 + F.col("l_extendedprice") % 6000).alias("nir"), (1500 + F.col("l_discount") * 20000).alias("swir16"), (1200 + F.col("l_tax") * 20000).alias("swir22"),
        F.when(F.col("l_returnflag") == "R", 9).otherwise(3 + F.col("l_linenumber") % 6).alias("scl"), (F.col("l_linenumber") * 8).cast("int").alias("qa"), (40000 + F.col("l_extendedprice") % 9000).alias("thermal"),
    ).where("window IS NOT NULL")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_orderpriority").alias("collection"), F.col("o_orderdate").alias("ts"), season_label(F.col("o_orderdate")).alias("window"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.floor(F.col("o_totalprice")) % 100).cast("double").alias("cloud_cover"), F.when(F.col("o_custkey") % 3 == 0, 5.09).otherwise(2.14).alias("processing_baseline"),
        F.when(F.col("o_custkey") % 4 == 0, "landsat-7").when(F.col("o_custkey") % 4 == 1, "landsat-8").otherwise("landsat-9").alias("platform"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("ts"), F.col("event_type"), F.col("user_id"), F.col("value"), (F.col("value") * 37 % 360).alias("direction"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a cell: quantities ordered there, none in some."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_partkey") / WIDTH).alias("row"), (F.col("l_partkey") % WIDTH).alias("col")).agg(
        F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0.0)).alias("population"), (F.avg("l_discount") - 0.05).alias("delta")
    )


# -- the same tables in SQL ---------------------------------------------------------

LABEL = "(CASE WHEN month({0}) IN (4,5,6) THEN year({0})||'-summer' WHEN month({0}) IN (11,12) THEN year({0})||'-winter' WHEN month({0})=1 THEN (year({0})-1)||'-winter' END)"
CELLS = "cells AS (SELECT 't' AS tile_id, CAST(floor(p_partkey/50.0) AS BIGINT) AS \"row\", p_partkey % 50 AS col, CASE WHEN p_size<=10 THEN 10 WHEN p_size<=40 THEN 50 WHEN p_size<=45 THEN 80 ELSE 30 END AS landcover, p_retailprice AS elevation_m FROM part)"
OBS = (
    "obs AS (SELECT * FROM (SELECT 't' AS tile_id, " + LABEL.format("l_shipdate") + " AS \"window\", CAST(floor(l_partkey/50.0) AS BIGINT) AS \"row\", l_partkey % 50 AS col, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS scene_id, l_shipdate AS ts, "
    "1000+l_quantity*20 AS blue, 900+l_quantity*60 AS red, 1000+l_extendedprice%6000 AS nir, 1500+l_discount*20000 AS swir16, 1200+l_tax*20000 AS swir22, "
    "CASE WHEN l_returnflag='R' THEN 9 ELSE 3+l_linenumber%6 END AS scl, CAST(l_linenumber*8 AS INTEGER) AS qa, 40000+l_extendedprice%9000 AS thermal FROM lineitem) WHERE \"window\" IS NOT NULL)"
)
SCENES = (
    "scenes AS (SELECT o_orderkey AS scene_id, o_orderpriority AS collection, o_orderdate AS ts, " + LABEL.format("o_orderdate") + " AS \"window\", CASE WHEN o_orderstatus='P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT)%100 END::DOUBLE AS cloud_cover, "
    "CASE WHEN o_custkey%3=0 THEN 5.09 ELSE 2.14 END::DOUBLE AS processing_baseline, CASE o_custkey%4 WHEN 0 THEN 'landsat-7' WHEN 1 THEN 'landsat-8' ELSE 'landsat-9' END AS platform FROM orders)"
)
HOURLY = "hourly AS (SELECT ts, event_type, user_id, value, (value*37)%360 AS direction FROM events)"
PEOPLE = "people AS (SELECT CAST(floor(l_partkey/50.0) AS BIGINT) AS \"row\", l_partkey%50 AS col, sum(CASE WHEN l_linenumber=1 THEN l_quantity ELSE 0 END) AS population, avg(l_discount)-0.05 AS delta FROM lineitem GROUP BY 1,2)"
