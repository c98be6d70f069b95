"""The catalogue of builds: three tables and a manifest that makes a build visible in all of them at once.

Rows of a build go to folders of the run that recorded it.  The manifest is written
last, one row for each build; what it does not name does not exist for a reader.  A
run that fails halfway leaves the build as it was, a run that is repeated replaces it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.features import BROADCAST_ROWS
from tessera.sources.io import LATEST_BUILD

TABLES = ("builds", "build_sources", "build_variables")


def record(root: str, builds: DataFrame, build_sources: DataFrame, build_variables: DataFrame) -> str:
    """Record the builds of ``builds(build_id, built_at, ...)`` with their sources and variables,
    in place of earlier runs of the same builds.  Returns the name of the run.

    Tables may have columns that earlier runs did not have.  Sources and variables
    of builds that ``builds`` does not list are refused, and nothing becomes visible.
    """
    spark, run = builds.sparkSession, uuid.uuid4().hex
    twice = builds.groupBy("build_id").count().where("count > 1 OR build_id IS NULL").limit(1).count()
    if twice:
        raise ValueError("a build without an id, or listed twice")
    for name, table in zip(TABLES[1:], (build_sources, build_variables), strict=True):
        if table.join(builds, "build_id", "left_anti").limit(1).count():
            raise ValueError(f"{name} names a build that is not recorded")
    for name, table in zip(TABLES, (builds, build_sources, build_variables), strict=True):
        table.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{root}/{name}")
    # the run's own rows name its builds: they are read back, not computed again
    kept = spark.read.parquet(f"{root}/builds/run={run}").select("build_id", F.lit(run).alias("run"), F.lit(_next(spark, root)).alias("nth"))
    kept.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _next(spark: SparkSession, root: str) -> int:
    """Number of the run: one more than the largest so far."""
    if not _exists(spark, f"{root}/manifest"):
        return 1
    return (spark.read.parquet(f"{root}/manifest").agg(F.max("nth")).first()[0] or 0) + 1


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(build_id, run) of each build as it stands: its last run."""
    rows = spark.read.parquet(f"{root}/manifest")
    last = Window.partitionBy("build_id").orderBy(F.desc("nth"), F.desc("run"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("build_id", "run")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The visible rows of one of TABLES; columns that a build's run did not have are null.
    Only the folders of runs that some build points to are read."""
    if table not in TABLES:
        raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
    rows, named = spark.read.option("mergeSchema", True).parquet(f"{root}/{table}"), manifest(spark, root)
    side = F.broadcast(named) if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else named
    return rows.join(side, ["build_id", "run"], "left_semi").drop("run")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The report of the latest build."""
    return spark.sql(LATEST_BUILD, builds=read(spark, root, "builds"), build_sources=read(spark, root, "build_sources"))
