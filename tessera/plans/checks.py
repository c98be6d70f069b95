"""Queries on structure, skill, sites, classes and stored cubes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import change, composite, quality, raster, stations
from tessera.plans import tables as T
from tessera.plans.observing import _IDX, _PIX, W, indices
from tessera.plans.people import _FIELD, change_field, station_table
from tessera.plans.registry import query, r4
from tessera.sources import io

NETS = 5


@query(
    f"WITH st AS (SELECT user_id AS station, user_id%{NETS} AS net, avg(value) AS modelled, avg(value*1.7+event_id%11) AS observed FROM events GROUP BY 1,2), c AS (SELECT *, modelled-avg(modelled) OVER w AS dx, observed-avg(observed) OVER w AS dy, avg(observed) OVER w AS my, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY net)), "
    "z AS (SELECT *, sum(dx*dx) OVER w AS sxx, sum(dx*dy) OVER w AS sxy, sum(dx) OVER w AS sx, sum(dy) OVER w AS sy FROM c WINDOW w AS (PARTITION BY net)), f AS (SELECT *, ((sxy-dx*dy)-(sx-dx)*(sy-dy)/(n-1))/((sxx-dx*dx)-(sx-dx)*(sx-dx)/(n-1)) AS slope FROM z WHERE n>=4), "
    "p AS (SELECT net, observed, my+(sy-dy-slope*(sx-dx))/(n-1)+slope*dx AS predicted, my+(sy-dy)/(n-1) AS null_predicted FROM f) "
    "SELECT net, count(*) AS stations, round(avg(abs(predicted-observed)),3) AS mae, round(avg(abs(null_predicted-observed)),3) AS null_mae, round(corr(predicted,observed),3) AS correlation, avg(abs(predicted-observed))<avg(abs(null_predicted-observed)) AS beats_null FROM p GROUP BY 1"
)
def station_skill(spark, sf_dir):
    """Correlation and errors of each network's left-out stations, and whether they beat the mean of the others."""
    nets = station_table(spark, sf_dir).withColumn("net", F.col("station") % NETS)
    out = stations.validation_report(stations.leave_one_out(nets, ["net"]), ["net"])
    return out.select("net", "stations", *[F.round(c, 3).alias(c) for c in ("mae", "null_mae", "correlation")], "beats_null")


SIGMA, LEAST = 1.0, 2


@query(
    f"WITH RECURSIVE {_FIELD.replace('3.0*1.4826', f'{SIGMA}*1.4826')}, m AS (SELECT \"row\" AS r, col AS c, change, CAST(sign(change-drift) AS INTEGER) AS s FROM fl, dr WHERE changed), e AS (SELECT a.s, a.r*2147483648+a.c AS x, b.r*2147483648+b.c AS y FROM m a JOIN m b ON a.s=b.s AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1), "
    f"w AS (SELECT s, x, y FROM e UNION SELECT w.s, w.x, e.y FROM w JOIN e ON w.s=e.s AND w.y=e.x), k AS (SELECT s, x, min(y) AS component FROM w GROUP BY 1,2), g AS (SELECT k.s AS sign, component, count(*) AS cells, round(avg(change),4) AS mean_change, avg(m.r) AS \"row\", avg(m.c) AS col FROM k JOIN m ON m.s=k.s AND m.r*2147483648+m.c=k.x GROUP BY 1,2 HAVING count(*)>={LEAST}) "
    "SELECT CAST(row_number() OVER (ORDER BY cells DESC, component, sign) AS INTEGER) AS rank, sign, component, cells, mean_change, round(\"row\",3) AS \"row\", round(col,3) AS col FROM g"
)
def loose_change_sites(spark, sf_dir):
    """The same sites at one sigma and two cells, where the small tables have some."""
    f = change.flag_change(change_field(spark, sf_dir), ["tile_id"], SIGMA)
    found = change.largest(change.sites(f, ["tile_id"], LEAST), ["tile_id"])
    return found.select("rank", "sign", "component", "cells", r4("mean_change"), F.round("row", 3).alias("row"), F.round("col", 3).alias("col"))


BLOCK = 10


@query(
    f"WITH {T.CELLS}, b AS (SELECT \"row\"//{BLOCK} AS block_row, col//{BLOCK} AS block_col, \"row\"%{BLOCK} AS r, col%{BLOCK} AS c FROM cells) SELECT block_row, block_col, count(*) AS cells, count(DISTINCT (r,c)) AS distinct_cells, "
    f"count(DISTINCT (r,c))={BLOCK * BLOCK} AND count(*)={BLOCK * BLOCK} AND min(r)=0 AND min(c)=0 AND max(r)={BLOCK - 1} AND max(c)={BLOCK - 1} AS complete FROM b GROUP BY 1,2"
)
def block_structure(spark, sf_dir):
    """Blocks that are whole, and those that the grid's edge cuts."""
    at = lambda c: F.floor(F.col(c) / BLOCK)
    blocks = T.cells(spark, sf_dir).withColumn("block_row", at("row")).withColumn("block_col", at("col")).withColumn("row", F.col("row") % BLOCK).withColumn("col", F.col("col") % BLOCK)
    return quality.structure(blocks, ["block_row", "block_col"], BLOCK, BLOCK).select("block_row", "block_col", "cells", "distinct_cells", "complete")


@query(f"WITH {T.CELLS}, n AS (SELECT landcover, count(*) AS cells FROM cells GROUP BY 1) SELECT landcover, cells, round(cells/sum(cells) OVER (),6) AS share, row_number() OVER (ORDER BY cells DESC, landcover) AS rank FROM n")
def ranked_classes(spark, sf_dir):
    """Land-cover classes, the most common first."""
    classes = quality.shares(T.cells(spark, sf_dir), "landcover")  # one row for each class
    return classes.select("landcover", "cells", F.round("share", 6).alias("share"), F.row_number().over(Window.orderBy(F.desc("cells"), "landcover")).cast("long").alias("rank"))


@query(
    f"WITH {T.OBS}, {_PIX}, {_IDX}, c AS (SELECT {W}, \"row\", col, median(ndvi) AS v FROM idx GROUP BY 1,2,3), l AS (SELECT max({W}) AS w FROM c) SELECT {W}, count(*) AS cells, count(v) AS valued, round(sum(CASE WHEN {W}=w THEN v+1 ELSE v END),3) AS total FROM c, l WHERE {W}<>w OR col%2=0 GROUP BY 1"
)
def stored_cube(spark, sf_dir):
    """A cube written by tile and window, its last window replaced as a whole, read back."""
    path = f"{raster.shared_folder(spark)}/cube-{uuid.uuid4().hex}"
    made = composite.composite(indices(spark, sf_dir), composite.CELL, ["ndvi"]).select(*composite.CELL, "ndvi")
    io.write_cube(made, path)
    last = io.read_cube(spark, path).agg(F.max("window")).first()[0]
    again = io.read_cube(spark, path, last).where("col % 2 = 0").withColumn("ndvi", F.col("ndvi") + 1)
    io.write_cube(raster.checkpointed(again.select(*composite.CELL, "ndvi")), path)
    return io.read_cube(spark, path).groupBy("window").agg(F.count("*").alias("cells"), F.count("ndvi").alias("valued"), F.round(F.sum("ndvi"), 3).alias("total"))
