"""Queries on hindcasts and on validation by folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.bands import KELVIN, THERMAL_OFFSET, THERMAL_SCALE
from tessera.operators import composite, features, hindcast
from tessera.operators.raster import checkpointed
from tessera.plans import tables as T
from tessera.plans.acting import feature_table
from tessera.plans.observing import _IDX, _PIX, W, indices
from tessera.plans.registry import query, r4

#: Spread and patch size at which the small tables have sites, and the window whose configuration leaks.
SIGMA, LEAST, LEAK = 1.2, 2, 6


def windows_cube(spark, sf_dir):
    """Composites of greenness and temperature of every window, beside the land cover."""
    both = composite.composite(indices(spark, sf_dir, ["thermal"]), composite.CELL, ["ndvi", "thermal"])
    both = both.select(*composite.CELL, "ndvi", (F.col("thermal") * THERMAL_SCALE + THERMAL_OFFSET - KELVIN).alias("lst_c"))
    cover = T.cells(spark, sf_dir).select("tile_id", "row", "col", "landcover")
    return checkpointed(both.join(cover, ["tile_id", "row", "col"]))


def configurations(cells):
    """A configuration for each window from the fourth on: the three windows before it, 5 or 10 bins; one leaks."""
    named = cells.select("window").distinct().withColumn("config_id", F.row_number().over(Window.orderBy("window")).cast("long"))  # two windows a year
    other = named.select(F.col("window").alias("w"), F.col("config_id").alias("k"))
    leak = F.when(F.col("config_id") == LEAK, 0).otherwise(1)
    pairs = named.where("config_id >= 4").join(F.broadcast(other), F.col("k").between(F.col("config_id") - 3, F.col("config_id") - leak))
    return pairs.groupBy("config_id", F.col("window").alias("scored")).agg(F.sort_array(F.collect_list("w")).alias("before")).withColumn("bins", (5 + F.col("config_id") % 2 * 5).cast("int"))


_SCORES = lambda p, when: f"count(CASE WHEN {when} THEN 1 END) AS {p}_n, avg(CASE WHEN {when} THEN abs(res) END) AS {p}_mae, avg(CASE WHEN {when} THEN res END) AS {p}_bias"


@query(
    f"WITH RECURSIVE {T.OBS}, {T.CELLS}, {_PIX}, {_IDX}, cv AS (SELECT i.{W}, i.\"row\", i.col, landcover, v, t FROM (SELECT {W}, \"row\", col, median(ndvi) AS v, median(thermal)*{THERMAL_SCALE}+{THERMAL_OFFSET}-{KELVIN} AS t FROM idx GROUP BY 1,2,3) i JOIN cells USING (\"row\",col)), "
    f"wn AS (SELECT {W}, row_number() OVER (ORDER BY {W}) AS k FROM (SELECT DISTINCT {W} FROM cv)), cf AS (SELECT k AS cid, {W} AS scored, 5+k%2*5 AS bins FROM wn WHERE k>=4), "
    f"tr AS (SELECT cid, cv.* FROM cf JOIN wn ON wn.k BETWEEN cid-3 AND cid-1 JOIN cv ON cv.{W}=wn.{W} WHERE cid<>{LEAK}), ln AS (SELECT cid, regr_slope(t,v) AS s, regr_intercept(t,v) AS b FROM tr GROUP BY 1), ps AS (SELECT cid, \"row\", col, median(v) AS v0, median(t) AS t0 FROM tr GROUP BY 1,2,3), "
    f"sc AS (SELECT cid, bins, cv.\"row\", cv.col, cv.landcover, cv.v, cv.t, v0, t0, v-v0 AS ch FROM cf JOIN cv ON cv.{W}=scored LEFT JOIN ps USING (cid,\"row\",col) WHERE cid<>{LEAK}), d1 AS (SELECT cid, median(ch) AS drift, stddev_pop(ch) AS sd FROM sc GROUP BY 1), "
    f"d2 AS (SELECT cid, drift, {SIGMA}*CASE WHEN m>0 THEN m ELSE sd END AS th FROM (SELECT cid, drift, sd, median(abs(ch-drift)*1.4826) AS m FROM sc JOIN d1 USING (cid) GROUP BY 1,2,3)), fl AS (SELECT sc.*, th, CAST(sign(ch-drift) AS INTEGER) AS sg, coalesce(abs(ch-drift)>th,false) AS flag FROM sc JOIN d2 USING (cid)), "
    "m AS (SELECT cid, sg, \"row\" AS r, col AS c FROM fl WHERE flag), ee AS (SELECT a.cid, a.sg, a.r*2147483648+a.c AS x, b.r*2147483648+b.c AS y FROM m a JOIN m b ON a.cid=b.cid AND a.sg=b.sg AND b.r BETWEEN a.r-1 AND a.r+1 AND b.c BETWEEN a.c-1 AND a.c+1), "
    "wk AS (SELECT cid, sg, x, y FROM ee UNION SELECT wk.cid, wk.sg, wk.x, ee.y FROM wk JOIN ee ON wk.cid=ee.cid AND wk.sg=ee.sg AND wk.y=ee.x), cs AS (SELECT cid, sg, x, count(*) AS n FROM wk GROUP BY 1,2,3), "
    f"rw AS (SELECT fl.*, coalesce(n>={LEAST},false) AS site, s*v+b-t AS res, t-t0 AS shift FROM fl JOIN ln USING (cid) LEFT JOIN cs ON cs.cid=fl.cid AND cs.sg=fl.sg AND flag AND cs.x=fl.\"row\"*2147483648+fl.col WHERE v IS NOT NULL AND t IS NOT NULL), "
    "eg AS (SELECT cid, CASE WHEN bins=5 THEN quantile_cont(v0,[0.2,0.4,0.6,0.8]) ELSE quantile_cont(v0,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) END AS e FROM rw GROUP BY cid, bins), sr AS (SELECT rw.*, landcover*(bins+1)+len(list_filter(e, lambda q: q<=v0)) AS stm FROM rw JOIN eg USING (cid) WHERE v0 IS NOT NULL AND (site OR NOT flag)), "
    "g AS (SELECT cid, stm, count(CASE WHEN site THEN 1 END) AS n, count(CASE WHEN NOT site THEN 1 END) AS k, avg(CASE WHEN site THEN res END)-avg(CASE WHEN NOT site THEN res END) AS de, count(CASE WHEN site AND shift IS NOT NULL THEN 1 END) AS n2, count(CASE WHEN NOT site AND shift IS NOT NULL THEN 1 END) AS k2, avg(CASE WHEN site THEN shift END)-avg(CASE WHEN NOT site THEN shift END) AS ds FROM sr GROUP BY 1,2), "
    "mt AS (SELECT cid, sum(CASE WHEN k>0 THEN n*de END)/sum(CASE WHEN k>0 THEN n END) AS matched_error, sum(CASE WHEN k2>0 THEN n2*ds END)/sum(CASE WHEN k2>0 THEN n2 END) AS matched_effect, CAST(sum(CASE WHEN k>0 THEN n ELSE 0 END) AS BIGINT) AS matched_cells, CAST(sum(CASE WHEN k=0 THEN n ELSE 0 END) AS BIGINT) AS unmatched_cells FROM g WHERE n>0 GROUP BY 1), "
    f"al AS (SELECT cid, {_SCORES('overall', 'true')}, {_SCORES('changed', 'site')}, {_SCORES('unchanged', 'NOT flag')}, avg(CASE WHEN site THEN shift END)-avg(CASE WHEN NOT flag THEN shift END) AS observed_effect FROM rw GROUP BY 1) "
    f"SELECT cf.cid AS config_id, scored, CASE WHEN cf.cid={LEAK} THEN 'trained on the window it is scored on, or on a later one' WHEN al.cid IS NULL THEN 'no cell to score' WHEN changed_n=0 THEN 'no change site to validate against' ELSE 'ok' END AS status, CASE WHEN changed_n>0 THEN overall_n END AS overall_n, CASE WHEN changed_n>0 THEN changed_n END AS changed_n, CASE WHEN changed_n>0 THEN unchanged_n END AS unchanged_n, "
    "CASE WHEN changed_n>0 THEN round(overall_mae,4) END AS overall_mae, CASE WHEN changed_n>0 THEN round(changed_bias,4) END AS changed_bias, CASE WHEN changed_n>0 THEN round(changed_bias-unchanged_bias,4) END AS effect_error, CASE WHEN changed_n>0 THEN round(observed_effect,4) END AS observed_effect, "
    "CASE WHEN changed_n>0 THEN round(matched_error,4) END AS matched_error, CASE WHEN changed_n>0 THEN round(matched_effect,4) END AS matched_effect, CASE WHEN changed_n>0 THEN matched_cells END AS matched_cells, CASE WHEN changed_n>0 THEN unmatched_cells END AS unmatched_cells FROM cf LEFT JOIN al USING (cid) LEFT JOIN mt USING (cid)"
)
def hindcast_reports(spark, sf_dir):
    """A report for each window from the fourth on, all in one plan."""
    cells = windows_cube(spark, sf_dir)
    out = hindcast.run(configurations(cells), cells, hindcast.by_line("ndvi"), sigma=SIGMA, least=LEAST)
    figures = [r4(c) for c in ("overall_mae", "changed_bias", "effect_error", "observed_effect", "matched_error", "matched_effect")]
    return out.select("config_id", "scored", "status", "overall_n", "changed_n", "unchanged_n", "matched_cells", "unmatched_cells", *figures)


#: Trees of the registered validations: small ones, as every fold's are fitted in each call.
ROUNDS, DEPTH, SEASONS = 5, 4, 3


@query()
def windows_left_out(spark, sf_dir):
    """Every window predicted by trees of the others (no SQL form): the trees' errors and the naive ones."""
    table = feature_table(spark, sf_dir)
    # the grid as it would be in three seasons that differ by an offset of the weather
    shift = (F.col("_k") - 1) * 1.5
    seasons = table.drop("window").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SEASONS - 1)))).withColumn("window", F.concat((2022 + F.col("_k")).cast("string"), F.lit("-summer")))
    frame = checkpointed(features.training_frame(seasons.withColumn("air_temp_c", F.col("air_temp_c") + shift).withColumn("lst_c", F.col("lst_c") + shift * 0.2).drop("_k")))
    scored = features.leave_one_window_out(frame, ["landcover"], [f"{2022 + k}-summer" for k in range(SEASONS)], rounds=ROUNDS, depth=DEPTH)
    by = scored.groupBy(F.col("fold").alias("window")).agg(F.count("*").alias("cells"), F.avg(F.abs(F.col("predicted") - F.col("lst_c"))).alias("mae"), F.avg(F.abs(F.col("naive") - F.col("lst_c"))).alias("naive_mae"))
    return by.withColumn("skill", 1 - F.try_divide("mae", "naive_mae"))


@query()
def feature_importances(spark, sf_dir):
    """Features of the trained trees, most important first (no SQL form)."""
    model = features.train(features.training_frame(feature_table(spark, sf_dir)), rounds=ROUNDS, depth=DEPTH)
    return spark.createDataFrame([(k + 1, name, share) for k, (name, share) in enumerate(features.importances(model))], "rank int, feature string, importance double")
