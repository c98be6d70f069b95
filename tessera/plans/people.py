"""Queries on who benefits, regions, monitors and past change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import verdicts
from tessera.operators import change, composite, equity, regions, stations
from tessera.plans import tables as T
from tessera.plans.observing import indices
from tessera.plans.registry import query, r4
from tessera.plans.spatial import height

W = '"window"'
_GROUPED = (
    f"{T.PEOPLE}, s AS (SELECT *, sum(population) OVER (ORDER BY population, \"row\", col ROWS UNBOUNDED PRECEDING) AS upto, sum(population) OVER () AS total FROM people WHERE population>0), "
    "grp AS (SELECT *, CAST(least(floor((upto-population/2)/total*10),9)+1 AS INTEGER) AS \"group\" FROM s)"
)
_SHARES = "sh AS (SELECT \"group\", sum(population) AS people, count(*) AS cells, sum(-delta*population) AS pd FROM grp GROUP BY 1), sd AS (SELECT *, pd/sum(pd) OVER () AS share FROM sh)"
_TOTALS = (
    "tt AS (SELECT sum(CASE WHEN population>0 THEN -delta*population ELSE 0 END) AS net, sum(abs(delta*greatest(population,0))) AS gross, sum(CASE WHEN population>0 THEN population ELSE 0 END) AS population_covered, "
    "sum(CASE WHEN population>0 THEN -delta ELSE 0 END) AS inhabited_cooling, sum(CASE WHEN population>0 THEN 0 ELSE -delta END) AS uninhabited_cooling FROM people)"
)


def cells(spark, sf_dir):
    return T.population(spark, sf_dir).withColumn("tile_id", T.tile("row"))


@query(f"WITH {_GROUPED} SELECT \"row\", col, \"group\" FROM grp")
def population_groups(spark, sf_dir):
    """Groups of equal population."""
    return equity.population_groups(cells(spark, sf_dir), ["tile_id"]).select("row", "col", "group")


@query(f"WITH {_GROUPED}, {_SHARES} SELECT \"group\", round(people,2) AS people, cells, round(-pd/people,6) AS mean_delta, round(share,6) AS share FROM sd")
def benefit_shares(spark, sf_dir):
    """Benefit of each group."""
    out = equity.benefit(equity.population_groups(cells(spark, sf_dir), ["tile_id"]), ["tile_id"])
    return out.select("group", F.round("people", 2).alias("people"), "cells", F.round("mean_delta", 6).alias("mean_delta"), F.round("share", 6).alias("share"))


@query(f"WITH {T.PEOPLE}, {_TOTALS} SELECT round(net,4) AS net, round(gross,4) AS gross, round(population_covered,2) AS population_covered, round(inhabited_cooling,4) AS inhabited_cooling, round(uninhabited_cooling,4) AS uninhabited_cooling FROM tt")
def benefit_totals(spark, sf_dir):
    """Net and gross person-degrees."""
    t = equity.totals(cells(spark, sf_dir), ["tile_id"])
    return t.select(r4("net"), r4("gross"), F.round("population_covered", 2).alias("population_covered"), r4("inhabited_cooling"), r4("uninhabited_cooling"))


@query(
    f"WITH {_GROUPED}, {_SHARES}, {_TOTALS}, top AS (SELECT sum(share) AS top_three_share FROM (SELECT share FROM sd ORDER BY share DESC LIMIT 3)), m AS (SELECT top_three_share, (SELECT \"group\" FROM sd ORDER BY share DESC, \"group\" LIMIT 1) AS best_served, (SELECT \"group\" FROM sd ORDER BY share, \"group\" LIMIT 1) AS worst_served, "
    "CASE WHEN gross=0 THEN 0 ELSE net/gross END AS ratio, net, CASE WHEN inhabited_cooling+uninhabited_cooling>0 THEN uninhabited_cooling/(inhabited_cooling+uninhabited_cooling) ELSE 0 END AS waste FROM top, tt) "
    "SELECT round(top_three_share,4) AS top_three_share, best_served, worst_served, round(ratio,6) AS net_to_gross, net>0 AND ratio>=0.2 AS reliable, round(waste,4) AS uninhabited_fraction, CASE WHEN NOT (net>0 AND ratio>=0.2) THEN 'no-net-effect' WHEN waste>=0.2 THEN 'wasted' WHEN top_three_share>0.5 THEN 'skewed' ELSE 'even' END AS verdict FROM m"
)
def equity_measures(spark, sf_dir):
    """How fair the benefit is."""
    c = cells(spark, sf_dir)
    m = equity.measures(equity.benefit(equity.population_groups(c, ["tile_id"]), ["tile_id"]), equity.totals(c, ["tile_id"]), ["tile_id"])
    verdict = verdicts.equity_verdict(F.col("reliable"), F.col("uninhabited_fraction"), F.col("top_three_share"))
    return m.select(r4("top_three_share"), "best_served", "worst_served", F.round("net_to_gross", 6).alias("net_to_gross"), "reliable", r4("uninhabited_fraction"), verdict.alias("verdict"))


# -- regions ------------------------------------------------------------------------------

_RID = "printf('r%02dc%02d', CAST(\"row\"//10 AS INTEGER), CAST(col//10 AS INTEGER))"
_LAND = f"{T.CELLS}, {T.PEOPLE}, land AS (SELECT c.*, p.population, CASE WHEN landcover IN (80,0) THEN 0.0 ELSE 0.3 END AS headroom, CASE WHEN landcover=30 THEN NULL ELSE elevation_m/40 END AS lst_c, CASE WHEN landcover=50 THEN elevation_m/1e6 END AS emission FROM cells c LEFT JOIN people p USING (\"row\",col))"
_LATTICE = f"{_LAND}, lat AS (SELECT {_RID} AS region_id, min(\"row\") AS row0, max(\"row\")+1 AS row1, min(col) AS col0, max(col)+1 AS col1, count(*) AS cells, count(*)*10000.0 AS area_m2, coalesce(sum(headroom),0)*10000.0 AS plantable_canopy_m2, avg(lst_c) AS mean_lst_c, coalesce(sum(population),0) AS population, coalesce(sum(emission),0) AS emission FROM land GROUP BY 1)"


def land(spark, sf_dir):
    c = T.cells(spark, sf_dir).join(T.population(spark, sf_dir), ["row", "col"], "left")
    return c.withColumn("headroom", F.when(F.col("landcover").isin(80, 0), 0.0).otherwise(0.3)).withColumn("lst_c", F.when(F.col("landcover") != 30, F.col("elevation_m") / 40)).withColumn("emission", F.when(F.col("landcover") == 50, F.col("elevation_m") / 1e6))


def lattice_of(spark, sf_dir):
    return regions.lattice(land(spark, sf_dir), ["tile_id"], 10_000.0, 10)


@query(f"WITH {_LATTICE} SELECT region_id, row0, row1, col0, col1, cells, round(area_m2,1) AS area_m2, round(plantable_canopy_m2,1) AS plantable_canopy_m2, CAST(floor(round(plantable_canopy_m2,3)/25) AS BIGINT) AS max_trees, round(mean_lst_c,4) AS mean_lst_c, round(population,2) AS population, round(emission+1e-9,6) AS emission FROM lat")
def lattice(spark, sf_dir):
    """Blocks as candidate regions."""
    return lattice_of(spark, sf_dir).select(
        "region_id", "row0", "row1", "col0", "col1", "cells", F.round("area_m2", 1).alias("area_m2"), F.round("plantable_canopy_m2", 1).alias("plantable_canopy_m2"),
        F.floor(F.round("plantable_canopy_m2", 3) / 25).alias("max_trees"), r4("mean_lst_c"), F.round("population", 2).alias("population"), F.round(F.col("emission") + 1e-9, 6).alias("emission"),
    )


_CHOICE = "ch AS (SELECT c_custkey%40 AS plan_id, printf('r%02dc%02d', CAST((c_custkey//40)%((SELECT max(p_partkey) FROM part)//500+2) AS INTEGER), CAST(c_custkey%5 AS INTEGER)) AS region_id FROM customer)"


def choices(spark, sf_dir):
    k = F.col("c_custkey")
    return T.read(spark, sf_dir, "customer").select((k % 40).alias("plan_id"), F.format_string("r%02dc%02d", F.floor(k / 40) % ((height(spark, sf_dir) - 1) // 10 + 2), k % 5).alias("region_id"))


@query(f"WITH {_LATTICE}, {_CHOICE} SELECT plan_id, CAST(sum(cells) AS BIGINT) AS cells, round(sum(area_m2),1) AS area_m2, round(sum(plantable_canopy_m2),1) AS plantable_canopy_m2 FROM (SELECT DISTINCT * FROM ch) JOIN lat USING (region_id) GROUP BY 1")
def region_measures(spark, sf_dir):
    """Regions of a plan add up."""
    return regions.measure(lattice_of(spark, sf_dir), choices(spark, sf_dir)).select("plan_id", "cells", F.round("area_m2", 1).alias("area_m2"), F.round("plantable_canopy_m2", 1).alias("plantable_canopy_m2"))


@query(f"WITH {_LATTICE}, {_CHOICE} SELECT plan_id, region_id, 'no region '||region_id AS reason FROM ch WHERE region_id NOT IN (SELECT region_id FROM lat)")
def unknown_regions(spark, sf_dir):
    """Proposals that name no region."""
    return regions.unknown_regions(choices(spark, sf_dir), lattice_of(spark, sf_dir))


@query(f"WITH {_LATTICE}, {_CHOICE} SELECT landcover, count(*) AS cells FROM land WHERE {_RID} IN (SELECT region_id FROM ch) GROUP BY 1")
def cells_in_regions(spark, sf_dir):
    """Cells of chosen regions."""
    return regions.cells_of(choices(spark, sf_dir), land(spark, sf_dir), 10).groupBy("landcover").agg(F.count("*").alias("cells"))


@query(f"WITH {_LATTICE}, s AS (SELECT region_id, round(plantable_canopy_m2*population,0) AS by_people, round(emission*1e6,0) AS by_emission FROM lat) SELECT * FROM (SELECT region_id, row_number() OVER (ORDER BY by_people DESC, region_id) AS rank, row_number() OVER (ORDER BY by_emission DESC, region_id) AS emission_rank FROM s) WHERE rank<=24")
def ranked_regions(spark, sf_dir):
    """Candidates by people and room, and by emission."""
    r = regions.ranked(lattice_of(spark, sf_dir), ["tile_id"], F.round(F.col("plantable_canopy_m2") * F.col("population"), 0)).withColumnRenamed("rank", "by_people").drop("score")
    both = regions.ranked(r, ["tile_id"], F.round(F.col("emission") * 1e6, 0))
    return both.where("by_people <= 24").select("region_id", F.col("by_people").alias("rank"), F.col("rank").alias("emission_rank"))


@query(
    f"WITH {_LATTICE}, {_GROUPED.replace(T.PEOPLE + ', ', '')}, x AS (SELECT l.*, -p.delta*0+coalesce(p.delta,0)*5-0.05 AS d, g.\"group\" AS g, l.\"row\"<20 AND l.col<25 AS inside, l.\"row\"<24 AND l.col<29 AS near FROM land l LEFT JOIN people p USING (\"row\",col) LEFT JOIN grp g USING (\"row\",col)), "
    f"e AS (SELECT {_RID} AS region_id, greatest(-avg(d),0)/2.5 AS expected_cooling, coalesce(sum(population),0) AS residents, CAST(floor(median(g)) AS INTEGER) AS population_decile, avg(CASE WHEN landcover=10 THEN 1.0 ELSE 0 END) AS tree_fraction, bool_or(inside) AS inside, NOT bool_or(inside) AND bool_or(near) AS spillover FROM x GROUP BY 1) "
    "SELECT * FROM (SELECT region_id, round(expected_cooling,6) AS expected_cooling, round(residents,2) AS residents, population_decile, round(tree_fraction,4) AS tree_fraction, inside, spillover, row_number() OVER (ORDER BY round(expected_cooling,9) DESC, region_id) AS rank FROM e WHERE expected_cooling>=0.005) WHERE rank<=8"
)
def explained_regions(spark, sf_dir):
    """What changed where, and for whom."""
    groups = equity.population_groups(cells(spark, sf_dir), ["tile_id"]).select("row", "col", "group")
    x = land(spark, sf_dir).withColumn("delta", F.coalesce("delta", F.lit(0.0)) * 5 - 0.05).join(groups, ["row", "col"], "left")
    x = x.withColumn("canopy_added", F.lit(0.1)).withColumn("inside", (F.col("row") < 20) & (F.col("col") < 25)).withColumn("near", (F.col("row") < 24) & (F.col("col") < 29))
    return regions.explain(x, ["tile_id"], 10).select("region_id", F.round("expected_cooling", 6).alias("expected_cooling"), F.round("residents", 2).alias("residents"), "population_decile", r4("tree_fraction"), "inside", "spillover", "rank")


# -- monitors ------------------------------------------------------------------------------

_STATION = "st AS (SELECT user_id AS station, avg(value) AS modelled, avg(value*1.7+event_id%11) AS observed FROM events GROUP BY 1)"


def station_table(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("station")).agg(F.avg("value").alias("modelled"), F.avg(F.col("value") * 1.7 + F.col("event_id") % 11).alias("observed")).withColumn("net", F.when(F.col("station").isNotNull(), "n"))


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_id%9=0 THEN -999.0 ELSE avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) END AS value FROM events), m AS (SELECT user_id, count(CASE WHEN value>=0 THEN 1 END) AS days, median(CASE WHEN value>=0 THEN value END) AS median FROM d GROUP BY 1) SELECT user_id, days, round(CASE WHEN days>=60 THEN median END,4) AS median, CASE WHEN days<60 THEN days||' of 60 days' END AS reason FROM m")
def station_medians(spark, sf_dir):
    """Medians of stations with enough days."""
    from pyspark.sql import Window

    e = T.read(spark, sf_dir, "events")
    day = F.to_date("ts")
    daily = e.select("user_id", day.alias("day"), F.when(F.col("event_id") % 9 == 0, -999.0).otherwise(F.avg("value").over(Window.partitionBy("user_id", day))).alias("value"))
    return stations.station_medians(daily, ["user_id"], least=60).withColumn("median", F.round("median", 4))


@query(
    f"WITH {_STATION}, c AS (SELECT *, modelled-avg(modelled) OVER () AS dx, observed-avg(observed) OVER () AS dy, avg(observed) OVER () AS my, count(*) OVER () AS n FROM st), z AS (SELECT *, sum(dx*dx) OVER () AS sxx, sum(dx*dy) OVER () AS sxy, sum(dx) OVER () AS sx, sum(dy) OVER () AS sy FROM c), "
    "f AS (SELECT *, ((sxy-dx*dy)-(sx-dx)*(sy-dy)/(n-1))/((sxx-dx*dx)-(sx-dx)*(sx-dx)/(n-1)) AS slope FROM z) SELECT station, round(my+(sy-dy-slope*(sx-dx))/(n-1)+slope*dx,3) AS predicted, round(my+(sy-dy)/(n-1),3) AS null_predicted FROM f"
)
def leave_one_out(spark, sf_dir):
    """Every station predicted by the others."""
    return stations.leave_one_out(station_table(spark, sf_dir), ["net"]).select("station", F.round("predicted", 3).alias("predicted"), F.round("null_predicted", 3).alias("null_predicted"))


@query(f"WITH {_STATION} SELECT count(*) AS stations, round(regr_slope(observed,modelled),3) AS scale, round(regr_intercept(observed,modelled),2) AS background FROM st")
def pooled_fit(spark, sf_dir):
    """The pooled line."""
    out = stations.validation_report(stations.leave_one_out(station_table(spark, sf_dir), ["net"]), ["net"])
    return out.select("stations", F.round("scale", 3).alias("scale"), F.round("background", 2).alias("background"))


# -- change ------------------------------------------------------------------------------

_PIX = "pix AS (SELECT *, CASE WHEN red>0 AND (red-1000.0)/10000>0 AND (red-1000.0)/10000<=1.6 AND scl IN (4,5,6,7) THEN (red-1000.0)/10000 END AS r, CASE WHEN nir>0 AND (nir-1000.0)/10000>0 AND (nir-1000.0)/10000<=1.6 AND scl IN (4,5,6,7) THEN (nir-1000.0)/10000 END AS n FROM obs)"
_FIELD = f"{T.OBS}, {T.CELLS}, {_PIX}, cw AS (SELECT {W}, \"row\", col, median((n-r)/nullif(n+r,0)) AS ndvi FROM pix GROUP BY 1,2,3), ch AS (SELECT \"row\", col, median(CASE WHEN {W}>='1998-winter' THEN ndvi END)-median(CASE WHEN {W}<'1998-winter' THEN ndvi END) AS change FROM cw GROUP BY 1,2), dr AS (SELECT median(change) AS drift FROM ch), th AS (SELECT drift, 3.0*1.4826*median(abs(change-drift)) AS threshold FROM ch, dr GROUP BY 1), fl AS (SELECT ch.*, coalesce(abs(change-drift)>threshold,false) AS changed FROM ch, th)"


def change_field(spark, sf_dir):
    c = composite.composite(indices(spark, sf_dir), ["tile_id", "window", "row", "col"], ["ndvi"])
    return change.change_field(c, ["tile_id"], "ndvi", F.col("window") < "1998-winter", F.col("window") >= "1998-winter")


@query(f"WITH {_FIELD} SELECT count(*) AS cells, count(CASE WHEN changed THEN 1 END) AS changed, round(max(drift),4) AS drift, round(max(threshold),4) AS threshold FROM fl, th")
def detected_change(spark, sf_dir):
    """Cells whose change stands out from the tile's own spread."""
    f = change.flag_change(change_field(spark, sf_dir), ["tile_id"])
    return f.agg(F.count("*").alias("cells"), F.count_if("changed").alias("changed"), r4(F.max("drift"), "drift"), r4(F.max("threshold"), "threshold"))


@query(
    f"WITH RECURSIVE {_FIELD}, m AS (SELECT \"row\" AS r, col AS c, change, CAST(sign(change-drift) AS INTEGER) AS s FROM fl, dr WHERE changed), e AS (SELECT a.s, a.r*2147483648+a.c AS x, b.r*2147483648+b.c AS y FROM m a JOIN m b ON a.s=b.s AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1), "
    "w AS (SELECT s, x, y FROM e UNION SELECT w.s, w.x, e.y FROM w JOIN e ON w.s=e.s AND w.y=e.x), k AS (SELECT s, x, min(y) AS component FROM w GROUP BY 1,2), g AS (SELECT k.s AS sign, component, count(*) AS cells, round(avg(change),4) AS mean_change FROM k JOIN m ON m.s=k.s AND m.r*2147483648+m.c=k.x GROUP BY 1,2 HAVING count(*)>=9) "
    "SELECT CAST(row_number() OVER (ORDER BY cells DESC, component, sign) AS INTEGER) AS rank, sign, component, cells, mean_change FROM g"
)
def change_sites(spark, sf_dir):
    """Patches of change, largest first within the tile."""
    f = change.flag_change(change_field(spark, sf_dir), ["tile_id"])
    return change.largest(change.sites(f, ["tile_id"]), ["tile_id"]).select("rank", "sign", "component", "cells", r4("mean_change"))


_STRATA = f"{_FIELD}, base AS (SELECT f.*, landcover, elevation_m AS b, elevation_m*0.01+CASE WHEN changed THEN -0.3 ELSE 0 END AS v FROM fl f JOIN cells USING (\"row\",col)), eg AS (SELECT quantile_cont(b,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM base), sr AS (SELECT base.*, landcover*11+len(list_filter(e, lambda x: x<=b)) AS stratum FROM base, eg)"


def stratified(spark, sf_dir):
    f = change.flag_change(change_field(spark, sf_dir), ["tile_id"])
    b = f.join(T.cells(spark, sf_dir).drop("tile_id"), ["row", "col"]).withColumn("v", F.col("elevation_m") * 0.01 + F.when(F.col("changed"), -0.3).otherwise(0.0))
    return change.strata(b, ["tile_id"], "landcover", "elevation_m")


@query(f"WITH {_STRATA} SELECT stratum, count(*) AS cells FROM sr GROUP BY 1")
def strata(spark, sf_dir):
    """Land cover by quantile bins."""
    return stratified(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("cells"))


@query(
    f"WITH {_STRATA}, g AS (SELECT stratum, count(CASE WHEN changed THEN 1 END) AS n, count(CASE WHEN NOT changed THEN 1 END) AS k, avg(CASE WHEN changed THEN v END) AS t, avg(CASE WHEN NOT changed THEN v END) AS c FROM sr GROUP BY 1) "
    "SELECT round(sum(CASE WHEN k>0 THEN n*(t-c) END)/sum(CASE WHEN k>0 THEN n END),4) AS value, CAST(coalesce(sum(CASE WHEN k>0 THEN n END),0) AS BIGINT) AS matched_cells, CAST(coalesce(sum(CASE WHEN k=0 THEN n END),0) AS BIGINT) AS unmatched_cells FROM g WHERE n>0"
)
def matched_difference(spark, sf_dir):
    """Changed against unchanged land of the same stratum."""
    return change.matched_difference(stratified(spark, sf_dir), ["tile_id"], "v").select(r4("value"), "matched_cells", "unmatched_cells")


@query(
    "WITH p AS (SELECT l_shipdate<DATE '1998-06-01' AS early, l_quantity*0.9+2 AS p, l_quantity+l_discount*10 AS o FROM lineitem), b AS (SELECT early, avg(p-o) AS bias, avg(o) AS mo FROM p GROUP BY 1) "
    "SELECT early, count(*) AS n, round(avg(abs(p-o)),4) AS mae, round(max(bias),4) AS bias, round(1-sum(pow(p-o,2))/sum(pow(o-mo,2)),4) AS spatial_r2, round(avg(abs(p-o-bias)),4) AS mae_debiased, round(1-sum(pow(p-o-bias,2))/sum(pow(o-mo,2)),4) AS spatial_r2_debiased FROM p JOIN b USING (early) GROUP BY 1"
)
def hindcast_score(spark, sf_dir):
    """Errors raw and without the common offset."""
    li = T.read(spark, sf_dir, "lineitem")
    pairs = li.select((F.col("l_shipdate") < F.lit("1998-06-01").cast("date")).alias("early"), (F.col("l_quantity") * 0.9 + 2).alias("predicted"), (F.col("l_quantity") + F.col("l_discount") * 10).alias("observed"))
    s = change.score(pairs, ["early"])
    return s.select("early", "n", *[r4(c) for c in ("mae", "bias", "spatial_r2", "mae_debiased", "spatial_r2_debiased")])


@query(f"WITH {_FIELD}, x AS (SELECT changed, elevation_m*0.01 AS b, elevation_m*0.011-CASE WHEN changed THEN 0.2 ELSE 0 END AS a FROM fl JOIN cells USING (\"row\",col)) SELECT round(avg(CASE WHEN changed THEN a-b END),4) AS changed_shift, round(avg(CASE WHEN NOT changed THEN a-b END),4) AS unchanged_shift, round(avg(CASE WHEN changed THEN a-b END)-avg(CASE WHEN NOT changed THEN a-b END),4) AS effect FROM x")
def difference_in_differences(spark, sf_dir):
    """Shift of changed land against the rest."""
    f = change.flag_change(change_field(spark, sf_dir), ["tile_id"]).join(T.cells(spark, sf_dir).drop("tile_id"), ["row", "col"])
    x = f.withColumn("b", F.col("elevation_m") * 0.01).withColumn("a", F.col("elevation_m") * 0.011 - F.when(F.col("changed"), 0.2).otherwise(0.0))
    return change.difference_in_differences(x, ["tile_id"], "b", "a").select(r4("changed_shift"), r4("unchanged_shift"), r4("effect"))


@query(f"WITH {T.OBS}, u AS (SELECT DISTINCT {W} FROM obs WHERE {W} LIKE '%summer'), r AS (SELECT {W}, count(*) OVER () AS n, row_number() OVER (ORDER BY {W}) AS rank FROM u) SELECT {W}, CASE WHEN n>=4 THEN CASE WHEN rank<=floor(n/2) THEN 'before' ELSE 'after' END END AS side, CASE WHEN n<4 THEN 'fewer than four usable windows' END AS reason FROM r")
def window_split(spark, sf_dir):
    """Summers before and after."""
    u = T.observations(spark, sf_dir).where(F.col("window").endswith("summer")).select("tile_id", "window").distinct()
    return change.split_windows(u, ["tile_id"]).select("window", "side", "reason")
