"""Queries on interventions: features, models, scenarios, plans, requests in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import textcheck, verdicts
from tessera.operators import features, planning, raster, scenario
from tessera.plans import tables as T
from tessera.plans.people import _CHOICE, _LATTICE, _RID, choices, lattice_of
from tessera.plans.registry import query, r4
from tessera.plans.spatial import _H, height

_CUBE = (
    f"{T.CELLS}, cube AS (SELECT tile_id, \"row\", col, landcover, elevation_m, CASE WHEN landcover=10 THEN 0.65 WHEN landcover=80 THEN -0.05 ELSE 0.12 END+(\"row\"*col%17)/200.0 AS ndvi, CASE WHEN landcover=10 THEN -0.20 ELSE 0.25 END-(\"row\"*col%13)/200.0 AS ndbi, CASE WHEN landcover=10 THEN 0.14 ELSE 0.20 END+(\"row\"*col%11)/400.0 AS albedo FROM cells), "
    "cubel AS (SELECT *, 30+25*(1-ndvi)+elevation_m/500 AS lst_c FROM cube)"
)


def cube(spark, sf_dir):
    """A cube of one window with a known dependence of temperature on greenness."""
    k = F.col("row") * F.col("col")
    cover = F.col("landcover")
    out = T.cells(spark, sf_dir).withColumns({
        "ndvi": F.when(cover == 10, 0.65).when(cover == 80, -0.05).otherwise(0.12) + k % 17 / 200.0,
        "ndbi": F.when(cover == 10, -0.20).otherwise(0.25) - k % 13 / 200.0, "albedo": F.when(cover == 10, 0.14).otherwise(0.20) + k % 11 / 400.0,
    })
    return out.withColumn("lst_c", 30 + 25 * (1 - F.col("ndvi")) + F.col("elevation_m") / 500).withColumn("window", F.when(F.col("row").isNotNull(), "2024-summer"))


def scalars(spark, sf_dir):
    one = T.read(spark, sf_dir, "region").limit(1)
    return one.select(T.tile("r_regionkey").alias("tile_id"), F.when(F.col("r_regionkey").isNotNull(), "2024-summer").alias("window"), F.lit(34.0).alias("air_temp_c"), F.lit(2.5).alias("wind_speed_ms"), F.lit(38.0).alias("relative_humidity_pct"))


KEYS = ["tile_id", "window"]


def feature_table(spark, sf_dir):
    return features.features(cube(spark, sf_dir), scalars(spark, sf_dir), KEYS, height(spark, sf_dir), T.WIDTH)


_NEAR = f"od AS (SELECT a.i AS dr, b.i AS dc FROM range(-2,3) a(i), range(-2,3) b(i)), nb AS (SELECT c.\"row\", c.col, least(greatest(c.\"row\"+dr,0),{_H}) AS nr, least(greatest(c.col+dc,0),49) AS nc FROM cube c, od), nr AS (SELECT nb.\"row\", nb.col, avg(c.ndvi) AS ndvi_near, avg(c.ndbi) AS ndbi_near FROM nb JOIN cube c ON c.\"row\"=nb.nr AND c.col=nb.nc GROUP BY 1,2)"


@query(f"WITH {_CUBE}, {_NEAR} SELECT \"row\", col, round(ndvi+ndbi+albedo,6) AS base, round(ndvi_near,6) AS ndvi_near, round(ndbi_near,6) AS ndbi_near, 34.0 AS air_temp_c, 2.5 AS wind_speed_ms, 38.0 AS relative_humidity_pct, landcover<>0 AS usable FROM cube JOIN nr USING (\"row\", col)")
def feature_rows(spark, sf_dir):
    """Features of every cell, of its neighbourhood, and its window's weather."""
    t = feature_table(spark, sf_dir)
    near = [F.round(c, 6).alias(c) for c in ("ndvi_near", "ndbi_near")]
    return t.select("row", "col", F.round(F.col("ndvi") + F.col("ndbi") + F.col("albedo"), 6).alias("base"), *near, *features.WEATHER, "usable")


@query(f"WITH {_CUBE}, b AS (SELECT DISTINCT \"row\"//10 AS block_row, col//10 AS block_col FROM cube) SELECT block_row, block_col, CAST((row_number() OVER (ORDER BY md5('0|'||block_row||'|'||block_col))-1)%5 AS INTEGER) AS fold FROM b")
def block_folds(spark, sf_dir):
    """Folds of blocks."""
    return features.block_folds(cube(spark, sf_dir), ["tile_id"], 5, 10).select("block_row", "block_col", "fold")


_FOLDS = f"{_CUBE}, b AS (SELECT DISTINCT \"row\"//10 AS br, col//10 AS bc FROM cube), fd AS (SELECT br, bc, CAST((row_number() OVER (ORDER BY md5('0|'||br||'|'||bc))-1)%5 AS INTEGER) AS fold FROM b), fr AS (SELECT c.*, fold FROM cubel c JOIN fd ON br=\"row\"//10 AND bc=col//10)"


def folded(spark, sf_dir):
    c = cube(spark, sf_dir)
    f = features.block_folds(c, ["tile_id"], 5, 10)
    return c.withColumn("block_row", F.floor(F.col("row") / 10)).withColumn("block_col", F.floor(F.col("col") / 10)).join(f, ["tile_id", "block_row", "block_col"])


@query(f"WITH {_FOLDS} SELECT fold, landcover, round(max(naive),4) AS naive, count(*) AS cells FROM (SELECT a.fold, a.landcover, a.lst_c, (SELECT avg(lst_c) FROM fr z WHERE z.fold<>a.fold AND z.landcover=a.landcover) AS naive FROM fr a) GROUP BY 1,2")
def naive_predictions(spark, sf_dir):
    """Mean of the group in the other folds, all folds at once."""
    out = features.fold_means(folded(spark, sf_dir), ["landcover"])
    return out.groupBy("fold", "landcover").agg(r4(F.max("naive"), "naive"), F.count("*").alias("cells"))


@query(
    f"WITH {_FOLDS}, m AS (SELECT f.i AS fold, regr_slope(lst_c,ndvi) AS s, regr_intercept(lst_c,ndvi) AS b, avg(lst_c) AS a FROM range(0,5) f(i) JOIN fr ON fr.fold<>f.i GROUP BY 1), "
    "e AS (SELECT fold, avg(abs(s*ndvi+b-lst_c)) AS mae, avg(abs(a-lst_c)) AS naive_mae FROM fr JOIN m USING (fold) GROUP BY 1) SELECT round(avg(mae),4) AS mae, round(stddev_pop(mae),4) AS mae_sd, round(avg(naive_mae),4) AS naive_mae, round(1-avg(mae)/avg(naive_mae),4) AS skill FROM e"
)
def linear_cross_validation(spark, sf_dir):
    """Blocked validation of the one-feature model that SQL can fit as well."""
    fr = folded(spark, sf_dir)
    scored = fr.join(F.broadcast(features.linear_without_fold(fr, F.col("ndvi"))), "fold").withColumn("predicted", F.col("slope") * F.col("ndvi") + F.col("intercept"))
    return features.cv_report(scored).select(*[r4(c) for c in ("mae", "mae_sd", "naive_mae", "skill")])


@query()
def boosted_cross_validation(spark, sf_dir):
    """Blocked validation of boosted trees on all features (no SQL form)."""
    t = features.training_frame(feature_table(spark, sf_dir))
    f = features.block_folds(t, ["tile_id"])
    block_row, block_col = (F.floor(F.col(c) / features.BLOCK) for c in ("row", "col"))
    fr = t.withColumn("block_row", block_row).withColumn("block_col", block_col).join(f, ["tile_id", "block_row", "block_col"])
    return features.cv_report(features.cross_validate(fr, ["landcover"], list(range(features.FOLDS))))


@query(f"WITH {_CUBE} SELECT round(median(CASE WHEN landcover=10 THEN ndvi END),4) AS tree_ndvi, round(median(CASE WHEN landcover=10 THEN ndbi END),4) AS tree_ndbi, round(median(CASE WHEN landcover=10 THEN albedo END),4) AS tree_albedo, count(CASE WHEN landcover=10 THEN 1 END) AS tree_cells FROM cube")
def tree_reference(spark, sf_dir):
    """Medians over tree cover."""
    return scenario.tree_reference(cube(spark, sf_dir), KEYS).select(r4("tree_ndvi"), r4("tree_ndbi"), r4("tree_albedo"), "tree_cells")


@query(f"WITH {_CUBE} SELECT round(median(CASE WHEN landcover=50 THEN lst_c END),4) AS built, round(median(CASE WHEN landcover=10 THEN lst_c END),4) AS tree, round(median(CASE WHEN landcover=50 THEN lst_c END)-median(CASE WHEN landcover=10 THEN lst_c END),4) AS contrast FROM cubel")
def tree_built_contrast(spark, sf_dir):
    """Built against tree temperature."""
    return scenario.tree_built_contrast(cube(spark, sf_dir), KEYS).select(r4("built"), r4("tree"), r4("contrast"))


_SCEN = (
    f"{_CUBE}, sc AS (SELECT s_suppkey AS scenario_id, 0.1+(s_suppkey%5)*0.1 AS canopy_fraction, (s_suppkey*7)%greatest((SELECT max(p_partkey)//50 FROM part)-6,1) AS r0, (s_suppkey*3)%43 AS c0 FROM supplier), rf AS (SELECT median(CASE WHEN landcover=10 THEN ndvi END) AS tn FROM cube), "
    "pl AS (SELECT scenario_id, \"row\", col, ndvi, CASE WHEN landcover NOT IN (80,0) THEN least(canopy_fraction, 1-least(greatest((ndvi-0.1)/greatest(tn-0.1,1e-6),0),1)) ELSE 0 END AS added, tn FROM sc JOIN cube ON \"row\" BETWEEN r0 AND r0+7 AND col BETWEEN c0 AND c0+7, rf)"
)


def scenarios(spark, sf_dir):
    k = F.col("s_suppkey")
    return T.read(spark, sf_dir, "supplier").select(k.alias("scenario_id"), (0.1 + k % 5 * 0.1).alias("canopy_fraction"), (k * 7 % max(height(spark, sf_dir) - 7, 1)).alias("r0"), (k * 3 % 43).alias("c0"))


def planted(spark, sf_dir):
    s = scenarios(spark, sf_dir)
    cells = s.select("scenario_id", T.tile("scenario_id").alias("tile_id"), F.explode(F.sequence("r0", F.col("r0") + 7)).alias("row"), "c0").select("scenario_id", "tile_id", "row", F.explode(F.sequence("c0", F.col("c0") + 7)).alias("col"))
    return scenario.planted(cube(spark, sf_dir), s.select("scenario_id", "canopy_fraction"), cells, KEYS)


@query(f"WITH {_SCEN} SELECT scenario_id, count(*) AS cells, round(sum(added),4) AS canopy_added, round(avg(ndvi+added*(tn-ndvi)),4) AS ndvi_after FROM pl GROUP BY 1")
def planting(spark, sf_dir):
    """What each scenario plants and what becomes of its cells."""
    return planted(spark, sf_dir).groupBy("scenario_id").agg(F.count("*").alias("cells"), r4(F.sum("canopy_added"), "canopy_added"), r4(F.avg("ndvi_new"), "ndvi_after"))


#: Changes of masked cells, of their neighbourhoods' means, and the sides, for masks ms(s.., row, col, d).
def _field_sql(ids: str) -> str:
    on = " AND ".join(f"m.{i}=a.{i}" for i in ids.split(","))
    a_ids = ",".join(f"a.{i}" for i in ids.split(","))
    return (
        f"af AS (SELECT DISTINCT {ids}, \"row\"+dr AS \"row\", col+dc AS col FROM ms, od WHERE \"row\"+dr BETWEEN 0 AND {_H} AND col+dc BETWEEN 0 AND 49), "
        f"sf AS (SELECT {a_ids}, a.\"row\", a.col, sum(coalesce(m.d,0))/25 AS shift FROM af a CROSS JOIN od LEFT JOIN ms m ON {on} AND m.\"row\"=least(greatest(a.\"row\"+dr,0),{_H}) AND m.col=least(greatest(a.col+dc,0),49) GROUP BY ALL), "
        f"rg AS (SELECT DISTINCT {ids}, \"row\"+dr AS \"row\", col+dc AS col, true AS near FROM ms, od WHERE abs(dr)+abs(dc)<=2), "
        f"fd AS (SELECT sf.*, lm.s*(coalesce(d,0)+0.5*shift) AS delta, d IS NOT NULL AS inside, d IS NULL AND coalesce(near,false) AS ring FROM sf LEFT JOIN ms USING ({ids},\"row\",col) LEFT JOIN rg USING ({ids},\"row\",col), lm)"
    )


_LM = "lm AS (SELECT regr_slope(lst_c,ndvi+0.5*ndvi_near) AS s, median(CASE WHEN landcover=50 THEN lst_c END)-median(CASE WHEN landcover=10 THEN lst_c END) AS k FROM cubel JOIN nr USING (\"row\",col))"
_DELTA = f"{_SCEN}, {_NEAR}, {_LM}, ms AS (SELECT scenario_id, \"row\", col, added*(tn-ndvi) AS d FROM pl), {_field_sql('scenario_id')}"


def greenness(table):
    """What the linear model sees: a cell's greenness and half of its neighbourhood's."""
    return F.col("ndvi") + 0.5 * F.col("ndvi_near")


def delta_field(spark, sf_dir, touched):
    """Changes of temperature of ``touched`` scenarios, inside, in the ring and beyond."""
    # both are read several times: the grid once per window, the masks once per scenario
    h, table, touched = height(spark, sf_dir), raster.checkpointed(feature_table(spark, sf_dir)), raster.checkpointed(touched)
    model = features.linear(table, KEYS, greenness(table))
    predict = lambda d: features.with_scalars(d, model, KEYS).withColumn("predicted", F.col("slope") * greenness(d) + F.col("intercept"))
    changed = scenario.deltas(scenario.after_features(touched, table, KEYS, h, T.WIDTH, ("ndvi",)), table, predict, [*KEYS, "row", "col"])
    return scenario.sided(changed, touched, ["scenario_id", *KEYS], h, T.WIDTH)


@query(
    f"WITH {_DELTA} SELECT scenario_id, count(CASE WHEN abs(delta)>1e-12 THEN 1 END) AS cells_changed, round(avg(CASE WHEN inside THEN delta END),4) AS mean_inside, round(coalesce(avg(CASE WHEN ring THEN delta END),0),4) AS mean_ring, count(CASE WHEN ring THEN 1 END) AS ring_cells, "
    "round(greatest(-avg(CASE WHEN inside THEN delta END),0)/2.5,4) AS expected_cooling FROM fd GROUP BY 1"
)
def scenario_deltas(spark, sf_dir):
    """Differences of two predictions for all scenarios at once, with
    the neighbourhoods of the planted field."""
    d = delta_field(spark, sf_dir, planted(spark, sf_dir))
    # equal predictions can differ in the last bit of their sums
    out = scenario.summarise_delta(d.withColumn("delta", F.when(F.abs("delta") > 1e-12, F.col("delta")).otherwise(0.0)), ["scenario_id"])
    return out.select("scenario_id", "cells_changed", r4("mean_inside"), r4("mean_ring"), "ring_cells", r4(verdicts.corrected_cooling(F.col("mean_inside")), "expected_cooling"))


@query("SELECT l_orderkey AS id, l_linenumber AS nth, e AS expected, c AS contrast, CASE WHEN e>=-0.005 THEN 'none' WHEN c<1 THEN CASE WHEN abs(e)>=0.1 THEN 'small' ELSE 'marginal' END WHEN abs(e)/c>=0.3 THEN 'large' WHEN abs(e)/c>=0.15 THEN 'moderate' WHEN abs(e)/c>=0.05 THEN 'small' ELSE 'marginal' END AS impact, CASE WHEN l_returnflag='R' OR l_linestatus='F' AND l_linenumber>3 THEN 'low' ELSE 'moderate' END AS confidence, CAST(round_even(l_tax*l_extendedprice/25,0) AS BIGINT) AS trees FROM (SELECT *, l_tax*-10 AS e, l_quantity/10 AS c FROM lineitem)")
def impact_verdicts(spark, sf_dir):
    """Labels of results."""
    li = T.read(spark, sf_dir, "lineitem").withColumn("expected", F.col("l_tax") * -10).withColumn("contrast", F.col("l_quantity") / 10)
    conf = verdicts.confidence(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") > 3, "summer").otherwise("winter"))
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), "expected", "contrast", verdicts.impact(F.col("expected"), F.col("contrast")).alias("impact"), conf.alias("confidence"), verdicts.trees_for(F.col("l_tax"), F.col("l_extendedprice")).alias("trees")
    )


# -- plans ------------------------------------------------------------------------------

_PLANS = f"WITH {_LATTICE}, {_CHOICE}, ms AS (SELECT plan_id, sum(area_m2) AS area, sum(plantable_canopy_m2) AS room FROM (SELECT DISTINCT * FROM ch) JOIN lat USING (region_id) GROUP BY 1), pp AS (SELECT c_custkey AS id, area, room, CASE WHEN c_custkey%3=0 THEN CAST(abs(c_acctbal) AS BIGINT)*10+1 END AS tree_count, CASE WHEN c_custkey%3=1 THEN (c_custkey%10)/10.0 END AS canopy_fraction, CASE WHEN c_custkey%2=0 THEN 0.5 END AS emission_fraction FROM customer JOIN ms ON plan_id=c_custkey%40), q AS (SELECT *, coalesce(tree_count*25.0, canopy_fraction*area, 0) AS asked, tree_count IS NOT NULL OR canopy_fraction IS NOT NULL AS plants FROM pp) "


def plan_table(spark, sf_dir):
    from tessera.operators import regions

    m = regions.measure(lattice_of(spark, sf_dir), choices(spark, sf_dir))
    k = F.col("c_custkey")
    c = T.read(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 40).alias("plan_id"), F.when(k % 3 == 0, F.bround(F.abs("c_acctbal")).cast("long") * 10 + 1).alias("tree_count"), F.when(k % 3 == 1, k % 10 / 10.0).alias("canopy_fraction"), F.when(k % 2 == 0, 0.5).alias("emission_fraction"),
    )
    return c.join(m, "plan_id")


@query(
    _PLANS + "SELECT id, CASE WHEN plants AND room<=0 OR tree_count IS NOT NULL AND asked>room THEN 'refused' ELSE 'ok' END AS status, CAST(floor(room/25) AS BIGINT) AS max_trees, "
    "CASE WHEN NOT (plants AND room<=0 OR tree_count IS NOT NULL AND asked>room) THEN round(least(asked/area,1),6) END AS canopy_fraction_added, CASE WHEN NOT (plants AND room<=0 OR tree_count IS NOT NULL AND asked>room) THEN CAST(CASE WHEN plants AND tree_count IS NULL AND asked>room THEN 1 ELSE 0 END + CASE WHEN emission_fraction>0 AND NOT plants THEN 1 ELSE 0 END + CASE WHEN plants AND emission_fraction IS NULL THEN 1 ELSE 0 END AS INTEGER) END AS notes FROM q"
)
def resolved_plans(spark, sf_dir):
    """Plans checked against what their regions can take."""
    out = planning.resolve(plan_table(spark, sf_dir))
    return out.select("id", "status", "max_trees", F.round("canopy_fraction_added", 6).alias("canopy_fraction_added"), F.when(F.col("notes").isNotNull(), F.size("notes")).alias("notes"))


@query(
    "WITH a AS (SELECT o_custkey AS plan_id, CASE WHEN o_orderkey%2=0 THEN 'plant' ELSE 'restrict' END AS kind, CASE WHEN o_orderkey%5=0 THEN o_orderkey%7 END AS tree_count, CASE WHEN o_orderkey%3=0 THEN (o_orderkey%13)/10.0 END AS canopy_fraction FROM orders), "
    "g AS (SELECT plan_id, kind, count(*) AS n, bool_or(kind='plant' AND ((tree_count IS NULL)=(canopy_fraction IS NULL))) AS bad, bool_or(coalesce(canopy_fraction NOT BETWEEN 0 AND 1,false) OR coalesce(tree_count<1,false)) AS out FROM a GROUP BY 1,2) SELECT plan_id, CASE WHEN bool_or(n>1) THEN 'an action twice' WHEN bool_or(bad) THEN 'exactly one of count and fraction' WHEN bool_or(out) THEN 'a number out of bounds' END AS reason FROM g GROUP BY 1"
)
def well_formed_plans(spark, sf_dir):
    """Plans that are not well formed."""
    k = F.col("o_orderkey")
    a = T.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("plan_id"), F.when(k % 2 == 0, "plant").otherwise("restrict").alias("kind"), F.when(k % 5 == 0, k % 7).alias("tree_count"), F.when(k % 3 == 0, k % 13 / 10.0).alias("canopy_fraction"), F.lit(None).cast("double").alias("emission_fraction")
    )
    return planning.well_formed(a)


_TEXT = "tx AS (SELECT o_orderkey AS id, CASE o_custkey%8 WHEN 0 THEN 'plant '||(o_orderkey%9000)||' trees in 2024 winter' WHEN 1 THEN 'Add '||(o_orderkey%150)||'% canopy this summer' WHEN 2 THEN 'remove '||(o_orderkey%90)||'% of traffic, summer of 2023' WHEN 3 THEN 'ban cars and plant '||(o_orderkey%30)||'k trees' WHEN 4 THEN 'canopy by '||(o_orderkey%60)||' per cent' WHEN 5 THEN 'make it nice' WHEN 6 THEN o_orderpriority ELSE NULL END AS t0 FROM orders)"


def requests(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 8
    n = lambda m: (k % m).cast("string")
    t = (
        F.when(c == 0, F.concat(F.lit("plant "), n(9000), F.lit(" trees in 2024 winter"))).when(c == 1, F.concat(F.lit("Add "), n(150), F.lit("% canopy this summer"))).when(c == 2, F.concat(F.lit("remove "), n(90), F.lit("% of traffic, summer of 2023")))
        .when(c == 3, F.concat(F.lit("ban cars and plant "), n(30), F.lit("k trees"))).when(c == 4, F.concat(F.lit("canopy by "), n(60), F.lit(" per cent"))).when(c == 5, "make it nice").when(c == 6, F.col("o_orderpriority"))
    )
    return T.read(spark, sf_dir, "orders").select(k.alias("id"), t.alias("text"))


_X = lambda p, g: f"nullif(regexp_extract(t, '{p}', {g}), '')"


#: Plans from rows of tx(id, t0).
_PARSED = (
    f"l AS (SELECT id, lower(t0) AS t FROM tx), x AS (SELECT id, t, regexp_replace({_X(planning.TREES, 1)}, '[,{textcheck.BLANKS}]', '', 'g') AS d, {_X(planning.TREES, 2)} AS m, coalesce({_X(planning.CANOPY_FIRST, 1)}, {_X(planning.CANOPY_LAST, 2)}) AS cf, {_X(planning.TRAFFIC_SHARE, 1)} AS sh, coalesce(regexp_matches(t, '{planning.TRAFFIC_WORDS}'), false) AS tw, "
    f"coalesce({_X(planning.WINDOW, 1)}||'-'||{_X(planning.WINDOW, 2)}, {_X(planning.WINDOW_REVERSED, 2)}||'-'||{_X(planning.WINDOW_REVERSED, 1)}) AS win, {_X(planning.SEASON, 1)} AS se FROM l), "
    "y AS (SELECT id, CASE WHEN d IS NOT NULL THEN CAST(greatest(round_even(CAST(d AS DOUBLE)*CASE WHEN m IS NULL THEN 1 ELSE 1000 END,0),1) AS BIGINT) END AS tree_count, CASE WHEN d IS NULL AND cf IS NOT NULL THEN least(greatest(CAST(cf AS DOUBLE)/100,0.01),1.0) END AS canopy_fraction, CASE WHEN sh IS NOT NULL THEN least(greatest(CAST(sh AS DOUBLE)/100,0.01),1.0) WHEN tw THEN 1.0 END AS emission_fraction, win, CASE WHEN win IS NULL THEN se END AS season, CASE WHEN d IS NOT NULL AND cf IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sh IS NULL AND tw THEN 1 ELSE 0 END AS warnings FROM x) "
    "SELECT id, tree_count, canopy_fraction, emission_fraction, win AS \"window\", season, warnings, CASE WHEN tree_count IS NULL AND canopy_fraction IS NULL AND emission_fraction IS NULL THEN 'no intervention' ELSE 'ok' END AS status FROM y"
)


@query(f"WITH {_TEXT}, {_PARSED}")
def parsed_requests(spark, sf_dir):
    """Plans read from plain text."""
    return planning.parse(requests(spark, sf_dir)).select("id", "tree_count", "canopy_fraction", "emission_fraction", "window", "season", F.coalesce(F.size("warnings"), F.lit(0)).alias("warnings"), "status")


@query(f"WITH tx AS (SELECT concat_ws('/', conv_id, turn) AS id, text AS t0 FROM conversations), {_PARSED}")
def parsed_conversations(spark, sf_dir):
    """Every turn of every conversation as a request."""
    turns = T.read(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return planning.parse(turns).select("id", "tree_count", "canopy_fraction", "emission_fraction", "window", "season", F.coalesce(F.size("warnings"), F.lit(0)).alias("warnings"), "status")


@query(
    "WITH p AS (SELECT o_orderkey AS id, (o_orderkey%97)*1000+500 AS v, o_orderkey%4 AS c FROM orders), q AS (SELECT id, c, v, CASE WHEN c=0 THEN v ELSE v+v*CASE c WHEN 1 THEN 0.02 WHEN 2 THEN 0.2 ELSE 0 END END AS w FROM p) SELECT id, c<>3 AND c<>2 AS numbers_ok, c<>1 AS direction_ok, c=0 OR c=3 AS headline_ok FROM q"
)
def faithful_rewrites(spark, sf_dir):
    """Rewrites that keep numbers, units, direction and headline."""
    k = F.col("o_orderkey")
    v, c = k % 97 * 1000 + 500, k % 4
    w = F.when(c == 1, v + v * 0.02).when(c == 2, v + v * 0.2).otherwise(v).cast("long").cast("string")
    source = F.concat(F.lit("It cools by "), v.cast("string"), F.lit(" km2 in all"))
    unit = F.when(c == 3, " m2").otherwise(" km2")
    rewrite = F.concat(F.when(c == 1, "It warms by ").otherwise("It cools by "), w, unit, F.lit(" or so"))
    o = T.read(spark, sf_dir, "orders").select(k.alias("id"), source.alias("s"), rewrite.alias("r"))
    s, r = F.col("s"), F.col("r")
    return o.select("id", textcheck.numbers_are_faithful(s, r).alias("numbers_ok"), textcheck.direction_is_faithful(s, r).alias("direction_ok"), textcheck.headline_survives(s, r).alias("headline_ok"))


_NUMBER_SQL = lambda t, g: f"regexp_extract_all({t}, '(?:^|[^a-z0-9.])(\\d+(?:\\.\\d+)?)(?:[{textcheck.BLANKS}]*({textcheck.UNITS})\\b)?', {g})"


@query(
    "WITH p AS (SELECT event_id AS id, event_id%8 AS k, CAST(round_even(value*10,0) AS BIGINT)/10.0 AS v FROM events WHERE value>=0), q AS (SELECT id, k, v, 'the block cools by '||printf('%.1f', v)||' degc over '||(id%500+20)||' km2' AS src, CASE k WHEN 1 THEN chr(8239)||'°c' WHEN 2 THEN chr(160)||'degc' WHEN 3 THEN '°f' WHEN 4 THEN chr(12288)||'degc' ELSE ' degc' END AS unit, CASE WHEN k=5 THEN v*1.03 WHEN k=6 THEN v*1.2+1 ELSE v END AS w FROM p), "
    "r AS (SELECT id, src, CASE WHEN k=7 THEN 'it warms by ' ELSE 'it cools by ' END||printf('%.1f', w)||unit||' or so' AS rew FROM q), "
    f"n AS (SELECT id, src, rew, list_zip({_NUMBER_SQL('src', 1)}, {_NUMBER_SQL('src', 2)}) AS a, list_zip({_NUMBER_SQL('rew', 1)}, {_NUMBER_SQL('rew', 2)}) AS b FROM r), "
    "u AS (SELECT id, src, rew, a, unnest(b) AS x FROM n), c AS (SELECT id, src, rew, x, len(list_filter(a, lambda y: replace(replace(y[2],'°c','degc'),'°f','degf')=replace(replace(x[2],'°c','degc'),'°f','degf') AND abs(CAST(x[1] AS DOUBLE)-CAST(y[1] AS DOUBLE))<=greatest(0.05,0.05*abs(CAST(y[1] AS DOUBLE)))))>0 AS ok FROM u) "
    "SELECT id, bool_and(ok) AS numbers_ok, NOT max(contains(rew,'warms')) AS direction_ok FROM c GROUP BY 1"
)
def spaced_rewrites(spark, sf_dir):
    """Figures whose unit stands after a space of any kind, rounded, invented, or with another unit."""
    k, v = F.col("event_id") % 8, F.bround(F.col("value") * 10).cast("long") / 10.0
    unit = F.when(k == 1, "\u202f°C").when(k == 2, "\u00a0degC").when(k == 3, "°F").when(k == 4, "\u3000degC").otherwise(" degC")
    w = F.when(k == 5, v * 1.03).when(k == 6, v * 1.2 + 1).otherwise(v)
    e = T.read(spark, sf_dir, "events").where("value >= 0").select(
        F.col("event_id").alias("id"), F.concat(F.lit("The block cools by "), F.format_string("%.1f", v), F.lit(" degC over "), (F.col("event_id") % 500 + 20).cast("string"), F.lit(" km2")).alias("s"),
        F.concat(F.when(k == 7, "It warms by ").otherwise("It cools by "), F.format_string("%.1f", w), unit, F.lit(" or so")).alias("r"),
    )
    return e.select("id", textcheck.numbers_are_faithful(F.col("s"), F.col("r")).alias("numbers_ok"), textcheck.direction_is_faithful(F.col("s"), F.col("r")).alias("direction_ok"))


@query(
    "WITH s AS (SELECT o_custkey AS search, o_orderkey AS step, CASE WHEN o_orderstatus='P' THEN NULL ELSE round(CASE o_custkey%3 WHEN 0 THEN o_totalprice/1000 WHEN 1 THEN coalesce(-(o_totalprice%7-3),0) ELSE o_totalprice END,5)+0.0 END AS score, coalesce(o_totalprice/1000>=250,false) AS satisfied FROM orders) "
    "SELECT search, step, score, max(score) OVER w AS best, coalesce(score=max(score) OVER w,false) AS improves, CASE WHEN satisfied THEN 'target met' WHEN row_number() OVER (PARTITION BY search ORDER BY step)>=10 THEN 'budget spent' END AS stop FROM s WINDOW w AS (PARTITION BY search ORDER BY step ROWS UNBOUNDED PRECEDING)"
)
def search_trace(spark, sf_dir):
    """Scores of proposals, the best so far, and why a search stops."""
    o = T.read(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 3
    metric = F.when(k == 0, "cooling").when(k == 1, "pm25_reduction").otherwise("person_degrees")
    s = scenario.score(metric, F.col("o_totalprice") / 1000, F.col("o_totalprice"), F.col("o_totalprice") % 7 - 3)
    scored = o.select(
        F.col("o_custkey").alias("search"), F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") != "P", F.round(s, 5) + F.lit(0.0)).alias("score"), scenario.satisfies(F.col("o_totalprice") / 1000, F.lit(250.0)).alias("satisfied")
    )
    return scenario.search_trace(scored, "search", "step", 10).drop("satisfied")


_AIR = "kr AS (SELECT a.i AS dr, b.i AS dc, sqrt(a.i*a.i+b.i*b.i::DOUBLE) AS d FROM range(-15,16) a(i), range(-15,16) b(i)), kw AS (SELECT dr, dc, exp(-0.5*pow(d/2.5,2))*exp(-0.004*d*400/(2.0*250))*(20000/(2.0*250*400*400))/(SELECT sum(exp(-0.5*pow(d/2.5,2))) FROM kr) AS w FROM kr)"


@query(
    f"WITH {_LATTICE}, {_CUBE.replace(T.CELLS + ', ', '')}, {_NEAR}, {_LM}, {_AIR}, rf AS (SELECT median(CASE WHEN landcover=10 THEN ndvi END) AS tn FROM cube), "
    "ob AS (SELECT n_nationkey AS oid, ['cooling','person_degrees','pm25_reduction'][CAST(n_nationkey%3 AS INTEGER)+1] AS metric, n_nationkey%5 AS area FROM nation), "
    "cd AS (SELECT oid, metric, region_id, plantable_canopy_m2, row_number() OVER (PARTITION BY oid ORDER BY CASE WHEN metric='pm25_reduction' THEN round(emission*1e6,0) ELSE round(plantable_canopy_m2*population,0) END DESC, region_id) AS rank FROM ob JOIN lat ON col0//10=area), "
    "tp AS (SELECT *, metric<>'pm25_reduction' AND plantable_canopy_m2<=0 AS refused FROM cd WHERE rank<=3), "
    f"lr AS (SELECT *, {_RID} AS region_id FROM land), cr AS (SELECT *, {_RID} AS region_id FROM cube), "
    "ms AS (SELECT oid, region_id, \"row\", col, CASE WHEN landcover NOT IN (80,0) THEN least(0.3, 1-least(greatest((ndvi-0.1)/greatest(tn-0.1,1e-6),0),1)) ELSE 0 END*(tn-ndvi) AS d FROM tp JOIN cr USING (region_id), rf WHERE NOT refused AND metric<>'pm25_reduction'), "
    f"{_field_sql('oid,region_id')}, "
    "th AS (SELECT oid, region_id, greatest(-avg(CASE WHEN inside THEN delta END),0)/2.5 AS cooling, sum(-delta*coalesce(CASE WHEN population>0 THEN population END,0)) AS degrees FROM fd LEFT JOIN (SELECT \"row\", col, population FROM people) USING (\"row\",col) GROUP BY 1,2), "
    "sr AS (SELECT oid, region_id, \"row\", col, emission FROM tp JOIN lr USING (region_id) WHERE NOT refused AND metric='pm25_reduction'), "
    "ar AS (SELECT s.oid, s.region_id, sum(s.emission*w)*1e6 AS c FROM sr s, kw JOIN sr t ON t.oid=s.oid AND t.region_id=s.region_id AND t.\"row\"=s.\"row\"+dr AND t.col=s.col+dc GROUP BY 1,2), "
    "pm AS (SELECT oid, region_id, c/count(*) AS less FROM ar JOIN sr USING (oid,region_id) GROUP BY oid, region_id, c), "
    "oc AS (SELECT oid, metric, region_id, rank, refused, CASE WHEN NOT refused THEN round(CASE metric WHEN 'cooling' THEN cooling WHEN 'person_degrees' THEN degrees ELSE coalesce(less,0) END,6) END AS score FROM tp LEFT JOIN th USING (oid,region_id) LEFT JOIN pm USING (oid,region_id)) "
    "SELECT oid AS objective_id, metric, arg_max(region_id, (score, -rank)) FILTER (WHERE score IS NOT NULL) AS best_region, round(max(score),4) AS score, count(CASE WHEN NOT refused THEN 1 END) AS tried, count(CASE WHEN refused THEN 1 END) AS refused FROM oc GROUP BY 1,2"
)
def greedy_best(spark, sf_dir):
    """E5: the first three candidates of each objective with one fixed lever, checked,
    run, scored; the best one.  An objective may use one column of regions."""
    from tessera.operators import equity, kernel, regions
    from tessera.plans.people import land
    from tessera.plans.spatial import _RES, parameters

    k = F.col("n_nationkey")
    metric = F.when(k % 3 == 0, "cooling").when(k % 3 == 1, "person_degrees").otherwise("pm25_reduction")
    objectives = T.read(spark, sf_dir, "nation").select(k.alias("objective_id"), metric.alias("metric"), (k % 5).alias("area"))
    air = F.col("metric") == "pm25_reduction"
    offered = lattice_of(spark, sf_dir).withColumn("area", F.floor(F.col("col0") / 10)).join(objectives, "area")
    worth = F.when(air, F.round(F.col("emission") * 1e6, 0)).otherwise(F.round(F.col("plantable_canopy_m2") * F.col("population"), 0))
    first = regions.ranked(offered, ["objective_id"], worth, 3)
    levers = first.withColumn("tree_count", F.lit(None).cast("long")).withColumn("canopy_fraction", F.when(~air, 0.30)).withColumn("emission_fraction", F.when(air, 1.0))
    plans = planning.resolve(levers).withColumn("scenario_id", F.concat_ws("/", F.col("objective_id").cast("string"), "region_id"))
    run = plans.where("status = 'ok'").select("scenario_id", "objective_id", "region_id", "metric", "canopy_fraction_added")
    ground = land(spark, sf_dir).withColumn("region_id", regions.region_id(10)).select("tile_id", "region_id", "row", "col", "population", "emission")
    own = ground.join(run, "region_id")
    trees = run.where(~air).select("scenario_id", F.col("canopy_fraction_added").alias("canopy_fraction"))
    touched = scenario.planted(cube(spark, sf_dir), trees, own.where(~air).select("scenario_id", "tile_id", "row", "col"), KEYS)
    people = ground.select("row", "col", "population")
    change = delta_field(spark, sf_dir, touched).join(people, ["row", "col"], "left").withColumn("population", F.coalesce("population", F.lit(0.0)))
    cooler = scenario.summarise_delta(change, ["scenario_id"]).join(equity.totals(change, ["scenario_id"]), "scenario_id")
    sent = own.where(air & (F.col("emission") > 0)).select("scenario_id", "tile_id", "row", "col", "emission")
    field = kernel.concentration(sent, kernel.seasonal_kernel(parameters(spark, sf_dir), ["tile_id"], _RES), ["tile_id", "scenario_id"], height(spark, sf_dir), T.WIDTH)
    less = own.where(air).select("scenario_id", "row", "col").join(field, ["scenario_id", "row", "col"], "left").groupBy("scenario_id").agg((-F.avg(F.coalesce("concentration", F.lit(0.0)))).alias("delta_pm25"))
    outcomes = run.select("scenario_id", "objective_id", "region_id").join(cooler, "scenario_id", "left").join(less, "scenario_id", "left").select(
        "objective_id", "region_id", verdicts.corrected_cooling(F.col("mean_inside")).alias("expected_cooling"), F.col("net").alias("person_degrees"), "delta_pm25"
    )
    best = scenario.greedy(plans.select("objective_id", "region_id", "rank", "metric", "status"), outcomes)
    return best.withColumn("score", F.round("score", 4))
