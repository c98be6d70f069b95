"""Queries that chain several operators, and those on sources and geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import geojson, season, verdicts
from tessera.functions import grid as G
from tessera.operators import change, composite, equity, features, kernel, planning, raster, regions, roads, scenario
from tessera.plans import tables as T
from tessera.plans.acting import _DELTA, _PLANS, KEYS, cube, delta_field, plan_table, planted, scenarios
from tessera.plans.observing import _IDX, _PIX, W, indices
from tessera.plans.people import lattice_of
from tessera.plans.registry import query, r4
from tessera.plans.spatial import _H, _KER, _RES, CORNERS, LONLAT, height, parameters
from tessera.sources import builds, io


@query(f"WITH {T.CELLS}, old AS (SELECT \"row\", col, CASE WHEN landcover<>30 THEN elevation_m END AS v FROM cells WHERE col<40), new AS (SELECT \"row\", col, CASE WHEN landcover<>10 THEN elevation_m*2 END AS v FROM cells WHERE col>=10) SELECT \"row\", col, round(coalesce(new.v, old.v),4) AS v FROM old FULL OUTER JOIN new USING (\"row\",col)")
def grafted_layer(spark, sf_dir):
    """New values where there are any, old ones elsewhere."""
    c = T.cells(spark, sf_dir)
    old = c.where("col < 40").select("row", "col", F.when(F.col("landcover") != 30, F.col("elevation_m")).alias("v"))
    new = c.where("col >= 10").select("row", "col", F.when(F.col("landcover") != 10, F.col("elevation_m") * 2).alias("v"))
    return io.graft(old, new, ["row", "col"], ["v"]).select("row", "col", r4("v"))


@query(
    f"WITH {T.SCENES}, builds AS (SELECT year(ts) AS build_id, CAST(max(ts) AS DATE) AS built_at FROM scenes GROUP BY 1), build_sources AS (SELECT year(ts) AS build_id, collection, {W}, count(*) AS found, count(CASE WHEN coalesce(cloud_cover,0)<=40 THEN 1 END) AS kept FROM scenes GROUP BY 1,2,3) "
    f"SELECT build_id, built_at, collection, {W}, found, kept FROM builds JOIN build_sources USING (build_id) WHERE built_at=(SELECT max(built_at) FROM builds)"
)
def latest_build(spark, sf_dir):
    """The report of the latest build."""
    s = T.scenes(spark, sf_dir).withColumn("build_id", F.year("ts"))
    made = s.groupBy("build_id").agg(F.to_date(F.max("ts")).alias("built_at"))
    return io.latest_build(made, composite.scene_counts(s, ["build_id", "collection", "window"], 40.0))


_BUILDS = (
    f"{T.SCENES}, src AS (SELECT year(ts) AS build_id, collection, {W}, count(*) AS found, count(CASE WHEN coalesce(cloud_cover,0)<=CASE WHEN year(ts)>=1996 THEN 60 ELSE 40 END THEN 1 END) AS kept, CASE WHEN year(ts)>=1996 THEN 'v2' END AS version FROM scenes GROUP BY 1,2,3), "
    "bld AS (SELECT year(ts) AS build_id, CAST(max(ts) AS DATE) AS built_at FROM scenes GROUP BY 1), var AS (SELECT year(ts) AS build_id, platform AS variable, round(avg(CASE WHEN cloud_cover IS NULL THEN 0.0 ELSE 1.0 END),4) AS valid FROM scenes GROUP BY 1,2)"
)


def recorded(spark, sf_dir) -> str:
    """A catalogue of builds: one for each year of scenes, recorded, and those since 1996
    recorded again with another limit of cloud and a column more.  Returns its folder."""
    root = f"{raster.shared_folder(spark)}/builds-{uuid.uuid4().hex}"
    scenes = T.scenes(spark, sf_dir).withColumn("build_id", F.year("ts"))

    def run(s, limit, *more):
        made = s.groupBy("build_id").agg(F.to_date(F.max("ts")).alias("built_at"))
        variables = s.groupBy("build_id", F.col("platform").alias("variable")).agg(r4(F.avg(F.col("cloud_cover").isNotNull().cast("double")), "valid"))
        builds.record(root, made, composite.scene_counts(s, ["build_id", "collection", "window"], limit).select("*", *more), variables)

    run(scenes, 40.0)
    run(scenes.where("build_id >= 1996"), 60.0, F.lit("v2").alias("version"))
    return root


@query(f"WITH {_BUILDS} SELECT build_id, built_at, count(*) AS sources, CAST(sum(found) AS BIGINT) AS found, CAST(sum(kept) AS BIGINT) AS kept, max(version) AS version, max(v.n) AS variables, max(v.valid) AS most_valid FROM bld JOIN src USING (build_id) JOIN (SELECT build_id, count(*) AS n, max(valid) AS valid FROM var GROUP BY 1) v USING (build_id) GROUP BY 1,2")
def recorded_builds(spark, sf_dir):
    """Builds as they stand in three tables after a second run replaced some of them."""
    root = recorded(spark, sf_dir)
    variables = builds.read(spark, root, "build_variables").groupBy("build_id").agg(F.count("*").alias("variables"), F.max("valid").alias("most_valid"))
    sources = builds.read(spark, root, "build_sources").groupBy("build_id").agg(F.count("*").alias("sources"), F.sum("found").alias("found"), F.sum("kept").alias("kept"), F.max("version").alias("version"))
    return builds.read(spark, root, "builds").join(sources, "build_id").join(variables, "build_id")


@query(f"WITH {_BUILDS} SELECT build_id, built_at, collection, {W}, found, kept FROM bld JOIN src USING (build_id) WHERE built_at=(SELECT max(built_at) FROM bld)")
def latest_recorded_build(spark, sf_dir):
    """The report of the latest build of the catalogue."""
    return builds.latest(spark, recorded(spark, sf_dir))


@query(
    "WITH o AS (SELECT o_orderkey AS id, o_orderkey%4 AS k, (o_orderkey%100)/10.0 AS x FROM orders) SELECT id, CASE k WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 1 END AS points, round(CASE k WHEN 0 THEN x WHEN 1 THEN x+1 WHEN 2 THEN x+2 END,4) AS lon, id%6=0 AS kiln FROM o"
)
def element_points(spark, sf_dir):
    """Vertices and kind of elements given in three ways, or in none."""
    k, x = F.col("o_orderkey") % 4, F.col("o_orderkey") % 100 / 10.0
    pair = lambda a: F.struct(a.alias("lon"), F.lit(1.0).alias("lat"))
    e = T.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, F.array(pair(x), pair(x + 1), pair(x + 2))).alias("geometry"), F.when(k == 1, x + 1).alias("lon"), F.when(k == 1, 1.0).alias("lat"),
        F.when(k == 2, F.struct((x + 1).alias("minlon"), F.lit(0.0).alias("minlat"), (x + 3).alias("maxlon"), F.lit(2.0).alias("maxlat"))).alias("bounds"),
        F.when(F.col("o_orderkey") % 6 == 0, F.create_map(F.lit("man_made"), F.lit("kiln"))).otherwise(F.create_map(F.lit("highway"), F.lit("primary"))).alias("tags"),
    )
    p = roads.element_points(e)
    return p.select("id", F.coalesce(F.size("points"), F.lit(0)).alias("points"), r4(F.col("points")[0]["lon"], "lon"), roads.is_kiln(F.col("tags")).alias("kiln")).withColumn("points", F.greatest("points", F.lit(0)))


@query("SELECT p_partkey AS id, round(74.25+(p_partkey%50)*0.21/50,6) AS lon, p_partkey%50 AS back FROM part")
def edge_columns(spark, sf_dir):
    """Columns to longitudes of their edges and back."""
    c = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("col"))
    lon = c.withColumn("lon", G.edge_longitude(F.col("col"), 74.25, 74.46, 50))
    return lon.select("id", F.round("lon", 6).alias("lon"), G.edge_column(F.col("lon"), 74.25, 74.46, 50).alias("back"))


@query(
    "WITH s AS (SELECT s_suppkey AS id, s_suppkey%8 AS k, 3+s_suppkey//8%6 AS n, (s_suppkey%90)*1.0 AS x FROM supplier), one AS (SELECT *, (n+1)*x+n*(n-1)/20.0 AS sx FROM s) "
    "SELECT id, CASE WHEN k<2 THEN n+1 WHEN k<4 THEN 2*(n+1) ELSE 0 END AS vertices, round(CASE WHEN k<2 THEN sx WHEN k<4 THEN 2*sx+n+1 ELSE 0 END,4) AS sum_x, CASE WHEN k=4 THEN 'no vertices' WHEN k>4 THEN 'not a polygon' END AS reason FROM one"
)
def geometry_checks(spark, sf_dir):
    """Geometries of rings that differ by row, unwrapped, counted, refused."""
    s = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (3 + F.floor(F.col("s_suppkey") / 8) % 6).alias("n"), (F.col("s_suppkey") % 90).cast("double").alias("x"))

    def ring(right: float):
        spots = F.concat(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.array(F.lit(0).cast("long")))
        return F.concat(F.lit("["), F.array_join(F.transform(spots, lambda i: F.format_string("[%.1f,%d]", F.col("x") + right + i / 10, i)), ","), F.lit("]"))

    typed = lambda kind, coords: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coords, F.lit("}"))
    feature = lambda g: F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), g, F.lit("}"))
    listed = lambda *f: F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *f), F.lit("]}"))
    poly = typed("Polygon", F.concat(F.lit("["), ring(0.0), F.lit("]")))
    holed = typed("Polygon", F.concat(F.lit("["), ring(0.0), F.lit(","), ring(1.0), F.lit("]")))
    multi = typed("MultiPolygon", F.concat(F.lit("[["), ring(0.0), F.lit("],["), ring(1.0), F.lit("]]")))
    texts = [poly, listed(feature(poly)), feature(holed), multi, typed("Polygon", F.lit("[]")), typed("Point", F.lit("[1,2]")), listed(feature(poly), feature(poly)), F.concat(F.lit("not json "), F.col("x").cast("string"))]
    out = geojson.polygons(s.withColumn("geojson", F.array(*texts)[(F.col("id") % 8).cast("int")]))
    xs = F.coalesce(F.aggregate(F.flatten("rings"), F.lit(0.0), lambda a, p: a + p["x"]), F.lit(0.0))
    return out.select("id", "vertices", r4(xs, "sum_x"), "reason")


@query(f"WITH {T.CELLS}, {CORNERS}, {LONLAT} SELECT region_id, nth, round(lon,7) AS lon, round(lat,7) AS lat FROM ll")
def block_rings(spark, sf_dir):
    """K8: corners of the regions in degrees."""
    g = G.Grid(429000.0, 3497500.0, 100.0, height(spark, sf_dir), T.WIDTH)
    ring = G.block_ring(F.col("row0"), F.col("row1"), F.col("col0"), F.col("col1"), g)
    return lattice_of(spark, sf_dir).select("region_id", F.posexplode(ring).alias("nth", "p")).select("region_id", F.col("nth").cast("long").alias("nth"), F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query(
    _PLANS.replace("q AS (SELECT *, coalesce", "q0 AS (SELECT *, coalesce") + ", ps AS (SELECT * FROM (VALUES ('street-trees',0.15,NULL),('dense-canopy',0.40,NULL),('low-emission-zone',NULL,1.0),('clean-and-green',0.25,0.5),('winter-inversion',NULL,1.0)) v(slug,cf,ef)) "
    "SELECT id, slug, CASE WHEN cf IS NOT NULL AND room<=0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN NOT (cf IS NOT NULL AND room<=0) THEN CAST(round_even(coalesce(cf*area,0)/25,0) AS BIGINT) END AS trees FROM pp JOIN ps ON slug=['street-trees','dense-canopy','low-emission-zone','clean-and-green','winter-inversion'][CAST(id%5 AS INTEGER)+1]"
)
def preset_plans(spark, sf_dir):
    """Named plans on the regions of each row."""
    names = F.array(*[F.lit(x) for x in ("street-trees", "dense-canopy", "low-emission-zone", "clean-and-green", "winter-inversion")])
    rows = plan_table(spark, sf_dir).drop("tree_count", "canopy_fraction", "emission_fraction").withColumn("slug", names[(F.col("id") % 5).cast("int")])
    joined = rows.join(planning.presets(spark), "slug").withColumn("tree_count", F.lit(None).cast("long"))
    return planning.resolve(joined).select("id", "slug", "status", "trees")


@query(
    f"WITH {_DELTA}, {T.PEOPLE}, ad AS (SELECT scenario_id, avg(added) AS a FROM pl GROUP BY 1), dd AS (SELECT scenario_id, avg(CASE WHEN inside THEN delta END) AS m, coalesce(avg(CASE WHEN ring THEN delta END),0) AS r, sum(CASE WHEN population>0 THEN -delta*population ELSE 0 END) AS degrees, sum(CASE WHEN population>0 AND delta<-1e-12 THEN population ELSE 0 END) AS reached FROM fd LEFT JOIN (SELECT \"row\", col, population FROM people) USING (\"row\",col) GROUP BY 1), "
    f"f AS (SELECT *, CASE WHEN k>=1 THEN m/nullif(-a*k,0) END AS ratio, abs(m) AS z FROM dd JOIN ad USING (scenario_id), lm) SELECT scenario_id, round(greatest(-m,0)/2.5,4) AS expected_cooling, CASE WHEN m>=-0.005 THEN 'none' WHEN k<1 THEN CASE WHEN z>=0.1 THEN 'small' ELSE 'marginal' END WHEN z/k>=0.3 THEN 'large' WHEN z/k>=0.15 THEN 'moderate' WHEN z/k>=0.05 THEN 'small' ELSE 'marginal' END AS impact, "
    "round(ratio,4) AS ratio_to_linear, CASE WHEN m>0 THEN 'warms' WHEN -m>k THEN 'beyond the ceiling' WHEN ratio<0.3 OR ratio>2 THEN 'off the linear expectation' WHEN r=0 THEN 'no spillover' END AS flag, round(degrees,2) AS person_degrees, round(reached,2) AS people_reached FROM f"
)
def scenario_outcomes(spark, sf_dir):
    """Figures and flags of all scenarios in one plan: masks,
    planting, changes inside and in the ring, who is reached, verdicts."""
    p = planted(spark, sf_dir)
    people = T.population(spark, sf_dir).select("row", "col", "population")
    d = delta_field(spark, sf_dir, p).join(people, ["row", "col"], "left").withColumn("population", F.coalesce("population", F.lit(0.0)))
    reached = d.groupBy("scenario_id").agg(F.sum(F.when((F.col("population") > 0) & (F.col("delta") < -1e-12), F.col("population")).otherwise(0.0)).alias("people_reached"))
    totals = equity.totals(d, ["scenario_id"]).select("scenario_id", F.col("net").alias("person_degrees"))
    stats = scenario.summarise_delta(d, ["scenario_id", *KEYS]).join(p.groupBy("scenario_id").agg(F.avg("canopy_added").alias("mean_added")), "scenario_id")
    out = scenario.outcome(stats.join(totals, "scenario_id").join(reached, "scenario_id"), scenario.tree_built_contrast(cube(spark, sf_dir), KEYS), KEYS)
    return out.select("scenario_id", r4("expected_cooling"), "impact", r4("ratio_to_linear"), "flag", F.round("person_degrees", 2).alias("person_degrees"), F.round("people_reached", 2).alias("people_reached"))


@query(
    f"WITH {T.CELLS}, {_KER}, sc AS (SELECT s_suppkey AS scenario_id, (s_suppkey*7)%greatest((SELECT max(p_partkey)//50 FROM part)-6,1) AS r0, (s_suppkey*3)%43 AS c0 FROM supplier), rm AS (SELECT scenario_id, \"row\", col, CASE WHEN landcover=80 THEN elevation_m/1e6 ELSE 0 END*0.5 AS g FROM sc JOIN cells ON \"row\" BETWEEN r0 AND r0+7 AND col BETWEEN c0 AND c0+7), "
    f"st AS (SELECT scenario_id, sum(g) AS t FROM rm GROUP BY 1), de AS (SELECT scenario_id, \"row\"+dr AS \"row\", col+dc AS col, sum(g*w)*1e6 AS c FROM rm, kw WHERE g>0 AND \"row\"+dr BETWEEN 0 AND {_H} AND col+dc BETWEEN 0 AND 49 GROUP BY 1,2,3) "
    "SELECT scenario_id, CASE WHEN t=0 THEN 'nothing to remove' ELSE 'ok' END AS status, round(-max(c),4) AS strongest, CASE WHEN max(c) IS NULL THEN NULL ELSE count(c) END AS cells FROM st LEFT JOIN de USING (scenario_id) GROUP BY 1, t"
)
def air_scenarios(spark, sf_dir):
    """Only what is removed is spread; unanswered is null with a status."""
    s = scenarios(spark, sf_dir)
    mask = s.select("scenario_id", F.explode(F.sequence("r0", F.col("r0") + 7)).alias("row"), "c0").select("scenario_id", "row", F.explode(F.sequence("c0", F.col("c0") + 7)).alias("col")).withColumn("emission_fraction", F.lit(0.5))
    cells = T.cells(spark, sf_dir).select("row", "col", F.when(F.col("landcover") == 80, F.col("elevation_m") / 1e6).otherwise(0.0).alias("emission"))
    known = mask.join(cells.select("row", "col"), ["row", "col"], "left_semi")
    removed = kernel.removed_emissions(cells, known, ["scenario_id"])
    k = kernel.seasonal_kernel(parameters(spark, sf_dir), ["tile_id"], _RES)
    sent = removed.where("removed > 0").select(T.tile("scenario_id").alias("tile_id"), "scenario_id", "row", "col", F.col("removed").alias("emission"))
    field = kernel.concentration(sent, k, ["tile_id", "scenario_id"], height(spark, sf_dir), T.WIDTH)
    stats = field.groupBy("scenario_id").agg(r4(-F.max("concentration"), "strongest"), F.count("*").alias("cells"))
    return removed.select("scenario_id", "status").distinct().join(stats, "scenario_id", "left")


@query(
    f"WITH {T.OBS}, {_PIX}, {_IDX}, c AS (SELECT {W}, \"row\", col, median(ndvi) AS x, median(thermal)*0.00341802+149-273.15 AS y FROM idx GROUP BY 1,2,3), m AS (SELECT regr_slope(y,x) AS s, regr_intercept(y,x) AS b FROM c WHERE {W}<'1998-winter'), "
    f"p AS (SELECT {W}, s*x+b AS p, y AS o FROM c, m WHERE {W}>='1998-winter' AND x IS NOT NULL), g AS (SELECT {W}, avg(p-o) AS bias FROM p GROUP BY 1) SELECT {W}, count(*) AS n, round(avg(abs(p-o)),4) AS mae, round(max(bias),4) AS bias, round(avg(abs(p-o-bias)),4) AS mae_debiased FROM p JOIN g USING ({W}) GROUP BY 1"
)
def hindcast(spark, sf_dir):
    """M8: trained on the windows before, scored on each window after."""
    obs = T.observations(spark, sf_dir).groupBy("tile_id", "window", "row", "col").agg(F.median("thermal").alias("t"))
    x = composite.composite(indices(spark, sf_dir), composite.CELL, ["ndvi"])
    from tessera.functions.bands import KELVIN, THERMAL_OFFSET, THERMAL_SCALE

    c = x.join(obs, composite.CELL).withColumn("lst_c", F.col("t") * THERMAL_SCALE + THERMAL_OFFSET - KELVIN)
    windows = [r[0] for r in c.select("window").distinct().orderBy("window").collect()]  # two a year
    before, later = [w for w in windows if w < "1998-winter"], [w for w in windows if w >= "1998-winter"]
    change.refuse_leakage(before, later)
    model = features.linear(c.where(F.col("window").isin(before)), ["tile_id"], F.col("ndvi"))
    after = c.where(F.col("window").isin(later)).join(model, "tile_id").withColumn("predicted", F.col("slope") * F.col("ndvi") + F.col("intercept")).withColumn("observed", F.col("lst_c"))
    return change.score(after, ["window"]).select("window", "n", r4("mae"), r4("bias"), r4("mae_debiased"))


@query(f"WITH {T.OBS}, {_PIX}, {_IDX} SELECT split_part({W},'-',2) AS season, count(DISTINCT {W}) AS windows, count(*) AS rows_in, count(ndvi) AS clear FROM idx GROUP BY 1")
def season_totals(spark, sf_dir):
    """Observations of each season."""
    i = indices(spark, sf_dir)
    return i.groupBy(season.season_of(F.col("window")).alias("season")).agg(F.count_distinct("window").alias("windows"), F.count("*").alias("rows_in"), F.count("ndvi").alias("clear"))


@query("SELECT o_orderkey AS id, printf('%s: %.2f degC, %.1f%% canopy added, %.0f residents', 'r00c'||lpad(CAST(o_custkey%100 AS VARCHAR),2,'0'), (o_custkey%50)/8.0+0.001, (o_custkey%32)/64.0*100+0.001, (o_orderkey%1000)*1.0) AS line FROM orders")
def region_lines(spark, sf_dir):
    """Facts of regions as lines of text."""
    o = T.read(spark, sf_dir, "orders")
    t = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("r00c"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0")).alias("region_id"), (F.col("o_custkey") % 50 / 8.0 + 0.001).alias("expected_cooling"),
        (F.col("o_custkey") % 32 / 64.0 + 0.00001).alias("canopy_added"), (F.col("o_orderkey") % 1000 * 1.0).alias("residents"),
    )
    return regions.as_text(t).select("id", "line")


@query("SELECT l_orderkey AS id, l_linenumber AS nth, CASE WHEN l_tax<0.02 THEN NULL ELSE round(-l_discount*l_quantity,4)+0.0 END AS expectation, CASE WHEN l_quantity>=1 AND l_discount>0 THEN round(-l_tax/(l_discount*l_quantity),4)+0.0 END AS ratio FROM lineitem")
def linear_expectations(spark, sf_dir):
    """What a linear response would give, and the ratio to it where it means something."""
    li = T.read(spark, sf_dir, "lineitem")
    added, contrast = F.col("l_discount"), F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), (F.round(F.when(F.col("l_tax") >= 0.02, verdicts.linear_expectation(added, contrast)), 4) + F.lit(0.0)).alias("expectation"),
        (F.round(verdicts.ratio_to_linear(F.col("l_tax"), added, contrast), 4) + F.lit(0.0)).alias("ratio"),
    )
