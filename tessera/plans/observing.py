"""Queries on scenes, composites, weather and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bands, season, verdicts
from tessera.operators import composite, quality, search
from tessera.plans import tables as T
from tessera.plans.registry import query, r4

W = '"window"'
_REFL = "CASE WHEN {0}>0 AND ({0}-1000.0)/10000>0 AND ({0}-1000.0)/10000<=1.6 AND scl IN (4,5,6,7) THEN ({0}-1000.0)/10000 END"
_PIX = f"pix AS (SELECT *, {_REFL.format('red')} AS r, {_REFL.format('nir')} AS n, {_REFL.format('swir16')} AS s1, {_REFL.format('swir22')} AS s2, {_REFL.format('blue')} AS b FROM obs)"
_IDX = "idx AS (SELECT *, (n-r)/nullif(n+r,0) AS ndvi, (s1-n)/nullif(s1+n,0) AS ndbi, (0.356*b+0.130*r+0.373*n+0.085*s1+0.072*s2-0.0018)/1.016 AS albedo FROM pix)"


def indices(spark, sf_dir, also=()):
    """Clear-sky reflectances and their indices, one row per observation, beside the columns ``also``."""
    obs = T.observations(spark, sf_dir)
    clear = bands.clear_class(F.col("scl"))
    refl = {x: F.when(clear, bands.reflectance(F.col(x), 1000.0)) for x in ("blue", "red", "nir", "swir16", "swir22")}
    return obs.select(
        "tile_id", "window", "row", "col", "scene_id", "ts", bands.normalised_difference(refl["nir"], refl["red"]).alias("ndvi"), bands.normalised_difference(refl["swir16"], refl["nir"]).alias("ndbi"),
        bands.albedo(refl["blue"], refl["red"], refl["nir"], refl["swir16"], refl["swir22"]).alias("albedo"), *also,
    )


@query(f"WITH {T.OBS}, {_PIX}, {_IDX} SELECT tile_id, {W}, \"row\", col, round(median(ndvi),4) AS ndvi, round(median(ndbi),4) AS ndbi, round(median(albedo),4) AS albedo, count(ndvi) AS looks FROM idx GROUP BY 1,2,3,4")
def composite_depth(spark, sf_dir):
    """Season composites of three indices and their depth."""
    made = composite.composite(indices(spark, sf_dir), composite.CELL, ["ndvi", "ndbi", "albedo"])
    return made.select(*composite.CELL, r4("ndvi"), r4("ndbi"), r4("albedo"), F.col("ndvi_looks").alias("looks"))


@query(
    f"WITH {T.OBS}, {T.CELLS}, {_PIX}, {_IDX}, w AS (SELECT DISTINCT {W} FROM obs), c AS (SELECT {W}, \"row\", col, count(ndvi) AS looks FROM idx GROUP BY 1,2,3) "
    f"SELECT {W}, min(coalesce(looks,0)) AS min_depth, median(coalesce(looks,0)) AS median_depth, min(coalesce(looks,0))=0 AS warns FROM cells CROSS JOIN w LEFT JOIN c USING ({W}, \"row\", col) GROUP BY 1"
)
def depth_by_window(spark, sf_dir):
    """Depth of the composites over every cell of every window."""
    obs = indices(spark, sf_dir)
    made = composite.composite(obs, ["window", "row", "col"], ["ndvi"])
    dense = composite.on_skeleton(T.cells(spark, sf_dir).select("row", "col"), obs.select("window").distinct(), made, ["window", "row", "col"], ["ndvi_looks"])
    return composite.composite_depth(dense, ["window"], "ndvi_looks")


@query(f"WITH {T.OBS} SELECT {W}, \"row\", col, round(median(CASE WHEN (qa & 31)=0 AND thermal>0 THEN thermal*0.00341802+149.0-273.15 END),4) AS lst_c, count(CASE WHEN (qa & 31)=0 THEN 1 END) AS looks FROM obs GROUP BY 1,2,3")
def surface_temperature(spark, sf_dir):
    """Temperature composites of clear pixels."""
    obs = T.observations(spark, sf_dir).withColumn("lst_c", F.when(bands.clear_bits(F.col("qa")), bands.surface_celsius(F.col("thermal"))))
    made = composite.composite(obs, ["window", "row", "col"], ["lst_c"])
    return made.select("window", "row", "col", r4("lst_c"), F.col("lst_c_looks").alias("looks"))


@query(f"WITH {T.SCENES} SELECT collection, {W}, count(*) AS found, count(CASE WHEN coalesce(cloud_cover,0)<=40 THEN 1 END) AS kept FROM scenes WHERE {W} IS NOT NULL GROUP BY 1,2")
def scene_accounting(spark, sf_dir):
    """Scenes found and kept."""
    return composite.scene_counts(T.scenes(spark, sf_dir).where("window IS NOT NULL"), ["collection", "window"], 40.0)


_BOXES = (
    f"{T.SCENES}, bx AS (SELECT *, (scene_id*137%34000)/100.0-170 AS west, (scene_id*71%15000)/100.0-75 AS south, (scene_id%23)/10.0+0.5 AS wide FROM scenes), "
    "sq AS (SELECT c_custkey AS search_id, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][CAST(c_custkey%5 AS INTEGER)+1] AS collection, CASE WHEN c_custkey%11=0 THEN 170.0 ELSE (c_custkey*331%33000)/100.0-170 END AS west, (c_custkey*97%14000)/100.0-75 AS south, "
    "CASE WHEN c_custkey%11=0 THEN -170.0 ELSE (c_custkey*331%33000)/100.0-170+(c_custkey%17)*(c_custkey%7)/4.0 END AS east, (c_custkey*97%14000)/100.0-75+(c_custkey%13) AS north, CASE WHEN c_custkey%9<>0 THEN TIMESTAMP '1995-01-01'+to_days(CAST(c_custkey*13%900 AS INTEGER)) END AS \"from\", "
    "CASE WHEN c_custkey%8<>0 THEN TIMESTAMP '1995-01-01'+to_days(CAST(c_custkey*13%900+c_custkey%4*c_custkey%300 AS INTEGER))+to_microseconds(86399999999) END AS \"to\", CASE WHEN c_custkey%3<>0 THEN (c_custkey%5)*20.0 END AS max_cloud FROM customer), "
    "ht AS (SELECT search_id, scene_id, coalesce(coalesce(cloud_cover,0)<=max_cloud,true) AS kept FROM sq JOIN bx ON sq.collection=bx.collection AND bx.south<=sq.north AND sq.south<=bx.south+wide AND "
    "CASE WHEN sq.west>sq.east THEN bx.west+wide>=sq.west OR bx.west<=sq.east ELSE bx.west<=sq.east AND sq.west<=bx.west+wide END AND coalesce(ts>=\"from\",true) AND coalesce(ts<=\"to\",true))"
)


def boxed_scenes(spark, sf_dir):
    k = F.col("scene_id")
    west, south, wide = k * 137 % 34000 / 100.0 - 170, k * 71 % 15000 / 100.0 - 75, k % 23 / 10.0 + 0.5
    return T.scenes(spark, sf_dir).withColumns({"west": west, "south": south, "east": west + wide, "north": south + wide})


def searches(spark, sf_dir):
    """A search for each customer: boxes from a point to 24 degrees, some over the date
    line; intervals from a day to ten months, open at either end or both."""
    k = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    west, south = k * 331 % 33000 / 100.0 - 170, k * 97 % 14000 / 100.0 - 75
    day = lambda n: F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    text = F.concat(F.when(k % 9 == 0, "..").otherwise(day(k * 13 % 900)), F.lit("/"), F.when(k % 8 == 0, "").otherwise(day(k * 13 % 900 + k % 4 * k % 300)))
    start, end = search.parse_interval(text)
    return T.read(spark, sf_dir, "customer").select(
        k.alias("search_id"), names[(k % 5).cast("int")].alias("collection"), F.when(k % 11 == 0, 170.0).otherwise(west).alias("west"), south.alias("south"),
        F.when(k % 11 == 0, -170.0).otherwise(west + k % 17 * (k % 7) / 4.0).alias("east"), (south + k % 13).alias("north"), start.alias("start"), end.alias("end"), F.when(k % 3 != 0, k % 5 * 20.0).alias("max_cloud"),
    )


@query(f"WITH {_BOXES} SELECT search_id, scene_id, kept FROM ht")
def scene_search(spark, sf_dir):
    """Scenes of many searches by box and interval."""
    return search.matches(boxed_scenes(spark, sf_dir), searches(spark, sf_dir)).select("search_id", "scene_id", "kept")


@query(f"WITH {_BOXES} SELECT search_id, count(scene_id) AS n_found, count(CASE WHEN kept THEN 1 END) AS n_kept FROM sq LEFT JOIN ht USING (search_id) GROUP BY 1")
def search_counts(spark, sf_dir):
    """How many scenes each search finds, and how many of them are clear enough."""
    return search.tallies(boxed_scenes(spark, sf_dir), searches(spark, sf_dir))


@query(f"WITH {T.SCENES} SELECT scene_id, collection, {W}, rank FROM (SELECT *, row_number() OVER (PARTITION BY collection, {W} ORDER BY coalesce(cloud_cover,0), scene_id) AS rank FROM scenes WHERE {W} IS NOT NULL) WHERE rank<=14")
def clearest_scenes(spark, sf_dir):
    """The 14 clearest scenes of a collection and window."""
    return composite.clearest(T.scenes(spark, sf_dir).where("window IS NOT NULL"), ["collection", "window"], 14).select("scene_id", "collection", "window", "rank")


@query(f"WITH {T.SCENES} SELECT {W}, CASE WHEN bool_or(processing_baseline>=4.0) THEN 1000.0 ELSE 0.0 END::DOUBLE AS \"offset\", count(DISTINCT processing_baseline>=4.0)>1 AS mixed FROM scenes WHERE {W} IS NOT NULL GROUP BY 1")
def baseline_offsets(spark, sf_dir):
    """The offset of a window's numbers."""
    return composite.baseline_offset(T.scenes(spark, sf_dir).where("window IS NOT NULL"), ["window"])


@query(f"WITH {T.SCENES} SELECT collection, count(*) AS scenes, count(CASE WHEN platform IN ('landsat-8','landsat-9') THEN 1 END) AS thermal FROM scenes s WHERE year(ts)=(SELECT max(year(ts)) FROM scenes x WHERE x.collection=s.collection) GROUP BY 1")
def newest_thermal(spark, sf_dir):
    """Scenes of a collection's newest year, and those that carry a thermal band."""
    newest = composite.newest_year(T.scenes(spark, sf_dir), ["collection"])
    return newest.groupBy("collection").agg(F.count("*").alias("scenes"), F.count_if(F.col("platform").isin(*bands.THERMAL_PLATFORMS)).alias("thermal"))


@query(f"WITH {T.OBS} SELECT \"row\", col, CAST(ts + to_seconds(CAST(round((col*2.0-50)/15*3600) AS BIGINT)) AS DATE) AS solar_day, arg_min(red, (scene_id, red)) AS red FROM obs WHERE red IS NOT NULL AND scl<>9 GROUP BY 1,2,3")
def solar_day_mosaic(spark, sf_dir):
    """A3: one value per cell and solar day."""
    obs = T.observations(spark, sf_dir).where("scl <> 9")
    return composite.solar_day_mosaic(obs, ["row", "col"], "red", F.col("col") * 2.0 - 50)


@query(
    f"WITH {T.HOURLY} SELECT event_type, count(*) AS records, round(median(value),4) AS value, count(value) AS value_kept, "
    "round(((degrees(atan2(avg(sin(radians(direction))),avg(cos(radians(direction)))))%360)+360)%360,3) AS direction FROM hourly WHERE hour(ts)=10 GROUP BY 1"
)
def overpass_weather(spark, sf_dir):
    """A4, A5: medians at the overpass hour and the mean direction."""
    out = composite.overpass_weather(T.hourly(spark, sf_dir), ["event_type"], ["value"], "direction")
    return out.select("event_type", "records", r4("value"), "value_kept", F.round("direction", 3).alias("direction"))


@query(f"WITH {T.OBS}, {_PIX}, {_IDX}, c AS (SELECT {W}, \"row\", col, median(ndvi) AS ndvi, median(albedo) AS albedo FROM idx GROUP BY 1,2,3), l AS (SELECT {W}, 'ndvi' AS variable, ndvi AS value FROM c UNION ALL SELECT {W}, 'albedo', albedo FROM c) SELECT variable, {W}, count(value) AS populated, round(count(value)/count(*)::DOUBLE,4) AS valid_fraction, round(min(value),4) AS vmin, round(max(value),4) AS vmax, round(avg(value),4) AS vmean FROM l GROUP BY GROUPING SETS ((variable),(variable,{W}))")
def summary(spark, sf_dir):
    """Populated cells and range of each variable by window and over all."""
    made = composite.composite(indices(spark, sf_dir), ["window", "row", "col"], ["ndvi", "albedo"])
    out = quality.summarise(made, ["ndvi", "albedo"])
    return out.select("variable", "window", "populated", r4("valid_fraction"), r4("vmin"), r4("vmax"), r4("vmean"))


_COVER = f"WITH {T.OBS}, {T.CELLS}, {_PIX}, {_IDX}, w AS (SELECT DISTINCT {W} FROM obs), c AS (SELECT {W}, \"row\", col, median(ndvi) AS ndvi, median(ndbi) AS ndbi FROM idx GROUP BY 1,2,3), d AS (SELECT {W}, ndvi, ndbi FROM cells CROSS JOIN w LEFT JOIN c USING ({W}, \"row\", col)), f AS (SELECT {W}, 'ndvi' AS variable, count(ndvi)/count(*)::DOUBLE AS fraction FROM d GROUP BY 1 UNION ALL SELECT {W}, 'ndbi', count(ndbi)/count(*)::DOUBLE FROM d GROUP BY 1) "


def dense_composite(spark, sf_dir):
    obs = indices(spark, sf_dir)
    made = composite.composite(obs, ["window", "row", "col"], ["ndvi", "ndbi"])
    return composite.on_skeleton(T.cells(spark, sf_dir).select("row", "col"), obs.select("window").distinct(), made, ["window", "row", "col"])


@query(_COVER + f"SELECT {W}, variable, round(fraction,4) AS fraction FROM f")
def coverage(spark, sf_dir):
    """Share of cells with a value."""
    return quality.valid_fractions(dense_composite(spark, sf_dir), ["window"], ["ndvi", "ndbi"]).select("window", "variable", r4("fraction"))


@query(_COVER + f", p AS (SELECT CASE WHEN fraction=0 THEN 'empty' WHEN fraction<0.6 THEN 'thin' END AS problem, variable, {W}, fraction FROM f UNION ALL SELECT 'absent','lst_c',{W},0.0 FROM w) SELECT problem, variable, {W}, round(fraction,4) AS fraction, CASE problem WHEN 'absent' THEN 'add the layer' WHEN 'empty' THEN 'build the window again' ELSE 'widen the window or the cloud limit' END AS remedy FROM p WHERE problem IS NOT NULL")
def coverage_problems(spark, sf_dir):
    """Problems and their remedies."""
    return quality.problems(dense_composite(spark, sf_dir), ["ndvi", "ndbi", "lst_c"], 0.6).select("problem", "variable", "window", r4("fraction"), "remedy")


@query(_COVER + f"SELECT {W}, arg_min(variable, (fraction, variable)) AS worst, round(min(fraction),4) AS fraction, min(fraction)>=0.5 AS usable FROM f GROUP BY 1")
def usable_windows(spark, sf_dir):
    """Windows whose worst variable has enough coverage."""
    fractions = quality.valid_fractions(dense_composite(spark, sf_dir), ["window"], ["ndvi", "ndbi"])
    return quality.usable_windows(fractions).withColumn("fraction", F.round("fraction", 4))


@query(f"WITH {T.CELLS} SELECT tile_id, count(*) AS cells, count(DISTINCT (\"row\",col)) AS distinct_cells, min(\"row\") AS min_row, max(\"row\") AS max_row, min(col) AS min_col, max(col) AS max_col, false AS complete FROM cells GROUP BY 1")
def grid_structure(spark, sf_dir):
    """A tile's cells against a grid of another size."""
    return quality.structure(T.cells(spark, sf_dir), ["tile_id"], 7, 50)


@query(f"WITH {T.OBS} SELECT {W}, count(CASE WHEN NOT thermal*0.00341802+149.0-273.15 BETWEEN 10 AND 35 THEN 1 END) AS rejected, count(CASE WHEN thermal*0.00341802+149.0-273.15 BETWEEN 10 AND 35 THEN 1 END) AS kept FROM obs GROUP BY 1")
def valid_range(spark, sf_dir):
    """P10: values out of range go, and are counted."""
    v = bands.surface_celsius(F.col("thermal"))
    return T.observations(spark, sf_dir).groupBy("window").agg(bands.rejected(v, 10, 35).alias("rejected"), F.count(bands.in_range(v, 10, 35)).alias("kept"))


@query(f"WITH {T.CELLS} SELECT landcover, count(*) AS cells, round(count(*)/(SELECT count(*) FROM cells)::DOUBLE,4) AS share FROM cells GROUP BY 1")
def cover_shares(spark, sf_dir):
    """Share of each class."""
    return quality.shares(T.cells(spark, sf_dir), "landcover").withColumn("share", F.round("share", 4))


_START = f"CASE WHEN {W} LIKE '%summer' THEN make_date(CAST(split_part({W},'-',1) AS INTEGER),4,1) ELSE make_date(CAST(split_part({W},'-',1) AS INTEGER),11,1) END"
_END = f"CASE WHEN {W} LIKE '%summer' THEN make_date(CAST(split_part({W},'-',1) AS INTEGER),6,30) ELSE make_date(CAST(split_part({W},'-',1) AS INTEGER)+1,1,31) END"


@query(f"WITH {T.OBS}, w AS (SELECT DISTINCT {W}, {_START} AS s, {_END} AS e FROM obs) SELECT {W}, split_part({W},'-',2) AS season, s AS start_day, e AS end_day, CAST(s + CAST(floor((e-s)/2) AS INTEGER) AS DATE) AS midpoint, CAST(s AS VARCHAR)||'/'||CAST(e AS VARCHAR) AS \"interval\" FROM w")
def window_table(spark, sf_dir):
    """Windows with season, days, middle and interval."""
    return season.with_midpoint(T.observations(spark, sf_dir).select("window").distinct())


@query(
    f"WITH {T.OBS}, w AS (SELECT DISTINCT {W} AS win, {_START} AS s FROM obs), p AS (SELECT c_custkey AS plan_id, CASE WHEN c_custkey%3=0 THEN (1990+c_custkey%12)||'-summer' END AS asked, CASE WHEN c_custkey%5=1 THEN 'winter' WHEN c_custkey%5=2 THEN 'summer' END AS season FROM customer), "
    "l AS (SELECT (SELECT arg_max(win,s) FROM w WHERE win LIKE '%summer') AS su, (SELECT arg_max(win,s) FROM w WHERE win LIKE '%winter') AS wi, (SELECT arg_max(win,s) FROM w) AS an), "
    f"r AS (SELECT plan_id, asked, CASE WHEN asked IS NOT NULL THEN win ELSE coalesce(CASE season WHEN 'summer' THEN su WHEN 'winter' THEN wi END, su, an) END AS chosen FROM p LEFT JOIN w ON asked=win CROSS JOIN l) SELECT plan_id, chosen AS {W}, CASE WHEN chosen IS NULL THEN 'no window '||coalesce(asked,'at all') END AS reason FROM r"
)
def resolved_windows(spark, sf_dir):
    """The window each plan runs in, or why it does not."""
    c = T.read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    plans = c.select(
        key.alias("plan_id"), F.when(key % 3 == 0, F.concat((1990 + key % 12).cast("string"), F.lit("-summer"))).alias("asked"), F.when(key % 5 == 1, "winter").when(key % 5 == 2, "summer").alias("season")
    )
    return season.resolve_windows(plans, T.observations(spark, sf_dir).select("window").distinct())


@query(f"WITH {T.OBS}, {_PIX}, {_IDX}, t AS (SELECT {W}, count(ndvi) AS v, count(*) AS n FROM idx GROUP BY 1) SELECT {W}, CASE WHEN v>=n THEN '100%' WHEN printf('%.1f%%',v*100.0/n)='100.0%' THEN printf('%.3f%%',v*100.0/n) ELSE printf('%.1f%%',v*100.0/n) END AS coverage FROM t")
def coverage_text(spark, sf_dir):
    """Coverage in words that hide no gap."""
    return indices(spark, sf_dir).groupBy("window").agg(F.count("ndvi").alias("v"), F.count("*").alias("n")).select("window", verdicts.coverage_text(F.col("v"), F.col("n")).alias("coverage"))
