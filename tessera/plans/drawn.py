"""Queries on drawn polygons: GeoJSON text to cells, and what lies in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grid as G
from tessera.operators import features, kernel, polygons, raster, scenario, simulate
from tessera.plans import tables as T
from tessera.plans.acting import _AIR, _CUBE, _LM, _NEAR, KEYS, cube, feature_table, greenness
from tessera.plans.people import _GROUPED
from tessera.plans.registry import query, r4
from tessera.plans.spatial import _H, _RES, height, parameters

#: Rings of each shape in steps around a middle, positions not closed; kind of geometry, and features around it.
_SQUARE = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
_DIAMOND = lambda k: [(-k, 0), (0, k), (k, 0), (0, -k)]
SHAPES = [
    ("Polygon", [[_DIAMOND(2)]]),
    ("Polygon", [[_DIAMOND(4), _DIAMOND(1)]]),  # a hole
    ("MultiPolygon", [[_SQUARE(-4, -2, -1, 2)], [_SQUARE(1, -2, 4, 2)]]),
    ("Polygon", [[[(-2, -2), (2, 2), (2, -2), (-2, 2)]]]),  # crosses itself
    ("Polygon", [[_DIAMOND(2)]]),  # two degrees away
    ("Polygon", [[_SQUARE(-4, -1, -2, 1), _SQUARE(1, -1, 3, 1)]]),  # the hole is outside
    ("Polygon", [[[(-3, -3), (3, -3), (3, 0), (0, 0), (0, 3), (-3, 3)]]]),
    ("MultiPolygon", [[_SQUARE(-3, -3, 1, 1)], [_SQUARE(-1, -1, 3, 3)]]),  # parts that cross
    ("MultiPolygon", [[_SQUARE(-4, -4, 4, 4)], [_SQUARE(-1, -1, 1, 1)]]),  # a part inside another
    ("Point", []),
    ("Polygon", [[_SQUARE(-4, -4, 4, 4), [(0, 4), (-1, 2), (1, 2)]]]),  # a hole that touches its shell
    ("Polygon", [[_DIAMOND(3)]]),  # two features
]
FAR, NESTED, PAIR = 4, 6, 11
ZONE, LEFT, TOP, RES = 43, 429000.0, 3497500.0, 100.0


def _grid(spark, sf_dir) -> G.Grid:
    return G.Grid(LEFT, TOP, RES, height(spark, sf_dir), T.WIDTH, ZONE)


def drawings(spark, sf_dir):
    """(id, geojson) of every customer: twelve shapes in turn, of sizes and places of their own."""
    k = F.col("c_custkey")
    c = T.read(spark, sf_dir, "customer").select(
        k.alias("id"), (k % len(SHAPES)).alias("shape"), (74252000 + k * 1373 % 50000 + F.when(k % len(SHAPES) == FAR, 2000000).otherwise(0)).alias("cx"),
        (31609000 - k * 911 % (900 * height(spark, sf_dir))).alias("cy"), (250 + k % 7 * 150).alias("s"),
    )
    place = lambda dx, dy: F.format_string("[%.6f,%.6f]", (F.col("cx") + dx * F.col("s")) / 1e6, (F.col("cy") + dy * F.col("s")) / 1e6)

    def listed(items, depth):
        inner = [listed(x, depth - 1) for x in items] if depth else [place(*p) for p in [*items, items[0]]]
        return F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]"))

    out = None
    for n, (kind, parts) in enumerate(SHAPES):
        coords = place(0, 0) if kind == "Point" else listed(parts[0], 1) if kind == "Polygon" else listed(parts, 2)
        text = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coords, F.lit("}"))
        feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"x"},"geometry":'), text, F.lit("}"))
        around = lambda *f: F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *f), F.lit("]}"))
        text = around(feature) if n == NESTED else around(feature, feature) if n == PAIR else text
        out = F.when(F.col("shape") == n, text) if out is None else out.when(F.col("shape") == n, text)
    return c.select("id", out.alias("geojson"))


def _metres_sql(points: str) -> str:
    """``xy``: rows of ``points(lon, lat, ...)`` with east and north, from the series' constants."""
    x = "+".join(["eta", *(f"({a!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(G.ALPHA, 1))])
    y = "+".join(["xi", *(f"({a!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(G.ALPHA, 1))])
    scale, ecc = f"{G.SCALE * G.RADIUS!r}", f"{G.ECCENTRICITY!r}"
    return (
        f"tm AS (SELECT *, sinh(atanh(sin(radians(lat)))-{ecc}*atanh({ecc}*sin(radians(lat)))) AS tt, radians(lon-({G.central_meridian(ZONE)})) AS lam FROM {points}), "
        f"em AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+tt*tt)) AS eta FROM tm), xy AS (SELECT *, {G.FALSE_EASTING}+{scale}*({x}) AS e, {scale}*({y}) AS n FROM em)"
    )


_TEMPLATE = ",".join(f"({n},{p},{r},{k},{x},{y})" for n, (_, parts) in enumerate(SHAPES) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring))
_TURN = lambda o, a, b: f"sign(({a}.x-{o}.x)*({b}.y-{o}.y)-({a}.y-{o}.y)*({b}.x-{o}.x))"
#: Every pair of edges of a geometry, every ring against every other ring, every cell against every polygon.
_DRAWN = (
    f"geo AS (SELECT c_custkey AS id, c_custkey%{len(SHAPES)} AS shape, 74252000+(c_custkey*1373)%50000+CASE WHEN c_custkey%{len(SHAPES)}={FAR} THEN 2000000 ELSE 0 END AS cx, 31609000-(c_custkey*911)%(900*({_H}+1)) AS cy, 250+(c_custkey%7)*150 AS s FROM customer), "
    f"tpl AS (SELECT * FROM (VALUES {_TEMPLATE}) v(shape, part, ring, nth, dx, dy)), "
    "pts AS (SELECT id, part, ring, nth, (cx+dx*s)/1e6 AS lon, (cy+dy*s)/1e6 AS lat, count(*) OVER (PARTITION BY id, part, ring) AS n_of FROM geo JOIN tpl USING (shape)), "
    f"{_metres_sql('pts')}, "
    "ed AS (SELECT a.id, a.part, a.ring, a.nth, a.n_of, {'x': a.lon, 'y': a.lat} AS a, {'x': b.lon, 'y': b.lat} AS b, a.e AS e0, a.n AS n0, b.e AS e1, b.n AS n1 FROM xy a JOIN xy b ON a.id=b.id AND a.part=b.part AND a.ring=b.ring AND b.nth=(a.nth+1)%a.n_of), "
    f"pr AS (SELECT p.id, p.part=q.part AND p.ring=q.ring AS same, q.nth-p.nth=1 OR q.nth-p.nth=p.n_of-1 AS next, {_TURN('p.a', 'p.b', 'q.a')}*{_TURN('p.a', 'p.b', 'q.b')} AS one, {_TURN('q.a', 'q.b', 'p.a')}*{_TURN('q.a', 'q.b', 'p.b')} AS two, "
    "least(p.a.x,p.b.x)<=greatest(q.a.x,q.b.x) AND least(q.a.x,q.b.x)<=greatest(p.a.x,p.b.x) AND least(p.a.y,p.b.y)<=greatest(q.a.y,q.b.y) AND least(q.a.y,q.b.y)<=greatest(p.a.y,p.b.y) AS near FROM ed p JOIN ed q ON p.id=q.id AND (p.part,p.ring,p.nth)<(q.part,q.ring,q.nth)), "
    "cr AS (SELECT DISTINCT id FROM pr WHERE CASE WHEN same THEN NOT next AND near AND one<=0 AND two<=0 ELSE one<0 AND two<0 END), "
    "pb AS (SELECT id, part, ring, arg_max({'x': (a.x+b.x)/2, 'y': (a.y+b.y)/2}, (pow(b.x-a.x,2)+pow(b.y-a.y,2), -nth)) AS p FROM ed GROUP BY 1,2,3), "
    "ins AS (SELECT pb.id, pb.part, pb.ring, ed.part AS part2, ed.ring AS ring2 FROM pb JOIN ed ON pb.id=ed.id AND (pb.part,pb.ring)<>(ed.part,ed.ring) WHERE (a.y>p.y)<>(b.y>p.y) AND p.x<a.x+(p.y-a.y)*(b.x-a.x)/(b.y-a.y) GROUP BY ALL HAVING count(*)%2=1), "
    "inp AS (SELECT id, part, ring, part2, count(*) AS k FROM ins GROUP BY 1,2,3,4), "
    "mp AS (SELECT DISTINCT pb.id FROM pb LEFT JOIN inp own ON own.id=pb.id AND own.part=pb.part AND own.ring=pb.ring AND own.part2=pb.part LEFT JOIN inp oth ON oth.id=pb.id AND oth.part=pb.part AND oth.ring=pb.ring AND oth.part2<>pb.part AND oth.k%2=1 WHERE coalesce(own.k,0)<>CASE WHEN pb.ring>0 THEN 1 ELSE 0 END OR oth.id IS NOT NULL), "
    f"rf AS (SELECT id, CASE WHEN shape={PAIR} THEN 'not one feature' WHEN shape=9 THEN 'not a polygon' WHEN id IN (SELECT id FROM cr) OR id IN (SELECT id FROM mp) THEN 'invalid' END AS refused FROM geo), "
    f"gd AS (SELECT r.i AS \"row\", c.i AS col, {LEFT}+(c.i+0.5)*{RES} AS x, {TOP}-(r.i+0.5)*{RES} AS y FROM (SELECT unnest(range(0,{_H}+1)) AS i) r, range(0,50) c(i)), "
    "ic AS (SELECT id, \"row\", col FROM gd JOIN ed ON (n0>y)<>(n1>y) AND x<e0+(y-n0)*(e1-e0)/(n1-n0) WHERE id IN (SELECT id FROM rf WHERE refused IS NULL) GROUP BY ALL HAVING count(*)%2=1), "
    "dr AS (SELECT rf.id, CASE WHEN refused IS NOT NULL THEN refused WHEN ic.id IS NULL THEN 'no cells' ELSE 'ok' END AS status, ic.\"row\", ic.col FROM rf LEFT JOIN ic ON ic.id=rf.id)"
)


@query(f"WITH {_DRAWN} SELECT id, status, \"row\", col FROM dr")
def geojson_cells(spark, sf_dir):
    """K1: from text in degrees to cells, with refusals of invalid geometries and of those without a cell."""
    status, runs = polygons.masks(drawings(spark, sf_dir), ["id"], _grid(spark, sf_dir))
    return status.join(raster.dealt(polygons.cells_of(runs, ["id"])), "id", "left").select("id", "status", "row", "col")


def headroom(spark, sf_dir):
    """Cells with the share that can still be planted, and tiles that have no tree cover to refer to."""
    c = cube(spark, sf_dir)
    reference = scenario.tree_reference(c, KEYS)
    room = scenario.effective_fraction(F.lit(1.0), F.lit(True), F.col("ndvi"), scenario.canopy_fraction(F.col("ndvi"), F.col("tree_ndvi")), F.col("landcover"))
    return scenario.referred(c, reference, KEYS).select("tile_id", "row", "col", room.alias("headroom")), reference.select("tile_id", "reason")


@query(
    f"WITH {_CUBE}, {_DRAWN}, rt AS (SELECT median(CASE WHEN landcover=10 THEN ndvi END) AS tn FROM cube), hr AS (SELECT \"row\", col, CASE WHEN landcover NOT IN (80,0) THEN 1-least(greatest((ndvi-0.1)/greatest(tn-0.1,1e-6),0),1) ELSE 0 END AS room FROM cube, rt) "
    "SELECT id, status, CASE WHEN status='ok' THEN count(hr.room) END AS cells, CASE WHEN status='ok' THEN count(hr.room)*10000.0 END AS area_m2, round(CASE WHEN status='ok' THEN coalesce(sum(hr.room),0)*10000 END,2) AS plantable_canopy_m2 FROM dr LEFT JOIN hr USING (\"row\",col) GROUP BY id, status"
)
def polygon_measures(spark, sf_dir):
    """Cells, area and room for trees of every drawn polygon, from running sums along rows."""
    status, runs = polygons.masks(drawings(spark, sf_dir), ["id"], _grid(spark, sf_dir))
    cells, reason = headroom(spark, sf_dir)
    out = polygons.measure(status, runs.withColumn("tile_id", T.tile("id")), cells, ["id"], ["tile_id"], T.WIDTH, RES * RES, reason)
    return out.select("id", "status", "cells", "area_m2", F.round("plantable_canopy_m2", 2).alias("plantable_canopy_m2"))


# -- simulations ------------------------------------------------------------------------


def drawn_requests(spark, sf_dir):
    """A request for each drawing: canopy to add, and in every third some emissions to remove."""
    k = F.col("id")
    return drawings(spark, sf_dir).select(
        k.alias("scenario_id"), T.tile("id").alias("tile_id"), F.when(k % 50 != 49, "2024-summer").otherwise("2030-summer").alias("window"), "geojson", (0.1 + k % 5 * 0.1).alias("canopy_fraction_added"), F.when(k % 3 == 0, 0.5).otherwise(0.0).alias("emission_fraction_removed")
    )


def simulated_table(spark, sf_dir):
    """Features of all cells, with people and emissions, written once for all simulations."""
    people = T.population(spark, sf_dir).select("row", "col", "population")
    emission = F.when(F.col("landcover") == 80, F.col("elevation_m") / 1e6).otherwise(0.0)
    return raster.checkpointed(feature_table(spark, sf_dir).join(people, ["row", "col"], "left").withColumn("emission", emission))


_REQUESTED = (
    f"{_CUBE}, {_NEAR}, {_LM}, {_DRAWN}, {_GROUPED}, {_AIR}, rq AS (SELECT c_custkey AS id, CASE WHEN c_custkey%50<>49 THEN '2024-summer' ELSE '2030-summer' END AS win, 0.1+(c_custkey%5)*0.1 AS cf, CASE WHEN c_custkey%3=0 THEN 0.5 ELSE 0.0 END AS ef FROM customer), "
    "st AS (SELECT DISTINCT dr.id, CASE WHEN status='ok' AND win<>'2024-summer' THEN 'no window '||win ELSE status END AS status, cf, ef FROM dr JOIN rq USING (id)), "
    "mk AS (SELECT dr.id, dr.\"row\", dr.col, cf, ef FROM dr JOIN st USING (id) WHERE st.status='ok'), tf AS (SELECT median(CASE WHEN landcover=10 THEN ndvi END) AS tn FROM cube), "
    "pl AS (SELECT id, \"row\", col, CASE WHEN landcover NOT IN (80,0) THEN least(cf, 1-least(greatest((ndvi-0.1)/greatest(tn-0.1,1e-6),0),1)) ELSE 0 END AS added, tn-ndvi AS gap FROM mk JOIN cube USING (\"row\",col), tf), "
    "ms AS (SELECT id, \"row\", col, added*gap AS d FROM pl WHERE added>0), nn AS (SELECT nb.\"row\", nb.col, count(*) AS n FROM nb JOIN cube c ON c.\"row\"=nb.nr AND c.col=nb.nc GROUP BY 1,2), "
    "af AS (SELECT DISTINCT id, m.\"row\"+dr AS \"row\", m.col+dc AS col FROM ms m, od), sf AS (SELECT a.id, a.\"row\", a.col, sum(coalesce(m.d,0)) AS s5 FROM af a JOIN nb ON nb.\"row\"=a.\"row\" AND nb.col=a.col LEFT JOIN ms m ON m.id=a.id AND m.\"row\"=nb.nr AND m.col=nb.nc GROUP BY ALL), "
    "rg AS (SELECT DISTINCT id, m.\"row\"+dr AS \"row\", m.col+dc AS col, true AS near FROM ms m, od WHERE abs(dr)+abs(dc)<=2), "
    "fd AS (SELECT sf.id, sf.\"row\", sf.col, lm.s*(coalesce(d,0)+0.5*s5/n) AS delta, d IS NOT NULL AS inside, d IS NULL AND coalesce(near,false) AS ring, population FROM sf JOIN nn USING (\"row\",col) LEFT JOIN ms USING (id,\"row\",col) LEFT JOIN rg USING (id,\"row\",col) LEFT JOIN (SELECT \"row\", col, population FROM people) USING (\"row\",col), lm), "
    "ss AS (SELECT id, count(*) AS n, coalesce(avg(CASE WHEN inside THEN delta END),0) AS mi, coalesce(avg(CASE WHEN ring THEN delta END),0) AS mr, count(CASE WHEN ring THEN 1 END) AS rc, min(delta) AS lo, max(delta) AS hi, sum(CASE WHEN population>0 THEN -delta*population ELSE 0 END) AS net, sum(abs(delta*greatest(population,0))) AS gross, "
    "sum(CASE WHEN population>0 THEN -delta ELSE 0 END) AS ic, sum(CASE WHEN population<=0 THEN -delta ELSE 0 END) AS uc FROM fd GROUP BY 1), "
    "sg AS (SELECT id, sum(-delta*population) AS pd FROM fd JOIN (SELECT \"row\", col, \"group\" FROM grp) USING (\"row\",col) GROUP BY id, \"group\"), sp AS (SELECT id, list_sum(list_reverse_sort(list_concat(list(coalesce(pd/nullif(t,0),0)), list_transform(range(10-count(*)), lambda x: 0.0)))[1:3]) AS top3 FROM (SELECT *, sum(pd) OVER (PARTITION BY id) AS t FROM sg) GROUP BY 1), "
    "pa AS (SELECT mk.id, count(*) AS cells FROM mk GROUP BY 1), pp AS (SELECT id, count(CASE WHEN added>0 THEN 1 END) AS changed, coalesce(avg(CASE WHEN added>0 THEN added END),0) AS a FROM pl GROUP BY 1), "
    "eq AS (SELECT mk.id, mk.\"row\", mk.col, c.landcover, coalesce(CASE WHEN c.landcover=80 THEN elevation_m/1e6 ELSE 0 END,0)*ef AS g FROM mk LEFT JOIN cube c USING (\"row\",col) WHERE ef>0), "
    f"de AS (SELECT id, \"row\"+dr AS \"row\", col+dc AS col, sum(g*w)*1e6 AS c FROM eq, kw WHERE g>0 AND \"row\"+dr BETWEEN 0 AND {_H} AND col+dc BETWEEN 0 AND 49 GROUP BY 1,2,3), "
    "ai AS (SELECT id, CASE WHEN count(landcover)=0 THEN 'no inventory' WHEN sum(g)=0 THEN 'nothing to remove' ELSE 'ok' END AS air, -avg(coalesce(c,0)) AS pm FROM eq LEFT JOIN de USING (id,\"row\",col) GROUP BY 1), am AS (SELECT id, -max(c) AS most FROM de GROUP BY 1), "
    "al AS (SELECT st.id, st.status, st.ef, cells, coalesce(changed,0) AS changed, coalesce(a,0) AS a, coalesce(mi,0) AS mi, coalesce(mr,0) AS mr, coalesce(rc,0) AS rc, coalesce(CASE WHEN n<(SELECT count(*) FROM cube) THEN least(lo,0) ELSE lo END,0) AS lo, coalesce(CASE WHEN n<(SELECT count(*) FROM cube) THEN greatest(hi,0) ELSE hi END,0) AS hi, coalesce(net,0) AS net, "
    "coalesce(net>0 AND net/nullif(gross,0)>=0.2,false) AS reliable, coalesce(CASE WHEN ic+uc>0 THEN uc/(ic+uc) END,0) AS waste, coalesce(top3,0) AS top3, k, air, pm, most, abs(coalesce(mi,0)) AS z FROM st LEFT JOIN pa USING (id) LEFT JOIN pp USING (id) LEFT JOIN ss USING (id) LEFT JOIN sp USING (id) LEFT JOIN ai USING (id) LEFT JOIN am USING (id), lm) "
)


@query(
    f"WITH {_REQUESTED} SELECT id AS scenario_id, status, CASE WHEN status='ok' THEN cells*10000.0 END AS area_m2, CASE WHEN status='ok' THEN changed END AS cells_changed, CASE WHEN status='ok' THEN round(mi,4) END AS mean_inside, CASE WHEN status='ok' THEN round(mr,4) END AS mean_ring, CASE WHEN status='ok' THEN rc END AS ring_cells, "
    "CASE WHEN status='ok' THEN round(lo,4) END AS min_delta, CASE WHEN status='ok' THEN round(hi,4) END AS max_delta, CASE WHEN status='ok' AND k>=1 THEN round(mi/nullif(-a*k,0),4) END AS ratio_to_linear, CASE WHEN status='ok' THEN round(greatest(-mi,0)/2.5,4) END AS expected_cooling, "
    "CASE WHEN status='ok' THEN CASE WHEN mi>=-0.005 THEN 'none' WHEN k<1 THEN CASE WHEN z>=0.1 THEN 'small' ELSE 'marginal' END WHEN z/k>=0.3 THEN 'large' WHEN z/k>=0.15 THEN 'moderate' WHEN z/k>=0.05 THEN 'small' ELSE 'marginal' END END AS impact, CASE WHEN status='ok' THEN round(net,2) END AS person_degrees, CASE WHEN status='ok' THEN round(top3,4) END AS top_three_share, "
    "CASE WHEN status='ok' THEN CASE WHEN NOT reliable THEN 'no-net-effect' WHEN waste>=0.2 THEN 'wasted' WHEN top3>0.5 THEN 'skewed' ELSE 'even' END END AS verdict, CASE WHEN status='ok' THEN CASE WHEN ef=0 THEN 'not asked' ELSE air END END AS air_status, CASE WHEN status='ok' AND air='ok' THEN round(pm,4) END AS pm25_inside, CASE WHEN status='ok' AND air='ok' THEN round(most,4) END AS pm25_strongest FROM al"
)
def drawn_scenarios(spark, sf_dir):
    """Every drawing simulated in one plan, by the model that SQL can fit."""
    table = simulated_table(spark, sf_dir)
    line = features.linear(table, KEYS, greenness(table))
    predict = simulate.by_line(line, KEYS, lambda s: F.col(f"ndvi{s}") + 0.5 * F.col(f"ndvi_near{s}"))
    air = kernel.seasonal_kernel(parameters(spark, sf_dir), ["tile_id"], _RES)
    out = simulate.run(drawn_requests(spark, sf_dir), _grid(spark, sf_dir), table, predict, KEYS, air)
    rounded = [r4(c) for c in ("mean_inside", "mean_ring", "min_delta", "max_delta", "ratio_to_linear", "expected_cooling", "top_three_share", "pm25_inside", "pm25_strongest")]
    return out.select("scenario_id", "status", "area_m2", "cells_changed", "ring_cells", "impact", F.round("person_degrees", 2).alias("person_degrees"), "verdict", "air_status", *rounded)


#: Trees of the registered simulations: small ones, as they are fitted in each call.
ROUNDS, DEPTH = 5, 4


@query()
def run_scenarios(spark, sf_dir):
    """The same by boosted trees on all features (no SQL form)."""
    table = simulated_table(spark, sf_dir)
    model = features.train(features.packed(features.training_frame(table)), rounds=ROUNDS, depth=DEPTH)
    air = kernel.seasonal_kernel(parameters(spark, sf_dir), ["tile_id"], _RES)
    return simulate.run(drawn_requests(spark, sf_dir), _grid(spark, sf_dir), table, simulate.by_trees(model), KEYS, air)
