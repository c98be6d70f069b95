"""Drawn polygons on a grid: are they valid, which runs of cells they cover, what lies there.

A geometry is one row of at most ``geojson.MAX_VERTICES`` positions.  It never becomes
a set of cells before it has to: a polygon is (row, first col, last col) runs, and what
it holds is a difference of two running sums for each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geojson
from tessera.functions.grid import Grid, forward
from tessera.operators.raster import checkpointed, dealt, polygon_spans

#: Buckets along each side of a geometry's box, at most.
BUCKETS = 128
#: Share of a bucket by which an edge also counts for the next one.
SLACK = 1e-6


def closed(ring: Column) -> Column:
    return F.when((ring[0]["x"] == F.element_at(ring, -1)["x"]) & (ring[0]["y"] == F.element_at(ring, -1)["y"]), ring).otherwise(F.concat(ring, F.array(ring[0])))


def readable(parts: Column) -> Column:
    """Every part has a ring, every ring four positions once it is closed, every position two finite numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = lambda r: (F.size(closed(r)) >= 4) & F.forall(r, lambda p: number(p["x"]) & number(p["y"]))
    return F.coalesce(F.forall(parts, lambda rings: rings.isNotNull() & (F.size(rings) > 0) & F.forall(rings, fine)), F.lit(False))


def edges(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, ring, nth, of, x0, y0, x1, y1, box) of each edge of ``parts`` with a length;
    ``of`` is the number of edges of its ring."""
    flat = F.flatten(F.flatten("parts"))
    axis = lambda pick, c: pick(F.transform(flat, lambda p: p[c]))
    side = F.least(F.greatest(F.ceil(F.sqrt(F.size(flat))), F.lit(1)), F.lit(BUCKETS))
    sides = {"x": axis(F.array_min, "x"), "y": axis(F.array_min, "y"), "x1": axis(F.array_max, "x"), "y1": axis(F.array_max, "y"), "k": side.cast("double")}
    box = F.named_struct(*[c for name, side in sides.items() for c in (F.lit(name), side)])
    rings = table.select(*keys, box.alias("box"), F.posexplode("parts").alias("part", "_rings")).select(*keys, "box", "part", F.posexplode("_rings").alias("ring", "_p"))
    # positions that repeat the one before have no edge
    points = closed(F.col("_p"))
    moved = F.filter(points, lambda p, i: (i == 0) | (p["x"] != F.element_at(points, F.greatest(i, F.lit(1)))["x"]) | (p["y"] != F.element_at(points, F.greatest(i, F.lit(1)))["y"]))
    rings = rings.withColumn("_p", moved).withColumn("of", F.size("_p") - 1).where("of > 0")
    each = rings.select(*keys, "box", "part", "ring", "of", F.posexplode(F.transform(F.slice("_p", 1, F.col("of")), lambda p, i: F.struct(p.alias("a"), F.col("_p")[i + 1].alias("b")))).alias("nth", "e"))
    return each.select(*keys, "part", "ring", "nth", "of", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"), "box")


def _bucket(value: Column, low: Column, high: Column, k: Column, slack: float) -> Column:
    """Bucket of a coordinate, moved by a share of a bucket, inside the box."""
    return F.least(F.greatest(F.floor(F.coalesce(F.try_divide((value - low) * k, high - low), F.lit(0.0)) + slack), F.lit(0)), k.cast("long") - 1)


def bucketed(e: DataFrame) -> DataFrame:
    """Edges in every bucket (bx, by) that they pass: at most two for each column and row they cross."""
    b = F.col("box")
    first, last = (_bucket(c, b["x"], b["x1"], b["k"], s) for c, s in ((F.least("x0", "x1"), -SLACK), (F.greatest("x0", "x1"), SLACK)))
    columns = e.withColumn("bx", F.explode(F.sequence(first, last)))
    wide = (b["x1"] - b["x"]) / b["k"]
    at = lambda x: F.coalesce(F.col("y0") + F.try_divide((x - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("x1") - F.col("x0")), F.col("y0"))
    inside = lambda y: F.least(F.greatest(y, F.least("y0", "y1")), F.greatest("y0", "y1"))
    upright = F.abs(F.col("x1") - F.col("x0")) < wide * SLACK
    left, right = inside(at(b["x"] + (F.col("bx") - SLACK) * wide)), inside(at(b["x"] + (F.col("bx") + 1 + SLACK) * wide))
    low = F.when(upright, F.least("y0", "y1")).otherwise(F.least(left, right))
    high = F.when(upright, F.greatest("y0", "y1")).otherwise(F.greatest(left, right))
    return columns.withColumn("by", F.explode(F.sequence(_bucket(low, b["y"], b["y1"], b["k"], -SLACK), _bucket(high, b["y"], b["y1"], b["k"], SLACK))))


def _turn(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.signum((ax - ox) * (by - oy) - (ay - oy) * (bx - ox))


def crossing(e: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of geometries of which two edges meet where they must not.

    Edges of one ring may share only the position between neighbours; edges of two
    rings may touch, but neither cross nor run along each other.  Pairs are tested
    inside a bucket only; a bucket holds no more than a geometry's edges.
    """
    cell = [*keys, "bx", "by"]
    own = bucketed(e).select(*cell, F.struct("part", "ring", "nth").alias("edge"), "of", "x0", "y0", "x1", "y1")
    other = own.select(*cell, *[F.col(c).alias(f"{c}_") for c in ("edge", "of", "x0", "y0", "x1", "y1")])
    pair = own.join(dealt(other), cell).where(F.col("edge") < F.col("edge_"))
    a, b, c, d = ((F.col(f"x{k}{s}"), F.col(f"y{k}{s}")) for s in ("", "_") for k in (0, 1))
    turns = {"t1": _turn(*a, *b, *c), "t2": _turn(*a, *b, *d), "t3": _turn(*c, *d, *a), "t4": _turn(*c, *d, *b)}
    within = lambda p, q, r: r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    touch = F.lit(False)
    for t, (p, q, r) in zip(turns, ((a, b, c), (a, b, d), (c, d, a), (c, d, b)), strict=True):
        touch = touch | ((F.col(t) == 0) & within(p, q, r))
    cross = (F.col("t1") * F.col("t2") < 0) & (F.col("t3") * F.col("t4") < 0)
    span = lambda k: F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])) - F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k]))
    along = (F.col("t1") == 0) & (F.col("t2") == 0) & (span(0) >= 0) & (span(1) >= 0) & (span(0) + span(1) > 0)
    same = (F.col("edge.part") == F.col("edge_.part")) & (F.col("edge.ring") == F.col("edge_.ring"))
    apart = F.col("edge_.nth") - F.col("edge.nth")
    neighbours = (apart == 1) | (apart == F.col("of") - 1)
    bad = F.when(same & neighbours, along).when(same, cross | touch).otherwise(cross | along)
    return pair.withColumns(turns).where(bad).select(*keys).distinct()


def misplaced(e: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of geometries with a hole that is not directly inside its shell, or a part inside another.

    Of each ring the middle of its longest edge is looked up among the edges of the
    same geometry in the same band of y.
    """
    b = F.col("box")
    band = lambda y, slack: _bucket(y, b["y"], b["y1"], b["k"], slack)
    ring = [*keys, "part", "ring"]
    length = (F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2
    middle = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    probes = e.groupBy(*ring).agg(F.max_by(middle, F.struct(length, -F.col("nth"))).alias("p"), F.first("box").alias("box"))
    several = probes.groupBy(*keys).count().where("count > 1").select(*keys)
    probes = probes.join(dealt(several), keys, "left_semi").withColumn("by", band(F.col("p.y"), 0.0)).drop("box")
    crossed = e.where("y0 <> y1").withColumn("by", F.explode(F.sequence(band(F.least("y0", "y1"), -SLACK), band(F.greatest("y0", "y1"), SLACK))))
    crossed = crossed.select(*keys, "by", F.col("part").alias("part_"), F.col("ring").alias("ring_"), "x0", "y0", "x1", "y1")
    py, px = F.col("p.y"), F.col("p.x")
    passes = ((F.col("y0") > py) != (F.col("y1") > py)) & (px < F.col("x0") + (py - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    hits = probes.join(dealt(crossed), [*keys, "by"]).where(((F.col("part") != F.col("part_")) | (F.col("ring") != F.col("ring_"))) & passes)
    around = hits.groupBy(*ring, "part_", "ring_").count().where("count % 2 = 1").groupBy(*ring, "part_").agg(F.count("*").alias("n"))
    other = around.where((F.col("part_") != F.col("part")) & (F.col("n") % 2 == 1)).select(*keys)
    in_own = around.where(F.col("part_") == F.col("part")).select(*ring, "n")
    wrong = probes.select(*ring).join(dealt(in_own), ring, "left").where(F.coalesce("n", F.lit(0)) != F.when(F.col("ring") > 0, 1).otherwise(0)).select(*keys)
    return other.unionByName(wrong).distinct()


def checked(table: DataFrame, keys: list[str], text: str = "geojson") -> DataFrame:
    """(keys, parts, vertices, status) of each row, ``keys`` being unique.

    Status is ok, a detail of :func:`geojson.polygons`, unreadable (rings of fewer than
    four positions, coordinates that are no numbers) or invalid.  Two things that a
    full test of validity refuses are let through: a ring that passes from one side of
    another to the other exactly at a position, and an interior that touching rings cut in two.
    """
    read = geojson.polygons(table, text).withColumn("status", F.coalesce("detail", F.when(~readable(F.col("parts")), "unreadable")))
    read = checkpointed(read.select(*keys, "parts", "vertices", "status"))
    e = checkpointed(edges(read.where("status IS NULL"), keys))
    flat = e.groupBy(*keys, "part", "ring").agg(F.max("of").alias("of")).where("of < 3").select(*keys)
    invalid = crossing(e, keys).unionByName(misplaced(e, keys)).unionByName(flat).distinct().withColumn("_bad", F.lit("invalid"))
    return read.join(dealt(invalid), keys, "left").withColumn("status", F.coalesce("status", "_bad", F.lit("ok"))).drop("_bad")


def masks(table: DataFrame, keys: list[str], grid: Grid, text: str = "geojson") -> tuple[DataFrame, DataFrame]:
    """(keys, vertices, status) of each drawn geometry, and the runs (keys, row, c0, c1)
    of cells whose centre lies in one that is ok.

    Positions are WGS84 degrees; edges are straight between projected positions.  A
    geometry without a cell has the status ``no cells`` and no runs: it is refused, as a
    mask of nothing would look like an answer of zero.
    """
    told = checked(table, keys, text)

    def metres(p: Column) -> Column:
        x, y = forward(p["x"], p["y"], grid.zone)
        return F.struct(x.alias("x"), y.alias("y"))

    fine = told.where("status = 'ok'").select(*keys, F.explode(F.flatten("parts")).alias("points")).withColumn("points", F.transform("points", metres))
    runs = checkpointed(polygon_spans(fine, keys, grid))
    found = runs.select(*keys).distinct().withColumn("_any", F.lit(True))
    status = F.when((F.col("status") == "ok") & F.col("_any").isNull(), "no cells").otherwise(F.col("status"))
    return told.join(dealt(found), keys, "left").select(*keys, "vertices", status.alias("status")), runs


def cells_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs as cells, where a later step needs each of them."""
    return runs.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def running_sums(cells: DataFrame, keys: list[str], values: list[str], width: int) -> DataFrame:
    """(keys, row, col, values) with sums of the row up to and including each col, from
    col -1 (zero) to the last; missing cells and values add nothing."""
    line = [*keys, "row"]
    every = cells.select(*line).distinct().withColumn("col", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(width - 1).cast("long"))))
    upto = Window.partitionBy(*line).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(dealt(cells.select(*line, "col", *values)), [*line, "col"], "left")
    return full.select(*line, "col", *[F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).over(upto).alias(v) for v in values])


def totals(runs: DataFrame, sums: DataFrame, keys: list[str], on: list[str], values: list[str]) -> DataFrame:
    """Sums of ``values`` over the cells of each geometry's runs: the running sum at the
    end of a run less the one before its start.  Two rows for each row of cells that a
    geometry crosses, however wide it is.  ``on`` are the keys that cells have, too."""
    ends = F.array(F.struct(F.col("c1").alias("col"), F.lit(1.0).alias("sign")), F.struct((F.col("c0") - 1).alias("col"), F.lit(-1.0).alias("sign")))
    each = runs.select(*dict.fromkeys([*keys, *on]), "row", F.explode(ends).alias("e")).select("*", "e.col", "e.sign").drop("e")
    return each.join(dealt(sums), [*on, "row", "col"]).groupBy(*keys).agg(*[F.sum(F.col("sign") * F.col(v)).alias(v) for v in values])


def measure(status: DataFrame, runs: DataFrame, cells: DataFrame, keys: list[str], on: list[str], width: int, cell_m2: float, reason: DataFrame | None = None) -> DataFrame:
    """(keys, status, cells, area_m2, plantable_canopy_m2) of each geometry.

    ``cells`` has ``headroom``, the share of a cell that can still be planted.  ``reason``
    (on, reason) holds why a tile can't be measured, null where it can.  Figures of refused geometries are null.
    """
    sums = running_sums(cells.withColumn("cells", F.lit(1.0)), on, ["cells", "headroom"], width)
    got = totals(runs, sums, keys, on, ["cells", "headroom"])
    out = status.join(dealt(got), keys, "left").withColumn("cells", F.round("cells").cast("long"))
    if reason is not None:
        tiles = runs.select(*dict.fromkeys([*keys, *on])).distinct().join(reason, on).where("reason IS NOT NULL").groupBy(*keys).agg(F.min("reason").alias("reason"))
        out = out.join(dealt(tiles), keys, "left").withColumn("status", F.when((F.col("status") == "ok") & F.col("reason").isNotNull(), F.col("reason")).otherwise(F.col("status"))).drop("reason")
    fine = F.col("status") == "ok"
    kept = {"cells": F.col("cells"), "area_m2": F.col("cells") * cell_m2, "plantable_canopy_m2": F.greatest(F.col("headroom"), F.lit(0.0)) * cell_m2}
    return out.select(*keys, "status", *[F.when(fine, c).alias(n) for n, c in kept.items()])
