"""Roads and point sources: emission factors, sampling along lines, binning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vehicles a day by class, share on link roads, grams per vehicle and km.
VEHICLES = {"motorway": 60_000.0, "trunk": 40_000.0, "primary": 25_000.0, "secondary": 12_000.0, "tertiary": 6_000.0, "residential": 1_200.0}
LINK_SHARE, GRAMS_PER_KM, DAY_S, KILN_G_S, SPACING_M = 0.3, 0.10, 86_400.0, 1.0, 50.0
#: Segments that a task looks at together, and starts and ends that it holds before it sends them.
SEGMENTS, KEPT = 20_000, 4_000_000
KILN_TAGS = (("man_made", "kiln"), ("industrial", "brick_kiln"), ("product", "brick"), ("product", "bricks"))


def road_factor(highway: Column) -> Column:
    """Grams per second and metre of a road class; 0 for anything else."""
    base = F.regexp_replace(highway, "_link$", "")
    per_day = F.coalesce(*[F.when(base == k, v) for k, v in VEHICLES.items()], F.lit(0.0))
    return per_day * F.when(highway.endswith("_link"), LINK_SHARE).otherwise(1.0) * GRAMS_PER_KM / DAY_S / 1000.0


def is_kiln(tags: Column) -> Column:
    hit = F.lit(False)
    for k, v in KILN_TAGS:
        hit = hit | F.coalesce(tags[k] == v, F.lit(False))
    return hit


def element_points(elements: DataFrame) -> DataFrame:
    """Vertices of an element however it is given: a list, a point, or a box's centre."""
    b = F.col("bounds")
    point = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.array(F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))))
    centre = F.when(b.isNotNull(), F.array(F.struct(((b["minlon"] + b["maxlon"]) / 2).alias("lon"), ((b["minlat"] + b["maxlat"]) / 2).alias("lat"))))
    return elements.withColumn("points", F.coalesce("geometry", point, centre))


def stretches(vertices: DataFrame, way: str = "way_id", spacing: float = SPACING_M) -> DataFrame:
    """Segments of each way of ``vertices(way_id, nth, x, y)`` with the samples k0 to k1 that fall into
    them, of the ``n`` equally weighted ones of the way, about ``spacing`` apart at the middle of equal
    lengths (``step``); ways without length and segments without a sample have no row.

    Counts come from here: what a segment holds is a number, however long it is."""
    w = Window.partitionBy(way).orderBy("nth", "x", "y")
    seg = vertices.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 IS NOT NULL").withColumn("len", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")))
    run = seg.withColumn("upto", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("len").over(Window.partitionBy(way)))
    # where a segment begins is exactly where the one before ends, so no sample falls into both
    run = run.withColumn("from", F.coalesce(F.lag("upto").over(w), F.lit(0.0))).where("total > 0 AND len > 0")
    n = F.greatest(F.bround(F.col("total") / spacing), F.lit(1.0))
    placed = run.withColumn("n", n).withColumn("step", F.col("total") / F.col("n"))
    last = F.col("upto") == F.max("upto").over(Window.partitionBy(way))
    k0 = F.ceil(F.col("from") / F.col("step") - 0.5)
    k1 = F.when(last, F.col("n") - 1).otherwise(F.ceil(F.col("upto") / F.col("step") - 0.5) - 1).cast("long")
    return placed.withColumn("k0", F.greatest(k0, F.lit(0))).withColumn("k1", F.least(k1, (F.col("n") - 1).cast("long"))).where("k0 <= k1")


def sampled(stretch: DataFrame, way: str = "way_id") -> DataFrame:
    """(way_id, n_samples, length) of each way: its samples, counted by segment."""
    return stretch.groupBy(way).agg(F.sum(F.col("k1") - F.col("k0") + 1).alias("n_samples"), F.max("total").alias("length"))


def densify(vertices: DataFrame, way: str = "way_id", spacing: float = SPACING_M) -> DataFrame:
    """The samples of :func:`stretches` themselves, a row for each."""
    samples = stretches(vertices, way, spacing).withColumn("k", F.explode(F.sequence("k0", "k1")))
    t = ((F.col("k") + 0.5) * F.col("step") - F.col("from")) / F.col("len")
    return samples.select(way, "k", F.col("n").cast("long").alias("n_samples"), F.col("total").alias("length"), (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("sx"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("sy"))


def emission_cells(samples: DataFrame, points: DataFrame, grid, per_metre: str = "per_m") -> DataFrame:
    """Grams per second of each cell: ways spread over their samples, points whole.
    Points on the far edges fall into the last cells; others outside are dropped."""
    row, col = grid.cell_of(F.col("sx"), F.col("sy"), closed_last=True)
    lines = samples.select(row.alias("row"), col.alias("col"), (F.col(per_metre) * F.col("length") / F.col("n_samples")).alias("g"))
    row, col = grid.cell_of(F.col("x"), F.col("y"), closed_last=True)
    stacks = points.select(row.alias("row"), col.alias("col"), F.lit(KILN_G_S).alias("g"))
    return lines.unionByName(stacks).where("row IS NOT NULL").groupBy("row", "col").agg(F.sum("g").alias("emission"))


def stretch_cells(stretch: DataFrame, points: DataFrame, grid, per_metre: str = "per_m") -> DataFrame:
    """:func:`emission_cells` from stretches, without a row for each sample.

    A stretch falls into at most ``grid.width`` runs of samples within a column.  Samples of a run
    are as far apart as each other, so nearly all rows that it crosses hold equally many: a run is split in
    halves until both have equal counts, and each part adds a start and an end to its column.
    Running sums down the columns, with whole numbers beside them for cells without samples, give the cells.
    """
    at = ["x", "y", "x1", "y1", "from", "len", "step", "k0", "k1", "g"]
    seg = stretch.withColumn("g", F.col(per_metre) * F.col("total") / F.col("n")).select(*[F.col(c).cast("long" if c in ("k0", "k1") else "double").alias(c) for c in at])
    ends = seg.mapInArrow(lambda batches: _ends(batches, grid), "up long, col long, n long, g double").groupBy("up", "col").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    down = Window.partitionBy("col").orderBy("up")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    held = ends.select("up", "col", F.sum("n").over(upto).alias("n"), F.sum("g").over(upto).alias("g"), F.lead("up").over(down).alias("_next")).where("n > 0")
    lines = held.select(F.explode(F.sequence("up", F.col("_next") - 1)).alias("up"), "col", "g").select((grid.height - 1 - F.col("up")).alias("row"), "col", "g")
    row, col = grid.cell_of(F.col("x"), F.col("y"), closed_last=True)
    stacks = points.select(row.alias("row"), col.alias("col"), F.lit(KILN_G_S).alias("g"))
    return lines.unionByName(stacks).where("row IS NOT NULL").groupBy("row", "col").agg(F.sum("g").alias("emission"))


def _ends(batches: Iterator[pa.RecordBatch], grid) -> Iterator[pa.RecordBatch]:
    """(up, col, n, g): where samples per row of a column begin (or end, with the opposite sign), up counted from the bottom."""
    keys, counts, grams, size = [], [], [], 0

    def merged():
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, inverse, np.concatenate(counts))
        return key, n, np.bincount(inverse, np.concatenate(grams), len(key))

    def batch(key, n, g):
        return pa.RecordBatch.from_arrays([pa.array(key // grid.width), pa.array(key % grid.width), pa.array(n), pa.array(g)], ["up", "col", "n", "g"])

    for b in batches:
        cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)}
        for i in range(0, b.num_rows, SEGMENTS):
            for up, col, n, g in _runs({c: v[i : i + SEGMENTS] for c, v in cols.items()}, grid):
                keys.append(up * grid.width + col)
                counts.append(n)
                grams.append(g)
                size += len(up)
        if size > KEPT:
            key, n, g = merged()
            keys, counts, grams, size = [key], [n], [g], len(key)
            if size > KEPT // 2:
                yield batch(key, n, g)
                keys, counts, grams, size = [], [], [], 0
    if size:
        yield batch(*merged())


def _runs(s: dict[str, np.ndarray], grid) -> Iterator[tuple[np.ndarray, ...]]:
    def coordinate(i, k, vertical):
        """Line of cells of sample k of segment i, by the arithmetic of ``densify`` and ``Grid.cell_of``."""
        a, b = (s["y"], s["y1"]) if vertical else (s["x"], s["x1"])
        v = a[i] + ((k + 0.5) * s["step"][i] - s["from"][i]) / s["len"][i] * (b[i] - a[i])
        low, far, last = (grid.top - grid.height * grid.res, grid.top, grid.height) if vertical else (grid.left, grid.left + grid.width * grid.res, grid.width)
        return np.where(v == far, last - 1, np.floor((v - low) / grid.res)).astype(np.int64)

    def first_at(i, lo, hi, target, sign, vertical):
        """Smallest k of lo..hi whose line is at or beyond ``target`` in the direction ``sign``; hi if none is."""
        a, b = (s["y"], s["y1"]) if vertical else (s["x"], s["x1"])
        low = grid.top - grid.height * grid.res if vertical else grid.left
        edge = low + (target + (sign < 0)) * grid.res
        d = np.where(b[i] == a[i], 1.0, b[i] - a[i])
        k = np.clip(np.ceil(((edge - a[i]) / d * s["len"][i] + s["from"][i]) / s["step"][i] - 0.5), lo, hi).astype(np.int64)
        beyond = lambda q, j: coordinate(i[j], q, vertical) * sign[j] >= target[j] * sign[j]
        every = np.arange(len(k))
        j = every[k > lo]
        while len(j):  # a guess is off by the last bits at most
            j = j[beyond(k[j] - 1, j)]
            k[j] -= 1
            j = j[k[j] > lo[j]]
        j = every[k < hi]
        while len(j):
            j = j[~beyond(k[j], j)]
            k[j] += 1
            j = j[k[j] < hi[j]]
        return k

    def spread(counts):
        """0, 1, ... within each of ``counts``, and which of them it is."""
        which = np.repeat(np.arange(len(counts)), counts)
        return np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts), which

    i = np.arange(len(s["k0"]))
    lo, hi = s["k0"], s["k1"] + 1
    c0, c1 = coordinate(i, lo, False), coordinate(i, hi - 1, False)
    nth, i = spread(np.abs(c1 - c0) + 1)
    sign = np.where(c1 < c0, -1, 1)[i]
    col = c0[i] + sign * nth
    a = np.where(nth == 0, lo[i], first_at(i, lo[i], hi[i], col, sign, False))
    # a run ends where the next of its segment begins
    b = np.where(np.append(i[1:] == i[:-1], False), np.append(a[1:], 0), hi[i])
    keep = (a < b) & (col >= 0) & (col < grid.width)
    i, col, a, b = i[keep], col[keep], a[keep], b[keep]
    r0, r1 = coordinate(i, a, True), coordinate(i, b - 1, True)
    sign = np.where(r1 < r0, -1, 1)
    # lines p..q - 1 along the run, which hold samples a..b - 1: first line, those between, last line
    p, q = np.zeros(len(i), np.int64), np.abs(r1 - r0) + 1
    level = [(np.arange(len(i)), p, q, a, b)]
    many = np.flatnonzero(q > 2)
    if len(many):
        ka = first_at(i[many], a[many], b[many], r0[many] + sign[many], sign[many], True)
        kb = first_at(i[many], a[many], b[many], r1[many], sign[many], True)
        one = np.flatnonzero(q <= 2)
        level = [(one, p[one], q[one], a[one], b[one]), (many, p[many], p[many] + 1, a[many], ka), (many, q[many] - 1, q[many], kb, b[many]), (many, p[many] + 1, q[many] - 1, ka, kb)]
    run, p, q, a, b = (np.concatenate(x) for x in zip(*level, strict=True))
    steady = np.zeros(len(run), bool)
    while len(run):
        lines, n = q - p, b - a
        done = (lines == 1) | steady | (n == 0)
        if done.any():
            j = np.flatnonzero(done & (n > 0))
            first = r0[run[j]] + sign[run[j]] * p[j]
            other = r0[run[j]] + sign[run[j]] * (q[j] - 1)
            bottom, top = np.maximum(np.minimum(first, other), 0), np.minimum(np.maximum(first, other) + 1, grid.height)
            here = bottom < top
            each, at, g = (n[j] // lines[j])[here], col[run[j]][here], s["g"][i[run[j]]][here]
            yield bottom[here], at, each, each * g
            yield top[here], at, -each, -each * g
        j = np.flatnonzero(~done)
        run, p, q, a, b = run[j], p[j], q[j], a[j], b[j]
        mid = (p + q) // 2
        k = first_at(i[run], a, b, r0[run] + sign[run] * mid, sign[run], True)
        # equally far apart: halves with one count per line hold it in each of their lines
        even = lambda n, lines: n % lines == 0
        same = even(k - a, mid - p) & even(b - k, q - mid) & ((k - a) // (mid - p) == (b - k) // (q - mid))
        run, p, q, a, b = np.concatenate([run, run]), np.concatenate([p, mid]), np.concatenate([mid, q]), np.concatenate([a, k]), np.concatenate([k, b])
        steady = np.concatenate([same, same])
