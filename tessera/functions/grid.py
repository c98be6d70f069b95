"""Metric grids and the transverse Mercator projection, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: WGS84 and UTM constants.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the sixth-order forward and inverse series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, alpha, beta


RADIUS, ALPHA, BETA = _series()
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def forward(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of WGS84 degrees."""
    lam = F.radians(lon - central_meridian(zone))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """WGS84 degrees of easting and northing."""
    xi, eta = north / (SCALE * RADIUS), (east - FALSE_EASTING) / (SCALE * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    tau = F.sin(p) / F.sqrt(F.sinh(q) ** 2 + F.cos(p) ** 2)
    lam = F.atan2(F.sinh(q), F.cos(p))
    # geodetic latitude from the conformal one: the fixed point is reached to 1e-15 in five steps
    psi = F.asinh(tau)
    phi = F.atan(tau)
    for _ in range(5):
        phi = F.asin(F.tanh(psi + ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi))))
    return F.degrees(lam) + central_meridian(zone), F.degrees(phi)


@dataclass(frozen=True)
class Grid:
    """A north-up grid: x ascends with col, y descends with row; cells are squares."""

    left: float
    top: float
    res: float
    height: int
    width: int
    zone: int = 43

    @staticmethod
    def around(west: float, south: float, east: float, north: float, res: float = 100.0, zone: int = 43) -> Grid:
        """The whole cells that cover the projected corners of a box."""
        corners = [_project(x, y, zone) for x in (west, east) for y in (south, north)]
        xs, ys = zip(*corners, strict=True)
        left, bottom = (math.floor(min(v) / res) * res for v in (xs, ys))
        right, top = (math.ceil(max(v) / res) * res for v in (xs, ys))
        return Grid(left, top, res, round((top - bottom) / res), round((right - left) / res), zone)

    def x(self, col: Column) -> Column:
        return self.left + (col + 0.5) * self.res

    def y(self, row: Column) -> Column:
        return self.top - (row + 0.5) * self.res

    def cells(self, spark: SparkSession) -> DataFrame:
        ids = spark.range(self.height * self.width)
        return ids.select(F.floor(F.col("id") / self.width).alias("row"), (F.col("id") % self.width).alias("col"))

    def cell_of(self, x: Column, y: Column, closed_last: bool = False) -> tuple[Column, Column]:
        """Row and col of a point, null outside.  ``closed_last`` puts points on the
        far edges (right, top) into the last cells, as a histogram does."""
        col, up = F.floor((x - self.left) / self.res), F.floor((y - (self.top - self.height * self.res)) / self.res)
        row = F.floor((self.top - y) / self.res)
        if closed_last:
            col = F.when(x == self.left + self.width * self.res, self.width - 1).otherwise(col)
            up = F.when(y == self.top, self.height - 1).otherwise(up)
            row = self.height - 1 - up
        inside = col.between(0, self.width - 1) & row.between(0, self.height - 1)
        return F.when(inside, row), F.when(inside, col)


def _project(lon: float, lat: float, zone: int) -> tuple[float, float]:
    lam, s = math.radians(lon - central_meridian(zone)), math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - ECCENTRICITY * math.atanh(ECCENTRICITY * s))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def disc(points: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Cells of ``points(id, x, y)`` whose centre is within ``radius``."""
    k = math.ceil(radius / grid.res) + 1
    near = points.withColumn("r0", F.floor((grid.top - F.col("y")) / grid.res)).withColumn("c0", F.floor((F.col("x") - grid.left) / grid.res))
    cells = near.withColumn("row", F.explode(F.sequence(F.col("r0") - k, F.col("r0") + k))).withColumn("col", F.explode(F.sequence(F.col("c0") - k, F.col("c0") + k)))
    d2 = (grid.x(F.col("col")) - F.col("x")) ** 2 + (grid.y(F.col("row")) - F.col("y")) ** 2
    return cells.where((d2 <= radius * radius) & F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).select("id", "row", "col")


def edge_longitude(col: Column, west: float, east: float, width: int) -> Column:
    """Longitude of a column's left edge, kept inside the box."""
    return F.least(F.greatest(west + col * (east - west) / width, F.lit(west)), F.lit(east))


def edge_column(lon: Column, west: float, east: float, width: int) -> Column:
    """Column whose edge is nearest to a longitude, kept inside the box."""
    return F.least(F.greatest(F.floor((lon - west) * width / (east - west) + 0.5), F.lit(0)), F.lit(width)).cast("long")


def bounds(blocks: DataFrame, grid: Grid) -> DataFrame:
    """``blocks`` (row0, row1, col0, col1) with west, south, east and north: the
    envelope of the four corners in degrees, as straight edges of a grid are curved there."""
    ring = blocks.withColumn("_ring", block_ring(F.col("row0"), F.col("row1"), F.col("col0"), F.col("col1"), grid))
    of = lambda pick, name: pick(F.transform("_ring", lambda p: p[name]))
    return ring.withColumns({"west": of(F.array_min, "lon"), "south": of(F.array_min, "lat"), "east": of(F.array_max, "lon"), "north": of(F.array_max, "lat")}).drop("_ring")


def block_ring(row0: Column, row1: Column, col0: Column, col1: Column, grid: Grid) -> Column:
    """Closed ring of a block's corners in WGS84 degrees."""
    corner = lambda row, col: F.struct((grid.left + col * grid.res).alias("x"), (grid.top - row * grid.res).alias("y"))

    def degrees(p: Column) -> Column:
        lon, lat = inverse(p["x"], p["y"], grid.zone)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    # one copy of the series for all corners: five would outgrow a generated method
    return F.transform(F.array(corner(row1, col0), corner(row1, col1), corner(row0, col1), corner(row0, col0), corner(row1, col0)), degrees)
