"""GeoJSON text to rings, with refusals as reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_VERTICES = 10_000
#: Features and collections that may lie around a geometry.
MAX_DEPTH = 4
POLYGON, MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def part(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def unwrapped(table: DataFrame, text: str) -> DataFrame:
    """``table`` with ``_g``, the geometry inside Features and collections of one feature, and
    ``_r``, why there is none.  A column for each layer: one nested expression would hold copies of copies of the text."""
    out = table.withColumn("_g", F.col(text)).withColumn("_r", F.lit(None).cast("string"))
    kind = part(F.col("_g"), "$.type")
    for depth in range(MAX_DEPTH + 1):
        out = out.withColumn("_k", kind)
        many = (F.col("_k") == "FeatureCollection") & (part(F.col("_g"), "$.features[0]").isNull() | part(F.col("_g"), "$.features[1]").isNotNull())
        bare = (F.col("_k") == "Feature") & part(F.col("_g"), "$.geometry.type").isNull()
        out = out.withColumn("_r", F.coalesce("_r", F.when(F.col("_k").isNull(), "not a polygon").when(many, "not one feature").when(bare, "no geometry")))
        if depth < MAX_DEPTH:
            out = out.withColumn("_g", F.when(F.col("_k") == "Feature", part(F.col("_g"), "$.geometry")).when(F.col("_k") == "FeatureCollection", part(F.col("_g"), "$.features[0]")).otherwise(F.col("_g")))
    last = F.when(F.col("_k").isin("Feature", "FeatureCollection"), "nested too deep").when(~F.col("_k").isin("Polygon", "MultiPolygon"), "not a polygon")
    return out.withColumn("_r", F.coalesce("_r", last)).withColumn("_g", F.when(F.col("_r").isNull(), F.col("_g")))


def polygons(table: DataFrame, text: str = "geojson", most: int = MAX_VERTICES) -> DataFrame:
    """``table`` with ``parts`` (polygons of rings of x, y), ``rings`` (of all parts), ``vertices``
    and ``reason``: not a polygon, no vertices, or too many; ``detail`` says why there is no
    polygon: not one feature, no geometry, nested too deep.  A polygon is a multipolygon of one part."""
    coords, kind = part(F.col("_g"), "$.coordinates"), F.col("_k")
    nested = F.when(kind == "Polygon", F.array(F.from_json(coords, POLYGON))).when(kind == "MultiPolygon", F.from_json(coords, MULTI))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, point)
    out = unwrapped(table, text).withColumn("parts", F.transform(nested, lambda rings: F.transform(rings, ring))).withColumn("rings", F.flatten("parts"))
    count = F.coalesce(F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r)), F.lit(0))
    reason = F.when(F.col("rings").isNull(), "not a polygon").when(count == 0, "no vertices").when(count > most, "too many vertices")
    return out.withColumn("vertices", count).withColumn("reason", reason).withColumn("detail", F.coalesce("_r", reason)).drop("_g", "_r", "_k")
