"""Labels, conversions and judgements that are one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
OVERPREDICTION = 2.5
TREE_CANOPY_M2 = 25.0
MIN_CONTRAST = 1.0
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def corrected_cooling(delta: Column) -> Column:
    """Null stays null: greatest would skip it."""
    return F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)) / OVERPREDICTION)


def impact(expected: Column, contrast: Column) -> Column:
    size = F.abs(expected)
    share = F.try_divide(size, contrast)
    flat = F.when(size >= 0.10, "small").otherwise("marginal")
    steep = F.when(share >= 0.30, "large").when(share >= 0.15, "moderate").when(share >= 0.05, "small").otherwise("marginal")
    return F.when(expected >= -0.005, "none").when(contrast < MIN_CONTRAST, flat).otherwise(steep)


def confidence(planted: Column, air: Column, season: Column) -> Column:
    return F.when(~planted | (air & (season != "winter")), "low").otherwise("moderate")


def equity_verdict(reliable: Column, uninhabited: Column, top_three: Column) -> Column:
    """No net effect, wasted on empty land, skewed to a few groups, or even."""
    return F.when(~reliable, "no-net-effect").when(uninhabited >= 0.2, "wasted").when(top_three > 0.5, "skewed").otherwise("even")


def linear_expectation(mean_added: Column, contrast: Column) -> Column:
    return -mean_added * contrast


def ratio_to_linear(delta: Column, mean_added: Column, contrast: Column) -> Column:
    """Null where the contrast is too small to divide by."""
    return F.when(contrast >= MIN_CONTRAST, F.try_divide(delta, linear_expectation(mean_added, contrast)))


def trees_for(fraction: Column, area: Column) -> Column:
    return F.bround(fraction * area / TREE_CANOPY_M2).cast("long")


def compass(degrees: Column) -> Column:
    step = F.floor(F.pmod(degrees + 11.25, F.lit(360.0)) / 22.5).cast("int")
    return F.array(*[F.lit(x) for x in COMPASS])[step]


def coverage_text(valid: Column, total: Column) -> Column:
    """A percentage in which a gap never rounds to full coverage."""
    share = F.try_divide(valid.cast("double"), total)
    one = F.concat(F.format_string("%.1f", share * 100), F.lit("%"))
    return F.when(share >= 1, "100%").when(one == "100.0%", F.concat(F.format_string("%.3f", share * 100), F.lit("%"))).otherwise(one)
