"""Per-pixel band arithmetic: validity, masks, indices, albedo, temperature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published products and formulas.
CLEAR_CLASSES = (4, 5, 6, 7)
REFLECTANCE_SCALE = 10_000.0
OFFSET_BASELINE = 4.0
OFFSET_DN = 1000.0
REFLECTANCE_MAX = 1.6
ALBEDO_WEIGHTS = {"blue": 0.356, "red": 0.130, "nir": 0.373, "swir16": 0.085, "swir22": 0.072}
ALBEDO_INTERCEPT = -0.0018
ALBEDO_NORMALISATION = 1.016
THERMAL_PLATFORMS = ("landsat-8", "landsat-9")
QA_BAD_BITS = 0b11111
THERMAL_SCALE, THERMAL_OFFSET, KELVIN = 0.00341802, 149.0, 273.15


def no_nan(v: Column) -> Column:
    """NaN is missing: null, as everywhere here."""
    return F.nanvl(v, F.lit(None).cast("double"))


def reflectance(dn: Column, offset: Column | float = 0.0) -> Column:
    """Surface reflectance of a digital number, null outside (0, 1.6]; 0 is no data."""
    value = (dn - offset) / REFLECTANCE_SCALE
    return F.when((dn > 0) & (value > 0) & (value <= REFLECTANCE_MAX), value)


def clear_class(scl: Column) -> Column:
    return scl.isin(*CLEAR_CLASSES)


def clear_bits(qa: Column) -> Column:
    return qa.bitwiseAND(F.lit(QA_BAD_BITS)) == 0


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def albedo(blue: Column, red: Column, nir: Column, swir16: Column, swir22: Column) -> Column:
    w = ALBEDO_WEIGHTS
    total = blue * w["blue"] + red * w["red"] + nir * w["nir"] + swir16 * w["swir16"] + swir22 * w["swir22"]
    return (total + ALBEDO_INTERCEPT) / ALBEDO_NORMALISATION


def surface_celsius(dn: Column) -> Column:
    return F.when(dn > 0, dn * THERMAL_SCALE + THERMAL_OFFSET - KELVIN)


def in_range(v: Column, low: float, high: float) -> Column:
    """The value, or null outside its valid range."""
    return F.when(v.between(low, high), v)


def rejected(v: Column, low: float, high: float) -> Column:
    """Count of values that were there and out of range."""
    return F.count_if(v.isNotNull() & ~v.between(low, high))
