"""Whether a rewritten text keeps the numbers and the direction of its source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for use inside brackets: the plain class alone leaves out no-break spaces.
BLANKS = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def wide(pattern: str) -> str:
    """``pattern`` with every ``\\s`` taken as any white space."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(BLANKS if inside else f"[{BLANKS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


#: Numerals that do not continue a word, and the unit or magnitude after one; fixed.
NUMERAL = r"(?<![A-Za-z0-9.])\d+(?:\.\d+)?"
UNITS = r"%|degc|degf|°c|°f|km2|m2|km|m3|µg/m3|ug/m3|million|billion"
NUMBER = wide(rf"({NUMERAL})(?:\s*({UNITS})\b)?")
#: Words of either direction; fixed, as equal verdicts need equal words.
COOLER = r"\b(cool(?:s|er|ing)?|falls?|drops?|decreas(?:es|ing)?)\b"
WARMER = r"\b(warm(?:s|er|ing)?|hotter|ris(?:es|ing)|increas(?:es|ing)?)\b"


def _plain(text: Column) -> Column:
    """Lower case without thousands commas; null is empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(","), F.lit(""))


def numbers(text: Column) -> Column:
    """Distinct (value, unit) of a text; degree signs are spelt out."""
    t = _plain(text)
    values, units = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(2))
    pairs = F.arrays_zip(values.alias("v"), units.alias("u"))
    return F.array_distinct(F.transform(pairs, lambda p: F.struct(
        p["v"].try_cast("double").alias("value"), F.when(p["u"] == "°c", "degc").when(p["u"] == "°f", "degf").otherwise(p["u"]).alias("unit")
    )))


def bare_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_plain(text), F.lit(NUMERAL), F.lit(0)))


def close(a: Column, b: Column) -> Column:
    """Equal to within 5 % or 0.05."""
    return F.abs(a - b) <= F.greatest(F.lit(0.05), 0.05 * F.abs(b))


def numbers_are_faithful(source: Column, rewritten: Column) -> Column:
    """Every number of the rewrite stands in the source, unit and all."""
    have = numbers(source)
    return F.forall(numbers(rewritten), lambda n: F.exists(have, lambda h: (h["unit"] == n["unit"]) & close(n["value"], h["value"])))


def direction_is_faithful(source: Column, rewritten: Column) -> Column:
    """A rewrite does not turn cooling into warming or the other way round."""
    s, r = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(rewritten, F.lit("")))
    turned = (s.rlike(COOLER) & ~s.rlike(WARMER) & r.rlike(WARMER) & ~r.rlike(COOLER)) | (s.rlike(WARMER) & ~s.rlike(COOLER) & r.rlike(COOLER) & ~r.rlike(WARMER))
    return ~turned


def headline_survives(headline: Column, rewritten: Column) -> Column:
    """Every numeral of the headline stands in the rewrite, whatever its unit."""
    return F.size(F.array_except(bare_numbers(headline), bare_numbers(rewritten))) == 0
