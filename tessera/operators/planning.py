"""Plans: form, feasibility, presets, and plans read from plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.textcheck import BLANKS, wide
from tessera.functions.verdicts import TREE_CANOPY_M2

KM2 = 1e6
#: Patterns of the request grammar, fixed.
TREES = wide(r"(\d[\d,\s]{0,14}(?:\.\d+)?)\s*(k|thousand)?\s*(?:more\s+)?(?:trees?)")
CANOPY_FIRST = wide(r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)[^.]{0,24}?(canopy|tree|shade|green)")
CANOPY_LAST = wide(r"(canopy|tree cover|shade|greening)[^.]{0,24}?(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)")
TRAFFIC_SHARE = wide(r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)\s*(?:of\s*)?(?:the\s*)?(traffic|vehicles?|cars?|emissions?|lorr|truck)")
TRAFFIC_WORDS = r"\b(ban|banning|car[- ]free|pedestriani[sz]|low[- ]emission zone|lez|congestion charge|combustion|no cars|no traffic|remove traffic|close .{0,12}to traffic|diesel)\b"
WINDOW = wide(r"\b(20\d\d)\s*[-/ ]\s*(summer|winter)\b")
WINDOW_REVERSED = wide(r"\b(summer|winter)\s*(?:of\s*)?(20\d\d)\b")
SEASON = r"\b(summer|winter)\b"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse(requests: DataFrame, text: str = "text") -> DataFrame:
    """Plan columns of each request: tree_count, canopy_fraction, emission_fraction,
    window, season, warnings, and status with ``no intervention`` where none is found.
    A null text has none."""
    t = F.lower(F.col(text))
    digits = F.regexp_replace(_group(t, TREES, 1), f"[,{BLANKS}]", "")
    count = F.greatest(F.bround(digits.try_cast("double") * F.when(_group(t, TREES, 2).isNotNull(), 1000).otherwise(1)), F.lit(1.0))
    fraction = lambda raw: F.when(raw.isNotNull(), F.least(F.greatest(raw.try_cast("double") / 100, F.lit(0.01)), F.lit(1.0)))  # noqa: E731  least skips nulls
    first, last = _group(t, CANOPY_FIRST, 1), _group(t, CANOPY_LAST, 2)
    share, words = _group(t, TRAFFIC_SHARE, 1), F.coalesce(t.rlike(TRAFFIC_WORDS), F.lit(False))
    trees = F.when(digits.isNotNull(), count.cast("long"))
    canopy = F.when(digits.isNull(), fraction(F.coalesce(first, last)))
    removed = F.when(share.isNotNull(), fraction(share)).when(words, 1.0)
    joined = lambda y, s: F.concat(y, F.lit("-"), s)
    window = F.coalesce(joined(_group(t, WINDOW, 1), _group(t, WINDOW, 2)), joined(_group(t, WINDOW_REVERSED, 2), _group(t, WINDOW_REVERSED, 1)))
    warnings = F.array_compact(F.array(
        F.when(digits.isNotNull() & F.coalesce(first, last).isNotNull(), F.lit("both a count and a percentage: the count was used")),
        F.when(share.isNull() & words, F.lit("read as removing all vehicle emissions")),
    ))
    out = requests.withColumns({
        "tree_count": trees, "canopy_fraction": canopy, "emission_fraction": removed, "window": window, "season": F.when(window.isNull(), _group(t, SEASON, 1)), "warnings": warnings,
    })
    return out.withColumn("status", F.when(F.coalesce("tree_count", "canopy_fraction", "emission_fraction").isNull(), "no intervention").otherwise("ok"))


def well_formed(actions: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Plans with a reason each: an action kind twice, or a planting without exactly
    one of count and fraction, or a number out of bounds."""
    both = F.col("tree_count").isNotNull() & F.col("canopy_fraction").isNotNull()
    none = F.col("tree_count").isNull() & F.col("canopy_fraction").isNull()
    bad = (F.col("kind") == "plant") & (both | none)
    out_of = ~F.coalesce(F.col("canopy_fraction").between(0, 1), F.lit(True)) | ~F.coalesce(F.col("emission_fraction").between(0, 1), F.lit(True)) | F.coalesce(F.col("tree_count") < 1, F.lit(False))
    by = actions.groupBy(plan, "kind").agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.bool_or(out_of).alias("out"))
    return by.groupBy(plan).agg(F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or("bad").alias("bad"), F.bool_or("out").alias("out")).select(
        plan, F.when(F.col("twice"), "an action twice").when(F.col("bad"), "exactly one of count and fraction").when(F.col("out"), "a number out of bounds").alias("reason")
    )


def resolve(plans: DataFrame) -> DataFrame:
    """``plans`` with area_m2 and plantable_canopy_m2 of their region: status and reason,
    canopy fraction, tree count, room for trees, utilisation and notes."""
    area, room = F.col("area_m2"), F.col("plantable_canopy_m2")
    plants = F.col("tree_count").isNotNull() | F.col("canopy_fraction").isNotNull()
    asked = F.coalesce(F.col("tree_count") * TREE_CANOPY_M2, F.col("canopy_fraction") * area, F.lit(0.0))
    most = F.floor(room / TREE_CANOPY_M2)
    by_count = F.col("tree_count").isNotNull()
    nothing, too_many = plants & (room <= 0), by_count & (asked > room)
    reason = F.when(nothing, F.lit("nothing in this region can be planted")).when(
        too_many, F.format_string("%d trees need %.3f km2 of crown, %.3f km2 are plantable, room for %d", F.col("tree_count"), asked / KM2, room / KM2, most)
    )
    removes = F.coalesce(F.col("emission_fraction"), F.lit(0.0)) > 0
    notes = F.array_compact(F.array(
        F.when(plants & ~by_count & (asked > room), F.lit("more canopy than the region can take: cells are capped")), F.when(removes & ~plants, F.lit("traffic only: no temperature change")), F.when(plants & ~removes, F.lit("planting only: no air result")),
    ))
    ok = reason.isNull()
    return plans.withColumns({
        "status": F.when(ok, "ok").otherwise("refused"), "reason": reason, "canopy_fraction_added": F.when(ok, F.least(F.coalesce(F.try_divide(asked, area), F.lit(0.0)), F.lit(1.0))),
        "trees": F.when(ok, F.coalesce(F.col("tree_count"), F.bround(asked / TREE_CANOPY_M2).cast("long"))), "max_trees": most, "utilisation": F.when(ok, F.coalesce(F.try_divide(asked, room), F.lit(0.0))), "notes": F.when(ok, notes),
    })


def presets(spark: SparkSession) -> DataFrame:
    """Named plans: one row each."""
    rows = [("street-trees", 0.15, None, None), ("dense-canopy", 0.40, None, None), ("low-emission-zone", None, 1.0, None), ("clean-and-green", 0.25, 0.5, None), ("winter-inversion", None, 1.0, "winter")]
    return spark.createDataFrame(rows, "slug string, canopy_fraction double, emission_fraction double, season string")
