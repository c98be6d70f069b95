"""Searches for the best plan, all of them advanced together round by round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import planning, scenario
from tessera.operators.raster import checkpointed

#: Regions that a proposal is chosen from.
SHOWN = 24
UNITS = {"cooling": "degC of expected cooling inside the region", "person_degrees": "person-degrees (residents x degC of cooling)", "pm25_reduction": "ug/m3 of PM2.5 removed inside the region"}
MET, NO_REGIONS = "the goal was met", "the search ran out of regions to try"


def units_for(metric: Column) -> Column:
    """What a score of this metric is measured in."""
    out = F.lit(None).cast("string")
    for name, unit in UNITS.items():
        out = F.when(metric == name, unit).otherwise(out)
    return out


def offered(searches: DataFrame, regions: DataFrame, tried: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` regions of each search's metric that it has not tried, by rank.

    ``regions(metric, region_id, rank, ...)`` is ranked once for each metric.  A search
    that has tried n regions finds its next ones among the first n + shown: it asks for those
    ranks, and no search meets the others."""
    ranks = F.explode(F.sequence(F.lit(1).cast("long"), F.col("step") + shown)).alias("rank")
    near = searches.select("search_id", "metric", "step", ranks).join(regions.withColumn("rank", F.col("rank").cast("long")), ["metric", "rank"])
    left = near.join(tried.select("search_id", "region_id"), ["search_id", "region_id"], "left_anti").drop("step")
    return left.withColumn("nth", F.row_number().over(Window.partitionBy("search_id").orderBy("rank"))).where(F.col("nth") <= shown)


def first_untried(searches: DataFrame, offer: DataFrame) -> DataFrame:
    """A proposal for each search: the first region on offer, with the trees asked for,
    halved after every refusal; or all traffic, where clean air is the goal."""
    air = F.col("metric") == "pm25_reduction"
    halved = F.greatest(F.floor(F.col("ask_trees") / F.pow(F.lit(2.0), F.col("refusals"))), F.lit(1)).cast("long")
    return searches.select("search_id", "ask_trees", "refusals").join(offer.where("nth = 1"), "search_id").select(
        "search_id", "region_id", F.when(~air, halved).alias("tree_count"), F.lit(None).cast("double").alias("canopy_fraction"), F.when(air, 1.0).alias("emission_fraction")
    )


def run(
    objectives: DataFrame,
    regions: DataFrame,
    evaluate: Callable[[DataFrame], DataFrame],
    propose: Callable[[DataFrame, DataFrame], DataFrame] = first_untried,
    most_runs: int = 6,
    most_steps: int = 12,
    control: DataFrame | None = None,
) -> DataFrame:
    """(search_id, step, region_id, status, reason, score, best, best_region, stop) of every attempt.

    ``objectives(search_id, metric, target, ask_trees)``; ``regions(metric, region_id, rank,
    area_m2, plantable_canopy_m2, ...)``.  Each round proposes one plan for every open
    search, checks it (a region that does not exist and a plan that does not fit are
    refused and never run), runs the rest in one plan, scores them and decides: a search
    ends when its best attempt meets the target, when ``most_runs`` plans were run, after
    ``most_steps`` attempts, or when there is nothing to propose.  ``stop`` is set on the
    last attempt of a search, and no attempt follows it; a search without any attempt has
    one row of step 0.  An attempt without a score never is the best; of equal scores the
    earlier one stays.

    ``evaluate`` gets (search_id, region_id, metric, canopy_fraction_added, ...) of plans that fit and returns
    (search_id, expected_cooling, person_degrees, delta_pm25).  ``control(search_id,
    region_id, score, expected_cooling, runs)`` is an attempt made before, counted and to be beaten.

    A state of one row for each search and the attempts of a round are checkpointed, so
    a round starts from files; there are ``most_steps`` + 1 rounds at most.
    """
    state = objectives.select(
        "search_id", "metric", F.col("target").cast("double").alias("target"), "ask_trees", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("refusals"),
        F.lit(0).cast("long").alias("runs"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("string").alias("best_region"), F.lit(None).cast("double").alias("best_cooling"), F.lit(None).cast("string").alias("stop"),
    )
    tried = objectives.select("search_id", F.lit(None).cast("string").alias("region_id")).limit(0)
    if control is not None:
        known = control.select("search_id", F.col("region_id").alias("_r"), F.col("score").alias("_s"), F.col("expected_cooling").alias("_c"), F.col("runs").alias("_n"))
        state = state.join(known, "search_id", "left").withColumns({"best": F.col("_s"), "best_region": F.col("_r"), "best_cooling": F.col("_c"), "runs": F.coalesce("_n", F.lit(0)).cast("long")}).drop("_r", "_s", "_c", "_n")
        tried = control.where("region_id IS NOT NULL").select("search_id", "region_id")
    state, tried, attempts = checkpointed(decided(state, most_runs, most_steps)), checkpointed(tried), []
    regions = checkpointed(regions)  # read in every round
    first = state.where("stop IS NOT NULL")
    while state.where("stop IS NULL").limit(1).count():
        still = state.where("stop IS NULL")
        plans = propose(still, offered(still, regions, tried))
        checked = planning.resolve(
            plans.join(still.select("search_id", "metric"), "search_id").join(regions.withColumn("_known", F.lit(True)).drop("rank"), ["metric", "region_id"], "left")
        )
        unknown = F.col("_known").isNull()
        checked = checkpointed(checked.withColumn("reason", F.when(unknown, F.concat(F.lit("no such region: "), "region_id")).otherwise(F.col("reason"))).withColumn("status", F.when(unknown, "refused").otherwise(F.col("status"))))
        outcome = evaluate(checked.where("status = 'ok'")).select("search_id", "expected_cooling", "person_degrees", "delta_pm25")
        result = checked.select("search_id", "region_id", "metric", "status", "reason").join(outcome, "search_id", "left")
        value = F.round(scenario.score(F.col("metric"), F.col("expected_cooling"), F.col("person_degrees"), F.col("delta_pm25")), 6)
        result = result.withColumn("_ok", F.col("status") == "ok").withColumn("score", F.when(F.col("_ok"), value)).select(
            "search_id", F.col("region_id").alias("_region"), F.when(F.col("_ok"), "scored").otherwise("refused").alias("_status"), F.col("reason").alias("_reason"), F.col("score").alias("_score"), F.col("expected_cooling").alias("_cooling"), "_ok"
        )
        wins = F.col("_score").isNotNull() & (F.col("best").isNull() | (F.col("_score") > F.col("best")))
        none = F.col("_status").isNull()
        moved = still.join(result, "search_id", "left").withColumns({
            "step": F.col("step") + F.when(none, 0).otherwise(1), "refusals": F.col("refusals") + F.when(F.col("_status") == "refused", 1).otherwise(0), "runs": F.col("runs") + F.when(F.col("_ok"), 1).otherwise(0),
            "best": F.when(wins, F.col("_score")).otherwise(F.col("best")), "best_region": F.when(wins, F.col("_region")).otherwise(F.col("best_region")), "best_cooling": F.when(wins, F.col("_cooling")).otherwise(F.col("best_cooling")),
            "stop": F.when(none, NO_REGIONS),
        })
        moved = checkpointed(decided(moved, most_runs, most_steps))
        attempts.append(moved.select("search_id", "step", F.col("_region").alias("region_id"), F.col("_status").alias("status"), F.col("_reason").alias("reason"), F.col("_score").alias("score"), "best", "best_region", "stop"))
        tried = tried.unionByName(moved.where("_region IS NOT NULL").select("search_id", F.col("_region").alias("region_id")))
        state = moved.select(*state.columns)
    out = first.select("search_id", "step", *[F.lit(None).cast("string").alias(c) for c in ("region_id", "status", "reason")], F.lit(None).cast("double").alias("score"), "best", "best_region", "stop")
    for a in attempts:
        out = out.unionByName(a)
    # a search that found nothing to propose ends on its attempt before
    last = Window.partitionBy("search_id").orderBy("step", F.col("region_id").isNull())
    ended = out.withColumn("stop", F.coalesce("stop", F.when((F.lead("step").over(last) == F.col("step")) & F.lead("region_id").over(last).isNull(), F.lead("stop").over(last))))
    return ended.where("region_id IS NOT NULL OR step = 0")


def decided(state: DataFrame, most_runs: int, most_steps: int) -> DataFrame:
    """``state`` with the reason to stop, null for searches that go on: the best attempt is
    held against the target, whichever attempt came last."""
    met = scenario.satisfies(F.col("best_cooling"), F.col("target"))
    stop = F.when(met, MET).when(F.col("stop").isNotNull(), F.col("stop")).when(F.col("runs") >= most_runs, f"the simulation budget ran out ({most_runs})").when(F.col("step") >= most_steps, f"the step budget ran out ({most_steps})")
    return state.withColumn("stop", stop)
