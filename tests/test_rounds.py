"""Search rounds against a loop over each search alone."""

from pyspark.sql import functions as F

from tessera.operators import rounds

REGIONS = [("cooling", f"r{k}", k, 1000.0, [900.0, 0.0, 500.0, 700.0, 50.0][k - 1]) for k in range(1, 6)]


def outcomes(plans):
    return plans.select("search_id", (F.col("canopy_fraction_added") * 2).alias("expected_cooling"), F.lit(0.0).alias("person_degrees"), F.lit(None).cast("double").alias("delta_pm25"))


def alone(target, ask, proposals, most_runs, most_steps, best=None, cooling=None, runs=0):
    """Rows (step, region, status, score, best) and the reason to stop of one search."""
    room = {r[1]: r[4] for r in REGIONS}
    rows, refusals = [], 0

    def stop():
        if target is not None and cooling is not None and cooling >= target:
            return rounds.MET
        return f"the simulation budget ran out ({most_runs})" if runs >= most_runs else f"the step budget ran out ({most_steps})" if len(rows) >= most_steps else None

    why = stop()
    for region in proposals:
        if why:
            break
        trees = max(ask // 2**refusals, 1)
        fits = region in room and room[region] > 0 and trees * 25 <= room[region]
        score = round(min(trees * 25 / 1000, 1) * 2, 6) if fits else None
        if fits:
            runs += 1
            if best is None or score > best:
                best, cooling = score, score
        else:
            refusals += 1
        rows.append((len(rows) + 1, region, "scored" if fits else "refused", score, best))
        why = stop()
    return rows, why or rounds.NO_REGIONS


def test_equals_searches_run_alone(spark):
    goals = [(1, "cooling", 0.5, 30), (2, "cooling", None, 40), (3, "cooling", None, 1), (4, "cooling", 0.1, 10), (5, "cooling", 5.0, 8), (6, "nothing ranked", None, 10)]
    df = spark.createDataFrame(goals, "search_id long, metric string, target double, ask_trees long")
    regions = spark.createDataFrame(REGIONS, "metric string, region_id string, rank int, area_m2 double, plantable_canopy_m2 double")
    control = spark.createDataFrame([(4, "r4", 0.2, 0.2, 1), (5, "r1", 0.3, 0.3, 2)], "search_id long, region_id string, score double, expected_cooling double, runs int")
    for most_runs, most_steps in ((3, 12), (9, 4), (9, 12)):
        got = rounds.run(df, regions, outcomes, most_runs=most_runs, most_steps=most_steps, control=control).orderBy("search_id", "step").collect()
        for s, _, target, ask in goals:
            started = {4: (0.2, 0.2, 1), 5: (0.3, 0.3, 2)}.get(s, (None, None, 0))
            free = [] if s == 6 else [r[1] for r in REGIONS if (s, r[1]) not in ((4, "r4"), (5, "r1"))]
            rows, why = alone(target, ask, free, most_runs, most_steps, *started)
            mine = [r for r in got if r.search_id == s]
            if not rows:
                assert [(r.step, r.region_id, r.stop) for r in mine] == [(0, None, why)]
                continue
            assert [(r.step, r.region_id, r.status, r.score, r.best) for r in mine] == rows
            assert [r.stop for r in mine] == [None] * (len(rows) - 1) + [why]


def test_unknown_regions_are_refused_and_never_run(spark):
    df = spark.createDataFrame([(1, "cooling", None, 4)], "search_id long, metric string, target double, ask_trees long")
    regions = spark.createDataFrame(REGIONS, "metric string, region_id string, rank int, area_m2 double, plantable_canopy_m2 double")

    def made_up(searches, offer):
        plan = rounds.first_untried(searches, offer)
        return plan.join(searches.select("search_id", "step"), "search_id").withColumn("region_id", F.when(F.col("step") == 0, "r99").otherwise(F.col("region_id"))).drop("step")

    got = rounds.run(df, regions, outcomes, made_up, most_runs=1).orderBy("step").collect()
    assert [(r.region_id, r.status, r.reason) for r in got] == [("r99", "refused", "no such region: r99"), ("r1", "scored", None)]


def test_units():
    assert set(rounds.UNITS) == {"cooling", "person_degrees", "pm25_reduction"}
