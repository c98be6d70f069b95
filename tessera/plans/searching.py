"""Queries on searches for the best plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import verdicts
from tessera.operators import regions, rounds
from tessera.plans import tables as T
from tessera.plans.people import _LATTICE, lattice_of
from tessera.plans.registry import query

RUNS, STEPS = 6, 12


def objectives(spark, sf_dir):
    """A goal for each supplier: one of three metrics, a cooling target in some, trees to ask for."""
    k = F.col("s_suppkey")
    metric = F.array(*[F.lit(m) for m in rounds.UNITS])[(k % 3).cast("int")]
    return T.read(spark, sf_dir, "supplier").select(k.alias("search_id"), metric.alias("metric"), F.when(k % 4 == 0, k % 10 / 20.0).alias("target"), (k * 37 % 900 * 20 + 50).alias("ask_trees"))


def ranked_by_metric(spark, sf_dir):
    """Regions of the lattice, ranked for each metric."""
    each = lattice_of(spark, sf_dir).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in rounds.UNITS])))
    air = F.col("metric") == "pm25_reduction"
    worth = F.when(air, F.round(F.col("emission") * 1e6, 0)).otherwise(F.round(F.col("plantable_canopy_m2") * F.col("population"), 0))
    return regions.ranked(each, ["metric"], worth).drop("score")


def linear_outcomes(plans):
    """What a plan does if temperature follows the canopy added: a tenth of the region's mean is its ceiling."""
    ceiling = F.coalesce(F.col("mean_lst_c"), F.lit(0.0)) / 10
    delta = verdicts.linear_expectation(F.col("canopy_fraction_added"), ceiling)
    return plans.select(
        "search_id", verdicts.corrected_cooling(delta).alias("expected_cooling"), (-delta * F.col("population")).alias("person_degrees"),
        F.when(F.col("emission_fraction") > 0, -F.col("emission") * F.col("emission_fraction") * 50).alias("delta_pm25"),
    )


@query(
    f"WITH RECURSIVE {_LATTICE}, mt AS (SELECT unnest(['cooling','person_degrees','pm25_reduction']) AS metric), "
    "rg AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric='pm25_reduction' THEN round(emission*1e6,0) ELSE round(plantable_canopy_m2*population,0) END DESC, region_id) AS rank, count(*) OVER (PARTITION BY metric) AS all_of FROM lat, mt), "
    "tr AS (SELECT s_suppkey AS search_id, 0::BIGINT AS step, ['cooling','person_degrees','pm25_reduction'][CAST(s_suppkey%3 AS INTEGER)+1] AS metric, CASE WHEN s_suppkey%4=0 THEN (s_suppkey%10)/20.0 END::DOUBLE AS target, (s_suppkey*37%900)*20+50 AS ask, NULL::VARCHAR AS region_id, NULL::VARCHAR AS status, "
    "NULL::DOUBLE AS score, 0::BIGINT AS refusals, 0::BIGINT AS runs, NULL::DOUBLE AS best, NULL::VARCHAR AS best_region, NULL::DOUBLE AS best_cooling, NULL::VARCHAR AS stop FROM supplier UNION ALL "
    "SELECT search_id, step, metric, target, ask, region_id, CASE WHEN ok THEN 'scored' ELSE 'refused' END, score, refusals, runs, best, best_region, best_cooling, "
    f"CASE WHEN coalesce(best_cooling>=target,false) THEN '{rounds.MET}' WHEN runs>={RUNS} THEN 'the simulation budget ran out ({RUNS})' WHEN step>={STEPS} THEN 'the step budget ran out ({STEPS})' WHEN step>=all_of THEN '{rounds.NO_REGIONS}' END FROM ("
    "SELECT search_id, step, metric, target, ask, region_id, all_of, ok, score, refusals+CASE WHEN ok THEN 0 ELSE 1 END AS refusals, runs+CASE WHEN ok THEN 1 ELSE 0 END AS runs, CASE WHEN wins THEN score ELSE best END AS best, CASE WHEN wins THEN region_id ELSE best_region END AS best_region, CASE WHEN wins THEN cooling ELSE best_cooling END AS best_cooling FROM ("
    "SELECT *, score IS NOT NULL AND (best IS NULL OR score>best) AS wins FROM (SELECT *, CASE WHEN ok THEN round(CASE metric WHEN 'cooling' THEN cooling WHEN 'person_degrees' THEN added*ceiling*population ELSE coalesce(emission*removed*50,0) END,6) END AS score FROM ("
    "SELECT *, CASE WHEN ok THEN added*ceiling/2.5 END AS cooling FROM (SELECT *, NOT (metric<>'pm25_reduction' AND (plantable_canopy_m2<=0 OR trees*25.0>plantable_canopy_m2)) AS ok, least(coalesce(trees*25.0/area_m2,0),1.0) AS added, coalesce(mean_lst_c,0)/10 AS ceiling FROM ("
    "SELECT t.search_id, t.step+1 AS step, t.metric, t.target, t.ask, r.region_id, r.all_of, t.refusals, t.runs, t.best, t.best_region, t.best_cooling, r.area_m2, r.plantable_canopy_m2, r.population, r.emission, r.mean_lst_c, "
    "CASE WHEN t.metric<>'pm25_reduction' THEN greatest(CAST(floor(t.ask/pow(2.0,t.refusals)) AS BIGINT),1) END AS trees, CASE WHEN t.metric='pm25_reduction' THEN 1.0 END AS removed FROM tr t JOIN rg r ON r.metric=t.metric AND r.rank=t.step+1 WHERE t.stop IS NULL))))))) "
    "SELECT search_id, step, region_id, status, round(score,4) AS score, round(best,4) AS best, best_region, stop FROM tr WHERE step>0"
)
def search_rounds(spark, sf_dir):
    """Propose, check, run, score, decide; every search ends where it has reason to."""
    out = rounds.run(objectives(spark, sf_dir), ranked_by_metric(spark, sf_dir), linear_outcomes, most_runs=RUNS, most_steps=STEPS)
    return out.select("search_id", "step", "region_id", "status", F.round("score", 4).alias("score"), F.round("best", 4).alias("best"), "best_region", "stop")


@query(
    f"WITH {_LATTICE}, r AS (SELECT region_id, row_number() OVER (ORDER BY round(plantable_canopy_m2*population,0) DESC, region_id) AS rank FROM lat), td AS (SELECT c_nationkey AS search_id, printf('r%02dc%02d', CAST(c_custkey%(({'(SELECT max(p_partkey)//50 FROM part)'})//10+1) AS INTEGER), CAST(c_custkey%5 AS INTEGER)) AS region_id FROM customer WHERE c_custkey%3=0), "
    "l AS (SELECT n_nationkey AS search_id, region_id, rank FROM nation, r WHERE NOT EXISTS (SELECT 1 FROM td WHERE td.search_id=n_nationkey AND td.region_id=r.region_id)) SELECT search_id, region_id, nth FROM (SELECT search_id, region_id, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS nth FROM l) WHERE nth<=24"
)
def untried_regions(spark, sf_dir):
    """T5: what is offered to searches that have tried some regions."""
    from tessera.plans.spatial import height

    k, rows = F.col("c_custkey"), (height(spark, sf_dir) - 1) // 10 + 1
    tried = T.read(spark, sf_dir, "customer").where(k % 3 == 0).select(F.col("c_nationkey").alias("search_id"), F.format_string("r%02dc%02d", k % rows, k % 5).alias("region_id")).distinct()
    steps = T.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("search_id"), F.when(F.col("n_nationkey").isNotNull(), "cooling").alias("metric"))
    steps = steps.join(tried.groupBy("search_id").agg(F.count("*").alias("step")), "search_id", "left").fillna(0, ["step"])
    return rounds.offered(steps, ranked_by_metric(spark, sf_dir), tried).select("search_id", "region_id", "nth")
