"""Queries without SQL cover all rows and run at their operators' own settings."""

import duckdb
import pytest

from tessera.operators import change, features, roads
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_emission_inventory_has_all_ways(spark):
    metres, stacks = duckdb.connect().execute(
        "SELECT (SELECT sum(sqrt(pow(x1-x,2)+pow(y1-y,2))) FROM (SELECT x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM (SELECT l_orderkey AS way, l_linenumber AS nth, (l_partkey%50+0.5)*100 AS x, 100000-(floor(l_partkey/50.0)+0.5)*100 AS y "
        f"FROM '{SF}/lineitem.parquet') WINDOW w AS (PARTITION BY way ORDER BY nth, x, y))), (SELECT count(*) FROM '{SF}/supplier.parquet' WHERE s_suppkey<=5000)"
    ).fetchone()
    per_m = roads.VEHICLES["primary"] * roads.GRAMS_PER_KM / roads.DAY_S / 1000
    total = sum(r["emission"] for r in catalogue.queries()["emission_inventory"](spark, SF).collect())
    assert total == pytest.approx(metres * per_m + stacks * roads.KILN_G_S, rel=1e-5)


def test_boosted_cross_validation_fits_every_fold_at_the_defaults(spark, monkeypatch):
    seen = {}

    def scored(frame, groups, folds, target="lst_c", rounds=20):
        seen.update(folds=list(folds), rounds=rounds, blocks=frame.select("block_row", "block_col", "fold").distinct().collect(), last=frame.agg({"row": "max"}).first()[0])
        return frame.selectExpr("fold", "lst_c", "lst_c AS predicted", "lst_c AS naive")

    monkeypatch.setattr(features, "cross_validate", scored)
    catalogue.queries()["boosted_cross_validation"](spark, SF.replace("0.001", "0.01"))
    assert (seen["folds"], seen["rounds"]) == (list(range(features.FOLDS)), 20)
    assert {r.fold for r in seen["blocks"]} <= set(seen["folds"])
    assert max(r.block_row for r in seen["blocks"]) == seen["last"] // features.BLOCK


def test_change_sites_take_the_defaults(spark, monkeypatch):
    seen = []
    flag, sites = change.flag_change, change.sites
    monkeypatch.setattr(change, "flag_change", lambda field, key, sigma=change.SIGMA: seen.append(sigma) or flag(field, key, sigma))
    monkeypatch.setattr(change, "sites", lambda flagged, key, least=change.MIN_SITE_CELLS: seen.append(least) or sites(flagged, key, least))
    catalogue.queries()["change_sites"](spark, SF)
    assert seen == [3.0, 9]


def test_change_sites_equal_their_sql_where_there_are_sites(spark, monkeypatch):
    flag, sites = change.flag_change, change.sites
    monkeypatch.setattr(change, "flag_change", lambda field, key: flag(field, key, 0.5))
    monkeypatch.setattr(change, "sites", lambda flagged, key: sites(flagged, key, 2))
    got = [tuple(r[c] for c in ("rank", "sign", "component", "cells")) for r in catalogue.queries()["change_sites"](spark, SF).collect()]
    duck = duckdb.connect()
    for t in ("part", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = catalogue.oracle_sql()["change_sites"].replace("3.0*1.4826", "0.5*1.4826").replace("count(*)>=9", "count(*)>=2")
    want = duck.execute(f"SELECT rank, sign, component, cells FROM ({sql})").fetchall()
    assert want and sorted(got) == sorted(want)
