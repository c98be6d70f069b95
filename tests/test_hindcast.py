"""Hindcasts against numpy for one configuration at a time; fits that run together."""

import threading

import numpy as np
import pytest

from tessera.operators import features, hindcast
from tessera.plans.acting import feature_table

WINDOWS = ["2019-summer", "2020-summer", "2021-summer", "2022-summer", "2023-summer"]


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(8)
    rows = []
    base = rng.uniform(0.1, 0.6, (16, 16))
    cover = rng.choice([10, 50], (16, 16))
    for k, w in enumerate(WINDOWS):
        v = base + rng.normal(size=base.shape) * 0.01
        if k >= 3:
            v[2:6, 2:6] += 0.3  # greened
        t = 40 - 12 * v + rng.normal(size=v.shape) * 0.2 + k * 0.1
        rows += [("t", w, int(r), int(c), int(cover[r, c]), None if rng.random() < 0.03 else float(v[r, c]), float(t[r, c])) for r in range(16) for c in range(16)]
    return rows


SCHEMA = "tile_id string, window string, row long, col long, landcover int, ndvi double, lst_c double"
CONFIGS = [(1, WINDOWS[:3], WINDOWS[3], 4), (2, WINDOWS[:2], WINDOWS[2], 10), (3, WINDOWS[:4], WINDOWS[3], 4), (4, [], WINDOWS[3], 4), (5, WINDOWS[:3], "2030-summer", 4), (6, WINDOWS[2:3] + WINDOWS[4:], WINDOWS[3], 4)]


def plain(cells, before, scored, bins):
    """Figures of one configuration with a line of one feature."""
    get = lambda w: {(r, c): (cover, v, t) for _, x, r, c, cover, v, t in cells if x == w}
    trained = [(v, t) for w in before for _, v, t in get(w).values() if v is not None]
    slope, intercept = np.polyfit(*np.array(trained).T, 1)
    now = get(scored)
    med = lambda k, j: np.median([x for x in (get(w)[k][j] for w in before) if x is not None]) if any(get(w)[k][j] is not None for w in before) else None
    past = {k: (med(k, 1), med(k, 2)) for k in now}
    change = {k: now[k][1] - past[k][0] for k in now if now[k][1] is not None and past[k][0] is not None}
    drift = np.median(list(change.values()))
    limit = 3 * 1.4826 * np.median([abs(x - drift) for x in change.values()])
    flagged = {k: np.sign(x - drift) for k, x in change.items() if abs(x - drift) > limit}
    site, seen = set(), set()
    for k in flagged:
        if k in seen:
            continue
        patch, todo = set(), [k]
        while todo:
            a = todo.pop()
            if a in patch:
                continue
            patch.add(a)
            todo += [b for b in flagged if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 and flagged[b] == flagged[a]]
        seen |= patch
        site |= patch if len(patch) >= 9 else set()
    residual = {k: slope * v + intercept - t for k, (_, v, t) in now.items() if v is not None}
    quiet = [k for k in residual if k not in flagged]
    edges = np.quantile([past[k][0] for k in residual if past[k][0] is not None], [i / bins for i in range(1, bins)])
    stratum = {k: (now[k][0], int((edges <= past[k][0]).sum())) for k in residual if past[k][0] is not None}

    def matched(value):
        total, n, lost = 0.0, 0, 0
        for s in {stratum[k] for k in site if k in stratum}:
            own, rest = [value(k) for k in site if stratum.get(k) == s], [value(k) for k in quiet if stratum.get(k) == s]
            if rest:
                total, n = total + len(own) * (np.mean(own) - np.mean(rest)), n + len(own)
            else:
                lost += len(own)
        return total / n if n else None, n, lost

    mean = lambda ks: np.mean([residual[k] for k in ks])
    error, n, lost = matched(residual.get)
    effect, *_ = matched(lambda k: now[k][2] - past[k][1])
    return {"overall_n": len(residual), "overall_mae": np.mean(np.abs(list(residual.values()))), "changed_n": len(site), "unchanged_n": len(quiet), "effect_error": mean(site) - mean(quiet), "matched_error": error, "matched_effect": effect, "matched_cells": n, "unmatched_cells": lost}


def test_equals_each_configuration_alone(spark, cells):
    configs = spark.createDataFrame(CONFIGS, "config_id long, before array<string>, scored string, bins int")
    out = {r.config_id: r for r in hindcast.run(configs, spark.createDataFrame(cells, SCHEMA), hindcast.by_line("ndvi")).collect()}
    leak = "trained on the window it is scored on, or on a later one"
    assert {k: r.status for k, r in out.items()} == {1: "ok", 2: "no change site to validate against", 3: leak, 4: "nothing to train on", 5: "no cell to score", 6: leak}
    want = plain(cells, *CONFIGS[0][1:])
    assert want["changed_n"] >= 9 and want["matched_effect"] < -2
    for name, value in want.items():
        assert out[1][name] == pytest.approx(value), name
    assert all(out[k].overall_mae is None and out[k].matched_error is None for k in (2, 3, 4, 5, 6))


def test_trees_of_each_configuration(spark, cells):
    table = spark.createDataFrame(cells, SCHEMA).na.drop(subset=["ndvi"])
    for name in features.NUMERIC:
        if name != "ndvi":
            table = table.selectExpr("*", f"cast(0 as double) AS {name}")
    configs = spark.createDataFrame(CONFIGS[:1] + [(7, WINDOWS[1:3], WINDOWS[3], 4)], "config_id long, before array<string>, scored string, bins int")
    out = hindcast.run(configs, table.selectExpr("*", "true AS usable"), hindcast.by_trees(rounds=3, depth=3)).collect()
    assert {r.status for r in out} == {"ok"} and all(r.overall_mae < 1.0 and r.overall_spatial_r2 > 0.5 for r in out)


def test_fits_run_together_and_in_order(spark):
    frame = spark.range(50).toDF("id")
    begun = threading.Barrier(3, timeout=60)  # passes only if three run at once

    def fit(k):
        begun.wait()
        return k, kept.where(f"id % 3 = {k}").count()

    with features.together(frame, 3) as (kept, submit):
        assert submit(fit, [0, 1, 2]) == [(0, 17), (1, 17), (2, 16)]
        with pytest.raises(ZeroDivisionError):
            submit(lambda k: 1 // k, [1, 0])
    assert not frame.is_cached


def test_blocked_validation_has_skill(spark):
    """Trees fitted for each fold predict held-out blocks better than the mean of their cover."""
    t = features.training_frame(feature_table(spark, "/root/testdata/sf0.001"))
    frame = t.selectExpr("*", "cast(floor(col / 10) % 3 as int) AS fold")
    scored = features.cross_validate(frame, ["landcover"], [0, 1, 2], rounds=3, depth=4)
    counts = {r.fold: r["count"] for r in scored.groupBy("fold").count().collect()}
    assert counts == {r.fold: r["count"] for r in frame.groupBy("fold").count().collect()}
    report = features.cv_report(scored).first()
    assert 0 < report.skill < 1 and report.mae > 0
