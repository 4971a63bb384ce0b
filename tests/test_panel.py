"""Golden values of the panel, detection and survival operators, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tenura.operators import calibrate as cal
from tenura.operators import detection as det
from tenura.operators import panel as pn
from tenura.operators import survival as sv

HISTORIES = {"a": [0, 1, 4, 9], "b": [2], "c": [3, 5, 6, 11]}


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame([(k, i) for k, v in HISTORIES.items() for i in v], "key string, run_idx int").cache()


@pytest.fixture(scope="module")
def runs(spark):
    return spark.sql("SELECT CAST(id AS INT) AS run_idx, date_add(date '2026-01-01', CAST(id AS INT)) AS run_date FROM range(12)").cache()


SPELLS = {
    1: {("a", 0, 1, 2, 2, True, False), ("a", 4, 4, 1, 1, False, False), ("a", 9, 9, 1, 1, False, False), ("b", 2, 2, 1, 1, False, False), ("c", 3, 3, 1, 1, False, False), ("c", 5, 6, 2, 2, False, False), ("c", 11, 11, 1, 1, False, True)},
    3: {("a", 0, 4, 3, 5, True, False), ("a", 9, 9, 1, 1, False, True), ("b", 2, 2, 1, 1, False, False), ("c", 3, 6, 3, 4, False, False), ("c", 11, 11, 1, 1, False, True)},
    7: {("a", 0, 9, 4, 10, True, True), ("b", 2, 2, 1, 1, False, False), ("c", 3, 11, 4, 9, False, True)},
}


def test_spells_and_censoring(spark, seen, runs):
    out = pn.spells(seen, runs, [1, 3, 7])
    for k, want in SPELLS.items():
        got = {(r["key"], r["start_idx"], r["last_seen_idx"], r["sightings"], r["duration"], r["left_censored"], r["right_censored"]) for r in out.where(F.col("grace") == k).collect()}
        assert got == want


def test_detection_and_markov(seen, runs):
    curve = {r["age"]: (r["detected"], r["trials"]) for r in det.detection_curve(seen, runs).collect()}
    want = {0: (2, 2), 1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (1, 2), 5: (0, 2), 6: (0, 2), 7: (0, 2), 8: (1, 2), 9: (1, 1)}
    assert {a: curve[a] for a in want} == want and len(curve) == 13
    m = det.markov_fit(seen).head()
    assert (m["sn"], m["ss"], m["hn"], m["hs"]) == (6, 2, 11, 4)


def obs(spark, rows, group="g"):
    return spark.createDataFrame([(group, t, bool(e)) for t, e in rows], "grp string, duration int, observed_event boolean")


A = [(1, 1), (2, 1), (2, 0), (3, 1), (5, 0)]
B = [(2, 1), (4, 1), (6, 1), (7, 0)]


def test_kaplan_meier(spark):
    curve = sv.km_curve(obs(spark, A), ["grp"]).cache()
    got = [(r["t"], r["at_risk"], r["d"], round(r["s"], 5), round(r["lower"], 5), round(r["upper"], 5)) for r in curve.orderBy("t").collect()]
    assert got == [(1, 5, 1, 0.8, 0.2038, 0.96918), (2, 4, 1, 0.6, 0.12572, 0.88176), (3, 2, 1, 0.3, 0.0123, 0.71922), (5, 1, 0, 0.3, 0.0123, 0.71922)]
    for horizon, want in ((4, 2.7), (10, 4.5)):
        r = sv.km_summary(curve, ["grp"], horizon).head()
        assert (r["p25"], r["median"], r["p75"]) == (2, 3, None) and abs(r["rmst"] - want) < 1e-9


def test_logrank(spark):
    r = sv.logrank_vs_rest(obs(spark, A, "a").union(obs(spark, B, "b")), "grp").where("grp = 'b'").head()
    assert (r["observed"], round(r["expected"], 6), round(r["variance"], 6), round(r["chi2"], 3), round(r["p"], 5)) == (3, 3.794444, 1.102985, 0.572, 0.44938)


def test_empty_panel(spark, runs):
    none = spark.createDataFrame([], "key string, run_idx int")
    assert pn.spells(none, runs, [3]).count() == 0
    assert det.markov_fit(none).head()["p_stay_visible"] == 0.0


def test_spells_fall_with_grace(spark, seen, runs):
    n = {r["grace"]: r["count"] for r in pn.spells(seen, runs, [1, 3, 7]).groupBy("grace").count().collect()}
    assert n[1] >= n[3] >= n[7]


def test_identity_rules(spark):
    rows = [
        ("k", 1, "First", "c", "u", "", "s1", "x", "r", "a", "same"),
        ("k", 2, "Second", "c", None, "b", "s2", "x", "r", "b", "long"),
        ("k", 3, "Third", "c", "", "a", "s3", "x", "r", "b", None),
    ]
    out = pn.identities(spark.createDataFrame(rows, "key string, seq long, title string, company string, url string, category string, seniority string, sector string, remote string, skills string, description string")).head()
    assert (out["title"], out["category"], out["seniority"], out["urls"]) == ("First", "a", "s1", 2)


def test_simulation_recovers_lifetimes(spark):
    import numpy as np

    ages = [0.6] * 61
    observed = cal.simulate(2.2, 0.8, 0.2, np.array(ages), 0.7, 60, 7, 20000, np.random.default_rng(5))
    points = [(1, m, 0.8, w) for m in (1.6, 2.2, 2.8) for w in (0.0, 0.2, 0.4)]
    best = cal.evaluate(spark, points, observed, ages, 0.7, 60, 7, 6000).orderBy("loss").head()
    assert (round(best["mu"], 1), round(best["share"], 1)) == (2.2, 0.2)


def test_erfc_expression(spark):
    from tenura.functions.stats import erfc_sql

    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 2.49, 2.5, 3.0, 5.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(erfc_sql("x")).alias("y")).collect():
        assert math.isclose(r["y"], math.erfc(r["x"]), rel_tol=1e-9, abs_tol=1e-15)
