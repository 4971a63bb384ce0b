"""Logistic regressions that share their scans, against separate fits of another implementation."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tenura.operators import classifiers as lr
from tenura.operators import semantic as sem


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    own = rng.choice(4, 900, p=[0.5, 0.25, 0.15, 0.1])
    x = rng.normal(size=(4, 6))[own] * 1.2 + rng.normal(size=(900, 6))
    names = np.array(["a", "b", "c", "d"], object)[own]
    names[::9] = "other"
    data = [(i, v.tolist(), str(n)) for i, (v, n) in enumerate(zip(x, names, strict=True))] + [(2000 + i, [9.0] * 6, "rare") for i in range(5)]
    return sem.as_vectors(spark.createDataFrame(data, "id long, embedding array<double>, category string").repartition(4)).cache()


def separate(rows, folds, c):
    """Out-of-fold classes and rescued ones by six fits, one after the other."""
    named = sem.folded(rows.where("category NOT IN ('other', 'rare')").withColumn("y", F.ascii("category") - 97.0), "category", folds).cache()

    def fit(train):
        k = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        n = sum(k.values())
        weight = F.lit(n / len(k)) / F.element_at(F.create_map(*(F.lit(v) for pair in k.items() for v in pair)), F.col("y"))
        return LogisticRegression(family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n), weightCol="weight", labelCol="y", maxIter=300, tol=1e-12).fit(train.withColumn("weight", weight))

    out = {}
    for f in range(folds):
        out |= {r["id"]: "abcd"[int(r["prediction"])] for r in fit(named.where(F.col("fold") != f)).transform(named.where(F.col("fold") == f)).collect()}
    return out, {r["id"]: ("abcd"[int(r["prediction"])], max(r["probability"])) for r in fit(named).transform(rows.where("category = 'other'")).collect()}


def test_shared_scans_give_what_separate_fits_give(spark, rows, monkeypatch):
    done = []
    monkeypatch.setattr(lr, "scan", lambda *a, scan=lr.scan: done.append(len(a[1])) or scan(*a))
    oof, rescued, metrics = sem.rescue(rows, "id", "category", threshold=0.0)
    want, other = separate(rows, 5, 4.0)
    got = {r["id"]: r["predicted"] for r in oof.collect()}
    assert set(got) == set(want) and sum(got[i] != want[i] for i in want) <= 1  # a row on the edge
    found = {r["id"]: (r["label"], r["confidence"]) for r in rescued.collect()}
    assert set(found) == set(other) and max(abs(found[i][1] - other[i][1]) for i in other) < 5e-3
    assert len(done) < 60 and done[0] == 6
    m = metrics.head()
    assert (m["n_train"], m["n_other"], m["n_rescued"]) == (800, 100, 100)
    assert abs(m["accuracy"] - np.mean([r["category"] == r["predicted"] for r in oof.collect()])) < 1e-12


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    x, y, w, theta = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), rng.random(30), rng.normal(size=(3, 4))
    _, g = lr.loss_and_gradient(x, y, w, theta)
    for i in np.ndindex(theta.shape):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        slope = (lr.loss_and_gradient(x, y, w, theta + step)[0] - lr.loss_and_gradient(x, y, w, theta - step)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-6


def test_folds_deal_each_class_evenly(spark):
    df = spark.range(5000).withColumn("category", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    for r in sem.folded(df, "category", 5).groupBy("category", "fold").count().collect():
        assert abs(r["count"] - (1667 if r["category"] == "x" else 3333) / 5) <= 1


def test_too_few_classes_rescue_nothing(spark, rows):
    oof, rescued, metrics = sem.rescue(rows.where("category IN ('a', 'other')"), "id", "category")
    assert oof.count() == rescued.count() == 0 and metrics.head()["accuracy"] == 0.0
