"""Quantiles by refinement against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions import quantiles as qt

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def values(df, column="x", by=None):
    return {tuple(r)[:-1]: r["values"] for r in qt.exact_quantiles(df, column, QS, by).collect()}


@pytest.mark.parametrize("kind", ["normal", "few", "one", "powers", "signs", "close", "widest"])
def test_quantiles_are_numpys(spark, kind):
    rng = np.random.default_rng(3)
    n = 5000
    x = {
        "normal": rng.normal(size=n) * 7 + 1,
        "few": rng.integers(-3, 4, n).astype(float),
        "one": np.array([4.5]),
        "powers": np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n),
        "signs": rng.choice([-1.0, -0.0, 0.0, 1.0], n),
        "close": 1 + rng.integers(0, 5000, n) * 2.0**-52,
        "widest": np.array([-1.7e308, 1.7e308, 1e-300, -1e-300, 0.0, 1.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    assert np.allclose(values(df)[()], np.percentile(x, [100 * q for q in QS]), rtol=1e-15, atol=0)


def test_groups_nulls_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else f"g{i % 3}", i % 2, float(v)) for i, v in enumerate(rng.normal(size=900))]
    odd = [("g1", 0, None), ("g1", 0, float("nan")), ("empty", 0, None)]
    got = values(spark.createDataFrame(rows + odd, "g string, h int, v double"), "v", ["g", "h"])
    assert set(got) == {(g, h) for g, h, _ in rows}
    for key, v in got.items():
        assert np.allclose(v, np.percentile([x for g, h, x in rows if (g, h) == key], [100 * q for q in QS]), rtol=1e-15)
    assert values(spark.createDataFrame([], "x double")) == {}


def test_nothing_grows_with_the_rows(spark, monkeypatch):
    sizes = []
    tallied = qt.tallied
    monkeypatch.setattr(qt, "tallied", lambda rows, by, cut: sizes.append((out := tallied(rows, by, cut)).count()) or out)
    qt.exact_quantiles(spark.range(200_000).select(F.rand(7).alias("x")), "x", [0.5, 0.99]).collect()
    assert len(sizes) <= 5 and max(sizes) <= 2 * qt.CUTS
