"""Searches over finite vectors of any size, null ids among queries, and doubles."""

import math

import numpy as np

from tenura.llm.impact_search import top_k
from tenura.llm.lsh_search import nearest
from tenura.llm.vectors import LONG


def rows(size, n=130, d=6):
    rng = np.random.default_rng(9)
    return [(i, (rng.normal(size=d) * 10.0 ** rng.uniform(-size, size)).tolist()) for i in range(n)] + [(500, [1e200] * d), (501, [1e200, 0.0, 0.0, 0.0, 0.0, -1e200]), (502, [1e-200] * d), (503, [1.7e308] * d), (None, [1.0] * d), (600, [float("inf")] * d), (700, None)]


def frame(spark, data, kind="double"):
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").repartition(3)


def test_cosines_of_any_finite_vectors(spark):
    data = rows(150)
    df = frame(spark, data)
    got = nearest(df, df.where("vec_id % 50 = 0 OR vec_id IS NULL"), block=64).collect()
    unit = {}
    for i, v in data:
        if i is not None and v and all(map(math.isfinite, v)):
            top = max(map(abs, v))
            w = [x / top for x in v]
            n = math.sqrt(sum(x * x for x in w))
            unit[i] = [x / n for x in w]
    assert {r["query_id"] for r in got} == {i for i in unit if i % 50 == 0} and len(got) == 5 * len({r["query_id"] for r in got})
    for r in got:
        assert abs(r["score"] - sum(a * b for a, b in zip(unit[r["query_id"]], unit[r["vec_id"]], strict=True))) < 1e-12
    assert {r["vec_id"] for r in got if r["query_id"] == 500} >= {502, 503}  # the same direction


def test_integer_products_of_any_finite_vectors(spark):
    for data in (rows(3), [r for r in rows(12) if r[0] is not None and r[0] < 500], rows(150)):
        df = frame(spark, data)
        whole = {i: [math.floor(1024 * x) if math.isfinite(1024 * x) else 1024 * int(x) for x in v] for i, v in data if i is not None and v and all(map(math.isfinite, v))}
        want = []
        for q in whole:
            if q % 100 == 0:
                s = {i: max(-LONG, min(LONG, sum(a * b for a, b in zip(whole[q], w, strict=True)))) for i, w in whole.items() if i != q}
                want += [(q, k, i, s[i]) for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:10], 1)]
        assert sorted(map(tuple, top_k(df, df.where("vec_id % 100 = 0"), block=50).collect())) == sorted(want)


def test_floats_of_the_largest_size(spark):
    df = frame(spark, [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 5.0]), (3, [1.0, 1.0])], "float")
    assert [(r["vec_id"], r["score"]) for r in top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, LONG), (3, LONG), (2, -LONG)]
    assert [r["vec_id"] for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [1, 3, 2]
