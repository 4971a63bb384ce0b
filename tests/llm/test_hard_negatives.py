"""Hard negatives against a plain search, and against the registered SQL."""

import math

import duckdb
import numpy as np
import pytest

from tenura.llm import hard_negatives as hn
from tenura.llm import queries as registry
from tenura.llm.vectors import LONG, dots, scaled


def whole(v, scale=256):
    return [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v]


def plain(rows, positives=5, negatives=10):
    v = [(i, y, whole(x)) for i, x, y in rows if i is not None and y is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out, done = [], set()
    for a, label, q in v:
        if a % 100 or a in done:
            continue
        done.add(a)
        score = lambda x: max(-LONG, min(LONG, sum(s * t for s, t in zip(q, x, strict=False))))
        ranked = sorted((-score(x), i, y) for i, y, x in v if i != a)
        for p, i, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(n, j) for n, j, y in ranked if y != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def mined(spark, rows, kind="float", **more):
    df = frame(spark, rows, kind).repartition(3)
    return sorted(map(tuple, hn.hard_negatives(df, df.where("vec_id % 100 = 0"), **more).collect()))


@pytest.fixture
def small_lists(monkeypatch):
    for name, n in (("LIST_ROWS", 20), ("PIECE", 16), ("BLOCK", 2), ("FIRST", 2)):
        monkeypatch.setattr(hn, name, n)


def clustered(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(9, d)) * 3
    own = rng.integers(9, size=n)
    x = (mid[own] + rng.normal(size=(n, d)) * 0.4).astype(np.float32)
    return [(i, v.tolist(), int((o + rng.integers(0, 3)) % 5)) for i, (v, o) in enumerate(zip(x, own, strict=True))]


def test_pruned_search_equals_a_plain_one(spark, small_lists, monkeypatch):
    rows = clustered(620)
    rows += [(700 + i, rows[100][1], i % 3) for i in range(150)]  # a popular vector, and ties without end
    seen = {}
    visits = hn.Index.visits

    def counted(self, asked, first, rest):
        out = visits(self, asked, first, rest)
        seen[rest] = seen.get(rest, 0) + out.count()
        seen["all"] = seen.get("all", 0) + asked.count() * len(self.pieces) // 2
        return out

    monkeypatch.setattr(hn.Index, "visits", counted)
    assert mined(spark, rows) == plain(rows)
    assert seen[False] + seen[True] < 0.7 * seen["all"]  # lists were skipped


def test_odd_rows_take_no_part_and_others_get_their_fill(spark, small_lists):
    rows = clustered(120)
    rows += [(200, None, 1), (300, [1.0] * 8, None), (400, [float("nan")] + [1.0] * 7, 2), (500, [None] * 8, 2), (600, [], 1), (None, [1.0] * 8, 1), (700, [0.0] * 8, 1), (800, [1.0, 2.0], 3), (0, rows[0][1], rows[0][2]), (901, [float("inf")] * 8, 1)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows[:3]) == plain(rows[:3])
    assert mined(spark, [rows[0], *rows[-3:-2]]) == []
    assert mined(spark, []) == []


def test_large_components_are_exact(spark, small_lists):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 9)).tolist(), int(i % 2)) for i in range(220)]
    assert mined(spark, rows, "double") == plain(rows)
    rows += [(300, [1e200, 1e-200, 3.0, -1.0], 0), (301, [3e38, -3e38, 1.0, 0.0], 1), (302, [1.7e308] * 4, 0)]
    assert mined(spark, rows, "double") == plain(rows)


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(2)
    for size in (1.0, 1e6, 1e12, 1e30, 1e307):
        x = rng.normal(size=(20, 5)) * size
        want = [[max(-LONG, min(LONG, sum(s * t for s, t in zip(whole(a, 1024), whole(b, 1024), strict=True)))) for b in x.tolist()] for a in x[:3].tolist()]
        assert dots(scaled(x[:3], 1024), scaled(x, 1024)).tolist() == want


def test_query_equals_its_sql(spark, tmp_path):
    rows = clustered(450, seed=3) + [(1000, None, 1), (1100, [1.0] * 8, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["op11_hard_negatives"]).fetchall()
    df = registry.queries()["op11_hard_negatives"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_clashing_column_names(spark):
    rows = clustered(210)
    df = frame(spark, rows).selectExpr("vec_id", "embedding", "label", "vec_id AS id", "'x' AS vector", "1 AS list", "2 AS gap")
    assert sorted(map(tuple, hn.hard_negatives(df, df.where("vec_id % 100 = 0")).collect())) == plain(rows)
