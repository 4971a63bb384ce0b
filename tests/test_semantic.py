"""Grouping by meaning against plain numpy and Python; encoders; the order of sections; the whole run with clusters."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenura.operators import calibrate as cal
from tenura.operators import clustering as cl
from tenura.operators import semantic as sem
from tenura.operators import views as vw
from tenura.plans import full_run
from tenura.sources.encoder import hashed_words, model, unit
from tenura.sources.sqlite import read_panel

from .test_full_run import db  # noqa: F401


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in ((0, 0, 0, 0), (3, 0, 1, 0), (0, 4, 0, 2))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def plain_silhouette(x, label):
    d, s = gaps(x), []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        a, b = d[i][same].mean() if same.any() else None, min(d[i][label == c].mean() for c in set(label) - {label[i]})
        s.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(s)


def test_silhouettes_are_the_plain_ones(spark, points):
    x, _ = points
    labels = [np.r_[np.repeat([0, 1], 50), np.full(19, 2), 3], np.repeat([2, 0, 5], 40)]  # a cluster of one; numbers that miss some
    rows = spark.createDataFrame([(i, v.tolist(), [int(c[i]) for c in labels]) for i, v in enumerate(x)], "id long, v array<double>, clusters array<int>")
    for block in (7, 256):
        assert np.allclose(cl.silhouettes(rows, block=block), [plain_silhouette(x, c) for c in labels], atol=1e-12)
    assert cl.silhouettes(rows.withColumn("clusters", F.array(F.lit(0)))) == [0.0]
    assert cl.silhouettes(rows.limit(0)) == []


def plain_lloyd(x, c):
    while True:
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(moved, c, atol=1e-12):
            return moved, ((x - c[own]) ** 2).sum()
        c = moved


def test_fits_that_share_their_scans_are_the_separate_ones(spark, points):
    x, df = points
    rows = df.select("id", F.col("embedding").alias("v")).repartition(5)
    starts = [cl.starting_centres(x, k, s) for k in (2, 3, 5, 9) for s in range(4)]
    starts.append(np.array([[100.0] * 4, x[0], x[50]]))  # a centre without rows stays
    for (centres, cost), start in zip(cl.lloyd(rows, starts, tolerance=1e-20), starts, strict=True):
        want, least = plain_lloyd(x, start)
        assert np.allclose(centres, want, atol=1e-9) and abs(cost - least) < 1e-9 * least


def test_scans_do_not_grow_with_the_fits(spark, points, monkeypatch):
    done = []
    monkeypatch.setattr(cl, "scan", lambda points, sets, scan=cl.scan: done.append(len(sets)) or scan(points, sets))
    sem.cluster(sem.as_vectors(points[1]), "id", range(2, 8), 10)
    assert len(done) < 40 and done[0] == 60 and sorted(done, reverse=True) == done


@pytest.mark.parametrize(("n", "width"), [(0, 4), (1, 4), (2, 4), (5, 12), (5, 3), (40, 4)])
def test_clusters_of_few_rows_and_narrow_vectors(spark, n, width):
    rng = np.random.default_rng(n)
    df = sem.as_vectors(spark.createDataFrame([(i, rng.normal(size=width).tolist()) for i in range(n)], "id long, embedding array<double>"))
    placed, scores = sem.cluster(df, "id", range(3, 7), 2)
    assert [r["k"] for r in scores.orderBy("k").collect()] == [k for k in range(3, 7) if k < n]
    assert sorted(r["id"] for r in placed.collect()) == list(range(n)) and (n > 3 or {r["cluster"] for r in placed.collect()} <= {0})
    assert sem.embedding_map(df, "id", 1).count() == n


def test_components_are_numpys(points):
    x, df = points
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    got = np.array([r["v"] for r in sem.reduced(sem.as_vectors(df), 2).orderBy("id").select(vector_to_array("reduced").alias("v")).collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_clusters_are_the_separate_groups(points):
    _, df = points
    placed, scores = sem.cluster(sem.as_vectors(df), "id", range(2, 5), 3, dims=3)
    got = [r["cluster"] for r in placed.orderBy("id").collect()]
    assert all(len(set(got[a : a + 40])) == 1 for a in (0, 40, 80)) and len(set(got)) == 3
    assert max(scores.collect(), key=lambda r: r["silhouette"])["k"] == 3


def test_systematic_sample(spark):
    ids = [i * i % 1009 for i in range(500)]
    rows = spark.createDataFrame([(i,) for i in sorted(set(ids))], "id long").repartition(7)
    for step in (1, 3, 50, 10_000):
        assert sorted(r["id"] for r in sem.every_nth(rows, "id", step).collect()) == sorted(set(ids))[::step]
    assert sem.every_nth(rows.limit(0), "id", 3).count() == 0


def test_names_and_keywords_look_at_everything(spark):
    """A title far down the list, and a keyword behind hundreds of overlapping terms, are found."""
    n = 70
    titles = spark.createDataFrame([(c, f"title {t:03d}", 1000 - t) for c in range(n) for t in range(n)], "cluster int, title string, n long")
    sizes = spark.createDataFrame([(c, 1000 - c) for c in range(n)], "cluster int, size long")
    words = spark.createDataFrame([(0, ["spark"])], "cluster int, keywords array<string>")
    assert sem.assign_names(sizes, titles, words) == {c: f"Title {c:03d}" for c in range(n)}
    scores = spark.createDataFrame([(1, f"ab{'c' * i}", 1000.0 - i) for i in range(400)] + [(1, "zz", 1.0)], "cluster int, term string, score double")
    assert sem.keywords(scores).head()["keywords"] == ["ab", "zz"]
    few = spark.createDataFrame([(0, "one", 1), (1, "two", 5)], "cluster int, title string, n long")
    assert sem.assign_names(sizes.where("cluster < 2"), few, words) == {0: "Spark", 1: "Two"}


def test_encoders_give_unit_vectors(spark):
    rows = spark.createDataFrame([("a", "Data engineer, data platform"), ("b", "data engineers"), ("c", ""), ("d", None)], "print string, text string")
    got = {r["print"]: np.array(r["embedding"]) for r in hashed_words(64)(rows).collect()}
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-6 and not got["c"].any() and not got["d"].any() and got["a"] @ got["b"] > 0.3

    def load():
        def vectors_of(texts):
            assert len(texts) <= 3
            return [[len(t), 3.0] for t in texts]

        return vectors_of

    out = {r["print"]: r["embedding"] for r in model(load, 3)(rows.repartition(1)).collect()}
    assert abs(np.linalg.norm(out["b"]) - 1) < 1e-6 and out["d"] == [0.0, 1.0]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(unit(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in v] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_orders(spark):
    series = spark.createDataFrame([("a", "2", 0.1), ("b", "1", 0.4), ("a", "1", 0.2), ("b", "2", 0.3)], "value string, month string, share double")
    assert [(r["value"], r["month"]) for r in vw.by_summed_share(series).collect()] == [("b", "1"), ("b", "2"), ("a", "1"), ("a", "2")]
    found = spark.createDataFrame([(1, 50, 2.0), (2, 60, 9.0), (3, 70, 2.0)], "cluster int, n long, rmst double")
    assert [r["cluster"] for r in vw.by_rmst(found).collect()] == [2, 3, 1]
    fits = spark.createDataFrame([(s, float(s), 2.0 * s, 0.1 * s) for s in range(1, 6)], "seed long, median_true double, mean_true double, share double")
    assert {r["what"]: (r["mid"], r["least"], r["most"]) for r in cal.seed_spread(fits).collect()}["mean_true"] == (6.0, 2.0, 10.0)


def test_run_with_clusters(spark, db, tmp_path):  # noqa: F811
    run = full_run.Run(*read_panel(spark, db, "sqlite"), grace=3)
    calls = [run.vectors(str(tmp_path / "cache")).count() for _ in range(2)]
    assert calls[0] == calls[1] == run.best.count()
    more = run.semantic(run.vectors(str(tmp_path / "cache")), ks=range(2, 4), starts=2)
    doc = json.loads(json.dumps(full_run.document(run, more)))
    names = {r["name"] for r in doc["clusters"]}
    assert sum(r["size"] for r in doc["clusters"]) == calls[0] and [r["size"] for r in doc["clusters"]] == sorted((r["size"] for r in doc["clusters"]), reverse=True)
    assert {r["group"] for r in doc["weekly"]} <= names | {"Other"} and {r["cluster"] for r in doc["longest"]} <= names | {""}
    assert len(doc["map"]) == calls[0] and {"x", "y", "cluster", "title", "company", "days"} <= set(doc["map"][0])
    shares = [r["last_share"] for r in doc["skill_index_mentions"]]
    assert shares == sorted(shares, reverse=True) and [r["age_from"] for r in doc["detection_by_age"]] == sorted(r["age_from"] for r in doc["detection_by_age"])
    assert [(r["group"], r["week"]) for r in doc["weekly"]] == sorted((r["group"], r["week"]) for r in doc["weekly"])
    assert doc["classifier"][0]["n_other"] >= 0 and "rescue_rate" in doc["classifier"][0]


def test_panel_is_found(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert full_run.panel_path(None) is None and full_run.panel_path("none.db") is None and full_run.main(["--out", "x"]) == 2
    (tmp_path / "data").mkdir()
    (tmp_path / "data/jobs.db").touch()
    assert full_run.panel_path(None) == "data/jobs.db" and full_run.panel_path("hdfs://x/y") == "hdfs://x/y"
