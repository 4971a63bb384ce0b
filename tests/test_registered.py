"""Registered queries do the operators' whole job."""

import inspect
import re

from pyspark.sql import functions as F

from tenura.operators import calibrate as cal
from tenura.operators import semantic as sem
from tenura.plans import queries


def test_calibrations_run_the_whole_search(monkeypatch):
    done = {}
    monkeypatch.setattr(queries, "instrument", lambda spark, d: ({}, [0.5], 0.7, 30))
    for name in ("calibrate", "evaluate"):
        monkeypatch.setattr(cal, name, lambda *a, to=name, sig=inspect.signature(getattr(cal, name)), **k: done.update({to: sig.bind(*a, **k)}) or done[to].apply_defaults())
    queries.calibrated(None, "")
    queries.simulate_moments(None, "")
    assert done["calibrate"].arguments["seeds"] == cal.SEEDS and done["calibrate"].arguments["n_sim"] == 6000
    assert done["evaluate"].arguments["points"] == cal.coarse_grid((42,)) and done["evaluate"].arguments["n_sim"] == 6000


def test_clusters_try_every_k_from_every_start(monkeypatch):
    done, sig = [], inspect.signature(sem.cluster)
    monkeypatch.setattr(queries, "vectors", lambda spark, d: None)
    monkeypatch.setattr(sem, "cluster", lambda *a, **k: done.append(sig.bind(*a, **k)) or (None, None))
    queries.clusters(None, "")
    done[0].apply_defaults()
    assert (done[0].arguments["ks"], done[0].arguments["starts"]) == (range(6, 17), 10)


def test_keywords_read_unaltered_texts(spark, tmp_path):
    text = "réeux réeux réeux naïf c++1 plain word_ cat"
    spark.createDataFrame([(1, "fr", text), (2, "de", text)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["cluster"]: sorted(r["keywords"]) for r in queries.ctfidf_keywords(spark, str(tmp_path)).collect()} == {c: ["c++", "cat", "plain"] for c in ("fr", "de")}


def test_pairs_straddle_the_ends_of_texts(spark):
    rows = [(i, g, t) for i, (g, t) in enumerate([("a", "one two"), ("b", "one"), ("a", ""), ("a", "three"), ("b", "two three"), ("a", None), ("-1", "one two"), ("a", "one two"), (None, "x y")])] + [(100 + i, "a", "and so") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(7)
    tf, groups = sem.term_counts(df, "g", "t", "id")
    got = {(r["cluster"], r["term"]): r["n"] for r in tf.collect()}
    assert {k: n for k, n in got.items() if k[0] == "b"} == {("b", "one"): 1, ("b", "two"): 1, ("b", "three"): 1, ("b", "one two"): 1, ("b", "two three"): 1}
    assert [got["a", t] for t in ("one two", "two three", "three one", "two and", "so and", "and so")] == [2, 1, 1, 1, 299, 300] and groups.head()["c"] == 2


def test_edges_of_words_know_every_script(spark):
    cases = {"réeux naïf c++1 word_ cat": ["c++", "cat"], "xü üx ab–cd ab²": ["ab", "cd"], "a.b. c# (go) x-": ["a.b", "go"], "Ünder the ΑΒ-test": ["the", "test"]}
    found = spark.createDataFrame([(t,) for t in cases], "t string").select("t", sem.tokens(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in found} == {t: re.findall(r"(?u)\b[a-zA-Z][a-zA-Z+#./-]{1,}\b", t.lower()) for t in cases}
