"""Golden values of normalisers and statistics, and whole queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tenura.functions import text as tx
from tenura.functions.stats import wilson
from tenura.operators import market as mk
from tenura.operators import semantic as sem
from tenura.operators import trends as tr

DATA = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).head()[0]


@pytest.mark.parametrize(
    ("raw", "core"),
    [
        ("Senior Data Scientist (m/v/x) – Remote", "senior data scientist"),
        ("ML Engineer & MLOps [Amsterdam]", "ml engineer and mlops"),
        ("Café Manager, Full-Time", "cafe manager"),
        ("Vacature: AI-engineer", "ai engineer"),
        ("(hybrid)", ""),
        ("Renewal Analyst", "renewal analyst"),
        (None, ""),
    ],
)
def test_titles(spark, raw, core):
    assert one(spark, raw, tx.normalise_title) == core


@pytest.mark.parametrize(("raw", "core"), [("Philips Nederland B.V.", "philips"), ("Ørsted Group", "rsted"), ("Müller GmbH", "muller"), ("BV", "")])
def test_companies(spark, raw, core):
    assert one(spark, raw, tx.normalise_company) == core


@pytest.mark.parametrize(("title", "hit"), [("Data Engineer", True), ("AI lead", True), ("Data Scientist", False), ("Data Analyst", False), ("Data Engineers", False), ("A.I. lead", False), ("Statistician", False)])
def test_relevance(spark, title, hit):
    assert one(spark, title, lambda c: tx.is_relevant(F.lit(""), c, F.array())) is hit


def test_tokens(spark):
    assert one(spark, "c++ and c# or node.js ci/cd .net a big-data x1", sem.tokens) == ["and", "or", "node.js", "ci/cd", "net", "big-data"]


@pytest.mark.parametrize(("k", "n", "lo", "hi"), [(3, 200, 0.0051141, 0.0431665), (0, 50, 0.0, 0.07135), (50, 50, 0.92865, 1.0), (0, 0, 0.0, 0.0)])
def test_wilson(spark, k, n, lo, hi):
    r = spark.createDataFrame([(k, n)], "k int, n int").select(*wilson(F.col("k"), F.col("n"))).head()
    assert abs(r[0] - lo) < 5e-7 and abs(r[1] - hi) < 5e-7


@pytest.mark.parametrize(("counts", "totals", "z", "p", "slope"), [((10, 20, 30), (100,) * 3, 3.536, 0.00041, 10.0), ((30, 28, 25, 26, 20), (200, 210, 190, 205, 220), -1.74, 0.0819, -1.25), ((5, 9), (50, 50), 0, 1, 0), ((0, 0, 0), (9, 9, 9), 0, 1, 0)])
def test_trend(spark, counts, totals, z, p, slope):
    rows = [("s", i, c, t, c / t) for i, (c, t) in enumerate(zip(counts, totals, strict=True))]
    r = mk.trend_tests(spark.createDataFrame(rows, "skill string, ord int, count long, total long, share double")).head()
    assert (round(r["z"], 3), round(r["p"], 4 if p == 0.0819 else 5), round(r["slope_pp"], 2)) == (z, p, slope)


def test_step_up(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    out = mk.multiplicity(spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(ps)], "skill string, p double")).collect()
    assert {r["skill"] for r in out if r["fdr_robust"]} == {"s0", "s1"} and {r["skill"] for r in out if r["bonferroni_robust"]} == {"s0"}


def test_iso_week(spark):
    r = spark.sql("SELECT date '2026-01-01' AS a, date '2027-01-01' AS b").select(tr.iso_week(F.col("a")), tr.iso_week(F.col("b"))).head()
    assert tuple(r) == ("2026-W01", "2026-W53")


def test_keywords_do_not_overlap(spark):
    rows = spark.createDataFrame([("a", "alpha", 3.0), ("a", "alpha beta", 2.0), ("a", "gamma", 1.0)], "cluster string, term string, score double")
    assert sem.keywords(rows).head()["keywords"] == ["alpha", "gamma"]


def test_title_case_and_names(spark):
    titles = spark.createDataFrame([("x", "ai-engineer", 3), ("y", "ai-engineer", 2), ("y", "data lead", 1)], "cluster string, title string, n long")
    sizes = spark.createDataFrame([("x", 5), ("y", 3)], "cluster string, size long")
    words = spark.createDataFrame([("y", ["sql", "team", "etl"])], "cluster string, keywords array<string>")
    assert sem.assign_names(sizes, titles, words) == {"x": "Ai-Engineer", "y": "Sql / Etl"}


CHECKED = ["spell_split_k", "markov_fit", "km_by_type", "logrank_vs_rest", "composition_sector", "top_employers", "weekly_series", "trend_slope", "normalise_title", "identity_meta", "title_counts"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_against_sql(spark, name):
    from tenura.plans import oracles, queries

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    tidy = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy(tuple(r) for r in df.select(*columns).collect()) == tidy(want.fetchall())


def test_dropped_adverts_without_a_company_are_unknown(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, ""), (4, " "), (5, " x "), (6, "kept")], "advert int, company string")
    kept, counts, dropped = mk.relevance(df, F.col("advert") == 6)
    assert {r["company"]: r["n"] for r in mk.top_dropped(dropped).collect()} == {"unknown": 2, "x": 2, "": 1}
    assert kept.count() == 1 and counts.head()["n_dropped"] == 5


def test_months_out_of_the_index_and_its_universe_are_listed(spark):
    rows = [(i, f"2026-{1 + i % 3:02d}", ["a", "b"] if i % 2 else ["a"], i % 10 != 0) for i in range(200)] + [(900, "2026-09", ["a"], True)]
    df = spark.createDataFrame(rows, "advert int, month string, skills array<string>, described boolean")
    months = {r["month"]: (r["total"], r["included"]) for r in mk.month_totals(df).collect()}
    assert months == {f"2026-{m:02d}": (sum(i % 3 == m - 1 and i % 10 != 0 for i in range(200)), True) for m in (1, 2, 3)} | {"2026-09": (1, False)}
    index = mk.skill_index(df)
    assert mk.universe(df, index, "adverts").head().asDict() == {"basis": "adverts", "n_tests": 2, "level": 0.05, "universe": "vacancies whose advert text was retrieved", "n_universe": 181, "n_all": 201}
