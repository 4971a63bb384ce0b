"""The whole run on a handmade panel in SQLite, and streamed against batch spells."""

import json
import sqlite3
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tenura.operators import panel as pn
from tenura.plans.full_run import document, main
from tenura.sources.cache import encoded
from tenura.sources.sections import read_section
from tenura.sources.sqlite import read_sqlite
from tenura.streaming.spells import closed_spells


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "panel.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE scrape_runs (id INTEGER, run_date TEXT)")
    con.execute("CREATE TABLE jobs (run_id INTEGER, title TEXT, company TEXT, url TEXT, category TEXT, seniority TEXT, sector TEXT, remote TEXT, skills TEXT, description TEXT, extra TEXT)")
    for i in range(20):
        con.execute("INSERT INTO scrape_runs VALUES (?, ?)", (i, str(date(2026, 1, 1) + timedelta(days=i))))
    con.execute("INSERT INTO scrape_runs VALUES (99, '2026-01-01')")
    rows = [(99, "(hybrid)", "x", None, None, None, None, None, None, None, None), (77, "Lost run", "x", None, None, None, None, None, None, None, None)]
    for k in range(12):
        for i in range(k, 20, 1 + k % 4):
            text = "lorem ipsum" if k == 3 else "We use Spark" * (k % 3)
            rows.append((i, f"Data Engineer {k}", "ACME B.V.", f"u{i % 2}", "data-engineer" if k % 2 else "other", "mid", "it", "yes", "Spark, SQL,,Spark" if k % 2 else "", text, None))
    con.executemany("INSERT INTO jobs VALUES (?,?,?,?,?,?,?,?,?,?,?)", rows)
    con.commit()
    return str(path)


def test_source_prunes_and_numbers(spark, db):
    df = read_sqlite(spark, db, "jobs", ["run_id", "title"])
    assert df.columns == ["run_id", "title", "seq"] and df.count() == df.select("seq").distinct().count() > 50


def test_document(spark, db, tmp_path):
    out = tmp_path / "data.json"
    assert main(["--db", db, "--out", str(out), "--grace", "3", "--no-calibration", "--cache", str(tmp_path / "vectors")]) == 0
    doc = json.loads(out.read_text())
    # texts are encoded and clustered without being asked for
    whole = {"clusters", "clustering", "silhouette_by_k", "survival_by_cluster", "survival_curves_by_cluster", "classifier", "per_class", "rescued_breakdown", "map"}
    whole |= {f"{s}_{b}" for s in ("months", "universe", "skill_index", "skill_shares") for b in ("adverts", "mentions")}
    assert whole <= set(doc)
    assert doc["classifier"][0]["threshold"] == 0.6 and doc["detection"][0]["grace_chosen"] == 3 and doc["clustering"][0]["k"] == len(doc["clusters"])
    assert doc["universe_adverts"][0]["n_all"] == doc["relevance_filter"][0]["n_kept"] and sum(c["size"] for c in doc["clusters"]) == 11  # one identity is a placeholder
    meta = doc["panel"][0]
    assert meta["n_runs"] == 20 and meta["n_identities"] == 12 and meta["placeholder_spells_dropped"] >= 1
    assert {r["grace"] for r in doc["grace_sensitivity"]} == {1, 3, 7, 14, 21}
    assert doc["relevance_filter"][0]["n_in"] == doc["relevance_filter"][0]["n_kept"] + doc["relevance_filter"][0]["n_dropped"]
    assert doc["longest"] and doc["survival_overall"] and doc["weekly"]


def test_a_document_from_committed_sections_is_the_same(spark, tmp_path):
    class Stub:
        def sections(self):
            return {"one": spark.range(3).selectExpr("id", "id / 3 AS share", "date'2026-01-02' AS day"), "none": spark.range(0)}

    plain, committed = document(Stub()), document(Stub(), {"more": spark.range(1)}, str(tmp_path))
    assert [committed[s] for s in ("one", "none")] == [plain[s] for s in ("one", "none")] and committed["more"] == [{"id": 0}]
    assert [r["id"] for r in read_section(str(tmp_path), "one")] == [0, 1, 2]


@pytest.mark.parametrize("grace", [1, 3])
def test_streamed_spells_are_the_closed_ones(spark, tmp_path, grace):
    rows = [(k, i) for k in "abcdef" for i in range(25) if (i * (ord(k) - 90)) % 7 < 3]
    seen = spark.createDataFrame(rows, "key string, run_idx int")
    for i in range(25):  # one file a run, read in order
        seen.where(F.col("run_idx") == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    stream = spark.readStream.schema("key string, run_idx int").option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = closed_spells(stream, grace).writeStream.format("memory").queryName(f"closed{grace}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table(f"closed{grace}").select("key", "start_idx", "last_seen_idx", "sightings").collect()}
    runs = spark.sql("SELECT CAST(id AS INT) AS run_idx, date_add(date '2026-01-01', CAST(id AS INT)) AS run_date FROM range(25)")
    want = {tuple(r) for r in pn.spells(seen, runs, [grace]).where("observed_event").select("key", "start_idx", "last_seen_idx", "sightings").collect()}
    assert got == want


def test_cache_encodes_once(spark, tmp_path):
    calls = []

    def encode(rows):
        calls.append(rows.count())
        return rows.select("print", F.array(F.length("text").cast("float")).alias("embedding"))

    rows = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    for _ in range(2):
        out = encoded(rows, "text", str(tmp_path / "cache"), "m1", encode).collect()
    assert sorted(r["embedding"][0] for r in out) == [1.0, 1.0, 2.0] and calls == [2, 0]
