"""Filters within SQLite, sections committed as a whole, and a cache of vectors that survives stops and doubles."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tenura.sources import cache, sections
from tenura.sources.sqlite import SqliteReader, read_sqlite


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "t.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (k INTEGER, name TEXT, score REAL, day DATE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i % 50 if i % 7 else None, f"n{i % 13}é" if i % 5 else None, i / 3, f"2026-01-{i % 28 + 1:02d}") for i in range(1000)])
    con.commit()
    return path


CONDITIONS = ["k = 3", "k > 40 AND name = 'n4é'", "k IN (1, 2, 60)", "name IS NULL", "name IS NOT NULL AND k <= 2", "NOT k = 5", "name LIKE 'n1%'", "name LIKE '%2%'", "k <=> NULL", "k <=> 4", "name > 'n5'", "seq < 30", "score > 100.5", "day = '2026-01-05'", "k = 1 OR name = 'n2é'", "NOT (name LIKE 'n1%')", "name LIKE '%9é'", "k NOT IN (1, 2)"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_mean_the_same_in_either_place(spark, db, condition):
    df = read_sqlite(spark, db, "t")
    rows = lambda d: sorted(map(str, d.collect()))
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert rows(df.where(condition)) == rows(plain.where(condition))


def test_filters_reach_sqlite(spark, db):
    from pyspark.sql import datasource as ds

    reader = SqliteReader({"path": db, "table": "t"}, ["k", "name", "seq"], {"k", "name", "seq"})
    other = ds.EqualTo(("score",), 1.0)
    assert list(reader.pushFilters([ds.EqualTo(("k",), 3), ds.Not(ds.IsNull(("name",))), other, ds.In(("seq",), (5, 12, 54))])) == [other]
    assert [sql for sql, _ in reader.where] == ['"k" = ?', 'NOT ("name" IS NULL)', "rowid IN (?, ?, ?)"]
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert got == [(3, "n1é", 54)]
    plan = read_sqlite(spark, db, "t", ["k"]).where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan


def test_sections_come_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    df = spark.range(100).selectExpr("id", "id / 4 AS share", "array(id, null) AS list", "named_struct('d', date'2026-01-02') AS day", "if(id = 3, null, 'é') AS name").repartitionByRange(5, "id")
    sections.write_section(df, path, "one")
    got = sections.read_section(path, "one")
    assert [r["id"] for r in got] == list(range(100)) and got[3] == {"id": 3, "share": 0.75, "list": [3, None], "day": {"d": "2026-01-02"}, "name": None}
    broken = df.withColumn("share", F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("share")))
    for name in ("one", "two"):
        with pytest.raises(Exception, match="stop"):
            sections.write_section(broken, path, name)
    assert sections.read_section(path, "one") == got and sections.read_section(path, "two") == []
    assert sorted(f for f in os.listdir(path) if not f.startswith("one-")) == ["one.json"] and len(os.listdir(path)) == 2
    sections.write_section(df.where("id < 2"), path, "one")
    assert len(sections.read_section(path, "one")) == 2 and len(os.listdir(path)) == 2
    sections.write_section(df.limit(0), path, "none")
    assert sections.manifest(path, "none")["rows"] == 0


def lengths(calls):
    def encode(rows):
        calls.append(sorted(r["text"] or "" for r in rows.collect()))
        return rows.select("print", F.array(F.length(F.coalesce("text", F.lit(""))).cast("float")).alias("embedding"))

    return encode


def test_cache_encodes_each_text_once(spark, tmp_path):
    path, calls = f"{tmp_path}/vectors", []
    rows = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, None), (5, "")], "id long, text string")
    for _ in range(2):
        got = cache.encoded(rows, "text", path, "m", lengths(calls))
        assert sorted((r["id"], r["embedding"]) for r in got.collect()) == [(1, [2.0]), (2, [3.0]), (3, [2.0]), (4, [0.0]), (5, [0.0])]
    more = rows.unionByName(spark.createDataFrame([(6, "new")], "id long, text string"))
    assert cache.encoded(more, "text", path, "m", lengths(calls)).count() == 6
    cache.encoded(rows, "text", path, "other model", lengths(calls)).count()
    assert calls == [["", "ab", "abc"], [], ["new"], ["", "ab", "abc"]]


def test_cache_survives_doubles_and_stopped_writes(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    prints = rows.select(cache.fingerprint(F.col("text"), "m").alias("print"))
    for v in (1.0, 7.0):  # two writers, who did not know of each other
        cache.commit(prints.withColumn("embedding", F.array(F.lit(v))), path)
    with pytest.raises(Exception, match="stop"):
        cache.commit(prints.withColumn("embedding", F.array(F.raise_error(F.lit("stop")).cast("float"))), path)
    os.makedirs(f"{path}/_staged-left-by-a-lost-driver")
    calls = []
    got = cache.encoded(rows, "text", path, "m", lengths(calls)).collect()
    assert sorted((r["id"], r["embedding"]) for r in got) == [(1, [7.0]), (2, [7.0])] and calls == [[]]
    assert len([f for f in os.listdir(path) if f.startswith("_staged")]) == 1


def test_a_broken_cache_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    os.makedirs(f"{path}/batch-1/prefix=ab")
    with open(f"{path}/batch-1/prefix=ab/part-0.parquet", "w") as f:
        f.write("no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        cache.encoded(spark.createDataFrame([(1, "x")], "id long, text string"), "text", path, "m", lengths([])).collect()
