"""What the driver holds while near duplicates are searched: small blocks of a filter, and nothing of finished steps."""

from pyspark.sql import functions as F

from tenura.llm import common
from tenura.llm.common import FILTER_BLOCK, FILTER_WORDS, filtered, relieve


def test_a_full_filter_is_broadcast_in_few_rows(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(common.F, "broadcast", lambda df, f=F.broadcast: sent.append(df) or f(df))
    rows = spark.range(0, 1_200_000).withColumn("likely_block", F.lit("mine"))
    wanted = spark.range(0, 900_000).select(F.col("id").alias("k"))
    out = filtered(rows, [F.col("id")], wanted, "likely")
    assert out.columns == ["id", "likely_block", "likely"]
    found = out.groupBy((F.col("id") < 900_000).alias("wanted"), "likely").count().collect()
    n = {(r["wanted"], r["likely"]): r["count"] for r in found}
    assert (True, False) not in n and n[True, True] == 900_000 and n[False, False] > 0.9 * 300_000
    (made,) = sent  # a row of 8 bytes for each of its words took 10.5 MB, several times over
    assert made.count() <= FILTER_WORDS // FILTER_BLOCK == 256


def test_a_filter_of_few_keys_or_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (-5, "d")], "id long, x string")
    likely = lambda ids: {r["x"] for r in filtered(rows, [F.col("id")], spark.createDataFrame([(i,) for i in ids], "k long"), "likely").where("likely").collect()}
    assert likely([]) == set() and likely([2, -5]) == {"b", "d"}


def test_relieving_the_driver_collects_in_both_languages_and_keeps_cached_rows(spark):
    kept = spark.range(10).cache()
    assert kept.count() == 10
    times = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = times()
    relieve(spark)
    assert times() > before and kept.count() == 10
