"""Views of the star-schema tables as panels and adverts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import run_axis, sightings
from .session import ship

#: Brands that stand for a fixed list of named providers.
PROVIDERS = [f"Brand#{i}" for i in range(1, 9)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_axis(table(spark, sf_dir, "events"), "ts")


def event_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return sightings(table(spark, sf_dir, "events"), event_runs(spark, sf_dir), key, "ts")


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as adverts: brands of their lines are skills, an order without lines is not described."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    by = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("p_brand")).alias("skills"), F.max("l_shipdate").alias("shipped"), F.count("*").cast("int").alias("urls"))
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    full = table(spark, sf_dir, "orders").join(buyers, "o_custkey").join(by, "o_orderkey", "left")
    return full.select(
        F.col("o_orderkey").alias("advert"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_orderdate").cast("date").alias("run_date"),
        F.col("c_name").alias("company"),
        F.col("o_orderpriority").alias("seniority"),
        F.col("c_mktsegment").alias("sector"),
        F.col("o_orderstatus").alias("remote"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        F.col("skills").isNotNull().alias("described"),
        F.coalesce(F.date_diff("shipped", "o_orderdate"), F.lit(0)).alias("duration"),
        F.coalesce("urls", F.lit(0)).alias("urls"),
    )
