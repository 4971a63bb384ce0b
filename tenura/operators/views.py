"""What pages show of the results: movers, both bases side by side, scaled bars, and middle values for colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def movers(index: DataFrame, robust: bool = False) -> DataFrame:
    """(skill, direction, slope_pp, kind) of risers, then fallers: those whose trend is significant, or robust only."""
    kept = index.where("fdr_robust" if robust else "significant")
    kind = F.when(F.col("fdr_robust"), "robust").otherwise("nominal").alias("kind")
    rises, falls = kept.where("slope_pp > 0"), kept.where("slope_pp < 0")
    return rises.select("skill", F.lit("riser").alias("direction"), "slope_pp", kind).unionByName(falls.select("skill", F.lit("faller").alias("direction"), "slope_pp", kind))


def both_bases(mentions: DataFrame, adverts: DataFrame) -> DataFrame:
    """(skill, mention_share, advert_share, mention_change, advert_change, relative_drop): by skill; null where adverts have none."""
    a = adverts.select("skill", F.col("last_share").alias("advert_share"), F.col("change_pp").alias("advert_change"), F.try_divide(F.col("first_share") - F.col("last_share"), F.col("first_share")).alias("relative_drop"))
    return mentions.select("skill", F.col("last_share").alias("mention_share"), F.col("change_pp").alias("mention_change")).join(a, "skill", "left")


def bars(rows: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The `n` largest rows with `width`, the value as a part of the largest."""
    return rows.orderBy(F.desc(value), *[c for c in rows.columns if c != value][:1]).limit(n).withColumn("width", F.try_divide(F.col(value).cast("double"), F.max(value).over(Window.partitionBy())))


def middle(rows: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """The value at place n/2 of the sorted list: of even counts, the upper one ascending and the lower one descending."""
    return rows.agg(F.get(F.sort_array(F.collect_list(value), asc=not descending), F.floor(F.count(value) / 2).cast("int")).alias("middle"))


def by_share(index: DataFrame) -> DataFrame:
    """Skills by last share, the largest first."""
    return index.orderBy(F.desc("last_share"), "skill")


def by_summed_share(series: DataFrame) -> DataFrame:
    """A composition's values by the sum of their shares, the largest first; months in order within each."""
    total = F.round(F.sum("share").over(Window.partitionBy("value")), 9)
    return series.withColumn("all_shares", total).orderBy(F.desc("all_shares"), "value", "month").drop("all_shares")


def by_rmst(clusters: DataFrame) -> DataFrame:
    """Clusters by restricted mean, the longest first; the larger of equals first."""
    return clusters.orderBy(F.desc("rmst"), F.desc("n"), "cluster")


def at_grace(sensitivity: DataFrame, grace: int = 1) -> DataFrame:
    """The row of one grace period, as pages compare it with the chosen one."""
    return sensitivity.where(F.col("grace") == grace)
