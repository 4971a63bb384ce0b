"""Weekly inflow, stock and skill shares, trimmed to the range of complete weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_WEEK = 5


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_axis(runs: DataFrame, full: int = FULL_WEEK) -> DataFrame:
    """(week, kept): weeks of runs; kept from the first to the last with `full` run dates (all, if none has)."""
    weeks = runs.groupBy(iso_week(F.col("run_date")).alias("week")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    complete = F.when(F.col("n") >= full, F.col("week"))
    lo, hi = F.coalesce(F.min(complete).over(every), F.min("week").over(every)), F.coalesce(F.max(complete).over(every), F.max("week").over(every))
    return weeks.select("week", F.col("week").between(lo, hi).alias("kept"))


def spell_groups(spelled: DataFrame, group_of: DataFrame | None, default: str | None = None) -> DataFrame:
    """Spells with `group`, by key; without a group they take `default`, or are left out if there is none."""
    if group_of is None:
        return spelled
    out = spelled.join(group_of, "key", "left" if default is not None else "inner")
    return out.withColumn("group", F.coalesce("group", F.lit(default))) if default is not None else out


def weekly_series(spelled: DataFrame, runs: DataFrame) -> DataFrame:
    """(group, week, inflow, stock, inflow_share) of spells (group, start_idx, last_seen_idx), on the full grid of kept weeks.

    A spell is stock of each week from its first to its last, as far as weeks have runs. A sweep over the weeks adds it at
    its first week and takes it away after its last, so a spell is two numbers, however long it is.
    """
    weeks = week_axis(runs).withColumn("no", F.row_number().over(Window.orderBy("week")))  # a row a week
    axis = runs.select("run_idx", iso_week(F.col("run_date")).alias("week")).join(F.broadcast(weeks), "week").select("run_idx", "no")
    at = lambda c, name: F.broadcast(axis.select(F.col("run_idx").alias(c), F.col("no").alias(name)))  # noqa: E731  a row a run
    ranges = spelled.groupBy("group", "start_idx", "last_seen_idx").agg(F.count("*").alias("n")).join(at("start_idx", "first"), "start_idx").join(at("last_seen_idx", "last"), "last_seen_idx")
    comes = F.struct(F.col("first").alias("no"), F.col("n").alias("inflow"), F.col("n").alias("change"))
    goes = F.struct((F.col("last") + 1).alias("no"), F.lit(0).cast("long").alias("inflow"), (-F.col("n")).alias("change"))
    steps = ranges.select("group", F.explode(F.array(comes, goes)).alias("s")).groupBy("group", "s.no").agg(F.sum("s.inflow").alias("inflow"), F.sum("s.change").alias("change"))
    grid = spelled.select("group").distinct().crossJoin(F.broadcast(weeks))
    swept = grid.join(steps, ["group", "no"], "left").na.fill(0, ["inflow", "change"])
    stock = F.sum("change").over(Window.partitionBy("group").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    full = swept.withColumn("stock", stock).where("kept").select("group", "week", "inflow", "stock")
    total = F.sum("inflow").over(Window.partitionBy("week"))
    return full.withColumn("inflow_share", F.col("inflow") / F.when(total == 0, 1).otherwise(total))


def skill_trends(rows: DataFrame, runs: DataFrame, top_n: int = 12) -> DataFrame:
    """(skill, week, ord, n, total, share): shares of the most frequent skills among all new rows (run_date, skills) by week."""
    dated = rows.select(iso_week(F.col("run_date")).alias("week"), "skills")
    totals = dated.groupBy("week").agg(F.count("*").alias("total"))
    counts = dated.select("week", F.explode("skills").alias("skill")).groupBy("skill", "week").agg(F.count("*").alias("n"))
    top = counts.groupBy("skill").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "skill").limit(top_n).select("skill")
    weeks = week_axis(runs).where("kept").select("week").withColumn("ord", F.row_number().over(Window.orderBy("week")) - 1)
    grid = top.crossJoin(F.broadcast(weeks)).join(F.broadcast(totals), "week", "left").join(counts, ["skill", "week"], "left").na.fill(0, ["n", "total"])
    return grid.withColumn("share", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)).select("skill", "week", "ord", "n", "total", "share")


def trend_slopes(series: DataFrame, by: str = "skill") -> DataFrame:
    """(by, slope) per step of least squares; 0 with fewer than three points."""
    return series.groupBy(by).agg(F.when(F.count("*") >= 3, F.coalesce(F.regr_slope("share", F.col("ord").cast("double")), F.lit(0.0))).otherwise(0.0).alias("slope"))
