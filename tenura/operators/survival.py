"""Kaplan-Meier curves, their summaries, and log-rank tests, as grouped aggregates and windows over distinct times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import Z95, chi2_tail_sql


def event_table(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., t, total, d): observations (duration, observed_event) by time; the only step over all rows."""
    return obs.groupBy(*by, F.col("duration").alias("t")).agg(F.count("*").alias("total"), F.count_if("observed_event").alias("d"))


def km_curve(obs: DataFrame, by: list[str], z: float = Z95) -> DataFrame:
    """(by..., t, at_risk, d, s, lower, upper), bands from Greenwood's variance on the log-log scale."""
    ahead = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    until = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = event_table(obs, by).withColumn("at_risk", F.sum("total").over(ahead))
    n, d = F.col("at_risk"), F.col("d")
    table = table.withColumn("s", F.product((1 - d / n).cast("double")).over(until))
    table = table.withColumn("g", F.sum(F.when(n > d, d / (n * (n - d)).cast("double")).otherwise(0.0)).over(until))
    s, g = F.col("s"), F.col("g")
    inner = (s > 0) & (s < 1)
    log_s = F.ln(F.when(inner, s))
    width = z * F.sqrt(g) / F.abs(log_s)
    band = lambda sign: F.when(inner, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(s, F.exp(sign * width))))).otherwise(s)
    return table.select(*by, "t", "at_risk", "d", "s", band(1).alias("lower"), band(-1).alias("upper"))


def km_summary(curve: DataFrame, by: list[str], horizon: int = 90) -> DataFrame:
    """(by..., p25, median, p75, rmst): first times by which 25, 50, 75 % are gone (null if never), and the area up to `horizon`."""
    w = Window.partitionBy(*by).orderBy("t")
    steps = curve.withColumns({"s0": F.lag("s", 1, 1.0).over(w), "t0": F.lag("t", 1, 0).over(w)})
    gone = lambda q: F.min(F.when(F.col("s") <= 1 - q, F.col("t")))
    inside = F.col("t") <= horizon
    out = steps.groupBy(*by).agg(
        gone(0.25).alias("p25"),
        gone(0.5).alias("median"),
        gone(0.75).alias("p75"),
        F.coalesce(F.sum(F.when(inside, F.col("s0") * (F.col("t") - F.col("t0")))), F.lit(0.0)).alias("area"),
        F.coalesce(F.max(F.when(inside, F.col("t"))), F.lit(0)).alias("last"),
        F.coalesce(F.max_by("s", F.when(inside, F.col("t"))), F.lit(1.0)).alias("s_last"),
    )
    return out.select(*by, "p25", "median", "p75", (F.col("area") + F.col("s_last") * (horizon - F.col("last"))).alias("rmst"))


def logrank_vs_rest(obs: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """(by..., group, observed, expected, variance, chi2, p) of each group against all other observations.

    The others are everything less the group, so no pair of groups is ever joined.
    """
    by = by or []
    own = event_table(obs.where(F.col(group).isNotNull()), [*by, group])
    times = own.groupBy(*by, "t").agg(F.sum("total").alias("all_total"), F.sum("d").alias("all_d"))
    ahead = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    times = times.withColumn("n", F.sum("all_total").over(ahead)).where("all_d > 0 and n >= 2").drop("all_total")
    groups = own.select(*by, group).distinct()
    grid = groups.join(times, by) if by else groups.crossJoin(times)  # groups by distinct times, both few
    risk = own.select(*by, group, "t", "total", "d").unionByName(grid.select(*by, group, "t", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("d")))
    risk = risk.groupBy(*by, group, "t").agg(F.sum("total").alias("total"), F.sum("d").alias("d"))
    risk = risk.withColumn("n1", F.sum("total").over(Window.partitionBy(*by, group).orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    both = grid.join(risk, [*by, group, "t"])
    n, n1, d = (F.col(c).cast("double") for c in ("n", "n1", "all_d"))
    out = both.groupBy(*by, group).agg(
        F.sum("d").alias("observed"),
        F.sum(d * n1 / n).alias("expected"),
        F.sum(d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).alias("variance"),
    )
    chi2 = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance")).otherwise(0.0)
    return out.withColumn("chi2", chi2).withColumn("p", F.expr(chi2_tail_sql("chi2")))


def grace_sensitivity(spelled: DataFrame, markov: DataFrame, horizon: int = 90) -> DataFrame:
    """(grace, n, median, rmst, false_delisting_markov) over spells of several grace periods: one plan for all."""
    kept = spelled.where("not left_censored")
    summary = km_summary(km_curve(kept, ["grace"]), ["grace"], horizon)
    n = kept.groupBy("grace").agg(F.count("*").alias("n"))
    out = n.join(summary, "grace").crossJoin(F.broadcast(markov.select("p_become_visible")))  # one row
    return out.select("grace", "n", "median", "rmst", F.pow(1 - F.col("p_become_visible"), F.col("grace")).alias("false_delisting_markov"))


def observed_moments(spelled: DataFrame, by: list[str]) -> DataFrame:
    """(by..., single_share, median_span, p90_span, n) of spells that are not left-censored; groups are few, quantiles exact."""
    kept = spelled.where("not left_censored")
    counts = kept.groupBy(*by).agg(F.avg((F.col("sightings") == 1).cast("double")).alias("single_share"), F.count("*").alias("n"))
    spans = exact_quantiles(kept, "duration", [0.5, 0.9], by).select(*by, F.get("values", F.lit(0)).alias("median_span"), F.get("values", F.lit(1)).alias("p90_span"))
    return counts.join(F.broadcast(spans), by).select(*by, "single_share", "median_span", "p90_span", "n")


def by_cluster(spelled: DataFrame, assigned: DataFrame, least: int = 40, horizon: int = 90) -> DataFrame:
    """(cluster, n, median, rmst, chi2, p) of clusters with `least` spells; the small ones stay in everyone's rest."""
    obs = spelled.join(assigned.select("key", "cluster"), "key")
    n = obs.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    summary = km_summary(km_curve(obs, ["cluster"]), ["cluster"], horizon).select("cluster", "median", "rmst")
    return n.join(summary, "cluster").join(logrank_vs_rest(obs, "cluster").select("cluster", "chi2", "p"), "cluster")



def curves_by_cluster(spelled: DataFrame, assigned: DataFrame, least: int = 40) -> DataFrame:
    """(cluster, t, at_risk, d, s) of clusters with `least` spells: the steps of each one's survival."""
    obs = spelled.join(assigned.select("key", "cluster"), "key")
    large = obs.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
    return km_curve(obs.join(F.broadcast(large), "cluster"), ["cluster"]).select("cluster", "t", "at_risk", "d", "s")
