"""How often a live entity is seen: by age, and as a two-state chain. Closed forms; no day is made a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import false_delisting, odds_ratio, stationary

EDGES = (0, 1, 7, 14, 30, 60, 90, 1_000_000)
GRACES = (1, 3, 7, 14, 21, 28)


def histories(seen: DataFrame, min_span: int) -> DataFrame:
    """(key, lo, span) of keys seen at least twice over at least `min_span` runs."""
    h = seen.groupBy("key").agg(F.min("run_idx").alias("lo"), (F.max("run_idx") - F.min("run_idx")).alias("span"), F.count("*").alias("n"))
    return h.where((F.col("n") >= 2) & (F.col("span") >= min_span)).select("key", "lo", "span")


def detection_curve(seen: DataFrame, runs: DataFrame, min_span: int = 3) -> DataFrame:
    """(age, detected, trials, rate) for ages 0 to the number of runs."""
    h = histories(seen, min_span)
    hits = seen.join(h, "key").groupBy((F.col("run_idx") - F.col("lo")).alias("age")).agg(F.count("*").alias("detected"))
    # an age is tried by all histories that span it: a histogram, summed from its end
    spans = h.groupBy(F.col("span").alias("age")).agg(F.count("*").alias("ends"))
    ages = runs.agg(F.explode(F.sequence(F.lit(0), F.count("*").cast("int"))).alias("age"))
    grid = ages.join(hits, "age", "left").join(spans, "age", "left").na.fill(0, ["detected", "ends"])
    trials = F.sum("ends").over(Window.orderBy(F.desc("age")).rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("trials", trials).select("age", "detected", "trials", F.coalesce(F.try_divide(F.col("detected").cast("double"), "trials"), F.lit(0.0)).alias("rate"))


def detection_binned(curve: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """Rates by bins of age, closed at the left; empty bins are left out."""
    lo = F.lit(None)
    for a in reversed(edges[:-1]):
        lo = F.when(F.col("age") >= a, F.lit(a)) if a == edges[-2] else F.when((F.col("age") >= a) & (F.col("age") < edges[edges.index(a) + 1]), F.lit(a)).otherwise(lo)
    label = F.lit(None)
    for a, b in zip(edges, edges[1:], strict=False):
        text = str(a) if b - a == 1 else f"{a}+" if b >= 1_000_000 else f"{a}-{b - 1}"
        label = F.when(F.col("age_from") == a, text).otherwise(label)
    by = curve.withColumn("age_from", lo).groupBy("age_from").agg(F.sum("detected").alias("detected"), F.sum("trials").alias("trials")).where("trials > 0")
    return by.select(label.alias("label"), "age_from", "detected", "trials", (F.col("detected") / F.col("trials")).alias("rate"))


def overall(curve: DataFrame, min_trials: int = 40) -> DataFrame:
    """(marginal, worst_case): the rate in all, and the least positive rate of ages with enough trials."""
    marginal = F.coalesce(F.try_divide(F.sum("detected").cast("double"), F.sum("trials")), F.lit(0.0))
    worst = F.min(F.when((F.col("trials") >= min_trials) & (F.col("detected") > 0), F.col("detected") / F.col("trials")))
    return curve.agg(marginal.alias("marginal"), F.coalesce(worst, marginal).alias("worst_case"))


def markov_fit(seen: DataFrame, min_span: int = 4) -> DataFrame:
    """One row: the chance of being seen after a run seen and after a run missed, and what follows from them.

    Of a gap g between sightings, the first day is a step after a sighting and the others are steps after a miss.
    """
    w = Window.partitionBy("key").orderBy("run_idx")
    gaps = seen.join(histories(seen, min_span), "key").withColumn("gap", F.col("run_idx") - F.lag("run_idx").over(w))
    n = gaps.agg(
        F.count("gap").alias("sn"),
        F.count_if(F.col("gap") == 1).alias("ss"),
        F.coalesce(F.sum(F.col("gap") - 1), F.lit(0)).alias("hn"),
        F.count_if(F.col("gap") > 1).alias("hs"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = n.withColumns({"p_stay_visible": rate("ss", "sn"), "p_become_visible": rate("hs", "hn")})
    stay, become = F.col("p_stay_visible"), F.col("p_become_visible")
    return out.select("sn", "ss", "hn", "hs", stay, become, stationary(stay, become).alias("stationary"), odds_ratio(stay, become).alias("odds_ratio"), (F.col("sn") + F.col("hn")).alias("n_transitions"))


def grace_table(curve: DataFrame, markov: DataFrame, graces: tuple[int, ...] = GRACES) -> DataFrame:
    """(grace_days, false_rate_independent, false_rate_markov)."""
    ks = curve.sparkSession.createDataFrame([(k,) for k in graces], "grace_days int")
    both = ks.crossJoin(F.broadcast(overall(curve))).crossJoin(F.broadcast(markov))  # rows of constants
    return both.select("grace_days", false_delisting(F.col("marginal"), F.col("grace_days")).alias("false_rate_independent"), false_delisting(F.col("p_become_visible"), F.col("grace_days")).alias("false_rate_markov"))
