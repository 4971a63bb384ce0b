"""The demand index: monthly shares of skills with trend tests, and what is read off it.

`adverts` everywhere: (advert, month, company, seniority, sector, remote, skills ARRAY, described, duration, urls, ...).
What is computed by month or by skill is tiny; only counting runs over all adverts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import two_sided_sql, wilson
from ..functions.text import trimmed

MONTH_FLOOR, MENTION_FLOOR, SKILL_FLOOR, PAIR_FLOOR, SERIES_FLOOR, EMPLOYER_FLOOR = 60, 300, 40, 8, 25, 4
#: False discovery rate of the trend tests.
LEVEL = 0.05


def relevance(adverts: DataFrame, relevant: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept adverts, one row of counts, dropped employers with counts); those without a company count as `unknown`."""
    flagged = adverts.withColumn("relevant", relevant)
    counts = flagged.agg(F.count("*").alias("n_in"), F.count_if("relevant").alias("n_kept"), F.count_if(~F.col("relevant")).alias("n_dropped"), F.coalesce(F.avg((~F.col("relevant")).cast("double")), F.lit(0.0)).alias("dropped_share"))
    named = trimmed(F.coalesce(F.nullif("company", F.lit("")), F.lit("unknown")))
    dropped = flagged.where("not relevant").groupBy(named.alias("company")).agg(F.count("*").alias("n"))
    return flagged.where("relevant").drop("relevant"), counts, dropped


def top_dropped(dropped: DataFrame, n: int = 10) -> DataFrame:
    return dropped.orderBy(F.desc("n"), "company").limit(n)


def month_totals(adverts: DataFrame, basis: str = "adverts", floor: int | None = None) -> DataFrame:
    """(month, total, included, ord): described adverts by month, or their skill mentions; ord numbers included months from 0."""
    size = F.size("skills")
    seen = adverts.where("described")
    seen = seen.where(size > 0).groupBy("month").agg(F.sum(size).cast("long").alias("total")) if basis == "mentions" else seen.groupBy("month").agg(F.count("*").alias("total"))
    floor = floor if floor is not None else MENTION_FLOOR if basis == "mentions" else MONTH_FLOOR
    flagged = seen.withColumn("included", F.col("total") >= floor)
    return flagged.withColumn("ord", F.when(F.col("included"), F.row_number().over(Window.partitionBy("included").orderBy("month")) - 1))


def skill_shares(adverts: DataFrame, basis: str = "adverts", month_floor: int | None = None, skill_floor: int = SKILL_FLOOR) -> DataFrame:
    """(skill, month, ord, count, total, share, lo, hi) on the full grid of kept skills and included months."""
    months = month_totals(adverts, basis, month_floor).where("included").select("month", "ord", "total")
    counts = adverts.where("described").select("month", F.explode("skills").alias("skill")).groupBy("skill", "month").agg(F.count("*").alias("count")).join(F.broadcast(months), "month")
    kept = counts.groupBy("skill").agg(F.sum("count").alias("n")).where(F.col("n") >= skill_floor).select("skill")
    grid = kept.crossJoin(F.broadcast(months))  # skills over the floor by months
    full = grid.join(counts.select("skill", "month", "count"), ["skill", "month"], "left").na.fill(0, ["count"])
    lo, hi = wilson(F.col("count"), F.col("total"))
    return full.select("skill", "month", "ord", "count", "total", (F.col("count") / F.col("total")).alias("share"), lo.alias("lo"), hi.alias("hi"))


def trend_tests(shares: DataFrame) -> DataFrame:
    """(skill, first_share, last_share, change_pp, z, p, slope_pp, total_mentions): Cochran-Armitage over the months.

    The slope is of unweighted least squares over the shares; the z test weighs months by their totals. p has five
    decimals, as later decisions use it so.
    """
    n, t, r = (F.col(c).cast("double") for c in ("total", "ord", "count"))
    s = shares.groupBy("skill").agg(
        F.count("*").alias("periods"),
        F.sum(n).alias("n"),
        F.sum(r).alias("r"),
        F.sum(r * t).alias("rt"),
        F.sum(n * t).alias("nt"),
        F.sum(n * t * t).alias("ntt"),
        F.min_by("share", "ord").alias("first_share"),
        F.max_by("share", "ord").alias("last_share"),
        F.regr_slope("share", t).alias("slope"),
        F.sum("count").alias("total_mentions"),
    )
    q = F.col("r") / F.col("n")
    var = q * (1 - q) * (F.col("ntt") - F.col("nt") * F.col("nt") / F.col("n"))
    dull = (F.col("periods") < 3) | (F.col("n") == 0) | (F.col("r") == 0) | (F.col("r") == F.col("n"))
    s = s.withColumn("var", F.when(~dull, var)).withColumn("z", F.when(F.col("var") > 0, (F.col("rt") - q * F.col("nt")) / F.sqrt("var")).otherwise(0.0))
    tested = F.col("var") > 0
    p = F.when(tested, F.round(F.expr(two_sided_sql("z")), 5)).otherwise(1.0)
    return s.select("skill", "first_share", "last_share", ((F.col("last_share") - F.col("first_share")) * 100).alias("change_pp"), "z", p.alias("p"), F.when(tested, F.col("slope") * 100).otherwise(0.0).alias("slope_pp"), "total_mentions")


def multiplicity(tests: DataFrame, level: float = LEVEL) -> DataFrame:
    """Adds significant, fdr_robust (Benjamini-Hochberg) and bonferroni_robust to rows with p; tests are few."""
    every = Window.partitionBy()
    ranked = tests.withColumns({"rn": F.row_number().over(Window.orderBy("p", "skill")), "m": F.count("*").over(every)})
    cut = F.max(F.when(F.col("p") <= level * F.col("rn") / F.col("m"), F.col("p"))).over(every)
    out = ranked.withColumns({"significant": F.col("p") < level, "fdr_robust": F.coalesce(F.col("p") <= cut, F.lit(False)), "bonferroni_robust": F.col("p") < level / F.col("m")})
    return out.drop("rn", "m")


def skill_index(adverts: DataFrame, basis: str = "adverts", month_floor: int | None = None, skill_floor: int = SKILL_FLOOR) -> DataFrame:
    return multiplicity(trend_tests(skill_shares(adverts, basis, month_floor, skill_floor)))


def universe(adverts: DataFrame, index: DataFrame, basis: str) -> DataFrame:
    """One row on what an index stands on: (basis, n_tests, level, universe, n_universe, n_all)."""
    what = "skill mentions in described vacancies" if basis == "mentions" else "vacancies whose advert text was retrieved"
    counts = adverts.agg(F.count_if("described").alias("n_universe"), F.count("*").alias("n_all"))
    return index.agg(F.count("*").alias("n_tests")).select(F.lit(basis).alias("basis"), "n_tests", F.lit(LEVEL).alias("level"), F.lit(what).alias("universe")).crossJoin(counts)


def rank_movement(index: DataFrame) -> DataFrame:
    """(skill, rank_first, rank_last, move, share_first, share_last, significant); ranks go by shares of four decimals."""
    first, last = F.round("first_share", 4), F.round("last_share", 4)
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), F.desc("last_share"), "skill"))
    out = index.withColumns({"share_first": first, "share_last": last})
    out = out.withColumns({"rank_first": rank("share_first"), "rank_last": rank("share_last")})
    return out.select("skill", "rank_first", "rank_last", (F.col("rank_first") - F.col("rank_last")).alias("move"), "share_first", "share_last", "significant")


def top_skills(index: DataFrame, n: int = 14) -> DataFrame:
    return index.orderBy(F.desc("last_share"), "skill").limit(n).select("skill")


def cooccurrence(adverts: DataFrame, top: DataFrame, least: int = PAIR_FLOOR, most: int = 26) -> DataFrame:
    """(a, b, both, lift, given_a) of pairs of the top skills, a before b in their order; by lift of two decimals.

    Pairs are made within each advert's array, so nothing is joined with itself.
    """
    order = top.agg(F.array_sort(F.collect_list("skill")).alias("top"))  # at most some dozens
    sets = adverts.where("described").crossJoin(F.broadcast(order)).select(F.array_intersect("top", "skills").alias("s"))
    n = adverts.where("described").agg(F.count("*").alias("n"))
    single = sets.select(F.explode("s").alias("skill")).groupBy("skill").agg(F.count("*").alias("k"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    full = counts.join(F.broadcast(single.withColumnsRenamed({"skill": "a", "k": "ka"})), "a").join(F.broadcast(single.withColumnsRenamed({"skill": "b", "k": "kb"})), "b").crossJoin(F.broadcast(n))
    out = full.select("a", "b", "both", F.round(F.col("both") / (F.col("ka") * F.col("kb") / F.col("n")), 2).alias("lift"), (F.col("both") / F.col("ka")).alias("given_a"))
    return out.orderBy(F.desc("lift"), "a", "b").limit(most)


def composition(adverts: DataFrame, field: str, month_floor: int = MONTH_FLOOR, floor: int = SERIES_FLOOR) -> DataFrame:
    """(value, month, total, share) of a categorical attribute of all adverts; '' and unknown are left out."""
    v = F.lower(F.trim(F.coalesce(F.col(field), F.lit(""))))
    counts = adverts.select("month", v.alias("value")).where(~F.col("value").isin("", "unknown")).groupBy("value", "month").agg(F.count("*").alias("n"))
    totals = counts.groupBy("month").agg(F.sum("n").alias("total")).where(F.col("total") >= month_floor)
    kept = counts.groupBy("value").agg(F.sum("n").alias("all")).where(F.col("all") >= floor).select("value")
    grid = kept.crossJoin(F.broadcast(totals))
    return grid.join(counts, ["value", "month"], "left").select("value", "month", "total", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def top_employers(adverts: DataFrame, n: int = 14, least: int = EMPLOYER_FLOOR) -> DataFrame:
    """(company, vacancies, median_days, reposts): the upper median of durations, and mean urls.

    The median comes from counts by duration, not from lists of rows, so that a large employer is no large row.
    """
    by = adverts.select(F.trim(F.coalesce("company", F.lit(""))).alias("company"), "duration", "urls").where("company <> ''")
    counts = by.groupBy("company", "duration").agg(F.count("*").alias("k"), F.sum("urls").alias("u"))
    w = Window.partitionBy("company").orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy("company"))})
    out = placed.groupBy("company").agg(F.max("n").alias("vacancies"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("duration"))).alias("median_days"), (F.sum("u") / F.sum("k")).alias("reposts"))
    return out.where(F.col("vacancies") >= least).orderBy(F.desc("vacancies"), "company").limit(n)


def specificity(adverts: DataFrame, floor: int = MONTH_FLOOR) -> DataFrame:
    """(month, mean_skills, share_naming_none, n)."""
    k = F.size("skills")
    return adverts.where("described").groupBy("month").agg(F.avg(k).alias("mean_skills"), F.avg((k == 0).cast("double")).alias("share_naming_none"), F.count("*").alias("n")).where(F.col("n") >= floor)


def provider_shares(adverts: DataFrame, providers: list[str], floor: int = MONTH_FLOOR) -> DataFrame:
    """(provider, first_share, last_share, vacancies) of named skills, in the first and last included month."""
    uni = adverts.where("described")
    totals = uni.groupBy("month").agg(F.count("*").alias("total")).where(F.col("total") >= floor)
    ends = totals.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    named = uni.select("month", F.explode(F.array_intersect("skills", F.array(*map(F.lit, providers)))).alias("provider")).groupBy("provider", "month").agg(F.count("*").alias("n"))
    full = named.join(F.broadcast(totals), "month").crossJoin(F.broadcast(ends))
    share = lambda at: F.coalesce(F.max(F.when(F.col("month") == F.col(at), F.col("n") / F.col("total"))), F.lit(0.0))
    return full.groupBy("provider").agg(share("first").alias("first_share"), share("last").alias("last_share"), F.sum("n").alias("vacancies")).where("vacancies > 0")
