"""Runs, sightings, identities and spells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_if_null, is_placeholder, normalise_company, normalise_title, trimmed


def run_axis(dates: DataFrame, column: str = "run_date") -> DataFrame:
    """(run_idx, run_date): the distinct dates, numbered densely from 0. Dates are few, however many rows there are."""
    days = dates.select(F.col(column).cast("date").alias("run_date")).where("run_date is not null").distinct()
    return days.select((F.dense_rank().over(Window.orderBy("run_date")) - 1).cast("int").alias("run_idx"), "run_date")


def dated_runs(rows: DataFrame, runs: DataFrame, key: Column, date_col: str = "run_date") -> DataFrame:
    """(key, run_idx) of each row; rows of unknown dates or without a key are left out. Rows may be a stream."""
    dated = rows.select(key.alias("key"), F.col(date_col).cast("date").alias("run_date")).where("key is not null")
    return dated.join(runs, "run_date").select("key", "run_idx")


def sightings(rows: DataFrame, runs: DataFrame, key: Column, date_col: str = "run_date") -> DataFrame:
    """Distinct (key, run_idx); rows of unknown dates or without a key are left out."""
    return dated_runs(rows, runs, key, date_col).distinct()


def identity_key(title: Column, company: Column, url: Column | None = None, mode: str = "vacancy") -> Column:
    """Of an advert: normalised title@@company (null where the title has no core), or its url."""
    if mode == "url":
        return F.coalesce(F.nullif(url, F.lit("")), F.concat_ws("|", trimmed(title), trimmed(company)))
    core = normalise_title(trimmed(title))
    return F.when(core != "", F.concat(core, F.lit("@@"), normalise_company(trimmed(company))))


ATTRIBUTES = ("category", "seniority", "sector", "remote", "skills", "description")


def identities(rows: DataFrame) -> DataFrame:
    """One row for each `key` of rows (key, seq, title, company, url, category, seniority, sector, remote, skills, description).

    Attributes come from the row of the longest description, the first of equals; category is then the most frequent
    one that is neither empty nor `other` (ties: the least), if any; title and company are the first row's.
    """
    filled = rows.select("key", "seq", *(blank_if_null(F.col(c)).alias(c) for c in ("title", "company", "url", *ATTRIBUTES)))
    whole = filled.groupBy("key").agg(
        F.min_by(F.struct("title", "company"), "seq").alias("label"),
        F.max_by(F.struct(*ATTRIBUTES), F.struct(F.length("description"), -F.col("seq"))).alias("meta"),
        F.count_distinct("url").cast("int").alias("urls"),
    )
    counts = filled.where(~F.col("category").isin("", "other")).groupBy("key", "category").count()
    modes = counts.groupBy("key").agg(F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("mode"))
    out = whole.join(modes, "key", "left")
    return out.select("key", "label.*", F.coalesce("mode", "meta.category").alias("category"), *(f"meta.{c}" for c in ATTRIBUTES[1:]), "urls")


def split_spells(seen: DataFrame, graces: Iterable[int]) -> DataFrame:
    """(grace, key, spell_no, run_idx) for each grace period: a spell ends where as many runs were missed in a row."""
    ks = list(graces)
    w = Window.partitionBy("key").orderBy("run_idx")
    gaps = seen.withColumn("missed", F.col("run_idx") - F.lag("run_idx").over(w) - 1)
    opened = gaps
    for k in ks:  # one pass over the sightings, however many grace periods
        opened = opened.withColumn(f"s{k}", F.sum(F.when(F.col("missed").isNull() | (F.col("missed") >= k), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("grace"), F.col(f"s{k}").cast("int").alias("spell_no")) for k in ks)))
    return opened.select("key", "run_idx", each.alias("e")).select("e.grace", "key", "e.spell_no", "run_idx")


def spells(seen: DataFrame, runs: DataFrame, graces: Iterable[int]) -> DataFrame:
    """One row for each spell, with its censoring: left if it starts at the first run, right if it may go on after the last."""
    last = runs.agg((F.max("run_idx") + 1).alias("n_runs"))
    rolled = split_spells(seen, graces).groupBy("grace", "key", "spell_no").agg(F.min("run_idx").alias("start_idx"), F.max("run_idx").alias("last_seen_idx"), F.count("*").cast("int").alias("sightings"))
    out = rolled.crossJoin(F.broadcast(last))  # one row
    return out.select(
        "grace",
        "key",
        "spell_no",
        "start_idx",
        "last_seen_idx",
        "sightings",
        (F.col("last_seen_idx") - F.col("start_idx") + 1).alias("duration"),
        (F.col("start_idx") == 0).alias("left_censored"),
        (F.col("n_runs") - 1 - F.col("last_seen_idx") < F.col("grace")).alias("right_censored"),
    ).withColumn("observed_event", ~F.col("right_censored"))


def panel_meta(seen: DataFrame, spelled: DataFrame, runs: DataFrame) -> DataFrame:
    """By grace: counts of the panel. n_identities counts keys of sightings, whatever was dropped from the spells."""
    ids = seen.agg(F.count_distinct("key").alias("n_identities"))
    axis = runs.agg(F.count("*").alias("n_runs"), F.min("run_date").alias("first_run"), F.max("run_date").alias("last_run"))
    by = spelled.groupBy("grace").agg(
        F.count("*").alias("n_spells"),
        F.count_if("left_censored").alias("n_left_censored"),
        F.count_if(~F.col("left_censored")).alias("n_spells_analysed"),
        F.count_if(F.col("right_censored") & ~F.col("left_censored")).alias("n_right_censored"),
    )
    return by.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(axis))


def drop_placeholders(spelled: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spells of other identities, one row with the number dropped); sightings keep theirs."""
    joined = spelled.join(identity.select("key", is_placeholder(F.col("description")).alias("placeholder")), "key", "left")
    flagged = joined.withColumn("placeholder", F.coalesce("placeholder", F.lit(False)))
    return flagged.where("not placeholder").drop("placeholder"), flagged.agg(F.count_if("placeholder").alias("placeholder_spells_dropped"))


def representative(spelled: DataFrame) -> DataFrame:
    """The longest spell of each key, the earliest of equals."""
    w = Window.partitionBy("grace", "key").orderBy(F.desc("duration"), "spell_no")
    return spelled.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def longest(spelled: DataFrame, n: int = 25) -> DataFrame:
    return spelled.orderBy(F.desc("duration"), "key", "spell_no").limit(n)
