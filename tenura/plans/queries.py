"""The registered queries over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.text import advert_text, is_placeholder, is_relevant, normalise_company, normalise_title
from ..operators import calibrate as cal
from ..operators import detection as det
from ..operators import market as mk
from ..operators import panel as pn
from ..operators import semantic as sem
from ..operators import survival as sv
from ..operators import trends as tr
from ..operators import views as vw
from ..sources.adapters import PROVIDERS, adverts, event_runs, event_sightings, table
from ..sources.encoder import unit
from ..sources.session import shared_folder
from ..streaming import panel_stream as ps

GRACES = (1, 3, 7)
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def spelled(spark: SparkSession, d: str, graces: tuple[int, ...] = GRACES) -> DataFrame:
    return pn.spells(event_sightings(spark, d), event_runs(spark, d), graces)


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Spells of grace 3 with the event type of their key."""
    return spelled(spark, d, (3,)).withColumn("event_type", F.element_at(F.split("key", r"\|"), 2))


def curve(spark: SparkSession, d: str) -> DataFrame:
    return det.detection_curve(event_sightings(spark, d), event_runs(spark, d))


def panel_meta(spark: SparkSession, d: str) -> DataFrame:
    out = pn.panel_meta(event_sightings(spark, d), spelled(spark, d), event_runs(spark, d))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_run", "last_run")})


def identity_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.col("source").alias("key"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("title"),
        F.lit("c").alias("company"),
        (F.col("doc_id") % 5).cast("string").alias("url"),
        F.col("lang").alias("category"),
        F.lit("").alias("seniority"),
        F.lit("").alias("sector"),
        F.lit("").alias("remote"),
        F.col("doc_id").cast("string").alias("skills"),
        F.col("text").alias("description"),
    )
    return pn.identities(rows).select("key", "title", "category", F.col("skills").cast("long").alias("chosen"), "urls")


def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.km_curve(spelled(spark, d).where("not left_censored"), ["grace"]), "s", "lower", "upper")


def km_by_type(spark: SparkSession, d: str) -> DataFrame:
    obs = typed(spark, d).where("not left_censored")
    return rounded(sv.km_summary(sv.km_curve(obs, ["event_type"]), ["event_type"]), "rmst")


def logrank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.logrank_vs_rest(typed(spark, d).where("not left_censored"), "event_type"), "expected", "variance", "chi2", "p")


def grace_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.grace_sensitivity(spelled(spark, d), det.markov_fit(event_sightings(spark, d))), "rmst", "false_delisting_markov")


def survival_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Keys grouped by user, in place of clusters of texts."""
    obs = typed(spark, d).where("not left_censored")
    groups = obs.select("key", F.pmod(F.element_at(F.split("key", r"\|"), 1).cast("long"), F.lit(4)).cast("int").alias("cluster")).distinct()
    return rounded(sv.by_cluster(obs, groups), "rmst", "chi2", "p")


def skill_index(basis: str) -> Query:
    return lambda spark, d: rounded(mk.skill_index(adverts(spark, d), basis), "first_share", "last_share", "change_pp", "z", "slope_pp")


def skill_shares(basis: str) -> Query:
    return lambda spark, d: rounded(mk.skill_shares(adverts(spark, d), basis).drop("ord"), "share", "lo", "hi")


def month_totals(spark: SparkSession, d: str) -> DataFrame:
    return mk.month_totals(adverts(spark, d)).drop("ord")


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = adverts(spark, d)
    return rounded(mk.cooccurrence(rows, mk.top_skills(mk.skill_index(rows))), "given_a")


def composition(field: str) -> Query:
    return lambda spark, d: rounded(mk.composition(adverts(spark, d), field), "share")


def movers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vw.movers(mk.skill_index(adverts(spark, d))), "slope_pp")


def both_bases(spark: SparkSession, d: str) -> DataFrame:
    rows = adverts(spark, d)
    return rounded(vw.both_bases(mk.skill_index(rows, "mentions"), mk.skill_index(rows)), "mention_share", "mention_change", "advert_share", "advert_change", "relative_drop")


def employer_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vw.bars(mk.top_employers(adverts(spark, d)).select("company", "vacancies"), "vacancies"), "width")


def middle_rmst(spark: SparkSession, d: str) -> DataFrame:
    obs = typed(spark, d).where("not left_censored")
    return rounded(vw.middle(sv.km_summary(sv.km_curve(obs, ["event_type"]), ["event_type"]), "rmst"), "middle")


def parts_as_adverts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "part").withColumn("company", F.col("p_brand"))
    skills = F.when(F.col("p_size") > 10, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>"))
    return mk.relevance(rows, is_relevant(F.col("p_type"), F.col("p_name"), skills))


def weekly_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.weekly_series(typed(spark, d).withColumn("group", F.col("event_type")), event_runs(spark, d)), "inflow_share")


def trends(spark: SparkSession, d: str) -> DataFrame:
    rows = adverts(spark, d)
    return tr.skill_trends(rows, pn.run_axis(rows))


def normalised_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalise_title(F.col("text")).alias("title"))


def normalised_companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", normalise_company(F.concat("c_name", F.lit(" Müller B.V. Group"))).alias("company"))


def vacancy_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", advert_text(F.concat_ws(" ", "source", "lang"), F.col("source"), F.col("text")).alias("body"))


def ctfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every language with its score and rank, from whole texts as they are."""
    scores = sem.ranked_terms(sem.ctfidf_scores(table(spark, d, "documents"), "lang", "text", "doc_id"))
    return rounded(scores, "score", places=9)


def ctfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return sem.keywords(sem.ctfidf_scores(table(spark, d, "documents"), "lang", "text", "doc_id"), n=8)


def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    titles = sem.title_counts(table(spark, d, "part"), "p_brand", "p_name")
    sizes = titles.groupBy("cluster").agg(F.sum("n").alias("size"))
    words = sem.keywords(sem.ctfidf_scores(table(spark, d, "part"), "p_brand", "p_name", "p_partkey"))
    return spark.createDataFrame(sorted(sem.assign_names(sizes, titles, words).items()), "cluster string, name string")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return sem.as_vectors(table(spark, d, "embeddings"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return sem.cluster(vectors(spark, d), "vec_id")[1]


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))


def rescue(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth label is hidden and may be rescued."""
    hidden = F.when(F.col("vec_id") % 5 == 0, "other").otherwise(F.col("label").cast("string"))
    return sem.rescue(vectors(spark, d).withColumn("category", hidden), "vec_id", "category")[2]


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scaled by their id and back to length 1: sums of their components and of the squares."""
    scaled = table(spark, d, "embeddings").withColumn("v", unit(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))))
    sums = [F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("squares")]
    return rounded(scaled.select("vec_id", *sums), "total", "squares")


def provider_order(spark: SparkSession, d: str) -> DataFrame:
    """Providers by last share, with their places."""
    w = Window.orderBy(F.desc(F.round("last_share", 9)), "provider")  # eight rows
    return mk.provider_shares(adverts(spark, d), PROVIDERS).select("provider", F.row_number().over(w).alias("place"))


def series_order(spark: SparkSession, d: str) -> DataFrame:
    """Values of a composition by summed share, with their places."""
    series = mk.composition(adverts(spark, d), "sector").groupBy("value").agg(F.round(F.sum("share"), 9).alias("s"))
    return series.select("value", F.row_number().over(Window.orderBy(F.desc("s"), "value")).alias("place"))  # a row a value


def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, file by file, through the stateful operator: the spells it has ended and those it holds open."""
    name, store = ps.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    # a pattern, as a stream takes a plain path for a folder and the table may be one file
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    stream = pn.dated_runs(events, event_runs(spark, d), key, "ts")
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    try:
        query = ps.ended_spells(stream, GRACES).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(ps.SPELL).parquet(f"{folder}/out").unionByName(ps.open_spells(spark, f"{folder}/state", GRACES))


def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of what lines cost, by their flags: nearly all values are distinct."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    found = exact_quantiles(lines, "price", [0.5, 0.9, 0.99], ["l_returnflag", "l_linestatus"])
    return found.select("l_returnflag", "l_linestatus", *(F.round(F.get("values", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


def every_third(spark: SparkSession, d: str) -> DataFrame:
    return sem.every_nth(table(spark, d, "embeddings").select("vec_id"), "vec_id", 3)


def instrument(spark: SparkSession, d: str) -> tuple[dict[str, float], list[float], float, int]:
    """(observed moments at grace 3, detection by age, chance of being seen again, runs): all of them a few numbers."""
    seen, runs = event_sightings(spark, d), event_runs(spark, d)
    moments = sv.observed_moments(pn.spells(seen, runs, (3,)), ["grace"]).head()
    observed = {k: float(moments[k]) for k in cal.WEIGHTS}
    n_runs = runs.count()
    return observed, cal.detection_lookup(det.detection_curve(seen, runs), n_runs), float(det.markov_fit(seen).head()["p_stay_visible"]), n_runs


def simulate_moments(spark: SparkSession, d: str) -> DataFrame:
    observed, ages, stay, n = instrument(spark, d)
    return cal.evaluate(spark, cal.coarse_grid((42,)), observed, ages, stay, n, 3, 6000)


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    observed, ages, stay, n = instrument(spark, d)
    return cal.calibrate(spark, observed, ages, stay, n, 3)


def queries() -> dict[str, Query]:
    seen, runs = event_sightings, event_runs
    return {
        "run_axis": lambda s, d: runs(s, d).withColumn("run_date", F.col("run_date").cast("string")),
        "panel_sightings": seen,
        "spell_split_k": spelled,
        "panel_meta": panel_meta,
        "identity_meta": identity_meta,
        "representative_spell": lambda s, d: pn.representative(spelled(s, d)).select("grace", "key", "spell_no", "start_idx", "duration"),
        "longest_spells": lambda s, d: pn.longest(spelled(s, d, (3,))).select("key", "spell_no", "duration", "sightings", "right_censored"),
        "detection_curve": lambda s, d: rounded(curve(s, d), "rate"),
        "detection_binned": lambda s, d: rounded(det.detection_binned(curve(s, d)), "rate"),
        "detection_overall": lambda s, d: rounded(det.overall(curve(s, d)), "marginal", "worst_case"),
        "markov_fit": lambda s, d: rounded(det.markov_fit(seen(s, d)), "p_stay_visible", "p_become_visible", "stationary", "odds_ratio"),
        "grace_table": lambda s, d: rounded(det.grace_table(curve(s, d), det.markov_fit(seen(s, d))), "false_rate_independent", "false_rate_markov"),
        "km_curve": km_curve,
        "km_by_type": km_by_type,
        "logrank_vs_rest": logrank,
        "grace_sensitivity": grace_sensitivity,
        "observed_moments": lambda s, d: rounded(sv.observed_moments(spelled(s, d), ["grace"]), "single_share", "p90_span"),
        "survival_by_cluster": survival_by_cluster,
        "skill_index_adverts": skill_index("adverts"),
        "skill_index_mentions": skill_index("mentions"),
        "skill_shares_adverts": skill_shares("adverts"),
        "skill_shares_mentions": skill_shares("mentions"),
        "month_totals": month_totals,
        "rank_movement": lambda s, d: mk.rank_movement(mk.skill_index(adverts(s, d))),
        "cooccurrence": cooccurrence,
        "composition_seniority": composition("seniority"),
        "composition_remote": composition("remote"),
        "composition_sector": composition("sector"),
        "top_employers": lambda s, d: rounded(mk.top_employers(adverts(s, d)), "reposts"),
        "specificity": lambda s, d: rounded(mk.specificity(adverts(s, d)), "mean_skills", "share_naming_none"),
        "provider_shares": lambda s, d: rounded(mk.provider_shares(adverts(s, d), PROVIDERS), "first_share", "last_share"),
        "trend_movers": movers,
        "both_bases": both_bases,
        "employer_bars": employer_bars,
        "middle_rmst": middle_rmst,
        "relevance_filter": lambda s, d: rounded(parts_as_adverts(s, d)[1], "dropped_share"),
        "dropped_employers": lambda s, d: mk.top_dropped(parts_as_adverts(s, d)[2]),
        "weekly_series": weekly_series,
        "skill_trends": lambda s, d: rounded(trends(s, d).drop("ord"), "share"),
        "trend_slope": lambda s, d: rounded(tr.trend_slopes(trends(s, d)), "slope", places=9),
        "normalise_title": normalised_titles,
        "normalise_company": normalised_companies,
        "placeholder_filter": lambda s, d: table(s, d, "documents").select("doc_id", is_placeholder(F.col("text")).alias("placeholder")),
        "vacancy_text": vacancy_text,
        "title_counts": lambda s, d: sem.title_counts(table(s, d, "part"), "p_brand", "p_name"),
        "ctfidf_scores": ctfidf_scores,
        "ctfidf_keywords": ctfidf_keywords,
        "cluster_names": cluster_names,
        "cluster_sizes": cluster_sizes,
        "kmeans_silhouette": clusters,
        "pca_map": lambda s, d: sem.embedding_map(rows := vectors(s, d), "vec_id", max(1, rows.count() // 1400)),
        "rescue_other": rescue,
        "unit_vectors": unit_vectors,
        "provider_order": provider_order,
        "series_order": series_order,
        "systematic_sample": every_third,
        "price_quantiles": price_quantiles,
        "stream_replay": stream_replay,
        "sensitivity_at_one": lambda s, d: rounded(vw.at_grace(sv.grace_sensitivity(spelled(s, d), det.markov_fit(seen(s, d)))), "rmst", "false_delisting_markov"),
        "middle_rmst_descending": lambda s, d: rounded(vw.middle(sv.km_summary(sv.km_curve(typed(s, d).where("not left_censored"), ["event_type"]), ["event_type"]), "rmst", True), "middle"),
        "simulate_moments": simulate_moments,
        "calibrate": calibrated,
    }
