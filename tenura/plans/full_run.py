"""The whole analysis of one panel, as one result DataFrame for each section, and its JSON document."""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time
from datetime import UTC, date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import advert_text, is_relevant, skills_of, trimmed
from ..operators import calibrate as cal
from ..operators import detection as det
from ..operators import market as mk
from ..operators import panel as pn
from ..operators import semantic as sem
from ..operators import survival as sv
from ..operators import trends as tr
from ..operators import views as vw
from ..sources.cache import encoded
from ..sources.encoder import Encoder, hashed_words
from ..sources.sections import read_section, write_section
from ..sources.session import kept_table, ship
from ..sources.sqlite import read_panel

# Names that a provider table is asked for.
PROVIDERS = ["OpenAI", "Anthropic", "Google AI", "Microsoft Copilot", "AWS Bedrock", "Meta Llama", "Mistral", "Other frontier"]
# Grace periods that are compared.
SENSITIVITY = (1, 7, 14, 21)
#: Where a panel is looked for if none is named.
PANELS = ("data/jobs.db", "panel.db", "../data/jobs.db")
#: Points of the map, about.
MAP_POINTS = 1400


class Run:
    """Stages are properties, made once; `sections` has a DataFrame for each part of the document."""

    def __init__(self, runs: DataFrame, jobs: DataFrame, grace: int = 21, mode: str = "vacancy", quick: bool = False):
        self.spark = jobs.sparkSession
        ship(self.spark)
        #: (key, group) once clusters have names; until then groups are categories.
        self.named: DataFrame | None = None
        self.grace, self.quick = grace, quick
        self.source_runs, self.jobs, self.mode = runs, jobs, mode

    @cached_property
    def runs(self) -> DataFrame:
        return pn.run_axis(self.source_runs).cache()

    @cached_property
    def rows(self) -> DataFrame:
        dated = self.jobs.join(self.source_runs.select(F.col("id").alias("run_id"), F.col("run_date").cast("date").alias("run_date")), "run_id")
        key = pn.identity_key(F.col("title"), F.col("company"), F.col("url"), self.mode)
        return dated.withColumns({"title": trimmed(F.col("title")), "company": trimmed(F.col("company"))}).withColumn("key", key).where("key is not null")

    @cached_property
    def seen(self) -> DataFrame:
        return pn.sightings(self.rows, self.runs, F.col("key")).cache()

    @cached_property
    def identity(self) -> DataFrame:
        return pn.identities(self.rows).cache()

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        return pn.drop_placeholders(pn.spells(self.seen, self.runs, sorted({*SENSITIVITY, self.grace})), self.identity)

    @cached_property
    def every_grace(self) -> DataFrame:
        return self.split[0].cache()

    @cached_property
    def spells(self) -> DataFrame:
        """Of the chosen grace, with the attributes of their identity."""
        return self.every_grace.where(F.col("grace") == self.grace).join(self.identity, "key").cache()

    @cached_property
    def analysis(self) -> DataFrame:
        return self.spells.where("not left_censored")

    @cached_property
    def adverts(self) -> DataFrame:
        dated = self.analysis.join(F.broadcast(self.runs.withColumnRenamed("run_idx", "start_idx")), "start_idx")
        return dated.withColumns({"month": F.date_format("run_date", "yyyy-MM"), "skills": skills_of(F.col("skills")), "described": trimmed(F.col("description")) != ""})

    @cached_property
    def relevant(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        kept, counts, dropped = mk.relevance(self.adverts, is_relevant(F.col("category"), F.col("title"), F.col("skills")))
        return kept.cache(), counts, dropped

    @cached_property
    def curve(self) -> DataFrame:
        return det.detection_curve(self.seen, self.runs).cache()

    @cached_property
    def markov(self) -> DataFrame:
        return det.markov_fit(self.seen).cache()

    @cached_property
    def index(self) -> DataFrame:
        return mk.skill_index(self.relevant[0]).cache()

    @property
    def group_names(self) -> DataFrame:
        if self.named is not None:
            return self.named
        return self.identity.where("category <> ''").select("key", F.col("category").alias("group"))

    def sections(self) -> dict[str, DataFrame]:
        kept, counts, dropped = self.relevant
        mentions = mk.skill_index(kept, "mentions").cache()
        trends = tr.skill_trends(self.adverts, self.runs).cache()
        groups = tr.spell_groups(self.analysis, self.group_names, "Other")
        one = F.lit("all").alias("all")
        survival = sv.km_curve(self.analysis.select("*", one), ["all"])
        return {
            "panel": pn.panel_meta(self.seen, self.every_grace.where(F.col("grace") == self.grace), self.runs).crossJoin(self.split[1]),
            "detection": det.overall(self.curve).crossJoin(self.markov).withColumn("grace_chosen", F.lit(self.grace)),
            "detection_by_age": det.detection_binned(self.curve).orderBy("age_from"),
            "grace_table": det.grace_table(self.curve, self.markov).orderBy("grace_days"),
            "survival_overall": survival.drop("all").orderBy("t"),
            "survival_summary": sv.km_summary(survival, ["all"]).drop("all"),
            "grace_sensitivity": sv.grace_sensitivity(self.every_grace, self.markov).orderBy("grace"),
            "relevance_filter": counts,
            "dropped_employers": mk.top_dropped(dropped),
            "skill_index_adverts": vw.by_share(self.index),
            "skill_index_mentions": vw.by_share(mentions),
            **{f"months_{b}": mk.month_totals(kept, b).drop("ord").orderBy("month") for b in ("adverts", "mentions")},
            **{f"skill_shares_{b}": mk.skill_shares(kept, b).drop("ord").orderBy("skill", "month") for b in ("adverts", "mentions")},
            "universe_adverts": mk.universe(kept, self.index, "adverts"),
            "universe_mentions": mk.universe(kept, mentions, "mentions"),
            "rank_movement": mk.rank_movement(mentions).orderBy("rank_last"),
            "cooccurrence": mk.cooccurrence(kept, mk.top_skills(mentions)),
            **{f"composition_{f}": vw.by_summed_share(mk.composition(kept, f)) for f in ("seniority", "remote", "sector")},
            "employers": mk.top_employers(kept),
            "specificity": mk.specificity(kept).orderBy("month"),
            "providers": mk.provider_shares(kept, PROVIDERS).orderBy(F.desc("last_share"), "provider"),
            "weekly": tr.weekly_series(groups, self.runs).orderBy("group", "week"),
            "skills": trends.orderBy("skill", "ord"),
            "skill_slopes": tr.trend_slopes(trends).orderBy("skill"),
            "longest": pn.longest(tr.spell_groups(self.analysis, self.group_names, "")).select(F.col("group").alias("cluster"), F.substring("title", 1, 80).alias("title"), F.substring("company", 1, 45).alias("company"), F.col("duration").alias("days"), "sightings", F.col("right_censored").alias("censored"), "urls"),
        }

    @cached_property
    def moments(self) -> DataFrame:
        return sv.observed_moments(self.every_grace.where(F.col("grace") == self.grace), ["grace"]).cache()

    def calibration(self, n_sim: int | None = None) -> DataFrame:
        moments = self.moments.head()
        if moments is None:
            return self.spark.createDataFrame([], cal.RESULT)
        n = self.runs.count()
        ages = cal.detection_lookup(self.curve, n)
        seeds = (42,) if self.quick else cal.SEEDS
        return cal.calibrate(self.spark, {k: float(moments[k]) for k in cal.WEIGHTS}, ages, float(self.markov.head()["p_stay_visible"]), n, self.grace, seeds, n_sim or (4000 if self.quick else 6000))

    @cached_property
    def best(self) -> DataFrame:
        """The longest spell of each key."""
        return pn.representative(self.spells).cache()

    def texts(self) -> DataFrame:
        """(key, text) of the longest spell of each key, for an encoder."""
        return self.best.select("key", advert_text(F.col("title"), F.col("company"), F.col("description")).alias("text"))

    def vectors(self, cache: str, encode: Encoder | None = None, model: str = "hashed-words-256") -> DataFrame:
        """(key, embedding) of all keys; only texts that the folder `cache` has not seen under that model are encoded."""
        return encoded(self.texts(), "text", cache, model, encode or hashed_words()).select("key", "embedding")

    def semantic(self, vectors: DataFrame, ks: range = range(6, 17), starts: int = 10) -> dict[str, DataFrame]:
        """Sections that need `vectors` (key, embedding): clusters, their survival, the rescue of unlabelled adverts, and a map.

        From then on spells are grouped by their cluster's name.
        """
        rows = sem.as_vectors(vectors.join(self.identity, "key")).cache()
        n = rows.count()
        assigned, scores = sem.cluster(rows, "key", ks, starts)
        placed = kept_table(assigned.select(F.col("id").alias("key"), "cluster"), "clusters")
        words = sem.keywords(sem.ctfidf_scores(self.texts().join(placed, "key"), "cluster", "text", "key")).cache()
        sizes = placed.groupBy("cluster").agg(F.count("*").alias("size")).cache()
        titles = sem.title_counts(self.best.join(placed, "key"), "cluster", "title")
        names = self.spark.createDataFrame(sorted(sem.assign_names(sizes, titles, words).items()), "cluster int, name string").cache()
        self.named = placed.join(F.broadcast(names), "cluster").select("key", F.col("name").alias("group"))
        oof, rescued, metrics = sem.rescue(rows, "key", "category")
        points = sem.embedding_map(rows, "key", max(1, n // MAP_POINTS)).withColumnRenamed("id", "key")
        about = self.best.select("key", F.substring("title", 1, 70).alias("title"), F.substring("company", 1, 40).alias("company"), F.col("duration").alias("days"))
        return {
            "clustering": sizes.agg(F.count("*").alias("k")).crossJoin(scores.agg(F.max("silhouette").alias("silhouette"))),
            "silhouette_by_k": scores.orderBy("k"),
            "survival_curves_by_cluster": sv.curves_by_cluster(self.analysis, placed).orderBy("cluster", "t"),
            "clusters": sizes.join(names, "cluster").join(words, "cluster", "left").orderBy(F.desc("size"), "cluster"),
            "survival_by_cluster": vw.by_rmst(sv.by_cluster(self.analysis, placed).join(names, "cluster")),
            "classifier": metrics.withColumn("rescue_rate", F.coalesce(F.try_divide(F.col("n_rescued").cast("double"), "n_other"), F.lit(0.0))).withColumn("threshold", F.lit(sem.THRESHOLD)),
            "per_class": sem.class_metrics(oof).orderBy("label"),
            "rescued_breakdown": rescued.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label"),
            "map": points.join(placed, "key").join(about, "key").orderBy("key").drop("key"),
        }


def plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else None
    return v.isoformat() if isinstance(v, date) else v


def document(run: Run, more: dict[str, DataFrame] | None = None, folder: str | None = None) -> dict:
    """The sections, each of them small, as JSON values; with `folder` each is committed there first, and read from there."""
    begun = time.time()
    out: dict = {"generated_at": datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC")}
    for name, df in {**run.sections(), **(more or {})}.items():
        if folder:
            write_section(df, folder, name)
        rows = read_section(folder, name) if folder else [r.asDict(recursive=True) for r in df.collect()]
        out[name] = [{k: plain(v) for k, v in r.items()} for r in rows]
    out["runtime_seconds"] = round(time.time() - begun, 1)
    return out


def panel_path(named: str | None) -> str | None:
    """The panel that was named, or the first of the usual places; none if it does not exist. Paths of other file systems are taken as they are."""
    if named and "://" in named:
        return named
    return next((p for p in ((named,) if named else PANELS) if os.path.exists(p)), None)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Analyses a panel of adverts and writes a JSON document.")
    p.add_argument("--db", help="SQLite file, or folder of Parquet tables with --format parquet; else the first that exists of " + ", ".join(PANELS))
    p.add_argument("--format", default="sqlite", choices=["sqlite", "parquet"])
    p.add_argument("--out", required=True)
    p.add_argument("--grace", type=int, default=21)
    p.add_argument("--key", default="vacancy", choices=["vacancy", "url"])
    p.add_argument("--quick", action="store_true", help="one calibration seed, fewer lives")
    p.add_argument("--no-calibration", action="store_true")
    p.add_argument("--cache", default=".cache", help="folder that keeps encoded texts, shared by all machines")
    p.add_argument("--no-texts", action="store_true", help="encode no texts: no clusters, rescue or map, and groups are categories")
    p.add_argument("--sections", help="folder, shared by all machines, that gets each section as committed JSON lines, too")
    args = p.parse_args(argv)
    db = panel_path(args.db)
    if db is None:
        print(f"no panel at {args.db or ' or '.join(PANELS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    run = Run(*read_panel(spark, db, args.format), args.grace, args.key, args.quick)
    more = {} if args.no_texts else run.semantic(run.vectors(args.cache))
    if not args.no_calibration:
        fits = run.calibration().cache()
        more |= {"calibration": fits.orderBy("loss", "seed"), "calibration_spread": cal.seed_spread(fits).orderBy("what"), "calibration_observed": run.moments.drop("grace")}
    found = document(run, more, args.sections)
    with open(args.out, "w", encoding="utf-8") as f:
        json.dump(found, f, indent=1, ensure_ascii=False)
    meta = (found["panel"] or [{}])[0]
    print(f"{meta.get('n_spells', 0)} spells of {meta.get('n_identities', 0)} identities, {found['runtime_seconds']} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
