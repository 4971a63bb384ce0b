"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells by source, language and topic. The cells' token weights are raked, margin by margin and round
by round, until their sums by source, by language and by topic are the targets. A document is kept with its cell's
probability: the tokens wanted from the cell by those it has, with one scale for all cells such that the tokens
expected in all are `keep` of the tokens there are, no probability being over 1. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, table, written

DIMS = ("source", "lang", "topic")
#: Topics by what a text holds, the first that fits: (name, pattern); `prose` where none does.
TOPICS = (("table", r" \| "), ("legal", r"(?i)licen[cs]e|copyright|all rights reserved"), ("contact", r"[a-z0-9]@[a-z0-9]"), ("record", r"[0-9]{6}"))
ROUNDS, KEEP, FLATTEN, SEED = 20, 0.75, 0.7, "mix-1"
#: Rounds whose plan is made at once.
STEP = 5


def topic_of(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("prose")


def cell_of(docs: DataFrame) -> Column:
    """The cell of a row of `docs`, as struct (source, lang, topic); null counts as ''."""
    blank = F.lit("")
    return F.struct(F.coalesce(docs["source"], blank).alias("source"), F.coalesce(docs["lang"], blank).alias("lang"), topic_of(F.coalesce(docs["text"], blank)).alias("topic"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id: 52 bits of an md5."""
    word = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(word, 16, 10).cast("long") / F.lit(float(16**13))


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Default targets of one margin: the observed token shares, raised to `power` and scaled to 1 in all."""
    share = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("s"))
    return share.select(dim, (F.col("s") / F.sum("s").over(Window.partitionBy())).alias(f"t_{dim}"))


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`cells` with `weight`, raked from `tokens` towards t_source, t_lang and t_topic; the weights sum to about 1.

    Cells are few, whatever the number of documents, so they are one partition, on which windows need no shuffle.
    """
    one = Window.partitionBy()
    out = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(one))
    for r in range(rounds):
        for dim in DIMS:
            out = out.withColumn("weight", F.col("weight") * F.col(f"t_{dim}") / F.sum("weight").over(Window.partitionBy(dim).orderBy(*DIMS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        if r % STEP == STEP - 1:
            out = written(out, "raked").coalesce(1)
    return out


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS, power: float = FLATTEN) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) of the cells with tokens.

    `targets` gives, by margin (source, lang, topic), the wanted share of each of its values; values without one keep
    their observed share, and each margin is scaled to 1. A margin without targets gets flattened shares.
    """
    spark = docs.sparkSession
    seen = docs.select(cell_of(docs).alias("cell"), tokens_of(docs["text"]).alias("n")).select("cell.*", "n")
    cells = written(seen.groupBy(*DIMS).agg(F.sum("n").alias("tokens")).where("tokens > 0"), "cells").coalesce(1)
    base = cells
    for dim in DIMS:
        if targets and dim in targets:
            given = spark.createDataFrame(list(targets[dim].items()), f"{dim} string, g double")
            raw = cells.groupBy(dim).agg(F.sum("tokens").alias("s")).withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy())).join(given, dim, "left").withColumn("s", F.coalesce("g", "s"))
            wanted = raw.select(dim, (F.col("s") / F.sum("s").over(Window.partitionBy())).alias(f"t_{dim}"))
        else:
            wanted = flattened(cells, dim, power)
        base = base.join(wanted, dim)
    raked = rake(written(base.select(*DIMS, "tokens", *(f"t_{d}" for d in DIMS)), "targets").coalesce(1), rounds)
    # cells in the order in which they run out as the scale grows; `scale` if just those up to this one have run out
    order = Window.partitionBy().orderBy(F.col("tokens") / F.col("weight"), *DIMS).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    wanted = F.lit(keep) * F.sum("tokens").over(every)
    ranked = raked.withColumns({"total": wanted, "all": F.sum("weight").over(every), "out_tokens": F.sum("tokens").over(order), "out_weight": F.sum("weight").over(order), "runs_out": F.col("tokens") / F.col("weight")})
    rest = F.col("all") - F.col("out_weight")
    scale = F.when(rest > 1e-12, (F.col("total") - F.col("out_tokens")) / rest)
    ranked = ranked.withColumn("scale", F.greatest(F.col("total") / F.col("all"), F.max(F.when(F.col("runs_out") <= scale, scale)).over(every)))
    return written(ranked.select(*DIMS, "tokens", "weight", F.least(F.lit(1.0), F.col("scale") * F.col("weight") / F.col("tokens")).alias("probability")), "probabilities")


def assign(docs: DataFrame, cells: DataFrame, seed: str = SEED, name: str = "cell") -> DataFrame:
    """`docs` with one more column `name`, a struct (source, lang, topic, probability, kept).

    Documents without tokens have probability 1, as no weight depends on them. `name` must be new to `docs`.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"the documents have a column {name}")
    columns = docs.columns
    p = fresh(docs, "probability")
    of = {d: fresh(docs, f"{d}_of_cell") for d in DIMS}
    named = cells.select(*(F.col(d).alias(of[d]) for d in DIMS), F.col("probability").alias(p))
    rows = docs.withColumn(name, cell_of(docs))
    same = [rows[name][d] == named[of[d]] for d in DIMS]
    probability = F.coalesce(named[p], F.lit(1.0))
    cell = [*(rows[name][d].alias(d) for d in DIMS), probability.alias("probability"), (uniform(rows["doc_id"], seed) < probability).alias("kept")]
    return rows.join(named, same, "left").select(*(rows[c] for c in columns), F.struct(*cell).alias(name))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """The sampled rows of `docs`, with all its columns, whatever their names.

    Null sources, languages and texts count as ''; a null id as ''. Rows that repeat an id are kept or left together if
    their cells agree. Very long texts are read whole. An empty table gives an empty result.
    """
    name = fresh(docs, "cell")
    out = assign(docs, probabilities(docs, targets, keep), seed, name)
    return out.where(out[name]["kept"]).drop(name)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = assign(docs, probabilities(docs))
    return out.select("doc_id", "cell.topic", tokens_of(F.col("text")).alias("n_tokens"), F.round("cell.probability", 9).alias("probability"), "cell.kept")


def op5_sql(rounds: int = ROUNDS) -> str:
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    out = [
        f"""WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS BIGINT) AS n_tokens FROM documents
), c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    ]
    for dim in DIMS:
        out.append(f"m_{dim} AS MATERIALIZED (SELECT {dim}, s / sum(s) OVER () AS t_{dim} FROM (SELECT {dim}, pow(sum(tokens), CAST({FLATTEN} AS DOUBLE)) AS s FROM c GROUP BY {dim}))")
    out.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))")
    at = 0
    for _ in range(rounds):
        for dim in DIMS:
            out.append(f"w{at + 1} AS MATERIALIZED (SELECT * REPLACE (weight * t_{dim} / sum(weight) OVER (PARTITION BY {dim}) AS weight) FROM w{at})")
            at += 1
    out.append(f"""r AS MATERIALIZED (SELECT *, CAST({KEEP} AS DOUBLE) * sum(tokens) OVER () AS total, sum(weight) OVER () AS every, tokens / weight AS runs_out,
    sum(tokens) OVER o AS out_tokens, sum(weight) OVER o AS out_weight FROM w{at} WINDOW o AS (ORDER BY tokens / weight, source, lang, topic ROWS UNBOUNDED PRECEDING))""")
    out.append("s AS (SELECT *, CASE WHEN every - out_weight > 1e-12 THEN (total - out_tokens) / (every - out_weight) END AS scale FROM r)")
    out.append("z AS (SELECT greatest(max(total / every), coalesce(max(CASE WHEN runs_out <= scale THEN scale END), 0)) AS scale FROM s)")
    out.append("p AS (SELECT source, lang, topic, least(CAST(1 AS DOUBLE), z.scale * weight / tokens) AS probability FROM r, z)")
    return (
        ",\n".join(out)
        + f"""
SELECT d.doc_id, d.topic, d.n_tokens, round(coalesce(p.probability, 1), 9) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < coalesce(p.probability, 1) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
    )
