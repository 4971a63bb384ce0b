"""Grouping by meaning: keywords of groups, PCA, k-means with silhouette, naming, and a rescue of unlabelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.text import STOP_WORDS, TERM, clean_title
from ..sources.session import kept_table
from . import classifiers as lr
from . import clustering as cl

SEED = 42
#: Confidence from which on a row is rescued.
THRESHOLD = 0.6


def tokens(text: Column) -> Column:
    """The matches of TERM in lower case, where letters and numbers of any script are word characters.

    Tokens are ASCII, so other characters only matter as edges of words: letters and numbers become underscores, which
    are word characters in no token, and the rest blanks. So the pattern needs to know ASCII alone.
    """
    edges = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "_")
    return F.regexp_extract_all(edges, F.lit(TERM), F.lit(0))


def crossing_pairs(ends: DataFrame) -> DataFrame:
    """(cluster, term, n) of the pairs that straddle two texts: of rows (cluster, id, first, last), one for each text with tokens, in the order of ids.

    Texts are dealt by ranges of (cluster, id). Within a range the text before is near; the first text of a cluster in a
    range looks at the last one of the range before it, of which there is one row for each cluster and range.
    """
    dealt = ends.repartitionByRange("cluster", "id").withColumn("part", F.spark_partition_id()).persist()
    w = Window.partitionBy("cluster", "part").orderBy("id")
    inner = dealt.withColumns({"before": F.lag("last").over(w), "at": F.row_number().over(w)})
    tails = dealt.groupBy("cluster", "part").agg(F.max_by("last", "id").alias("last"))
    edge = tails.withColumn("edge", F.lag("last").over(Window.partitionBy("cluster").orderBy("part"))).select("cluster", "part", "edge")
    joined = inner.join(edge, ["cluster", "part"]).withColumn("before", F.when(F.col("at") == 1, F.col("edge")).otherwise(F.col("before"))).where("before IS NOT NULL")
    return joined.groupBy("cluster", F.concat_ws(" ", "before", "first").alias("term")).agg(F.count("*").alias("n"))


def term_counts(rows: DataFrame, group: str, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """((cluster, term, n) of words and pairs, one row with the number `c` of clusters): texts are split once, and read as one text a cluster in the order of the column `order`."""
    kept = rows.where(F.col(group).isNotNull() & (F.col(group).cast("string") != "-1"))
    toks = kept.select(F.col(group).alias("cluster"), F.col(order).alias("id"), tokens(F.col(text)).alias("t"))
    pairs = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("t", i), x))
    none = F.lit(None)
    count = lambda x: F.struct(x.alias("term"), none.cast(dict(toks.dtypes)["id"]).alias("id"), none.cast("string").alias("first"), none.cast("string").alias("last"))
    text_ends = F.struct(none.cast("string").alias("term"), F.col("id"), F.get("t", F.lit(0)).alias("first"), F.get("t", F.size("t") - 1).alias("last"))
    listed = F.concat(F.transform(F.concat("t", F.when(F.size("t") > 1, pairs).otherwise(F.array().cast("array<string>"))), count), F.array(text_ends))
    counted = toks.select("cluster", F.explode(listed).alias("r")).groupBy("cluster", "r.term", "r.id", "r.first", "r.last").agg(F.count("*").alias("n"))
    counted = kept_table(counted, "terms")
    ends = counted.where("term IS NULL AND first IS NOT NULL").select("cluster", "id", "first", "last")
    tf = counted.where("term IS NOT NULL").select("cluster", "term", "n").unionByName(crossing_pairs(ends)).groupBy("cluster", "term").agg(F.sum("n").alias("n"))
    return tf, counted.where("term IS NULL").agg(F.count_distinct("cluster").alias("c"))


def ctfidf_scores(rows: DataFrame, group: str, text: str, order: str, vocabulary: int = 40_000, least_groups: int = 2) -> DataFrame:
    """(cluster, term, score): class-based TF-IDF of words and word pairs, with group -1 left out.

    The texts of a group are one text, in the order of the column `order`, so pairs straddle their ends. Terms must occur in
    `least_groups` groups; the vocabulary is cut by corpus frequency (ties: by term); then terms with a stop word go, and
    frequencies are shares of what is left.
    """
    tf, n_groups = term_counts(rows, group, text, order)
    tf = tf.persist()
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least_groups)
    top = df.orderBy(F.desc("total"), "term").limit(vocabulary).select("term", "df")
    kept = tf.join(top, "term").where(~F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, STOP_WORDS))))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return kept.crossJoin(F.broadcast(n_groups)).select("cluster", "term", (share * F.ln(1 + F.col("c") / F.col("df"))).alias("score"))


def ranked_terms(scores: DataFrame, n: int = 40_000) -> DataFrame:
    """The first `n` terms of each cluster, with their rank; as many as a vocabulary has, unless fewer are asked for."""
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "term")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def keywords(scores: DataFrame, n: int = 8, considered: int = 40_000) -> DataFrame:
    """(cluster, keywords): the best terms, none of which contains or is contained in one taken before; all terms of the vocabulary are looked at."""
    listed = ranked_terms(scores, considered).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))

    def take(kept: Column, term: Column) -> Column:
        clash = F.exists(kept, lambda k: F.contains(k, term) | F.contains(term, k))
        return F.when((F.size(kept) >= n) | clash, kept).otherwise(F.concat(kept, F.array(term)))

    return listed.select("cluster", F.aggregate("terms", F.array().cast("array<string>"), take).alias("keywords"))


def title_counts(rows: DataFrame, group: str, title: str) -> DataFrame:
    return rows.select(F.col(group).alias("cluster"), clean_title(F.col(title)).alias("title")).where("title <> ''").groupBy("cluster", "title").agg(F.count("*").alias("n"))


def assign_names(sizes: DataFrame, titles: DataFrame, words: DataFrame) -> dict:
    """Names of clusters, of which there are at most some dozens: the largest first, each takes its most frequent title
    that no other has and that occurs twice, or else its first two keywords. As fewer titles are taken than there are
    clusters, each cluster needs no more than that many of its own."""
    listed_sizes = sizes.collect()
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "title")
    best = titles.where("n >= 2").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= len(listed_sizes))
    listed = {r["cluster"]: sorted(r["t"], key=lambda t: (-t["n"], t["title"])) for r in best.groupBy("cluster").agg(F.collect_list(F.struct("n", "title")).alias("t")).collect()}
    words_of = {r["cluster"]: [k for k in r["keywords"] if k not in STOP_WORDS] for r in words.collect()}
    taken: set[str] = set()
    names = {}
    for r in sorted(listed_sizes, key=lambda r: (-r["size"], str(r["cluster"]))):
        c = r["cluster"]
        pick = next((t["title"] for t in listed.get(c, []) if t["title"] not in taken), None)
        if pick:
            taken.add(pick)
        else:
            pick = " / ".join(words_of.get(c, [])[:2]) or f"cluster {c}"
        names[c] = pick.title()
    return names


def as_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def reduced(rows: DataFrame, k: int, to: str = "reduced") -> DataFrame:
    """Centred principal components of `features`: k of them, or fewer where the vectors are narrower or the rows fewer; zeros where there is one row."""
    first = rows.select(F.size(vector_to_array("features")).alias("w")).head()
    n = rows.limit(k + 2).count()  # more rows make no difference
    k = max(1, min(k, first["w"] if first else k, max(2, n - 1)))
    if n < 2:
        return rows.withColumn(to, array_to_vector(F.array_repeat(F.lit(0.0), k)))
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    return PCA(k=k, inputCol="centred", outputCol=to).fit(centred).transform(centred).drop("centred")


def cluster(rows: DataFrame, id_col: str, ks: range = range(6, 17), starts: int = 10, dims: int = 10) -> tuple[DataFrame, DataFrame]:
    """(assignments (id, cluster), silhouettes (k, silhouette)): for each k below the number of rows the cheapest of `starts` fits counts.

    The k with the best silhouette assigns, the smallest of equals. With too few rows for any k all are cluster 0. All
    fits share their scans, and all silhouettes theirs.
    """
    small = reduced(rows, dims).select(F.col(id_col).alias("id"), vector_to_array("reduced").alias("v")).cache()
    n = small.count()
    tried = [k for k in ks if k < n]
    spark = rows.sparkSession
    if not tried:
        return small.select("id", F.lit(0).alias("cluster")), spark.createDataFrame([], "k int, silhouette double")
    best = cl.best_fits(small, tried, starts, SEED)
    scores = cl.silhouettes(cl.nearest(small, [best[k] for k in tried]))
    top = tried[max(range(len(tried)), key=lambda i: scores[i])]
    placed = cl.nearest(small, [best[top]]).select("id", F.get("clusters", F.lit(0)).alias("cluster"))
    return placed, spark.createDataFrame(list(zip(tried, scores, strict=True)), "k int, silhouette double")


def every_nth(rows: DataFrame, id_col: str, step: int) -> DataFrame:
    """The first row by id and each `step`-th after it. Rows are sorted over partitions; only their sizes come to the driver."""
    if step <= 1:
        return rows
    dealt = rows.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    begin, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        begin.append(before)
        before += sizes.get(p, 0)
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.get(F.array(*map(F.lit, begin or [0])), F.col("_part"))
    return dealt.where(place % step == 0).drop("_part", "_at")


def embedding_map(rows: DataFrame, id_col: str, step: int) -> DataFrame:
    """(id, x, y): every `step`-th row by id, in two components scaled by the 99th percentile of their absolute values."""
    flat = reduced(rows, 2).select(F.col(id_col).alias("id"), vector_to_array("reduced").alias("v")).cache()
    found = exact_quantiles(flat.select(F.explode("v").alias("c")).select(F.abs("c").alias("c")), "c", [0.99]).head()
    scale = F.lit((found["values"][0] if found else 0.0) or 1.0)
    at = lambda i: F.round(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) / scale, 4)  # noqa: E731  vectors of one component have no second
    return every_nth(flat, "id", step).select("id", at(0).alias("x"), at(1).alias("y"))


#: Pieces that a class is numbered in.
PIECES = 1024


def folded(rows: DataFrame, by: str, folds: int) -> DataFrame:
    """`rows` (id, `by`, ...) with `fold`: the rows of each value of `by` dealt in turn, by hash of the id. No task numbers a whole class."""
    order = [F.xxhash64("id", F.lit(SEED)), F.col("id")]
    cut = rows.withColumn("_piece", F.pmod(order[0], F.lit(PIECES)).cast("int"))
    before = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut.groupBy(by, "_piece").count().select(by, "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy(by, "_piece").orderBy(*order)) - 1
    return cut.withColumn("_no", within).join(F.broadcast(begins), [by, "_piece"]).withColumn("fold", ((F.col("_begin") + F.col("_no")) % folds).cast("int")).drop("_piece", "_begin", "_no")


def rescue(rows: DataFrame, id_col: str, category: str, min_class: int = 20, threshold: float = THRESHOLD, folds: int = 5, c: float = 4.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(out-of-fold predictions (id, category, predicted), rescued rows (id, label, confidence), one row of metrics).

    Rows with `features`; those without a category ('', other, unknown, null) may be rescued, the rest train if their
    class has `min_class` rows. Classes weigh alike within what a model is trained on. The models of all folds and the
    one of all rows are fitted in the same scans.
    """
    cat = F.coalesce(F.col(category), F.lit(""))
    named = rows.select(F.col(id_col).alias("id"), cat.alias("category"), vector_to_array("features").alias("v")).withColumn("open", cat.isin("", "other", "unknown")).cache()
    sizes = named.where("not open").groupBy("category").agg(F.count("*").alias("k")).where(F.col("k") >= min_class)
    classes = sorted(r["category"] for r in sizes.select("category").collect())  # classes are few
    spark = rows.sparkSession
    if len(classes) < 2:
        none = named.where("false")
        return none.select("id", "category", F.lit("").alias("predicted")), none.select("id", F.lit("").alias("label"), F.lit(0.0).alias("confidence")), spark.createDataFrame([(0.0, 0.0, 0, 0, 0)], "macro_f1 double, accuracy double, n_train int, n_other int, n_rescued int")
    index = spark.createDataFrame([(n, i) for i, n in enumerate(classes)], "category string, y int")
    train = folded(named.where("not open").join(F.broadcast(index), "category"), "category", folds).cache()
    counts = np.zeros((folds, len(classes)))
    for r in train.groupBy("fold", "y").count().collect():  # folds x classes
        counts[r["fold"], r["y"]] = r["count"]
    masks = [np.arange(folds) != f for f in range(folds)] + [np.ones(folds, bool)]
    models = lr.fit_masks(train, counts, masks, train.select(F.size("v").alias("w")).head()["w"], c)
    label = lambda i: F.get(F.array(*map(F.lit, classes)), i)
    oof = lr.predicted(train.select("id", "category", "v", F.col("fold").alias("use")), models).select("id", "category", label(F.col("best")).alias("predicted")).cache()
    other = lr.predicted(named.where("open").select("id", "v", F.lit(folds).alias("use")), models)
    rescued = other.where(F.col("confidence") >= threshold).select("id", label(F.col("best")).alias("label"), "confidence")
    per = class_metrics(oof)
    n_other = named.where("open").count()
    metrics = per.agg(F.avg("f1").alias("macro_f1")).crossJoin(oof.agg(F.avg((F.col("category") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").cast("int").alias("n_train")))
    metrics = metrics.crossJoin(rescued.agg(F.count("*").cast("int").alias("n_rescued"))).withColumn("n_other", F.lit(n_other))
    return oof, rescued, metrics


def class_metrics(oof: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of (category, predicted)."""
    cells = oof.groupBy("category", "predicted").agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("category").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("category") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = true.join(said, "label", "left")
    p, r = F.coalesce(F.try_divide(F.col("hit").cast("double"), "said"), F.lit(0.0)), F.col("hit") / F.col("support")
    return both.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")
