"""Hard-negative mining over k-means inverted lists with stored radii.

Centroids are fitted on a bounded sample; every row then lies in the list of its nearest centroid, and each list knows its
radius, the distance of its farthest row. For an anchor a and a row x of a list with centroid c and radius r,
Cauchy-Schwarz gives a.c - |a| r <= a.x <= a.c + |a| r. So an anchor visits lists by that upper bound, in two steps: the
first few; and then all others but those whose upper bound is strictly below the k-th score found, or whose bounds lie
outside the window of scores wanted. What is skipped can't be in the result, ties included, so the result is exact.

Lists are cut into pieces of a bounded size by hash, and the anchors that visit one into blocks, so neither a popular
list nor a popular anchor is the work of one task. Integer products are exact: in doubles while they stay below 2^53, in
Python's integers for the rows beyond, which are in a list of their own that is always visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, table, tune, written
from .vectors import LONG, dots, matrix, scaled, vector_rows, widen

#: Rows of the sample that centroids are fitted on, rows a list (so far as MOST lists suffice), rows of a piece, anchors of a block.
SAMPLE, LIST_ROWS, MOST_LISTS, PIECE, BLOCK = 20_000, 500, 1024, 4096, 1024
#: Lists that an anchor visits first.
FIRST = 4
#: Components beyond this, once scaled, put a row into the list of large rows.
LARGE = float(1 << 20)


def fit_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's method; the first ones are rows drawn at random, and an empty one stays."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def is_large(x: np.ndarray) -> np.ndarray:
    return (np.abs(x) >= LARGE).any(1)


def indexed(rows: DataFrame, scale: int) -> tuple[DataFrame, np.ndarray]:
    """(`rows` with `list` and `gap`, the distance from its centroid; the centroids): list -1 holds the rows with large components."""
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.select("vector").where(~F.exists("vector", lambda x: F.abs(x * scale) >= LARGE)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if sample.num_rows:
        drawn = np.floor(scale * matrix(sample.column("vector")))
        centres = fit_centres(drawn, max(1, min(MOST_LISTS, -(-n // LIST_ROWS))))
    else:
        centres = np.zeros((1, 1))
    at = spark.sparkContext.broadcast(centres)  # MOST_LISTS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(over="ignore"):
                x = np.floor(scale * matrix(batch.column("vector")))
            large = is_large(x)
            x[large] = 0
            width = max(x.shape[1], at.value.shape[1])
            x, c = widen(x, width), widen(at.value, width)
            own = nearest_centre(x, c)
            gap = np.sqrt(((x - c[own]) ** 2).sum(1))
            own[large], gap[large] = -1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(gap)], [*batch.schema.names, "list", "gap"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return map_arrow(rows, place, f"{kinds}, list int, gap double"), centres


def bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible products of the rows of x with the rows of each list, a little wider than exact for rounding."""
    width = max(x.shape[1], centres.shape[1])
    x, c = widen(x, width), widen(centres, width)
    mid, reach = x @ c.T, np.sqrt((x * x).sum(1))[:, None] * radius[None, :]
    slack = 1e-9 * (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :] + reach) + 1e-6
    return mid - reach - slack, mid + reach + slack


class Index:
    """The lists as a written table, and of each list its centroid, radius and number of pieces (bounded by MOST_LISTS)."""

    def __init__(self, rows: DataFrame, scale: int):
        placed, self.centres = indexed(rows, scale)
        self.scale, self.rows = scale, written(placed, "lists")
        self.radius, self.pieces = np.full(len(self.centres), -1.0), {}
        for r in self.rows.groupBy("list").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():
            self.pieces[r["list"]] = -(-r["n"] // PIECE)
            if r["list"] >= 0:
                self.radius[r["list"]] = r["radius"]

    def visits(self, asked: DataFrame, first: int, rest: bool) -> DataFrame:
        """`asked` (anchor, vector, label, windows of (window, low, high, kth)) with one row for each `list` to visit.

        Without `rest` these are, for each window, the `first` lists by upper bound among those that may have scores
        within it, and the list of large rows; with `rest` all others that may have scores within it and from kth on.
        """
        centres, radius, scale, large = self.centres, self.radius, self.scale, -1 in self.pieces
        live = np.array(sorted(k for k in self.pieces if k >= 0), np.int64)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * matrix(batch.column("vector")))
                wide = is_large(x)
                x[wide] = 0
                least, most = bounds(x, centres[live], radius[live])
                least[wide], most[wide] = -np.inf, np.inf
                order, lists = np.argsort(-most, axis=1, kind="stable"), []
                for i, windows in enumerate(batch.column("windows").to_pylist()):
                    now, later = set(), set()
                    for w in windows:
                        way = order[i]
                        if w["low"] is not None:
                            way = way[(most[i, way] >= w["low"]) & (least[i, way] <= w["high"])]
                        now.update(way[:first].tolist())
                        later.update((way if w["kth"] is None else way[most[i, way] >= w["kth"]]).tolist())
                    lists.append(live[sorted(later - now if rest else now)].tolist() + [-1] * (large and not rest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

        kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
        return map_arrow(asked, choose, f"{kinds}, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")

    def meet(self, visits: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
        """(anchor, window, id, score): of each piece of a list the k best rows with the visiting anchor's label (or another one), for each window."""
        scale = self.scale
        sizes = F.create_map(*(F.lit(v) for pair in sorted(self.pieces.items()) for v in pair)) if self.pieces else F.create_map(F.lit(0), F.lit(1))
        pieces = F.element_at(sizes, F.col("list"))
        left = self.rows.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(3)), pieces).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = visits.withColumn("block", F.pmod(F.xxhash64("anchor", F.lit(4)), F.lit(blocks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int, int]] = []
            if a.num_rows and b.num_rows:
                a = a.sort_by("id")
                x, y = matrix(a.column("vector")), matrix(b.column("vector"))
                width = max(x.shape[1], y.shape[1])
                ids, labels = a.column("id").to_numpy(), a.column("label").to_numpy()
                scores = dots(scaled(widen(y, width), scale), scaled(widen(x, width), scale))
                falling = np.argsort(-scores, axis=1, kind="stable")  # ties stay by id
                for row, order, anchor, label, windows in zip(scores, falling, *(b.column(c).to_pylist() for c in ("anchor", "label", "windows")), strict=True):
                    order = order[((labels[order] == label) == same) & (ids[order] != anchor)]
                    s = -row[order]
                    for w in windows:
                        begin = 0 if w["high"] is None else np.searchsorted(s, -w["high"], "left")
                        least = max((v for v in (w["low"], w["kth"]) if v is not None), default=-LONG)
                        end = min(begin + k, np.searchsorted(s, -least, "right"))
                        out += [(anchor, w["window"], i, -v) for i, v in zip(ids[order[begin:end]].tolist(), s[begin:end].tolist(), strict=True)]
            names, kinds = ("anchor", "window", "id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

        key = ["list", "piece", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "anchor long, window int, id long, score long")

    def top(self, asked: DataFrame, blocks: int, k: int, same: bool, first: int = FIRST) -> DataFrame:
        """(anchor, window, rank, id, score): for each window of each anchor its k best rows of all lists."""
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        some = written(ranked(self.meet(self.visits(asked, first, False), blocks, k, same)), "first")
        kth = some.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kths"))  # a few windows an anchor
        with_kth = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["low"].alias("low"), w["high"].alias("high"), F.element_at("kths", w["window"]).alias("kth")))
        again = asked.join(kth, "anchor", "left").withColumn("windows", with_kth).drop("kths")
        rest = self.meet(self.visits(again, first, True), blocks, k, same)
        return written(ranked(some.drop("rank").unionByName(rest)), "best")


def window(no: Column, low: Column, high: Column) -> Column:
    return F.struct(no.cast("int").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(None).cast("long").alias("kth"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact, as a written table.

    Components x become floor(scale * x); a score is the integer inner product, higher ones first, ties by smaller id. An
    anchor's positives are its first `positives` other rows of its label; for each, its negatives are the first
    `negatives` rows of another label that score from low/10 to high/10 of the positive's score (none if that is
    negative). Fewer come back where there are no more.

    Rows without an id or label, with null vectors or with null or non-finite components take no part, as anchor or as
    row; other columns play no role. An anchor's own id is no row for it. Rows that repeat an id count one by one, a
    repeated anchor once. Shorter vectors count as filled with zeros. Scores beyond +-(2^63 - 1) are cut to that. Empty
    tables give empty results.
    """
    spark = rows.sparkSession
    tune(spark)

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label")).where("label IS NOT NULL")
        kept = vector_rows(df.select("i", "v", F.struct("label").alias("rest")), "i", "v", False, ["rest"])
        return kept.select("id", "vector", "rest.label")

    with scratch(spark, keep=True):
        index = Index(usable(rows), scale)
        none = F.lit(None)
        asked = written(usable(anchors).dropDuplicates(["id"]).select(F.col("id").alias("anchor"), "vector", "label"), "anchors")
        blocks = max(1, -(-asked.count() // BLOCK))
        found = index.top(asked.withColumn("windows", F.array(window(F.lit(0), none, none))), blocks, positives, True)
        tens, ones = F.expr("score div 10"), F.expr("score % 10").cast("int")
        part = lambda n, up: n * tens + F.floor((n * ones + up) / 10)
        pairs = written(found.where("score >= 0").select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score"), part(low, 9).alias("low"), part(high, 0).alias("high")), "pairs")
        windows = pairs.groupBy("anchor").agg(F.collect_list(window(F.col("window"), F.col("low"), F.col("high"))).alias("windows"))  # `positives` at most
        wrong = index.top(asked.join(windows, "anchor"), blocks, negatives, False)
        out = pairs.join(wrong, ["anchor", "window"])
        named = {"anchor": "anchor_id", "positive": "positive_id", "rank": "rank", "id": "negative_id", "positive_score": "positive_score", "score": "negative_score"}
        return written(out.select(*(F.col(c).alias(n) for c, n in named.items())), "negatives")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth row among all rows, some of whose labels are wrong."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", wrong.alias("label"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
