"""Quality classifier: surface features of whole texts, scored by a generalised additive model (see gam.py)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, table, texts_of
from .gam import Gam, fit_gam

FEATURES = (
    "chars", "words", "word_length", "distinct_words", "repeats", "top_word", "upper", "digits", "punctuation", "symbols", "exclaims", "bars",
    "lines", "distinct_lines", "line_length", "wordless", "ends", "short_words", "long_words", "distinct_pairs", "packed", "non_ascii", "entropy", "capitals",
)
SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=+_", np.uint8)
#: Labelled rows that a model is fitted on at most: the first by hash of the id.
SAMPLE_ROWS = 20_000


def text_features(text: str) -> list[float]:
    """The values of FEATURES for one whole text; all are defined for an empty one."""
    raw = text.encode()
    words = text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    space = hist[32] + hist[9:14].sum()
    high = hist[128:].sum()
    share = hist[hist > 0] / n
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        size.mean() if len(words) else 0.0,
        len(counts) / w,
        sum(map(eq, words, words[1:])) / w,
        max(counts.values(), default=0) / w,
        upper / max(upper + lower, 1),
        digits / n,
        (len(raw) - upper - lower - digits - space - high) / n,
        hist[SYMBOLS].sum() / n,
        hist[33] / n,
        hist[124] / n,
        np.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(text) / max(len(lines), 1)),
        sum(not x.isalpha() for x in counts) / max(len(counts), 1),
        (hist[46] + hist[63]) / w,
        (size <= 3).mean() if len(words) else 0.0,
        (size > 12).mean() if len(words) else 0.0,
        len(set(zip(words, words[1:], strict=False))) / w,
        len(zlib.compress(raw, 1)) / n,
        high / n,
        float(-(share * np.log(share)).sum()),
        sum(v for x, v in counts.items() if x[0].isupper()) / w,
    ]


def feature_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, features) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([text_features(x) for x in texts_of(b)], pa.list_(pa.float64()))], ["doc_id", "features"])

    return map_arrow(rows, run, "doc_id long, features array<double>")


def plain_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def labelled_sample(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, y): at most `most` labelled ids, first by hash; of several labels of one id the largest counts."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = SAMPLE_ROWS) -> Gam:
    """Fit on labelled rows where `learn` holds (`most` of them at most, a documented bound; they are broadcast)."""
    sample = labelled_sample(labels, label, learn, most)
    ids = spark_frame(docs.sparkSession, sample.collect())
    rows = plain_rows(docs).join(F.broadcast(ids), "doc_id")
    found = feature_rows(rows.select("doc_id", "text")).dropDuplicates(["doc_id"]).join(F.broadcast(ids), "doc_id").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in found], np.float64).reshape(len(found), len(FEATURES))
    return fit_gam(x, np.array([r["y"] for r in found], np.float64))


def spark_frame(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(int(r["doc_id"]), int(r["y"])) for r in rows], "doc_id long, y int")


def score_quality(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row.

    A null text is scored as an empty one; repeated rows and ids are scored one by one; other columns are ignored and
    may have any name; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in texts_of(b)], np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    out = map_arrow(plain_rows(docs), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores at least `threshold` (null: as an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in texts_of(b)], np.float64).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return map_arrow(docs, run, docs.schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> Gam:
    """The model of the registered query: rows with crc32(doc_id as text) mod 5 = 0 are held out."""
    return fit_quality(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
