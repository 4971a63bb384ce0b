"""Encoders of texts: a default one of hashed words that needs no model, and any batch function as one; unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[DataFrame], DataFrame]
#: Texts that a model is given at once.
BATCH = 32


def unit(vector: Column) -> Column:
    """An array scaled to Euclidean length 1; zero vectors stay as they are."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def hashed_words(dims: int = 256) -> Encoder:
    """(print, text) to (print, embedding): counts of words and of their first five letters, damped, hashed to `dims` buckets."""

    def encode(rows: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}+#]+"), F.lit(0))
        terms = F.concat(words, F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, 5))))
        hashed = HashingTF(numFeatures=dims, inputCol="terms", outputCol="counts").transform(rows.select("print", terms.alias("terms")))
        return hashed.select("print", unit(F.transform(vector_to_array("counts"), lambda x: F.log1p(x))).cast("array<float>").alias("embedding"))

    return encode


def model(load: Callable[[], Callable[[list[str]], list]], batch: int = BATCH) -> Encoder:
    """An encoder around a model: `load` is called once a partition and gives a function from texts to vectors."""

    def encode(rows: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vectors_of = load()
            for f in frames:
                texts = f["text"].fillna("").tolist()
                found = [list(map(float, v)) for i in range(0, len(texts), batch) for v in vectors_of(texts[i : i + batch])]
                yield pd.DataFrame({"print": f["print"], "embedding": found})

        made = rows.select("print", "text").mapInPandas(run, "print string, embedding array<float>")
        return made.select("print", unit(F.col("embedding")).cast("array<float>").alias("embedding"))

    return encode
