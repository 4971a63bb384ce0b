"""Vectors of texts, kept by the hash of model and text, so that only unseen texts are encoded again.

A write is one batch: a folder of Parquet files by the first two digits of the print, written under a name that readers
pass over and renamed once it is whole. So a write that stops half-way leaves nothing that is read, and writers don't
disturb each other: where two batches hold the same print, the later one counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "print string, embedding array<float>, prefix string"


def fingerprint(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, function from a string to its path)"""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of whole batches, in the order in which they were committed."""
    fs, to = file_system(spark, path)
    if not fs.exists(to(path)):
        return []
    found = [s.getPath() for s in fs.listStatus(to(path)) if s.isDirectory()]
    return [p.toString() for p in sorted(found, key=lambda p: p.getName()) if p.getName().startswith("batch-")]


def known(spark: SparkSession, path: str) -> DataFrame:
    """(print, embedding, prefix): one row for each print, from the last batch that has it. A batch that can't be read is an error."""
    parts = [spark.read.schema(KEPT).parquet(b).withColumn("batch", F.lit(i)) for i, b in enumerate(batches(spark, path))]
    if not parts:
        return spark.createDataFrame([], KEPT)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("prefix", "print").agg(F.max_by("embedding", "batch").alias("embedding")).select("print", "embedding", "prefix")


def commit(vectors: DataFrame, path: str) -> str:
    """Writes (print, embedding) as one batch; gives its folder."""
    spark = vectors.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged, to_be = f"{path}/_staged-{name}", f"{path}/batch-{name}"
    fs, to = file_system(spark, path)
    kept = vectors.select("print", F.col("embedding").cast("array<float>").alias("embedding"), F.substring("print", 1, 2).alias("prefix"))
    try:
        kept.write.partitionBy("prefix").parquet(staged)
        if not fs.rename(to(staged), to(to_be)):
            raise OSError(f"{staged} can't be renamed")
    except BaseException:
        fs.delete(to(staged), True)
        raise
    return to_be


def encoded(rows: DataFrame, text: str, path: str, model: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with `embedding`. `encode` turns (print, text) into (print, embedding); what it makes is kept in the folder `path`."""
    spark = rows.sparkSession
    keyed = rows.withColumn("print", fingerprint(F.col(text), model)).withColumn("prefix", F.substring("print", 1, 2))
    wanted = keyed.select("print", F.col(text).alias("text"), "prefix").dropDuplicates(["print"])
    commit(encode(wanted.join(known(spark, path), ["prefix", "print"], "left_anti")), path)
    return keyed.join(known(spark, path), ["prefix", "print"]).drop("print", "prefix")
