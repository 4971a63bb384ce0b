"""Helpers shared by the text operators: shared scratch tables, word splitting, batch plumbing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ship

#: Rows handed to a Python worker at once; long texts are cut into smaller work lists by `chunks`.
BATCH_ROWS = 2000
#: Characters that a worker holds split into words at once.
CHUNK_CHARS = 4_000_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A word, wherever operators speak of words: a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir. Where that is unset and Spark runs within one machine, a temporary folder for each application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tenura-shared-"))
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _open:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, but for the last one with `keep`: nothing returned may read the others."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]
        for path in made[:-1] if keep else made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Sends the package, and lowers the rows of an Arrow batch where the session has more (no result depends on them)."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores put before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Words of 64 bits of the filter below, and of one row of it: a bound on what is broadcast (2 MB in 256 rows).
FILTER_WORDS, FILTER_BLOCK = 1 << 18, 1 << 10


def filter_blocks(hashed: DataFrame) -> DataFrame:
    """(block, masks): the words of a Bloom filter of the hashes `h`, FILTER_BLOCK to a row; blocks without a hash have no row."""
    words = hashed.groupBy(filter_word(F.col("h")).alias("word")).agg(F.bit_or(filter_bit(F.col("h"))).alias("mask"))
    slot = F.pmod("word", F.lit(FILTER_BLOCK)).cast("int").alias("slot")
    held = words.groupBy(F.floor(F.col("word") / FILTER_BLOCK).alias("block")).agg(F.collect_list(F.struct(slot, "mask")).alias("held"))
    bare = F.array_except(F.sequence(F.lit(0), F.lit(FILTER_BLOCK - 1)), F.col("held.slot"))
    full = F.concat("held", F.transform(bare, lambda x: F.struct(x.alias("slot"), F.lit(0).cast("long").alias("mask"))))
    return held.select("block", F.transform(F.array_sort(full), lambda x: x["mask"]).alias("masks"))


def filter_word(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS))


def filter_bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def filtered(rows: DataFrame, keys: list[Column], wanted: DataFrame, flag: str) -> DataFrame:
    """`rows` with a boolean column `flag`: false where `keys` surely equal no row of `wanted` (whose columns they stand for).

    A Bloom filter of one hash and FILTER_WORDS words, whatever the size of `wanted`, made and read by joins. Its words
    are broadcast in blocks, as the driver holds a broadcast several times over and a row for each word takes five times
    their size. As `wanted` grows the filter says true more often, which costs the caller's join work and changes nothing
    in its result.
    """
    at, masks, h = (fresh(rows, f"{flag}_{x}") for x in ("block", "masks", "hash"))
    made = filter_blocks(wanted.select(F.xxhash64(*wanted.columns).alias("h"))).withColumnsRenamed({"block": at, "masks": masks})
    word = filter_word(F.col(h))
    out = rows.withColumn(h, F.xxhash64(*keys)).withColumn(at, F.floor(word / FILTER_BLOCK)).join(F.broadcast(made), at, "left")
    mask = F.get(F.col(masks), F.pmod(word, F.lit(FILTER_BLOCK)).cast("int"))
    hit = F.coalesce(mask.bitwiseAND(filter_bit(F.col(h))) != 0, F.lit(False))
    return out.withColumn(flag, hit).drop(h, at, masks)


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], by: str, salts: int = 16) -> DataFrame:
    """`rows` left-joined with `found` (one row for each key `on`), where a key may hold any share of `rows`: each key is dealt over `salts` tasks by hash of the column `by`, and `found` is copied to them."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives back to the system what this worker no longer uses: idle workers are kept, and their memory with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def relieve(spark: SparkSession) -> None:
    """Collects the driver's garbage, in Python and the JVM, between the steps of long jobs: Spark drops the broadcasts and shuffle files of finished queries only when the driver collects."""
    release()
    spark.sparkContext._jvm.System.gc()


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `most` characters (one text at least)."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8; bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    return text.encode().translate(LOWER).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen lately."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]
