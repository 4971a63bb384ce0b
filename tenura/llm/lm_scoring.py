"""LM scoring: corpus counts, a log-bilinear model trained on all training texts, and scores of whole texts.

Counts. Every word of every training text is counted. Words with at least a count that is chosen so that at most
FREQUENT words have it are the frequent ones: a bounded table, which every worker gets. Other words of a text are looked
up by a join; a text's scores need of them only the sum of log10(count + 1), so they travel as (row, word, times).

Model. A token's probability has two steps. The model gives that of its unit: the end of a text, one of the most
frequent words, or a class of all other words, by their last bytes. Units grow with the root of the distinct words that
were counted, up to SIZE. Within its class, a word has its share by count, plus one for each and for unseen ones.

Training. Texts are dealt to shards of about SHARD tokens by hash, in ROUNDS parts. In each part, every shard trains a
copy of the model so far by noise-contrastive estimation, and the copies are averaged by tokens. Shards, their order and
their draws come from the texts and their number alone, so scores don't depend on how the table is partitioned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, chunks, crc_mod, map_arrow, table, words_of, written
from .log_bilinear import DIM, END, LogBilinear, Trainer, contexts, normalisers, start

FREQUENT, SIZE, LEAST_SIZE = 262_144, 2048, 64
SHARD, ROUNDS = 2_000_000, 3
#: Words that a worker counts before it hands its counts on.
HELD = 300_000


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the whole texts of rows (text), words as in `words_of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return b

        for b in batches:
            for text in b.column("text").to_pylist():
                held.update(words_of(text))
                if len(held) > HELD:
                    yield out()
        yield out()

    return map_arrow(rows, run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ending(word: bytes) -> int:
    """What classes go by: a hash of the last two bytes."""
    return zlib.crc32(word[-2:])


class Classes(dict):
    """word -> its class of `n`, by its ending."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def of(self, words: list[bytes]) -> list[int]:
        return [self[w[-2:]] for w in words]

    def __missing__(self, end: bytes) -> int:
        found = self[end] = ending(end) % self.n
        return found


class Counts:
    """What scoring needs of the training counts: totals, the frequent words, most frequent first, and totals of classes.

    Units: 0 is the first class, 1 the end, then come the `single` most frequent words, then the other classes.
    """

    def __init__(self, words: list[str], counts: list[int], n_words: int, n_distinct: int, n_texts: int, size: int, endings: dict[int, tuple[int, int]]):
        """`endings` has (words, distinct words) by `ending`."""
        raw = [w.encode() for w in words]
        self.index = {w: i for i, w in enumerate(raw)}
        self.c = np.array(counts, np.float64)
        self.ends = n_texts
        self.total = n_words + n_texts
        self.distinct = n_distinct + (n_texts > 0)
        self.classes = max(1, size // 2)
        self.single = min(size - self.classes - 1, len(words))
        self.size = 1 + self.single + self.classes
        self.class_total, self.class_distinct = np.zeros((2, self.classes))
        for e, (n, d) in endings.items():
            self.class_total[e % self.classes] += n
            self.class_distinct[e % self.classes] += d
        of = np.array(Classes(self.classes).of(raw), np.int64)
        np.subtract.at(self.class_total, of[: self.single], self.c[: self.single])
        np.subtract.at(self.class_distinct, of[: self.single], 1)
        self.unit = np.where(np.arange(len(raw)) < self.single, np.arange(len(raw)) + 2, self.unit_of_class(of))
        self.unigram = np.zeros(self.size)
        self.unigram[self.unit_of_class(np.arange(self.classes))] = self.class_total
        self.unigram[END] = n_texts
        self.unigram[2 : 2 + self.single] = self.c[: self.single]

    def unit_of_class(self, k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, 0, 1 + self.single + k)

    def units(self, split: list[list[bytes]], at: np.ndarray) -> np.ndarray:
        """Units of tokens from their places (see `placed`)."""
        out = np.full(len(at), END)
        known = at >= 0
        out[known] = self.unit[at[known]]
        rare = np.flatnonzero(at == -1)
        if len(rare):
            words = list(chain.from_iterable((*s, b"") for s in split))
            out[rare] = self.unit_of_class(np.array(Classes(self.classes).of([words[i] for i in rare.tolist()])))
        return out


def units_for(n_distinct: int) -> int:
    return int(min(SIZE, max(LEAST_SIZE, n_distinct**0.5)))


def gather_counts(rows: DataFrame, frequent: int = FREQUENT, size: int | None = None) -> tuple[Counts, DataFrame]:
    counted = written(word_counts(rows), "counts")
    step = F.floor(8 * F.log2(F.col("c")))  # some hundreds of values, whatever the counts
    by_log = counted.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    least, have = None, 0
    for r in sorted(by_log, key=lambda r: -r["k"]):
        have += r["n"]
        if have > frequent:
            break
        least = r["k"]
    top = counted.where(step >= least).collect() if least is not None else []
    top.sort(key=lambda r: (-r["c"], r["word"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.array([ending(w.encode()) for w in b.column("word").to_pylist()], np.int64)
            found, at = np.unique(e, return_inverse=True)
            c = np.bincount(at, b.column("c").to_numpy(), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(c), pa.array(np.bincount(at, minlength=len(found)).astype(np.int64))], ["e", "n", "d"])

    # at most 65,792 endings, whatever the words
    ends = {r["e"]: (r["n"], r["d"]) for r in map_arrow(counted, run, "e long, n long, d long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}
    n_distinct = sum(r["n"] for r in by_log)
    return Counts([r["word"] for r in top], [r["c"] for r in top], sum(r["c"] for r in by_log), n_distinct, rows.count(), size or units_for(n_distinct), ends), counted


def placed(texts: list[str | None], index: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words by text; the place of each word in `index` or -1, with -2 for the end after each text's; where texts begin."""
    split = [words_of(x) for x in texts]
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    at = np.full(int(size.sum()), -2, np.int64)
    begin = np.cumsum(size) - size
    inner = np.ones(len(at), bool)
    inner[begin + size - 1] = False
    at[inner] = np.fromiter(map(index.get, chain.from_iterable(split), repeat(-1)), np.int64, int(size.sum()) - len(split))
    return split, at, begin


def train(rows: DataFrame, counts: Counts, shard: int = SHARD, rounds: int = ROUNDS) -> LogBilinear:
    """The model after `rounds` averages of the copies that the shards of `rows` (doc_id, text) train."""
    model = start(counts.unigram)
    spark = rows.sparkSession
    n = max(1, -(-counts.total // (shard * rounds)))
    place = F.xxhash64("doc_id", "text")
    dealt = rows.select("text", place.alias("place"), F.pmod(place, F.lit(rounds)).alias("round"), F.pmod(F.shiftright(place, 20), F.lit(n)).cast("int").alias("shard"))
    for part in range(rounds):
        shared = spark.sparkContext.broadcast((counts, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            counts, model = shared.value
            texts = ((s, t or "") for b in batches for s, t in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True))
            for of, group in groupby(texts, key=lambda x: x[0]):
                trainer = Trainer(model, counts.unigram, seed=part * n + of)
                for chunk in of_characters(t for _, t in group):
                    split, at, begin = placed(chunk, counts.index)
                    first = np.zeros(len(at), bool)
                    first[begin] = True
                    trainer.learn(counts.units(split, at), first)
                v = trainer.m.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v * trainer.tokens), pa.array(np.full(len(v), float(trainer.tokens)))], ["i", "v", "n"])

        mine = dealt.where(F.col("round") == part).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "place", "text").select("shard", "text")
        summed = map_arrow(mine, run, "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if summed.num_rows:
            flat = np.zeros(summed.num_rows)
            flat[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
            model = LogBilinear.unflat(flat, counts.size, DIM)
        shared.unpersist()
    return model


def of_characters(texts: Iterator[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about `most` characters, one text at least."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def score(docs: DataFrame, counts: Counts, counted: DataFrame, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    base_score sums log10((c + 1) / (N + V + 1)) over the words and one end, score the model's log10 probabilities of
    the same tokens. A null text is scored as an empty one (its end only); rows that repeat an id are scored one by
    one; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts, *model.tables(), normalisers(spark, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, a1, a2, z = shared.value
        logs = np.r_[np.log10(counts.c + 1), np.log10(counts.ends + 1.0), 0.0]  # -2: the end, -1: looked up later
        # what a token adds by its share within its class, but for the class's own constant
        outside = np.r_[np.zeros(counts.single), logs[counts.single : -2], 0.0, 0.0]
        rest = np.zeros(counts.size)
        rest[counts.unit_of_class(np.arange(counts.classes))] = np.log10(counts.class_total + counts.class_distinct + 1.0)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        row = 0
        kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())]))
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in chunks(texts):
                split, at, begin = placed(texts[i:j], counts.index)
                w = counts.units(split, at)
                first = np.zeros(len(at), bool)
                first[begin] = True
                w1, w2 = contexts(w, first)
                by_token = ((a1[w1, w] + a2[w2, w]).astype(np.float64) - z[w2, w1]) / np.log(10)
                by_token += outside[at] - rest[w]
                rare, last = [], np.r_[begin[1:], len(at)]
                for s, p, e in zip(split, begin.tolist(), last.tolist(), strict=True):
                    found = Counter([s[k] for k in np.flatnonzero(at[p : e - 1] == -1)])
                    rare.append([{"word": x.decode(), "times": n} for x, n in found.items()])
                out = [
                    pa.array(np.arange(part + row, part + row + j - i)),
                    ids.slice(i, j - i),
                    pa.array(last - begin),
                    pa.array(np.add.reduceat((at >= 0) | ((at == -2) & (counts.ends > 0)), begin, dtype=np.int64)),
                    pa.array(np.add.reduceat(logs[at], begin)),
                    pa.array(np.add.reduceat(by_token, begin)),
                    pa.array(rare, kind),
                ]
                row += j - i
                yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "n_tokens", "n_known", "logs", "score", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = written(map_arrow(rows, run, "row long, doc_id long, n_tokens long, n_known long, logs double, score double, rare array<struct<word string, times int>>"), "scored")
    looked = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counted, "word")
    more = looked.groupBy("row").agg(F.sum("times").cast("long").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = part.drop("rare").join(more, "row", "left").withColumns({"known": F.coalesce("known", F.lit(0)), "more": F.coalesce("more", F.lit(0.0))})
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(int(counts.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(counts.total + counts.distinct + 1.0)))).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 7) == 2
    rows = docs.where(~held).select("doc_id", "text")
    counts, counted = gather_counts(rows.select("text"))
    scored = score(docs, counts, counted, train(rows, counts))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
