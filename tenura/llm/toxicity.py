"""Toxicity by weak supervision.

Voters. Many weak voters look at a text: words of a lexicon, patterns, and word stems mined from labelled texts. A stem
votes where a text is dense in it: under several word forms, or as a good share of its words. Stems need not be pure;
how far each voter can be trusted is for the label model to say. Two voters speak for the other class: silence of all,
and stray mentions of stems too thin for a vote.

Label model. A generative model explains the votes: each class has a rate for each voter, and within a class the voters
depend on one another along a tree, the one of largest mutual information (Chow and Liu), so that voters that repeat one
another count once. Rates, correlations and classes are estimated by expectation maximisation on the votes alone.

Classifier. A linear classifier on the texts' features (votes, how dense a text is in each stem, surface figures) is
trained on the label model's posteriors, then its scale is set on the labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, sigmoid, table, texts_of, written
from .quality import labelled_sample, plain_rows, spark_frame

#: Insults that vote one by one.
LEXICON = (
    "arschloch bastard bitch bobo cabron clown connard cretin cretino depp disgusting dumb dumbass enculé estupido fdp freak garbage gilipollas hateful hure "
    "idiot idiota imbecile jerk kretin loser lügner merde mierda mistkerl moron nazi pathetic pendejo pig puta pute retard retarded salaud scheiße schlampe scum "
    "stupid subhuman sucker trash tonto ugly vermin wichser worthless"
).split()
#: Pattern voters.
PATTERNS = {
    "address": re.compile(r"\b(?:you|your|du|dein|tu|vous|eres)\b[^.!?\n]{0,40}\b(?:idiot|moron|loser|scum|trash|clown|stupid|worthless|pathetic|disgusting)", re.IGNORECASE),
    "threat": re.compile(r"\b(?:kill|hurt|destroy|hang|shoot)\s+(?:you|him|her|them|yourself)\b", re.IGNORECASE),
    "masked": re.compile(r"\b[a-z]{1,3}[*@#]{2,}[a-z]{0,3}\b", re.IGNORECASE),
}
#: Without a match of this, the first pattern need not be tried.
INSULT = re.compile(r"idiot|moron|loser|scum|trash|clown|stupid|worthless|pathetic|disgusting", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
#: Letters of the stems that are mined; longer ones add nothing to their beginnings.
STEM_LENGTHS = range(3, 13)
#: Labelled rows used at most (for mining stems, for the label model and for the classifier).
SAMPLE_ROWS = 20_000
#: A text is dense in a stem if so many of its words begin with it and such a share of its distinct words do, or a larger share of these alone.
DENSE_WORDS, DENSE_SHARE, FEW_SHARE = 2, 0.008, 0.05
#: A stem needs so many dense toxic texts, and a rate among toxic texts so many times that among others; the STEMS best vote, none of them the beginning of another.
STEM_TEXTS, STEM_LIFT, STEMS = 6, 8.0, 200
#: A mined word needs so many toxic texts, and such a share of toxic ones among those that hold it.
WORD_TEXTS, WORD_SHARE = 12, 0.95
#: A word of the lexicon leaves if so many labelled texts hold it and fewer than half of them are toxic.
DOUBT_TEXTS = 5


def lower_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sketch(words: list[str]) -> int:
    """The least hashes of the text's word triples under three functions, as one: copies share it, so that one text of a group of copies is mined; texts that share a passage hardly do."""
    triples = {" ".join(t) for t in zip(words, words[1:], words[2:], strict=False)} or {" ".join(words)}
    least = (min(xxhash.xxh3_64_intdigest(t, seed) for t in triples) for seed in range(3))
    return xxhash.xxh3_64_intdigest(",".join(map(str, least)))


def dense(hits: np.ndarray | int, forms: np.ndarray | int, distinct: int) -> np.ndarray | bool:
    """Of words that begin with a stem: how many, how many distinct ones, among how many distinct ones of the text."""
    return (hits >= DENSE_WORDS) & (forms >= DENSE_SHARE * distinct) | (forms > 0) & (forms >= FEW_SHARE * distinct)


def dense_stems(words: list[str]) -> list[str]:
    """Stems in which a text of these words is dense by distinct words alone, so that a repeated word mines nothing."""
    distinct = set(words)
    forms = Counter(w[:k] for w in distinct for k in STEM_LENGTHS if len(w) >= k)
    return [s for s, n in forms.items() if dense(n, n, len(distinct))]


@dataclass
class Voters:
    words: list[str]
    stems: list[str]

    def __post_init__(self) -> None:
        self.word_at = {w: i for i, w in enumerate(self.words)}
        self.stem_at = {s: len(self.words) + i for i, s in enumerate(self.stems)}
        self.lengths = sorted({len(s) for s in self.stems})
        #: Voters for the class, then the two against it: silence and stray mentions.
        self.positive = len(self.words) + len(self.stems) + len(PATTERNS)
        self.size = self.positive + 2
        lead = sorted({re.escape(w) for w in [*self.words, *self.stems]})
        self.any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(lead) + ")") if lead else None

    def look(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(votes, surface): times that each voter votes; how dense the text is in each stem, and figures of its surface."""
        out = np.zeros(self.size)
        hits, share = np.zeros((2, len(self.stems)))
        low = text.lower()
        stray = False
        if self.any is not None and self.any.search(low):
            found = Counter(WORD.findall(low))
            for w, n in found.items():
                if (i := self.word_at.get(w)) is not None:
                    out[i] += n
                for k in self.lengths:
                    if (i := self.stem_at.get(w[:k])) is not None and len(w) >= k:
                        hits[i - len(self.words)] += n
                        share[i - len(self.words)] += 1
            full = dense(hits, share, len(found))
            out[len(self.words) : len(self.words) + len(share)] = np.where(full, hits, 0)
            stray = bool(((share > 0) & ~full).any())
            share /= len(found)
        at = self.positive - len(PATTERNS)
        if INSULT.search(text):
            out[at] = sum(1 for _ in PATTERNS["address"].finditer(text))
        out[at + 1] = sum(1 for _ in PATTERNS["threat"].finditer(text))
        if "*" in text or "@" in text or "#" in text:
            out[at + 2] = sum(1 for _ in PATTERNS["masked"].finditer(text))
        quiet = not out[: self.positive].any()
        out[-2], out[-1] = quiet and not stray, quiet and stray
        n = max(len(text), 1)
        figures = [np.log1p(text.count(" ") + 1) / 10, min(50 * text.count("!") / n, 2), min(20 * text.count("*") / n, 2)]
        return out, np.r_[np.minimum(30 * share, 2), min(20 * share.sum(), 3), figures]


def features(votes: np.ndarray, surface: np.ndarray) -> np.ndarray:
    """Of the classifier: which voters vote, how many of them for the class and how often, and the text's own figures."""
    v = np.minimum(votes, 1)
    for_it = v[:, :-2]
    return np.column_stack([v, for_it.max(1, initial=0), np.log1p(for_it.sum(1)), np.log1p(votes[:, :-2].sum(1)), surface])


def dependency_tree(joint: np.ndarray) -> list[int]:
    """Parents of voters (-1: none) in the tree of largest mutual information; joint[a, b] are (n, n) probabilities of the values a and b of two voters, summed over classes as information adds up."""
    n = joint.shape[-1]
    parent, best, inside = [-1] * n, np.full(n, 1e-6), np.zeros(n, bool)
    for _ in range(n):
        j = int(np.argmax(np.where(inside, -1, best)))
        inside[j] = True
        better = ~inside & (joint[j] > best)
        best[better] = joint[j][better]
        for i in np.flatnonzero(better).tolist():
            parent[i] = j
    return parent


def label_model(votes: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the class for each row of votes (the last two columns speak against it), by EM.

    Each class has, for each voter, the probability of a vote given what the voter's parent in the dependency tree does;
    rates, tree and posteriors are estimated in turn. It starts from any vote for the class against none.
    """
    v = (votes > 0).astype(np.float64)
    start = np.where(v[:, :-2].any(1), 0.9, 0.02)
    v = v[:, (v.sum(0) > 0) & (v.sum(0) < len(v))]
    if not v.shape[1]:
        return start
    q = start
    for _ in range(rounds):
        log_odds = np.log((q.sum() + 1) / ((1 - q).sum() + 1))
        single, pair, information = [], [], 0.0
        for w in (q, 1 - q):
            total = w.sum() + 2
            one = (w @ v + 0.2) / total  # P(vote)
            both = ((v * w[:, None]).T @ v + 0.2 * np.minimum(one[:, None], one[None])) / total
            both = np.minimum(both, np.minimum(one[:, None], one[None]))
            cells = [(both, one[:, None] * one[None]), (one[:, None] - both, one[:, None] * (1 - one)[None]), (one[None] - both, (1 - one)[:, None] * one[None]), (1 - one[:, None] - one[None] + both, (1 - one)[:, None] * (1 - one)[None])]
            information = information + w.sum() / len(v) * sum(np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(e, 1e-12)), 0) for p, e in cells)
            single.append(one), pair.append(both)
        np.fill_diagonal(information, 0)
        parent = dependency_tree(information)
        score = np.full(len(v), log_odds)
        for j, p in enumerate(parent):
            logs = []
            for one, both in zip(single, pair, strict=True):
                if p < 0:
                    given = np.full(len(v), one[j])
                else:
                    yes, no = both[j, p] / one[p], (one[j] - both[j, p]) / (1 - one[p])
                    given = np.where(v[:, p] > 0, yes, no)
                given = np.clip(given, 1e-4, 1 - 1e-4)
                logs.append(np.log(np.where(v[:, j] > 0, given, 1 - given)))
            score += logs[0] - logs[1]
        q = sigmoid(score)
    return q


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x1.T @ (q - p) - ridge * w * np.r_[np.ones(len(w) - 1), 0])
    return w


@dataclass
class Toxicity:
    voters: Voters
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        votes, surface = (np.stack(x) for x in zip(*map(self.voters.look, texts), strict=True))
        z = features(votes, surface) @ self.weights[:-1] + self.weights[-1]
        return sigmoid(self.slope * z + self.shift)


def fit_scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a calibrated probability of y (smoothed targets)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * z + b)
        h = p * (1 - p) + 1e-9
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(m, [((p - t) * z).sum(), (p - t).sum()])
        a, b = a - 0.5 * d[0], b - 0.5 * d[1]
    return max(float(a), 0.05), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", most: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on labelled rows where `learn` holds: `most` of them at most, a documented bound; their ids are broadcast.

    What comes to the driver is bounded by `most` too: the best stems and words, then each sampled text's votes. Without
    labelled rows the lexicon and the patterns vote alone.
    """
    spark = docs.sparkSession
    ids = spark_frame(spark, labelled_sample(labels, label, learn, most).collect())
    rows = plain_rows(docs).join(F.broadcast(ids), "doc_id")

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for b in batches:
            words = [lower_words(x) for x in texts_of(b)]
            columns = [pa.array([sketch(w) - (1 << 63) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], kind), pa.array([dense_stems(w) for w in words], kind)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *columns], ["doc_id", "y", "sketch", "words", "stems"])

    told = map_arrow(rows.select("doc_id", "y", "text"), mined, "doc_id long, y int, sketch long, words array<string>, stems array<string>")
    # one text of each group of copies
    told = written(told.groupBy("sketch", "y").agg(F.min_by(F.struct("words", "stems"), "doc_id").alias("t")).select("y", "t.words", "t.stems"), "toxic-words")
    of = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(of.get(0, 0) / max(of.get(1, 0), 1))
    by = lambda c: told.select("y", F.explode(c).alias("word")).groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other"))
    lift = F.col("toxic") * rate >= STEM_LIFT * (F.col("other") + 0.5)
    good = by("stems").where((F.col("toxic") >= STEM_TEXTS) & lift).orderBy(F.desc(F.col("toxic") - F.col("other")), F.length("word"), "word").limit(20 * STEMS)
    kept: list[str] = []
    for r in good.collect():
        if len(kept) < STEMS and not any(r["word"].startswith(p) or p.startswith(r["word"]) for p in kept):
            kept.append(r["word"])
    by_word = by("words")
    doubted = {r["word"] for r in by_word.where(F.col("word").isin(*LEXICON) & (F.col("toxic") + F.col("other") >= DOUBT_TEXTS) & (F.col("toxic") < F.col("other"))).collect()}
    telling = by_word.where((F.col("toxic") >= WORD_TEXTS) & (F.col("toxic") >= WORD_SHARE * (F.col("toxic") + F.col("other"))))
    words = [r["word"] for r in telling.orderBy(F.desc("toxic"), "word").limit(STEMS).collect()]
    lexicon = sorted({*LEXICON} - doubted | {w for w in words if not any(w.startswith(s) for s in kept)})
    voters = Voters(lexicon, sorted(kept))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for b in batches:
            seen = [voters.look(x) for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array([x[k] for x in seen], kind) for k in (0, 1))], ["doc_id", "y", "votes", "surface"])

    found = map_arrow(rows.select("doc_id", "y", "text"), vote, "doc_id long, y int, votes array<float>, surface array<float>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    votes, surface = (np.array(found.column(c).combine_chunks().flatten(), np.float64).reshape(len(found), -1 if len(found) else 0) for c in ("votes", "surface"))
    y = np.array(found.column("y"), np.float64)
    if not len(found):  # nothing to learn from: one vote tells
        empty = voters.look("")
        x = features(*(v[None] for v in empty))
        w = np.zeros(x.shape[1] + 1)
        w[: voters.positive], w[-1] = 3.0, -3.0
        return Toxicity(voters, w)
    x = features(votes, surface)
    w = fit_linear(x, label_model(votes))
    slope, shift = fit_scale(x @ w[:-1] + w[-1], y)
    return Toxicity(voters, w, slope, shift)


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row.

    A null text is scored as an empty one; repeated rows and ids are scored one by one; whole texts are read; other
    columns are ignored and may have any name; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(texts_of(b)), pa.float64())], ["doc_id", "score"])

    out = map_arrow(plain_rows(docs), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
