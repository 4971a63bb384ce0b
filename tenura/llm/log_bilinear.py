"""A log-bilinear language model over a small vocabulary, trained in numpy by noise-contrastive estimation.

Ids stand for units of text; 1 is the end of a text (also what stands before its first word). The representation predicted from the two ids before, R[w1] C1 + R[w2] C2, is compared with each word's Q, and a
bias is added. Training tells observed ids from ids drawn from the unigram distribution; scoring normalises over the
vocabulary, with matrix products over batches of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .common import map_arrow, sigmoid

END = 1
DIM, NOISE, BATCH, RATE = 24, 64, 4096, 0.05


@dataclass
class LogBilinear:
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    NAMES = ("r", "c1", "c2", "q", "b")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    @classmethod
    def unflat(cls, v: np.ndarray, size: int, dim: int) -> LogBilinear:
        shapes = {"r": (size, dim), "c1": (dim, dim), "c2": (dim, dim), "q": (size, dim), "b": (size,)}
        out, at = {}, 0
        for n, s in shapes.items():
            k = int(np.prod(s))
            out[n] = v[at : at + k].reshape(s).copy()
            at += k
        return cls(**out)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(by w1, by w2): a token's log-probability is the sum of its entries, minus `log_sums` of its context."""
        a1 = (self.r @ self.c1 @ self.q.T).astype(np.float32) + self.b.astype(np.float32)
        return a1, (self.r @ self.c2 @ self.q.T).astype(np.float32)


def log_sums(a1: np.ndarray, a2: np.ndarray, w2: int, block: int = 256) -> np.ndarray:
    """The log of the sum over all units, by w1, after w2."""
    out = np.empty(len(a1), np.float32)
    for i in range(0, len(a1), block):
        s = a1[i : i + block] + a2[w2]
        top = s.max(1, keepdims=True)
        out[i : i + block] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
    return out


def normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    """[w2, w1]: log_sums of all contexts, made by all machines; as many squared as there are units."""
    size = len(model.b)
    shared = spark.sparkContext.broadcast(model.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a1, a2 = shared.value
        for b in batches:
            for w2 in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([w2]), pa.array([log_sums(a1, a2, w2).tobytes()], pa.binary())], ["w2", "z"])

    rows = map_arrow(spark.range(0, size, 1, max(1, size // 64)), run, "w2 long, z binary").collect()
    z = np.empty((size, size), np.float32)
    for r in rows:
        z[r["w2"]] = np.frombuffer(r["z"], np.float32)
    shared.unpersist()
    return z


def start(counts: np.ndarray, dim: int = DIM, seed: int = 3) -> LogBilinear:
    """Before training: the unigram distribution of `counts`, by id."""
    rng = np.random.default_rng(seed)
    p = (counts + 0.5) / (counts + 0.5).sum()
    return LogBilinear(rng.normal(0, 0.1, (len(p), dim)), np.eye(dim), np.eye(dim) * 0.5, rng.normal(0, 0.1, (len(p), dim)), np.log(p))


def contexts(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two before each, END before the first of a text; `first` marks where texts begin."""
    w1 = np.r_[END, ids[:-1]] if len(ids) else ids
    w1 = np.where(first, END, w1)
    w2 = np.r_[END, w1[:-1]] if len(ids) else ids
    return w1, np.where(first, END, w2)


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums `rows` by `at`; gives the distinct places, `to` being changed there."""
    order = np.argsort(at, kind="stable")
    places, begin = np.unique(at[order], return_index=True)
    to[places] = np.add.reduceat(rows[order], begin, axis=0)
    return places


class Trainer:
    """Trains a copy of a model, one chunk of ids after another; Adagrad."""

    def __init__(self, model: LogBilinear, counts: np.ndarray, seed: int):
        self.m = LogBilinear.unflat(model.flat().astype(np.float32), *model.r.shape)
        p = (counts + 0.5) / (counts + 0.5).sum()
        self.log_noise = np.log(NOISE * p).astype(np.float32)
        self.cum = np.cumsum(p)
        self.rng = np.random.default_rng(seed)
        self.sq = {n: np.full_like(getattr(self.m, n), 1e-8) for n in LogBilinear.NAMES}
        self.tokens = 0

    def step(self, name: str, g: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        s, v = self.sq[name], getattr(self.m, name)
        s[at] += g * g
        v[at] -= RATE * g / np.sqrt(s[at])

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        """All tokens of a chunk, dealt by chance to batches of BATCH tokens: equal triples of a batch are one example that weighs as many, and every token weighs 1 / BATCH."""
        size = len(self.m.b)
        w1, w2 = contexts(ids, first)
        key = self.rng.permutation((w2.astype(np.int64) * size + w1) * size + ids)
        self.tokens += len(ids)
        for i in range(0, len(key), BATCH):
            k, n = np.unique(key[i : i + BATCH], return_counts=True)
            self.batch(k // (size * size), k // size % size, k % size, (n / BATCH).astype(np.float32))

    def batch(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        m = self.m
        noise = np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1])
        r1, r2 = m.r[w1], m.r[w2]
        pred = r1 @ m.c1 + r2 @ m.c2
        qw, qn = m.q[w], m.q[noise]
        d = (sigmoid((pred * qw).sum(1) + m.b[w] - self.log_noise[w]) - 1) * weight
        dn = sigmoid(pred @ qn.T + m.b[noise] - self.log_noise[noise]) * weight[:, None]
        back = d[:, None] * qw + dn @ qn
        gq, gb = np.zeros_like(m.q), np.zeros_like(m.b)
        at_q = add_rows(gq, np.r_[w, noise], np.concatenate([d[:, None] * pred, dn.T @ pred]))
        np.add.at(gb, np.r_[w, noise], np.r_[d, dn.sum(0)])
        gr = np.zeros_like(m.r)
        at_r = add_rows(gr, np.r_[w1, w2], np.concatenate([back @ m.c1.T, back @ m.c2.T]))
        self.step("c1", r1.T @ back)
        self.step("c2", r2.T @ back)
        self.step("q", gq[at_q], at_q)
        self.step("r", gr[at_r], at_r)
        self.step("b", gb[at_q], at_q)
