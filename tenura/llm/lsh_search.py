"""Approximate nearest neighbours by cosine, with multiprobe p-stable hashing.

Vectors are scaled to unit length, where the Euclidean distance orders as the cosine does. Each of TABLES tables hashes
a vector by HASHES functions floor((a.x + b) / width), a drawn from a 2-stable (normal) distribution. A query visits, in
each table, its own bucket and then perturbed ones, in the order of the estimated probability that a neighbour lies
there: by the sum over hashes of the squared distance from the query's projection to the slot. The candidates of all
tables are merged and exact cosines in double precision rank them.

The index is dealt into blocks of rows by hash of the id, each with its own buckets; a query visits its buckets in every
block. So no bucket, however popular, is the work of one task, and only the k best of each block go on.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune
from .vectors import in_blocks, matrix, shrunk, vector_rows, widen

#: Chosen for nearly uniform directions in 64 dimensions, where neighbours are far: recall of 0.9 or more there.
TABLES, HASHES, WIDTH, PROBES, REACH, SEED = 2, 6, 2.0, 200, 1, 5


def planes(width: int, tables: int, hashes: int, slot: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, hashes, width) and offsets, the same on every machine for each length of vectors."""
    rng = np.random.default_rng([seed, width])
    return rng.normal(size=(tables, hashes, width)), rng.uniform(0, slot, (tables, hashes))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    y = x / top
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def positions(x: np.ndarray, a: np.ndarray, b: np.ndarray, slot: float) -> np.ndarray:
    """(n, tables, hashes): projections in units of slots."""
    return (np.einsum("nd,thd->nth", unit(x), a) + b) / slot


def bucket_keys(slots: np.ndarray) -> np.ndarray:
    """(n, tables): a 64-bit key for each tuple of slots."""
    h = np.zeros(slots.shape[:2], np.uint64)
    for j in range(slots.shape[2]):
        h = (h ^ slots[:, :, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@lru_cache
def perturbations(hashes: int, reach: int) -> np.ndarray:
    return np.array(list(itertools.product(range(-reach, reach + 1), repeat=hashes)))


def probes(f: np.ndarray, most: int, reach: int) -> np.ndarray:
    """(tables, probes, hashes): the slots that one query (tables, hashes) visits, likeliest first."""
    shifts = perturbations(f.shape[1], reach)
    own = np.floor(f)
    within = f - own
    # distance to the nearest edge of a shifted slot, 0 for the own one
    gap = np.abs(np.where(shifts[None] > 0, shifts[None] - within[:, None], np.where(shifts[None] < 0, within[:, None] - shifts[None] - 1, 0)))
    order = np.argsort((gap**2).sum(2), axis=1, kind="stable")[:, :most]
    return own[:, None].astype(np.int64) + shifts[order]


class Buckets:
    """The hash tables of one block of rows."""

    def __init__(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, slot: float):
        self.a, self.b = a, b
        keys = bucket_keys(np.floor(positions(x, a, b, slot)))
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 0)
        self.hit = np.zeros(len(x), bool)

    def candidates(self, at: np.ndarray, most: int, reach: int) -> np.ndarray:
        """Rows in the buckets that a query at these positions (tables, hashes) visits in any table."""
        wanted = bucket_keys(probes(at, most, reach))
        self.hit[:] = False
        for t, keys in enumerate(wanted):
            begin, end = np.searchsorted(self.keys[:, t], keys, "left"), np.searchsorted(self.keys[:, t], keys, "right")
            for i, j in zip(begin[begin < end], end[begin < end], strict=True):
                self.hit[self.order[i:j, t]] = True
        return np.flatnonzero(self.hit)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of one query with rows, each row by itself, so that equal rows get equal values."""
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def best_rows(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact cosines of the k nearest of `rows` (indices into ids, x and rough, their cosines to within rounding)."""
    keep = rows[ids[rows] != own]
    if len(keep) > k:  # ties with the k-th, to within rounding, stay
        r = rough[keep]
        keep = keep[r >= np.partition(r, len(r) - k)[len(r) - k] - 1e-9]
    if not len(keep):
        return ids[:0], np.zeros(0)
    score = cosines(q, x[keep])
    best = np.lexsort((ids[keep], -score))[:k]
    return ids[keep[best]], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, hashes: int = HASHES, slot: float = WIDTH, n_probes: int = PROBES, reach: int = REACH, block: int = 8192, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by cosine on the original vectors.

    Every row is indexed. Finite vectors of any size count. Vectors that are null, empty, zero or hold null or non-finite components take no part, as
    query or as row; rows without an id neither. Vectors of different lengths count as filled with zeros. A query's own
    id is no candidate of it; a repeated query gives its rows once. Ties go to the smaller id. Where fewer than k
    candidates are in the visited buckets of a block, the whole block is searched, so that min(k, all) come back.
    Empty tables give empty results.
    """
    tune(vectors.sparkSession)
    rows = vector_rows(vectors, id_col, vector_col, True)
    asked = vector_rows(queries, id_col, vector_col, True).dropDuplicates(["id"])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            x, y = shrunk(matrix(a.column("vector"))), shrunk(matrix(b.column("vector")))  # no square of a component overflows or vanishes
            width = max(x.shape[1], y.shape[1])
            x, y = widen(x, width), widen(y, width)
            ids = a.column("id").to_numpy()
            index = Buckets(x, *planes(width, tables, hashes, slot, SEED), slot)
            directions, asks = unit(x), unit(y)
            for i, (q, v, at) in enumerate(zip(b.column("id").to_pylist(), y, positions(y, index.a, index.b, slot), strict=True)):
                if i % 256 == 0:
                    rough = asks[i : i + 256] @ directions.T
                found, score = best_rows(ids, x, index.candidates(at, n_probes, reach), rough[i % 256], v, q, k)
                if len(found) < k:
                    found, score = best_rows(ids, x, np.arange(len(ids)), rough[i % 256], v, q, k)
                out["query_id"] += [q] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    met = in_blocks(rows, asked, search, "query_id long, vec_id long, score double", block, query_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
