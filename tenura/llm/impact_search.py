"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Rows are dealt into blocks; each block has an index of its own: per dimension, its rows ordered by their component and
cut into segments of one quantised impact. Seen from a query, a dimension gives each row a non-negative impact (the
distance of its component from the least helpful one, times the query's weight), so a block's segments can be processed
in descending order of impact. After any segment, no row can gain more than the sum over dimensions of the impact that
comes next; rows that can still reach the k-th best are possible members. Processing stops once that bound proves that
few are left, and they are rescored exactly; without proof it goes on to the end. So the result is exact.

Queries are dealt into blocks too, and each block of rows meets each block of queries once; only the k best of each
meeting go on, and the k best of all of them are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune
from .vectors import dots, in_blocks, matrix, scaled, vector_rows, widen

LEVELS = 16
#: Components (scaled) from which on the index isn't used.
LARGEST = 1 << 24


class ImpactIndex:
    """Of one block: `rows` (n x d, integers as int64), `ids`; `largest` bounds the components of queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: int = 1 << 20, levels: int = LEVELS):
        self.ids, self.rows = ids, rows
        n, d = rows.shape
        self.low, self.high = rows.min(0), rows.max(0)
        # sums of products below 2^53 are exact in doubles, which multiply faster
        top = max(int(self.high.max(initial=0)), -int(self.low.min(initial=0)))
        self.exact = rows.astype(np.float64) if d * top * largest < 1 << 53 else rows
        order = np.argsort(rows, axis=0, kind="stable")
        step = np.maximum((self.high - self.low + levels) // levels, 1)
        sorted_rows = np.take_along_axis(rows, order, 0)
        level = (sorted_rows - self.low) // step
        self.order = np.ascontiguousarray(order.T).astype(np.int32)
        #: Of each dimension the segments (begin, end, least value, largest value), ascending.
        self.segments = []
        for j in range(d):
            cut = np.flatnonzero(np.diff(level[:, j])) + 1
            a, b = np.r_[0, cut], np.r_[cut, n]
            self.segments.append((a, b, sorted_rows[a, j], sorted_rows[b - 1, j]))

    def top(self, query: np.ndarray, own: int, k: int, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but row `own`, ties to smaller ids."""
        n = len(self.ids)
        allowed = self.ids != own
        possible = np.flatnonzero(allowed)
        if n > 4 * few and len(possible) > k:
            possible = self.possible(query, allowed, k, few)
        score = (self.exact[possible] @ query.astype(self.exact.dtype)).astype(np.int64)
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible[best]], score[best]

    def possible(self, query: np.ndarray, allowed: np.ndarray, k: int, few: int) -> np.ndarray:
        dims, begin, end, gives, upto, falls = [], [], [], [], [], []
        bound = slack = 0
        for j in np.flatnonzero(query):
            a, b, least, most = self.segments[j]
            w = int(query[j])
            if w > 0:  # largest components first; what a segment gives at least and at most
                g, u = (least - self.low[j])[::-1] * w, (most - self.low[j])[::-1] * w
                a, b = a[::-1], b[::-1]
            else:
                g, u = (self.high[j] - most) * -w, (self.high[j] - least) * -w
            dims.append(np.full(len(a), j))
            begin.append(a), end.append(b), gives.append(g), upto.append(u)
            falls.append(u - np.r_[u[1:], 0])
            bound += int(u[0])
            slack += int((u - g).max())  # what quantisation may hide from a row: one segment of each dimension
        if not dims:
            return np.flatnonzero(allowed)
        rank = np.argsort(-np.concatenate(upto), kind="stable")
        plan = [np.concatenate(x)[rank].tolist() for x in (dims, begin, end, gives, falls)]
        acc = np.zeros(len(self.ids), np.int64)  # what a row has at least
        check = max(len(rank) // 8, 1)
        left = np.flatnonzero(allowed)
        for i, (j, a, b, g, fall) in enumerate(zip(*plan, strict=True), 1):
            if g:
                acc[self.order[j, a:b]] += g
            bound -= fall
            if i % check == 0 and 2 * i > len(rank):
                had = acc[left]
                kth = np.partition(had, len(left) - k)[len(left) - k]
                left = left[had + (bound + slack) >= kth]
                if len(left) <= few:
                    break
        return left


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 16384, query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest integer inner products, for each query.

    Components x become floor(scale * x), exactly, whatever their size; a score beyond +-(2^63 - 1) is cut to that. Vectors that are null, empty or hold null or
    non-finite components take no part, as query or as row; rows without an id neither. Vectors of different lengths
    count as filled with zeros. A query's own id is no candidate of it; rows that repeat an id count one by one; a
    repeated query gives its rows once. Ties go to the smaller id. Empty tables give empty results.
    """
    tune(vectors.sparkSession)
    rows = vector_rows(vectors, id_col, vector_col, False)
    asked = vector_rows(queries, id_col, vector_col, False).dropDuplicates(["id"])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            a = a.sort_by("id")
            x, y = matrix(a.column("vector")), matrix(b.column("vector"))
            width = max(x.shape[1], y.shape[1])
            x, y = scaled(widen(x, width), scale), scaled(widen(y, width), scale)
            ids, small = a.column("id").to_numpy(), x.dtype != object and y.dtype != object and max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < LARGEST
            index = ImpactIndex(ids, x.astype(np.int64), int(np.abs(y).max())) if small else None
            for q, v in zip(b.column("id").to_pylist(), y, strict=True):
                if index:
                    found, score = index.top(v.astype(np.int64), q, k, few=max(8 * k, len(ids) // 50))
                else:  # sums of impacts could leave 64 bits: every row is scored exactly
                    every = dots(v[None], x)[0]
                    best = [i for i in np.argsort(-every, kind="stable") if ids[i] != q][:k]
                    found, score = ids[best], every[best]
                out["query_id"] += [q] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    met = in_blocks(rows, asked, meet, "query_id long, vec_id long, score long", block, query_block)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
