"""Reading of vector tables: which rows take part, and as what arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str, nonzero: bool) -> Column:
    """True for vectors without null or non-finite components, neither null nor empty, and with `nonzero` not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(column).isNotNull() & (F.size(column) > 0) & ~bad
    return F.coalesce(ok & F.exists(column, lambda x: x != 0) if nonzero else ok, F.lit(False))


def vector_rows(df: DataFrame, id_col: str, vector_col: str, nonzero: bool, more: list[str] | None = None) -> DataFrame:
    """(id long, vector array<double>) of the rows that take part, and the columns `more`; rows without an id take none."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *(more or []))
    return rows.where(F.col("id").isNotNull() & usable("vector", nonzero))


def in_blocks(rows: DataFrame, asked: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int, query_block: int) -> DataFrame:
    """Each block of `rows` meets each block of `asked` once, as search(rows, asked). Blocks are dealt by hash of the id, so copies and near copies of a vector spread over all of them."""
    n_rows = max(1, -(-rows.count() // block))
    n_asked = max(1, -(-asked.count() // query_block))
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_rows)).cast("int")
    left = rows.withColumn("block", salt).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    salt = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_asked)).cast("int")
    right = asked.withColumn("q", salt).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    return left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInArrow(search, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows as doubles; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where those are exact, else as Python's integers (dtype object)."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if np.abs(y).max(initial=0) < 1 << 53:
        return y
    whole = lambda v, w: int(w) if math.isfinite(w) else scale * int(v)
    return np.array([[whole(v, w) for v, w in zip(a, b, strict=True)] for a, b in zip(x.tolist(), y.tolist(), strict=True)], object)


LONG = (1 << 63) - 1


def dots(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of y with the rows of x, both from `scaled`: exact, as int64; what is beyond +-(2^63 - 1) is cut to that."""
    top = x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0))
    if top < 1 << 53:
        return (y.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < LONG:
        return y.astype(np.int64) @ x.astype(np.int64).T
    large = np.array([[int(v) for v in r] for r in y.tolist()], object) @ np.array([[int(v) for v in r] for r in x.tolist()], object).T
    return np.clip(large, -LONG, LONG).astype(np.int64)


def shrunk(x: np.ndarray) -> np.ndarray:
    """Each row (none of zeros) times a power of two, so that its largest component is between 1/2 and 1: directions and cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
