"""k-means for many numbers of clusters and many starts in the same scans, and silhouettes of all of them in one.

What grows with the rows is read once a pass: each task holds its rows against the centres of every fit that still moves,
and gives back one partial sum for each centre. The centres themselves (fits x k x dimensions numbers) are few, and are
all that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship

#: Rows that starting centres are drawn from, and rows whose silhouettes are averaged: the first ones by hash of the id.
SAMPLE = 2000


def rows_of(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)


def distances2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of x from the rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def starting_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of x by k-means++: each next one is drawn with the squared distance from those before as its weight."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    gap = distances2(x, x[at])[:, 0]
    while len(at) < k:
        total = gap.sum()
        at.append(int(rng.choice(len(x), p=gap / total)) if total > 0 else int(rng.integers(len(x))))
        gap = np.minimum(gap, distances2(x, x[at[-1:]])[:, 0])
    return x[at].copy()


def partial_sums(x: np.ndarray, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each set of centres: the sums and the numbers of the rows nearest to each centre, and the rows' cost."""
    names = list(sets)
    every = distances2(x, np.concatenate([sets[f] for f in names]))
    out, at = {}, 0
    for f in names:
        k = len(sets[f])
        d = every[:, at : at + k]
        own = d.argmin(1)
        one = (own[:, None] == np.arange(k)).astype(np.float64)
        out[f] = (one.T @ x, one.sum(0), float(d[np.arange(len(x)), own].sum()))
        at += k
    return out


def scan(points: DataFrame, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """`partial_sums` over all rows, added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                for f, part in partial_sums(rows_of(batch), sets).items():
                    got[f] = [a + b for a, b in zip(got[f], part, strict=True)] if f in got else list(part)
        cells = [(f, j, s, float(n), cost if j == 0 else 0.0) for f, (sums, ns, cost) in got.items() for j, (s, n) in enumerate(zip(sums.tolist(), ns, strict=True))]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(kinds)], ["fit", "centre", "sums", "n", "cost"])

    width = len(next(iter(sets.values()))[0])
    parts = points.select("v").mapInArrow(add, "fit int, centre int, sums array<double>, n double, cost double")
    total = parts.groupBy("fit", "centre").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    out = {f: (np.zeros_like(c), np.zeros(len(c)), 0.0) for f, c in sets.items()}
    for r in total.collect():  # a row for each centre of each fit
        sums, ns, cost = out[r["fit"]]
        sums[r["centre"]], ns[r["centre"]] = r["sums"], r["n"]
        out[r["fit"]] = (sums, ns, cost + r["cost"])
    return out


def lloyd(points: DataFrame, starts: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-5) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of each start, all of them moved in the same scans of `points` (v ARRAY<DOUBLE>).

    A fit whose centres move by less than `tolerance` of the rows' spread, in squares, is done and leaves the scans. A
    centre without rows stays where it is. Each fit takes the steps it would take alone.
    """
    ship(points.sparkSession)
    moving = {f: c for f, c in enumerate(starts)}
    done: dict[int, tuple[np.ndarray, float]] = {}
    spread = None
    for left in range(rounds, 0, -1):
        found = scan(points, moving)
        if spread is None:
            f = next(iter(found))
            spread = found[f][2] / max(found[f][1].sum(), 1)
        for f, (sums, ns, cost) in found.items():
            moved = np.where(ns[:, None] > 0, sums / np.maximum(ns, 1)[:, None], moving[f])
            if ((moved - moving[f]) ** 2).sum() <= tolerance * spread or left == 1:
                done[f] = (moving.pop(f), cost)
            else:
                moving[f] = moved
        if not moving:
            break
    return [done[f] for f in range(len(starts))]


def best_fits(points: DataFrame, ks: list[int], starts: int, seed: int) -> dict[int, np.ndarray]:
    """k -> the centres of the cheapest of `starts` fits; all fits of all k share their scans."""
    drawn = np.array([r["v"] for r in points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    plan = [(k, s) for k in ks for s in range(starts)]
    fits = lloyd(points, [starting_centres(drawn, k, seed + 1000 * k + s) for k, s in plan])
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (k, _), (centres, cost) in zip(plan, fits, strict=True):
        if k not in best or cost < best[k][0]:
            best[k] = (cost, centres)
    return {k: centres for k, (_, centres) in best.items()}


def nearest(points: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """`points` (id, v) with `clusters`: the nearest centre of each model."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch) if batch.num_rows else np.zeros((0, models[0].shape[1]))
            own = np.stack([distances2(x, c).argmin(1) for c in models], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "clusters"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(place, f"{kinds}, clusters array<int>")


def silhouettes(placed: DataFrame, most: int = SAMPLE, block: int = 256) -> list[float]:
    """The mean Euclidean silhouette of each of the `clusters` of rows (id, v, clusters), over the first `most` rows by hash of the id.

    The distances of a block of rows from all the others are made once for all numbers of clusters. A row alone in its
    cluster counts as 0; without a second cluster the mean is 0.
    """
    ship(placed.sparkSession)
    sample = placed.orderBy(F.xxhash64("id"), "id").limit(most).select("v", "clusters").collect()  # `most` rows
    if not sample:
        return []
    x, own = np.array([r["v"] for r in sample]), np.array([r["clusters"] for r in sample])
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast((x, own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, labels = shared.value
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                rows = np.arange(begin, min(begin + block, len(every)))
                gap = np.sqrt(((every[rows, None] - every[None]) ** 2).sum(-1))
                for m in range(labels.shape[1]):
                    c = labels[:, m]
                    one = (c[:, None] == np.arange(c.max() + 1)).astype(np.float64)
                    n, sums, mine = one.sum(0), gap @ one, c[rows]
                    at = np.arange(len(rows))
                    alone = n[mine] < 2
                    a = sums[at, mine] / np.maximum(n[mine] - 1, 1)
                    mean = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
                    mean[at, mine] = np.inf
                    b = mean.min(1)
                    s = np.where(alone | ~np.isfinite(b), 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([float(s.sum())])], ["model", "s"])

    blocks = spark.range(0, len(x), block, max(1, min(-(-len(x) // block), spark.sparkContext.defaultParallelism)))
    found = {r["model"]: r["s"] for r in blocks.mapInArrow(score, "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()}
    return [found.get(m, 0.0) / len(x) for m in range(own.shape[1])]
