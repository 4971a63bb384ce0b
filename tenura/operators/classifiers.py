"""Multinomial logistic regressions for several training masks at once: all folds of a cross-validation and the final model.

Each scan of the rows gives the loss and gradient of every model that still moves, at a point of its own. The driver keeps
the models' few numbers (models x classes x width) and takes quasi-Newton steps, so six fits cost the scans of the
slowest one, not of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship

PARTIAL = "model int, loss double, gradient array<double>"
KINDS = (pa.int32(), pa.float64(), pa.list_(pa.float64()))


def design(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, with a last column of ones."""
    x = np.array(batch.column("v").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
    return np.hstack([x, np.ones((len(x), 1))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted cross-entropy of rows with classes y under theta (classes x width), without penalty."""
    p = softmax(x @ theta.T)
    at = np.arange(len(x))
    loss = -float(w @ np.log(np.maximum(p[at, y], 1e-300)))
    p[at, y] -= 1
    return loss, (p * w[:, None]).T @ x


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(KINDS)], [c.split()[0] for c in PARTIAL.split(", ")])


def scan(rows: DataFrame, thetas: dict[int, np.ndarray], weights: np.ndarray) -> dict[int, tuple[float, np.ndarray]]:
    """model -> (loss, gradient) over `rows` (v, y, fold); weights[m, fold, class] says what a row counts for model m."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x, y, fold = design(batch), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                for m, theta in thetas.items():
                    w = weights[m][fold, y]
                    used = np.flatnonzero(w)
                    part = loss_and_gradient(x[used], y[used], w[used], theta)
                    got[m] = [a + b for a, b in zip(got[m], part, strict=True)] if m in got else list(part)
        yield record([(m, loss, g.ravel().tolist()) for m, (loss, g) in got.items()])

    # the partial gradients of a model, one for each task, are added up within one row
    parts = rows.select("v", "y", "fold").mapInArrow(add, PARTIAL).groupBy("model").agg(F.sum("loss").alias("loss"), F.collect_list("gradient").alias("parts"))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    summed = parts.select("model", "loss", F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), plus).alias("gradient"))
    return {r["model"]: (r["loss"], np.array(r["gradient"]).reshape(thetas[r["model"]].shape)) for r in summed.collect()}


@dataclass
class Descent:
    """L-BFGS on one model, a point at a time: `at` is the point to be measured next."""

    at: np.ndarray
    penalty: float
    rows: float
    memory: int = 12
    tolerance: float = 1e-5
    point: np.ndarray | None = None
    value: float = 0.0
    slope: np.ndarray | None = None
    steps: list = field(default_factory=list)
    way: np.ndarray | None = None
    size: float = 1.0
    done: bool = False

    def measured(self, loss: float, gradient: np.ndarray) -> None:
        """Takes the loss and gradient at `at`, moves there if it is better enough, and chooses the next point."""
        slopes = self.at.copy()
        slopes[:, -1] = 0  # intercepts carry no penalty
        loss, gradient = loss + 0.5 * self.penalty * float((slopes**2).sum()), gradient + self.penalty * slopes
        if self.point is not None and loss > self.value + 1e-4 * self.size * float((self.slope * self.way).sum()):
            self.size /= 2
            self.done = self.size < 1e-10
            self.at = self.point + self.size * self.way
            return
        if self.point is not None:
            s, y = self.at - self.point, gradient - self.slope
            if float((s * y).sum()) > 1e-12 * float((y * y).sum()):
                self.steps = [*self.steps, (s, y)][-self.memory :]
        self.point, self.value, self.slope, self.size = self.at, loss, gradient, 1.0
        self.done = float(np.abs(gradient).max()) <= self.tolerance * self.rows
        self.way = -self.scaled(gradient)
        if not self.steps:  # a first step of a length that suits the unpenalised loss
            self.size = min(1.0, self.rows / max(float(np.abs(gradient).sum()), 1e-300))
        self.at = self.point + self.size * self.way

    def scaled(self, g: np.ndarray) -> np.ndarray:
        """The inverse curvature, as seen in the last steps, times g."""
        q, kept = g.copy(), []
        for s, y in reversed(self.steps):
            a = float((s * q).sum()) / float((s * y).sum())
            q -= a * y
            kept.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= float((s * y).sum()) / float((y * y).sum())
        else:
            q /= max(self.rows, 1.0)
        for (s, y), a in zip(self.steps, reversed(kept), strict=True):
            q += s * (a - float((y * q).sum()) / float((s * y).sum()))
        return q


def fit_masks(rows: DataFrame, counts: np.ndarray, masks: list[np.ndarray], width: int, c: float, most: int = 200) -> list[np.ndarray]:
    """One model (classes x (width + 1)) for each mask over folds, all fitted in the same scans of `rows` (v, y, fold).

    counts[fold, class] are the numbers of rows. Within a mask classes weigh alike, so that weights add up to its rows.
    """
    ship(rows.sparkSession)
    classes = counts.shape[1]
    weights = np.zeros((len(masks), *counts.shape))
    models = []
    for m, mask in enumerate(masks):
        k = counts[mask].sum(0)
        weights[m][mask] = np.where(k > 0, k.sum() / (max((k > 0).sum(), 1) * np.maximum(k, 1)), 0)[None, :]
        models.append(Descent(np.zeros((classes, width + 1)), 1.0 / c, max(float(k.sum()), 1.0)))
    for _ in range(most):
        moving = {m: d.at for m, d in enumerate(models) if not d.done}
        if not moving:
            break
        found = scan(rows, moving, weights)
        for m in moving:
            models[m].measured(*found.get(m, (0.0, np.zeros((classes, width + 1)))))
    return [d.point for d in models]


def predicted(rows: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """`rows` (id, v, use) with `best`, the likeliest class under model number `use`, and its `confidence`."""
    ship(rows.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            if batch.num_rows:
                x, use = design(batch), batch.column("use").to_numpy()
                for m in np.unique(use):
                    p = softmax(x[use == m] @ models[m].T)
                    best[use == m], sure[use == m] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(sure)], [*batch.schema.names, "best", "confidence"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(place, f"{kinds}, best int, confidence double")
