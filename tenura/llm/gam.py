"""A generalised additive model with pairwise interactions, trained by cyclic boosting of shallow trees in numpy.

Each feature is cut into quantile bins. Training goes round the features in turn; each turn fits a tree of at most four
leaves to the gradient over that feature's bins and adds its leaves, shrunk, to the feature's lookup table. The pairs
with the largest gain over the additive part get small two-way tables in the same way. Scoring adds table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import sigmoid


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: dict[int, np.ndarray] = field(default_factory=dict)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        coarse = {j: np.searchsorted(e, x[:, j], side="right") for j, e in self.pair_edges.items()}
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)


def tree_leaves(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values by bin of the tree over ordered bins that greedy splits give."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            ok = (ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)
            gain = np.where(ok, (cg[at] - cg[a]) ** 2 / (ch[at] - ch[a] + ridge) + (cg[b] - cg[at]) ** 2 / (ch[b] - ch[at] + ridge) - worth(a, b), 0)
            m = int(gain.argmax())
            if gain[m] > best[0]:
                best = (gain[m], k, int(at[m]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values by cell of the best cross: one cut on each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    n, m = g.shape
    for a in range(n - 1):
        b = np.arange(m - 1)
        quads = []
        for c in (cg, ch):
            nw, ne, sw = c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b]
            quads.append((nw, ne, sw, c[-1, -1] - nw - ne - sw))
        gain = sum(x * x / (y + ridge) for x, y in zip(*quads, strict=True))
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best = gain[k]
            v = [x[k] / (y[k] + ridge) for x, y in zip(*quads, strict=True)]
            out = np.zeros_like(g)
            out[: a + 1, : k + 1], out[: a + 1, k + 1 :], out[a + 1 :, : k + 1], out[a + 1 :, k + 1 :] = v
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 60, coarse: int = 8, ridge: float = 1.0, least: float = 1.0) -> Gam:
    """Fit to labels 0/1. Without rows, or with rows of one class, the model is that class's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    f = x.shape[1]
    model = Gam(base, [quantile_edges(x[:, j], bins) for j in range(f)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(f):
            p = sigmoid(logit)
            g = np.bincount(binned[j], y - p, len(model.tables[j]))
            h = np.bincount(binned[j], p * (1 - p), len(model.tables[j]))
            step = rate * np.clip(tree_leaves(g, h, 4, ridge, least), -4, 4)
            model.tables[j] += step
            logit += step[binned[j]]
    weight = [float(np.abs(t[b]).mean()) for t, b in zip(model.tables, binned, strict=True)]
    top = sorted(range(f), key=lambda j: (-weight[j], j))[:10]
    edges = {j: quantile_edges(x[:, j], coarse) for j in top}
    small = {j: np.searchsorted(edges[j], x[:, j], side="right") for j in top}
    p = sigmoid(logit)

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        n, m = len(edges[i]) + 1, len(edges[j]) + 1
        return np.bincount(small[i] * m + small[j], v, n * m).reshape(n, m)

    gains = []
    for a, i in enumerate(top):
        for j in top[a + 1 :]:
            g, h = cells(i, j, y - p), cells(i, j, p * (1 - p))
            gains.append((float((g * g / (h + ridge)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:pairs]]
    model.pair_edges = {j: edges[j] for ij in model.pairs for j in ij}
    model.pair_tables = [np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = sigmoid(logit)
            step = rate * np.clip(quadrants(cells(i, j, y - p), cells(i, j, p * (1 - p)), ridge), -4, 4)
            model.pair_tables[k] += step
            logit += step[small[i], small[j]]
    return model
