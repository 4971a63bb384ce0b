"""A small character convolutional network in numpy that tells secrets from other long strings.

A candidate is shown with its surroundings: LEFT characters before it, a window of CORE characters of it, RIGHT
characters after it. Characters are embedded, convolved (width 5), rectified and max-pooled over each of the three
zones; one linear layer follows. A candidate longer than CORE is shown window by window and the largest score counts,
so that whole candidates are read. Training uses labelled findings (`labelled_findings`), half of them for fitting and
a quarter each for calibration (Platt scaling) and for the threshold, the largest that keeps the wanted recall; both are
set on whole candidates, as scored. Negatives are hard ones: long words, names, paths and numbers with and without
digits, some of them in surroundings that speak of keys.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .common import sigmoid

LEFT, CORE, RIGHT, WIDTH = 24, 48, 8, 5
SPAN = LEFT + CORE + RIGHT
CLASSES = 98  # 0: nothing, 1: any character outside printable ASCII, 2...: printable ASCII
ZONES = ((0, LEFT), (LEFT, LEFT + CORE), (LEFT + CORE, SPAN))


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 30, 1).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    out = []
    left = encode(text[max(0, start - LEFT) : start])
    right = encode(text[end : end + RIGHT])
    for at in range(start, max(end, start + 1), CORE):
        core = encode(text[at : min(end, at + CORE)])
        x = np.zeros(SPAN, np.uint8)
        x[LEFT - len(left) : LEFT] = left
        x[LEFT : LEFT + len(core)] = core
        x[LEFT + CORE : LEFT + CORE + len(right)] = right
        out.append(x)
    return out


@dataclass
class CharCnn:
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        e = self.emb[np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2)))]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)  # n, SPAN, d, WIDTH
        cols = cols.reshape(len(x), SPAN, -1)
        act = np.maximum(cols @ self.conv + self.bias, 0)
        pooled, where = [], []
        for a, b in ZONES:
            k = act[:, a:b].argmax(1)
            where.append(k + a)
            pooled.append(np.take_along_axis(act[:, a:b], k[:, None], 1)[:, 0])
        flat = np.concatenate(pooled, 1)
        return flat @ self.out + self.out_bias, flat, np.stack(where, 1), cols

    def score(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """Calibrated probabilities of rows of `windows`."""
        parts = [sigmoid(self.slope * self.forward(x[i : i + block])[0] + self.shift) for i in range(0, len(x), block)]
        return np.concatenate(parts) if parts else np.zeros(0)


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """`n` labelled findings (text, start, end, label): random keys in telling or plain surroundings against other long strings."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    alnum, hexa, low = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que ch ge sch pf tz ung keit heit ver ein lich schl str mpf nkt eau eux oir ille tion ment cion mente ado rr ll qu zh wr ght ss ck".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    telling = ["client_key: ", "auth = ", "Authorization: Bearer ", "credential=", "private key ", "key -> ", "access_key_id=", "pwd: ", "PASS=", "sig=", "apikey ", "x-auth: "]
    positive = [
        lambda: pick(alnum, rnd.randint(20, 64)),
        lambda: pick(alnum + "+/", rnd.randint(24, 88)) + rnd.choice(["", "=", "=="]),
        lambda: rnd.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "pk_", "rk_test_", "SG_"]) + pick(alnum, rnd.randint(20, 40)),
        lambda: pick(string.ascii_uppercase + string.digits, rnd.randint(20, 40)),
        lambda: pick(hexa, rnd.choice([20, 22, 23])),
        lambda: pick(alnum + "-_", rnd.randint(22, 43)),
        lambda: pick(string.ascii_letters, rnd.randint(20, 48)),
        lambda: pick(string.ascii_letters, rnd.randint(20, 48)),
        lambda: rnd.choice(["sk_", "key-", "id_", "t0_"]) + pick(hexa, rnd.choice([24, 32])) + pick(alnum, rnd.randint(8, 24)),
    ]
    negative = [
        lambda: "".join(word() for _ in range(6))[: rnd.randint(16, 30)] + rnd.choice(["", "2", "1999", "s1"]),
        lambda: "/".join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(["", "/v2", "/index2"]),
        lambda: "_".join(word() for _ in range(rnd.randint(3, 5))) + pick(string.digits, rnd.randint(1, 2)),
        lambda: "-".join(word() for _ in range(rnd.randint(3, 5))) + "-" + pick(string.digits, rnd.randint(1, 4)),
        lambda: pick(string.digits, rnd.randint(16, 22)),
        lambda: "-".join(pick(string.digits, rnd.randint(3, 5)) for _ in range(4)),
        lambda: f"20{pick('012', 1)}{pick(string.digits, 1)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}-{rnd.randint(10, 59)}-00",
        lambda: rnd.choice("=-_x0a1") * rnd.randint(16, 40) + rnd.choice(["", "1"]),
        lambda: "".join(word().capitalize() for _ in range(5)) + rnd.choice(["V2", "3", "Test1", ""]),
        lambda: "+" + pick(string.digits, 2) + "-" + pick(string.digits, 3) + "-" + pick(string.digits, 8),
        lambda: rnd.choice(["com/", "org/", "net/wiki/"]) + "/".join(rnd.choice(["", "_", "-"]).join(word() for _ in range(2)) + rnd.choice(["", "", pick(string.digits, 2)]) for _ in range(rnd.randint(2, 5))),
        lambda: "".join(word() for _ in range(7))[: rnd.randint(16, 40)],
        lambda: "".join(word() for _ in range(7))[: rnd.randint(16, 34)].capitalize(),
        lambda: "".join(word() for _ in range(6))[: rnd.randint(16, 28)].upper(),
        lambda: "".join(word().capitalize() for _ in range(rnd.randint(4, 7)))[: rnd.randint(18, 40)],
        lambda: rnd.choice(["-", "_", "/"]).join(word() for _ in range(rnd.randint(4, 7))),
        lambda: word() + "_" + word() + "_" + pick(low, 4) + pick(string.digits, 1) + "_" + word() + "_" + word(),
    ]
    out = []
    for i in range(n):
        label = i % 2
        s = rnd.choice(positive if label else negative)()
        lead = words(rnd.randint(0, 5)) + " "
        if rnd.random() < (0.5 if label else 0.15):
            lead += rnd.choice(telling)
        elif rnd.random() < 0.3:
            lead += rnd.choice(['"', "(", ": ", "= ", "https://example.com/", "file "])
        out.append((lead + s + rnd.choice([" ", '"', ".", ", ", "\n", ")"]) + words(2), len(lead), len(lead) + len(s), label))
    return out


def shown(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First windows and labels."""
    return np.stack([windows(t, a, b)[0] for t, a, b, _ in found]), np.array([y for *_, y in found], np.float64)


def largest(net: CharCnn, found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """The network's output before calibration, the largest of each candidate's windows."""
    seen = [windows(t, a, b) for t, a, b, _ in found]
    out = np.full(len(found), -np.inf)
    np.maximum.at(out, np.repeat(np.arange(len(found)), [len(w) for w in seen]), net.forward(np.stack([x for w in seen for x in w]))[0])
    return out


def fit_char_cnn(found: list[tuple[str, int, int, int]], recall: float = 0.95, dim: int = 8, filters: int = 24, epochs: int = 8, seed: int = 7, rate: float = 4e-3) -> CharCnn:
    rng = np.random.default_rng(seed)
    x, y = shown(found)
    part = rng.permutation(len(x)) % 4
    fit, cal, held = part < 2, part == 2, part == 3
    net = CharCnn(rng.normal(0, 0.3, (CLASSES, dim)), rng.normal(0, (2 / (WIDTH * dim)) ** 0.5, (dim * WIDTH, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), 0.0)
    net.emb[0] = 0
    names = ("emb", "conv", "bias", "out")
    m1, m2, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    rows = np.flatnonzero(fit)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for i in range(0, len(order), 64):
            xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
            z, flat, where, cols = net.forward(xb)
            dz = (sigmoid(z) - yb) / len(yb)
            net.out_bias -= 0.05 * dz.sum()
            dflat = (dz[:, None] * net.out) * (flat > 0)
            grads = {"out": flat.T @ dz, "conv": np.zeros_like(net.conv), "bias": np.zeros_like(net.bias), "emb": np.zeros_like(net.emb)}
            padded = np.pad(xb, ((0, 0), (WIDTH // 2, WIDTH // 2)))
            f = np.arange(filters)
            for zone in range(3):
                d = dflat[:, zone * filters : (zone + 1) * filters]  # n, filters
                at = where[:, zone]  # n, filters
                seen = np.take_along_axis(cols, at[:, :, None], 1)  # n, filters, dim*WIDTH
                grads["conv"] += np.einsum("nf,nfk->kf", d, seen)
                grads["bias"] += d.sum(0)
                back = (d[:, :, None] * net.conv.T[f][None]).reshape(len(xb), filters, dim, WIDTH)
                for w in range(WIDTH):
                    np.add.at(grads["emb"], np.take_along_axis(padded, at + w, 1), back[:, :, :, w])
            step += 1
            for k in names:
                g = grads[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8))
            net.emb[0] = 0
    z = largest(net, [found[i] for i in np.flatnonzero(cal)])
    for _ in range(200):  # Platt scaling by Newton-like steps
        p = sigmoid(net.slope * z + net.shift)
        h = p * (1 - p)
        a = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(a, [((p - y[cal]) * z).sum(), (p - y[cal]).sum()])
        net.slope, net.shift = net.slope - 0.5 * d[0], net.shift - 0.5 * d[1]
    keys = [found[i] for i in np.flatnonzero(held & (y == 1))]
    s = np.sort(sigmoid(net.slope * largest(net, keys) + net.shift)) if keys else np.zeros(0)
    net.threshold = float(s[int((1 - recall) * len(s))]) if len(s) else 0.5
    net.recall = float((s >= net.threshold).mean()) if len(s) else 0.0
    return net


@lru_cache(maxsize=2)
def default_cnn(recall: float = 0.95) -> CharCnn:
    """The network of the registered query: fitted on 8,000 generated labelled findings, the same everywhere."""
    return fit_char_cnn(labelled_findings(8000, 11), recall)
