"""Hashed character n-grams and small linear models in numpy, used inside tasks."""

from __future__ import annotations

import numpy as np

#: Characters of a text that are hashed at once.
STRETCH = 1 << 20
_TABLES: dict[str, np.ndarray] = {}


def table(name: str, test) -> np.ndarray:
    """``test`` of every character below 0x10000; the last entry stands for all above, which count as letters without case."""
    if name not in _TABLES:
        _TABLES[name] = np.array([test(chr(i)) for i in range(0x10000)] + [name == "alpha"])
    return _TABLES[name]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def counts(c: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each of ``2 ** bits`` buckets is hit by the n-grams of the given orders of a sequence of code points."""
    out = np.zeros(1 << bits, dtype=np.int64)
    for n in orders:
        for at in range(0, max(len(c) - n + 1, 0), STRETCH):
            part = c[at : at + STRETCH + n - 1].astype(np.uint32)
            h = np.full(len(part) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            out += np.bincount((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 60, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by accelerated gradient steps of a fixed number: the same at every call."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    total = weight.sum()
    rate = 1 / (0.25 * float((x * x).sum(axis=1) @ weight) / total + l2)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = x.T @ (weight * (sigmoid(x @ v) - y)) / total + l2 * np.append(v[:-1], 0)
        new, s = v - rate * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a logit + b) is calibrated on the given examples; smoothed targets, so it stays finite."""
    p, n = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * logit + b)
        r, s = q - target, q * (1 - q) + 1e-9
        h = np.array([[(s * logit * logit).sum() + 1e-6, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(r * logit).sum(), r.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b
