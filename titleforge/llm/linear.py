"""Small linear models, trained on the driver from bounded samples: squared-hinge SVM, logistic regression, Platt scaling."""

from __future__ import annotations

import numpy as np


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns over their root mean square (floored), and the factors; a weight for x is the trained weight times the factor."""
    rms = np.sqrt((x.astype(np.float32) ** 2).mean(axis=0))
    factor = (1.0 / (rms + np.float32(0.2) * (rms[rms > 0].mean() if (rms > 0).any() else 1.0) + np.float32(1e-9))).astype(np.float32)
    return x * factor / np.float32(np.sqrt(x.shape[1])), factor / np.float32(np.sqrt(x.shape[1]))


def _descend(k: np.ndarray, slope, steps: int, l2: float, curvature: float) -> tuple[np.ndarray, float]:
    """Nesterov's accelerated gradient over w = z.T @ alpha, run on the Gram matrix k = z @ z.T; alpha and the bias.

    slope(outputs) is the loss's derivative by each output, curvature a bound of its second derivative times the rows.
    """
    n = len(k)
    u, top = np.ones(n) / np.sqrt(n), 1.0
    for _ in range(15):
        x = k @ u / n
        top = float(np.linalg.norm(x)) or 1.0
        u = x / top
    rate = 1.0 / (curvature * (top + 1.0) + l2)
    a = va = np.zeros(n)
    b = vb = 0.0
    t = 1.0
    for _ in range(steps):
        g = slope(k @ va + vb)
        a2, b2 = va - rate * (g + l2 * va), vb - rate * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        va, vb, a, b, t = a2 + m * (a2 - a), b2 + m * (b2 - b), a2, b2, t2
    return a, b


class Products:
    """The Gram matrix of rows that are too many for it: a product with a vector goes through the rows."""

    def __init__(self, z: np.ndarray):
        self.z = z

    def __len__(self) -> int:
        return len(self.z)

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return (self.z @ (v.astype(self.z.dtype) @ self.z)).astype(np.float64)


def gram(z: np.ndarray, most: int = 4096):
    """z @ z.T, or something that multiplies like it if z has more than ``most`` rows, so memory is linear in the rows."""
    return (z @ z.T).astype(np.float64) if len(z) <= most else Products(z)


def fit_svm(k: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge linear SVM on a Gram matrix; y is -1 or 1. Both classes weigh the same. Returns alpha and the bias."""
    y = y.astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    return _descend(k, lambda f: -2 * weight * y * np.maximum(0, 1 - y * f), steps, l2, 2 * float(weight.max()) * len(y))


def fit_logistic(k: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on a Gram matrix; y in 0..1. Returns alpha and the bias."""
    return _descend(k, lambda f: (sigmoid(f) - y) / len(y), steps, l2, 0.25)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * score + b))) is calibrated, with Platt's smoothed targets, by Newton's method."""
    pos, neg = float((y > 0.5).sum()), float((y <= 0.5).sum())
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(score.std()) or 1.0
    s, a, b = score / spread, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r = p * (1 - p) + 1e-6
        ga, gb = ((p - t) * s).sum() + 1e-3 * a, (p - t).sum()
        haa, hab, hbb = (r * s * s).sum() + 1e-3, (r * s).sum(), r.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a / spread, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
