"""Small linear models on sparse rows, trained in numpy on the bounded labelled sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows in compressed form."""

    def __init__(self):
        self.index: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def add(self, index: np.ndarray, value: np.ndarray) -> None:
        self.index.append(index.astype(np.int32))
        self.value.append(value.astype(np.float32))

    def __len__(self):
        return len(self.index)

    def take(self, mask: np.ndarray) -> Rows:
        out = Rows()
        out.index = [x for x, m in zip(self.index, mask, strict=True) if m]
        out.value = [x for x, m in zip(self.value, mask, strict=True) if m]
        return out

    def packed(self):
        """Row, index and value of all entries."""
        n = np.array([len(x) for x in self.index], np.int32)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        return row, np.concatenate([*self.index, np.zeros(0, np.int32)]), np.concatenate([*self.value, np.zeros(0, np.float32)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return Packed(self).dot(w)


class Packed:
    """Products with sparse rows, in pieces, so that no large temporary arrays are needed."""

    def __init__(self, rows: Rows, piece: int = 1 << 19):
        self.n = len(rows)
        self.row, self.index, self.value = rows.packed()
        self.pieces = [slice(i, i + piece) for i in range(0, len(self.row), piece)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for s in self.pieces:
            out += np.bincount(self.row[s], self.value[s] * w[self.index[s]], minlength=self.n)
        return out

    def back(self, error: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for s in self.pieces:
            out += np.bincount(self.index[s], self.value[s] * error[self.row[s]], minlength=size)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; deterministic."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return x


def fit_logistic(x: Rows, y: np.ndarray, size: int, ridge: float = 1e-6, steps: int = 150, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept; both classes weigh the same in all."""
    p_ = Packed(x)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)

    def gradient(p):
        w, b = p[:-1], p[-1]
        error = weight * (sigmoid(p_.dot(w) + b) - y)
        return np.append(p_.back(error, size) + ridge * w, error.sum())

    p = descend(gradient, size + 1, steps, rate)
    return p[:-1], float(p[-1])


def platt(z: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a calibrated probability."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, high, low)
    scale = max(float(np.std(z)), 1e-9)
    u = z / scale

    def gradient(p):
        error = (sigmoid(p[0] * u + p[1]) - target) / len(u)
        return np.array([(error * u).sum(), error.sum()])

    a, b = descend(gradient, 2, steps, 0.05)
    return max(float(a), 1e-6) / scale, float(b)


def fit_ordinal(x: Rows, y: np.ndarray, size: int, grades: int, ridge: float = 1e-3, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link model: P(y > j) = sigmoid(w.x - t[j]), one w for all ordered thresholds t."""
    p_ = Packed(x)
    n = np.bincount(y.astype(int), minlength=grades)
    share = np.where(np.arange(grades) == 0, 0.5, 0.5 / max((n[1:] > 0).sum(), 1))  # half for the lowest grade, the rest alike
    weight = (share / np.maximum(n, 1))[y.astype(int)]

    def thresholds(p):  # the first is free, each next lies above by a positive step
        return np.cumsum(np.append(p[:1], np.log1p(np.exp(np.clip(p[1:], -30, 30))) + 1e-3))

    def likelihood_gradient(p):
        w, tail = p[:size], p[size:]
        t = thresholds(tail)
        z = p_.dot(w)
        s = sigmoid(z[:, None] - t[None, :])  # P(y > j)
        upper = np.concatenate([np.ones((len(y), 1)), s], 1)
        grade = y.astype(int)
        high = upper[np.arange(len(y)), grade]
        low = np.concatenate([s, np.zeros((len(y), 1))], 1)[np.arange(len(y)), grade]
        p_y = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        dz = -(d_high - d_low) / p_y * weight
        dt = np.zeros(grades - 1)
        for j in range(grades - 1):
            dt[j] = ((grade == j + 1) * d_high / p_y * weight).sum() - ((grade == j) * d_low / p_y * weight).sum()
        back = np.cumsum(dt[::-1])[::-1]
        dtail = np.append(back[:1], back[1:] * sigmoid(tail[1:]))
        return np.append(p_.back(dz, size) + ridge * w, dtail)

    p = descend(likelihood_gradient, size + grades - 1, steps, rate)
    return p[:size], thresholds(p[size:])
