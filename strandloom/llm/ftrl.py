"""Follow-the-regularised-leader (proximal) for sparse softmax regression with an elastic-net penalty, in NumPy."""

from __future__ import annotations

import math

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial (or with one output, logistic) regression; a feature is (index, value), index ``size`` is the bias.

    Per coordinate: ``w = 0`` where ``|z| <= l1``, else ``-(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2)``. Only the
    coordinates that occur in the rows are held (``at``, in order; the bias is the last).
    """

    def __init__(self, size: int, outputs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.1, l2: float = 1e-3):
        self.size, self.outputs, self.alpha, self.beta, self.l1, self.l2 = size, outputs, alpha, beta, l1, l2
        self._hold(np.array([size]))

    def _hold(self, at: np.ndarray) -> None:
        self.at, self.place = at, np.full(self.size + 1, -1, np.int32)
        self.place[at] = np.arange(len(at))
        self.z, self.n = np.zeros((len(at), self.outputs)), np.zeros((len(at), self.outputs))

    def weights(self, rows=slice(None)) -> np.ndarray:
        """Weights of the coordinates held (``rows`` of them)."""
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices, weights) of the features with a weight, and the biases."""
        w = self.weights()
        keep = w[:-1].any(axis=1)
        return self.at[:-1][keep], w[:-1][keep], w[-1]

    def dense(self) -> np.ndarray:
        """Weights of all features, and as the last row the biases."""
        out = np.zeros((self.size + 1, self.outputs))
        out[self.at] = self.weights()
        return out

    def hold(self, rows) -> Ftrl:
        """Hold the coordinates of ``rows``, a sequence of features."""
        seen = np.zeros(self.size + 1, bool)
        seen[self.size] = True
        for k in range(len(rows)):
            seen[rows[k][0]] = True
        self._hold(np.flatnonzero(seen))
        return self

    def fit(self, rows, labels: np.ndarray, epochs: int, seed: int = 7) -> Ftrl:
        """``rows``: a sequence of features; ``labels``: the class of each (outputs > 1), or 0/1."""
        self.hold(rows)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            self.learn(rows, labels, order.permutation(len(rows)))
        return self

    def learn(self, rows, labels: np.ndarray, order) -> None:
        """One pass over rows whose coordinates are held, from the state there is."""
        bias = len(self.at) - 1
        if self.outputs == 1:
            return self.learn_placed(self.z[:, 0], self.n[:, 0], (self.placed(*rows[r]) for r in order), (labels[r] for r in order))
        for r in order:
            at, x = rows[r]
            at, x = np.append(self.place[at], bias), np.append(x, 1.0)
            w = self.weights(at)
            miss = softmax(x @ w)
            miss[labels[r]] -= 1
            g = x[:, None] * miss
            n = self.n[at]
            self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
            self.n[at] = n + g * g

    def placed(self, at: np.ndarray, x: np.ndarray, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
        """A row by the places of its coordinates, the bias among them."""
        place, value = np.empty(len(at) + 1, np.int32), np.empty(len(at) + 1, kind)
        place[:-1], place[-1] = self.place[at], len(self.at) - 1
        value[:-1], value[-1] = x, 1.0
        return place, value

    def learn_placed(self, z: np.ndarray, n: np.ndarray, rows, labels) -> None:
        """One pass of logistic regression over placed rows and their labels, from the state ``z``, ``n``, which it changes."""
        l1, l2, alpha, beta = self.l1, self.l2, self.alpha, self.beta
        for (at, x), y in zip(rows, labels, strict=True):
            zs, ns = z.take(at), n.take(at)
            root = np.sqrt(ns)
            w = (np.minimum(np.maximum(zs, -l1), l1) - zs) / ((beta + root) / alpha + l2)
            miss = 1 / (1 + math.exp(-min(max(float(x @ w), -40.0), 40.0))) - y
            g = x * miss
            ns += g * g
            z[at] = zs + g - (np.sqrt(ns) - root) / alpha * w
            n[at] = ns

    def scores(self, rows) -> np.ndarray:
        w, bias = self.weights(), self.weights(slice(-1, None))[0]
        out = np.tile(bias, (len(rows), 1))
        for k in range(len(rows)):
            at, x = rows[k]
            place = self.place[at]
            known = place >= 0
            out[k] += np.asarray(x, np.float64)[known] @ w[place[known]]
        return out


def temperature(scores: np.ndarray, labels: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature with the least negative log likelihood of ``softmax(scores / t)``, by golden section on log t."""

    def loss(u: float) -> float:
        p = softmax(scores / np.exp(u))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, g = np.log(low), np.log(high), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))
