"""A regularised linear classifier on hashed features, fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rows:
    """Hashed features of rows in one flat array: row i has ``features[begin[i]:begin[i + 1]]``.
    A feature that stands twice counts twice; every row has at least one."""

    features: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        return cls(flat, np.concatenate([[0], np.cumsum(size)]))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, at: np.ndarray) -> Rows:
        return Rows.of([self.features[self.begin[i] : self.begin[i + 1]] for i in at])


@dataclass(frozen=True)
class Linear:
    """weights by feature and bias; a row's score is the sum of its features' weights, divided by
    the root of their number, plus the bias: the log-odds of the label."""

    weights: np.ndarray
    bias: float
    rounds: int
    slope: float

    def scores(self, rows: Rows) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        return np.add.reduceat(self.weights[rows.features], rows.begin[:-1]) / np.sqrt(np.diff(rows.begin)) + self.bias


def fit(rows: Rows, label: np.ndarray, buckets: int, *, penalty: float = 1e-4, prior: float = 0.5, settled: float = 1e-6, rounds: int = 100) -> Linear:
    """Logistic regression with squared penalty; the rows of label 1
    weigh ``prior`` in all, the others the rest.

    Newton's steps, each solved by conjugate gradient and shortened until the loss falls.  Ends
    where the gradient's norm is under ``settled``; an error if ``rounds`` steps do not get there.
    """
    used, at = np.unique(rows.features, return_inverse=True)
    size, k = np.diff(rows.begin), len(used)
    owner = np.repeat(np.arange(len(rows)), size)
    value = 1 / np.sqrt(size)[owner]
    share = np.where(label == 1, prior / max(1, (label == 1).sum()), (1 - prior) / max(1, (label == 0).sum()))

    def forward(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v[at] * value, rows.begin[:-1]) + v[k]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, r[owner] * value, k), r.sum())

    pull = np.append(np.full(k, penalty), 0.0)  # the bias isn't penalised

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float((share * (np.logaddexp(0, z) - label * z)).sum() + (pull * v * v).sum() / 2)

    w = np.zeros(k + 1)
    for turn in range(rounds):
        z = forward(w)
        chance = 1 / (1 + np.exp(-z))
        slope = back(share * (chance - label)) + pull * w
        norm = float(np.sqrt(slope @ slope))
        if norm < settled:
            weights = np.zeros(buckets, np.float32)
            weights[used] = w[:k]
            return Linear(weights, float(w[k]), turn, norm)
        bend = share * chance * (1 - chance)
        step, rest = np.zeros(k + 1), -slope
        way, left = rest.copy(), float(rest @ rest)
        for _ in range(200):
            curved = back(bend * forward(way)) + (pull + 1e-9) * way
            far = left / float(way @ curved)
            step, rest = step + far * way, rest - far * curved
            now = float(rest @ rest)
            if now < norm * norm * min(0.01, norm * norm):
                break
            way, left = rest + now / left * way, now
        before, part = loss(w, z), 1.0
        while part > 1e-9 and loss(w + part * step, forward(w + part * step)) > before + 1e-4 * part * float(slope @ step):
            part /= 2
        w = w + part * step
    raise RuntimeError(f"the classifier did not settle in {rounds} rounds: gradient {norm:.1e}")
