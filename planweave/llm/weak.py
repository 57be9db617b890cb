"""A generative label model over abstaining voters, and the linear classifier that its posteriors train."""

from __future__ import annotations

import numpy as np

#: Two voters share one voice whose votes correlate above this given the class, and that vote together on more than
#: this share of the rows of the one that votes less.
CORRELATED = 0.5


def posterior(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, accuracies, weights) from votes of -1 (abstains), 0 and 1: rows by voters.

    Expectation-maximisation: each voter's rates of either vote in either class are its expected shares
    (smoothed); the posterior multiplies their ratios for the votes that are cast, an abstention says nothing.
    Correlations given the class are estimated from the votes' residuals and only count among voters that
    vote on the same rows; a voter's weight is one over the
    number of voters that say the same, itself included. No rows or no voters: the start.
    """
    n, m = votes.shape
    if not n or not m:
        return start.copy(), np.full(m, 0.5), np.ones(m)
    said = np.stack([votes == 0, votes == 1]).astype(float)
    p, weights, accuracy = start.astype(float), np.ones(m), np.full(m, 0.5)
    for k in range(rounds):
        q = np.stack([1 - p, p])
        count = np.einsum("cn,vnm->vcm", q, said)
        rate = (count + 0.5) / (q.sum(axis=1)[None, :, None] + 5)
        accuracy = (count[0, 0] + count[1, 1] + 0.5) / (count.sum(axis=(0, 1)) + 1)
        if k == 0:
            sign = said[1] - said[0]
            rest = sign - q.T @ ((q @ sign) / (q.sum(axis=1)[:, None] + 1e-9))
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            cast = said.sum(axis=0)
            together = cast.T @ cast / np.maximum(1, np.minimum(cast.sum(axis=0)[:, None], cast.sum(axis=0)))
            weights = 1 / np.maximum(1, (((rest.T @ rest) / n / scale[:, None] / scale > CORRELATED) & (together > CORRELATED)).sum(axis=0))
        odds = np.log(prior / (1 - prior)) + np.einsum("vnm,vm->n", said, weights * np.log(rate[:, 1] / rate[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, accuracy, weights


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on soft labels, by Adam over the whole sample; deterministic."""
    x = x.astype(np.float32)
    n, d = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    w, b = np.zeros(d), np.log(mean / (1 - mean))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for k in range(1, rounds + 1 if n else 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        g = np.append((x.T @ (p - y).astype(np.float32)) / n + penalty * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)
