"""Linear-chain conditional random fields in numpy, for many sequences at once.

Sequences are stored one after the other: emission scores ``(rows, labels)``
and ``offsets`` of the sequences.  A step handles one position of every
sequence that is long enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CRF:
    """``weights (features, labels)``, ``transitions (from, to)``, ``first (labels)``."""

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def _steps(offsets: np.ndarray) -> list[np.ndarray]:
    """The rows of position 0, 1, ... of all sequences, longest sequences first."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, n = offsets[:-1][order], n[order]
    count = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return [begin[:m] + t for t, m in enumerate(count)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(e: np.ndarray, offsets: np.ndarray, crf: CRF, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities of every row, expected transitions (if ``pairs``) and the sum of log partition values."""
    steps, alpha, beta = _steps(offsets), np.empty_like(e), np.zeros_like(e)
    for t, rows in enumerate(steps):
        if t == 0:
            alpha[rows] = e[rows] + crf.first
        else:
            alpha[rows] = _log_sum(alpha[rows - 1][:, :, None] + crf.transitions, 1) + e[rows]
    expected = np.zeros_like(crf.transitions)
    for rows in reversed(steps[1:]):
        beta[rows - 1] = _log_sum(crf.transitions + (e[rows] + beta[rows])[:, None, :], 2)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    log_z = _log_sum(alpha[ends], 1)
    z = np.repeat(log_z, np.diff(offsets)[np.diff(offsets) > 0])[:, None]
    if pairs:
        for rows in steps[1:]:
            p = alpha[rows - 1][:, :, None] + crf.transitions + (e[rows] + beta[rows])[:, None, :] - z[rows][:, :, None]
            expected += np.exp(p).sum(axis=0)
    return np.exp(alpha + beta - z), expected, float(log_z.sum())


def viterbi(e: np.ndarray, offsets: np.ndarray, crf: CRF) -> np.ndarray:
    """The best label of every row."""
    steps, best, back = _steps(offsets), e.copy(), np.zeros(e.shape, np.int8)
    for t, rows in enumerate(steps):
        if t == 0:
            best[rows] += crf.first
        else:
            options = best[rows - 1][:, :, None] + crf.transitions
            back[rows] = options.argmax(axis=1)
            best[rows] += options.max(axis=1)
    out = np.zeros(len(e), np.int64)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    out[ends] = best[ends].argmax(axis=1)
    for rows in reversed(steps[1:]):
        out[rows - 1] = back[rows, out[rows]]
    return out


def train(x: np.ndarray, labels: np.ndarray, offsets: np.ndarray, n_labels: int, rounds: int = 200,
          l2: float = 1e-3, rate: float = 0.1) -> CRF:
    """Maximum conditional likelihood (mean per row, with a quadratic penalty) by Adam steps; deterministic."""
    crf = CRF(np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    begins = np.zeros(len(x), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    gold = np.zeros((len(x), n_labels))
    gold[np.arange(len(x)), labels] = 1
    gold_pairs = np.zeros((n_labels, n_labels))
    later = np.flatnonzero(~begins)
    np.add.at(gold_pairs, (labels[later - 1], labels[later]), 1)
    parameters = [crf.weights, crf.transitions, crf.first]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for i in range(1, rounds + 1):
        p, expected, _ = marginals(crf.emissions(x), offsets, crf, True)
        grads = [x.T @ (p - gold) / len(x), (expected - gold_pairs) / len(x), (p - gold)[begins].sum(axis=0) / len(x)]
        for k, (w, g) in enumerate(zip(parameters, grads)):
            g = g + l2 * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w -= rate * (first[k] / (1 - 0.9 ** i)) / (np.sqrt(second[k] / (1 - 0.99 ** i)) + 1e-8)
    return crf
