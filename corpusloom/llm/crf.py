"""A linear-chain conditional random field over hashed features, in numpy."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Labels sequences whose items each have up to ``width`` feature numbers below ``size``.

    Feature 0 pads and weighs nothing. Training maximises the penalised likelihood of whole label
    sequences by full-batch Adam, with forward and backward sums over padded arrays; decoding is
    Viterbi's. Both give the same result for the same input.
    """

    def __init__(self, labels: int, size: int):
        self.weights = np.zeros((size, labels))
        self.moves = np.zeros((labels, labels))
        self.begin = np.zeros(labels)

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 60, rate: float = 0.15, penalty: float = 1e-4):
        """features (sequences, time, width), labels (sequences, time); beyond its length padding.

        Every item must have a feature.
        """
        # Longest first, so that each step of time works on the sequences that reach it.
        order = np.argsort(-lengths, kind="stable")
        features, labels, lengths = features[order], labels[order], lengths[order]
        n, time, _ = features.shape
        reach = [int((lengths > t).sum()) for t in range(time)]
        size, k = self.weights.shape
        real = np.arange(time)[None, :] < lengths[:, None]
        total = max(1, int(real.sum()))
        gold = np.eye(k)[labels] * real[..., None]
        gold_moves = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        # Only what isn't padding is gathered and added up, item after item.
        used = features[real]
        flat = used[used > 0]
        counts = (used > 0).sum(axis=1)
        starts = np.cumsum(counts) - counts
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weights, self.moves, self.begin)]
        for step in range(1, steps + 1):
            s = np.zeros((n, time, k))
            s[real] = np.add.reduceat(self.weights[flat], starts)
            alpha = np.zeros((n, time, k))
            alpha[:, 0] = s[:, 0] + self.begin
            last = alpha[:, 0].copy()
            for t in range(1, time):
                m = reach[t]
                alpha[:m, t] = _logsum(alpha[:m, t - 1, :, None] + self.moves, 1) + s[:m, t]
                last[:m] = alpha[:m, t]
            beta = np.zeros((n, time, k))
            for t in range(time - 2, -1, -1):
                m = reach[t + 1]
                beta[:m, t] = _logsum(self.moves + (s[:m, t + 1] + beta[:m, t + 1])[:, None, :], 2)
            z = _logsum(last, 1)
            p = np.zeros((n, time, k))
            p[real] = np.exp((alpha + beta)[real] - np.repeat(z, lengths)[:, None])
            pair = np.zeros((k, k))
            for t in range(1, time):
                m = reach[t]
                e = alpha[:m, t - 1, :, None] + self.moves + (s[:m, t] + beta[:m, t])[:, None, :] - z[:m, None, None]
                pair += np.exp(e).sum(axis=0)
            d = ((gold - p) / total)[real]
            g = np.stack([np.bincount(flat, np.repeat(d[:, j], counts), size) for j in range(k)], 1)
            grads = (g - penalty * self.weights, (gold_moves - pair) / total, (gold[:, 0] - p[:, 0]).sum(axis=0) / total)
            for param, grad, (m, v) in zip((self.weights, self.moves, self.begin), grads, state):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, features: list[list[int]], barred: list[tuple[int, int]] = ()) -> list[int]:
        """The best labels of one sequence; ``barred`` are (item, label) pairs that it can't have."""
        if not features:
            return []
        s = np.array([self.weights[f].sum(axis=0) for f in features])
        for t, label in barred:
            s[t, label] = -1e9
        best, back = s[0] + self.begin, []
        for row in s[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
