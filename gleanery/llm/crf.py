"""A small linear-chain conditional random field over binary features, trained and run with NumPy."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Weights of features per label and of label steps; sequences come flattened with their lengths."""

    def __init__(self, n_features: int, n_labels: int):
        self.emission = np.zeros((n_features, n_labels))
        self.step = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def fit(self, features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 300, rate: float = 0.5, decay: float = 2e-3) -> LinearChain:
        """Gradient ascent on the regularised log-likelihood (Adam, full batch, deterministic)."""
        params = [self.emission, self.step, self.first]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        total = sum(len(y) for y in labels)
        # Sequences of one length are worked on together.
        groups = []
        for n in sorted({len(y) for y in labels}):
            same = [i for i, y in enumerate(labels) if len(y) == n]
            groups.append((np.stack([features[i] for i in same]), np.stack([labels[i] for i in same])))
        for r in range(1, rounds + 1):
            grads = [np.zeros_like(p) for p in params]
            for x, y in groups:
                node, edge = self._marginals(x @ self.emission)
                gold = np.eye(node.shape[2])[y]
                grads[0] += np.tensordot(x, gold - node, ([0, 1], [0, 1]))
                grads[2] += (gold[:, 0] - node[:, 0]).sum(0)
                if y.shape[1] > 1:
                    grads[1] -= edge
                    np.add.at(grads[1], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g / total - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return self

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each place and summed step probabilities, for sequences of one length."""
        m, n, k = scores.shape
        ahead, back = np.zeros((m, n, k)), np.zeros((m, n, k))
        ahead[:, 0] = self.first + scores[:, 0]
        for t in range(1, n):
            ahead[:, t] = scores[:, t] + _logsum(ahead[:, t - 1, :, None] + self.step, 1)
        for t in range(n - 2, -1, -1):
            back[:, t] = _logsum(self.step + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        z = _logsum(ahead[:, -1], 1)
        edge = np.zeros((k, k))
        for t in range(1, n):
            edge += np.exp(ahead[:, t - 1, :, None] + self.step + (scores[:, t] + back[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return np.exp(ahead + back - z[:, None, None]), edge

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all sequences at once: step t works on every sequence longer than t."""
        scores = features @ self.emission
        k = scores.shape[1]
        lengths = np.asarray(lengths, np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        alive = [int(np.searchsorted(-lengths[order], -t, side="left")) for t in range(longest)]
        if not longest:
            return np.empty(0, np.int8)
        came_from = np.zeros((len(scores), k), np.int8)
        best = scores[starts[order[: alive[0]]]] + self.first
        for t in range(1, longest):
            now = order[: alive[t]]
            ways = best[: alive[t], :, None] + self.step
            came_from[starts[now] + t] = ways.argmax(1)
            best[: alive[t]] = ways.max(1) + scores[starts[now] + t]
        labels = np.zeros(len(scores), np.int8)
        state = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            now = order[: alive[t]]
            at = starts[now] + t
            labels[at] = state[: alive[t]]
            if t:
                state[: alive[t]] = came_from[at, state[: alive[t]]]
        return labels


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis=axis)
