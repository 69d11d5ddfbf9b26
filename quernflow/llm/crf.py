"""A linear-chain conditional random field with two labels and sparse binary features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


class ChainCRF:
    """Weights by feature name and label, transition and edge weights. Unknown features weigh nothing."""

    def __init__(self, weights: dict[str, tuple[float, float]], edges: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.weights, self.edges, self.begin, self.end = weights, edges, begin, end

    @classmethod
    def train(cls, pages: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]], *, rounds: int = 150, rate: float = 0.4, ridge: float = 0.005) -> ChainCRF:
        """Maximum likelihood by adaptive gradient ascent, all pages at a time; `ridge` penalizes large weights."""
        names = sorted({f for page in pages for block in page for f in block})
        index = {f: i for i, f in enumerate(names)}
        n, width = len(pages), max(map(len, pages))
        length = np.array([len(p) for p in pages])
        flat = [(p, t, index[f]) for p, page in enumerate(pages) for t, block in enumerate(page) for f in block]
        p, t, f = (np.array(x) for x in zip(*flat, strict=True))
        cell = p * width + t
        y = np.zeros((n, width), int)
        live = np.arange(width)[None, :] < length[:, None]
        for i, row in enumerate(labels):
            y[i, : len(row)] = row
        w, edges, begin, end = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)
        params = [w, edges, begin, end]
        seen = [np.full(x.shape, 1e-8) for x in params]
        gold = np.eye(2)[y] * live[..., None]
        both = live[:, 1:] & live[:, :-1]
        gold_edges = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        last = length - 1
        for _ in range(rounds):
            score = np.stack([np.bincount(cell, w[f, k], n * width) for k in (0, 1)], axis=1).reshape(n, width, 2)
            alpha, beta = np.empty((n, width, 2)), np.zeros((n, width, 2))
            alpha[:, 0] = score[:, 0] + begin
            for i in range(1, width):
                alpha[:, i] = _log_sum(alpha[:, i - 1, :, None] + edges[None], 1) + score[:, i]
            final = _log_sum(alpha[np.arange(n), last] + end, 1)
            beta[np.arange(n), last] = end
            for i in range(width - 2, -1, -1):
                step = _log_sum(edges[None] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where((i < last)[:, None], step, beta[:, i])
            post = np.exp(alpha + beta - final[:, None, None]) * live[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + edges[None, None] + (score + beta)[:, 1:, None, :] - final[:, None, None, None]) * both[..., None, None]
            gap = (gold - post).reshape(-1, 2)
            grads = [
                np.stack([np.bincount(f, gap[cell, k], len(names)) for k in (0, 1)], axis=1),
                gold_edges - pair.sum((0, 1)),
                (gold - post)[:, 0].sum(0),
                (gold - post)[np.arange(n), last].sum(0),
            ]
            for x, g, s in zip(params, grads, seen, strict=True):
                g = g - ridge * x
                s += g * g
                x += rate * g / np.sqrt(s)
        return cls({name: (float(w[i, 0]), float(w[i, 1])) for name, i in index.items()}, edges, begin, end)

    def weight(self, names: Sequence[str]) -> tuple[float, float]:
        """The summed weights of features, by label."""
        w0 = w1 = 0.0
        get = self.weights.get
        for f in names:
            got = get(f)
            if got:
                w0 += got[0]
                w1 += got[1]
        return w0, w1

    def decode(self, blocks: Sequence[Sequence[str]], given: Sequence[tuple[float, float]] | None = None) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi. `given`: weights that blocks have besides their features."""
        if not blocks:
            return []
        (e00, e01), (e10, e11) = self.edges.tolist()
        back = []
        s0, s1 = self.begin.tolist()
        for i, block in enumerate(blocks):
            w0, w1 = self.weight(block)
            if i:
                a, b = s0 + e00, s1 + e10
                c, d = s0 + e01, s1 + e11
                back.append((a < b, c < d))
                s0, s1 = max(a, b), max(c, d)
            s0 += w0
            s1 += w1
            if given:
                s0 += given[i][0]
                s1 += given[i][1]
        label = int(s0 + self.end[0] < s1 + self.end[1])
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]
