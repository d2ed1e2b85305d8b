"""A linear-chain conditional random field over short sequences with hashed features."""

from __future__ import annotations

import zlib

import numpy as np

#: Size of the hashed feature space.
SPACE = 1 << 16


def feature(name: str, half: int = 1) -> int:
    """Place of a feature in the hashed space; the features of the two halves never meet."""
    return half * (SPACE // 2) + (zlib.crc32(name.encode("utf-8", "surrogatepass")) & (SPACE // 2 - 1))


def _by_length(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths) if n > 0]


def viterbi(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best tag of every position; sequences are runs of rows of ``emissions``."""
    tags = np.zeros(len(emissions), np.int64)
    for n, which in _by_length(lengths):
        at = starts[which][:, None] + np.arange(n)
        e = emissions[at]
        score, back = e[:, 0] + begin, []
        for i in range(1, n):
            step = score[:, :, None] + move
            back.append(step.argmax(1))
            score = step.max(1) + e[:, i]
        last = (score + end).argmax(1)
        tags[at[:, n - 1]] = last
        for i in range(n - 2, -1, -1):
            last = back[i][np.arange(len(which)), last]
            tags[at[:, i]] = last
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: np.ndarray, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tags: np.ndarray, n_tags: int, *, steps: int = 100, rate: float = 0.15, decay: float = 1e-4, weights: np.ndarray | None = None, tied: tuple[int, ...] = (), lead: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(emission weights, transitions, begin, end) by gradient ascent on the penalised likelihood.

    ``rows``/``features``: position and hashed feature of each observation; ``weights``: of each sequence.
    Features of the second half of the space learn ``lead`` times as fast. The tags of ``tied`` share their weights of the features in the first half of the space, which can't tell them apart then.
    """
    n = len(tags)
    weights = np.ones(len(lengths)) if weights is None else weights
    w, move, begin, end = np.zeros((SPACE, n_tags)), np.zeros((n_tags, n_tags)), np.zeros(n_tags), np.zeros(n_tags)
    params = [w, move, begin, end]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(n_tags)[tags]
    total = weights.sum()
    for step in range(1, steps + 1):
        emissions = np.stack([np.bincount(rows, w[features, t], minlength=n) for t in range(n_tags)], axis=1)
        marginal = np.zeros((n, n_tags))
        weight_of = np.zeros(n)
        g_move, g_begin, g_end = np.zeros_like(move), np.zeros(n_tags), np.zeros(n_tags)
        for size, which in _by_length(lengths):
            at = starts[which][:, None] + np.arange(size)
            e, sw = emissions[at], weights[which]
            fwd = [e[:, 0] + begin]
            for i in range(1, size):
                fwd.append(_logsum(fwd[-1][:, :, None] + move, 1) + e[:, i])
            bwd = [np.tile(end, (len(which), 1))]
            for i in range(size - 1, 0, -1):
                bwd.append(_logsum(move + (e[:, i] + bwd[-1])[:, None, :], 2))
            bwd.reverse()
            z = _logsum(fwd[-1] + end, 1)
            for i in range(size):
                marginal[at[:, i]] = np.exp(fwd[i] + bwd[i] - z[:, None])
                weight_of[at[:, i]] = sw
            for i in range(1, size):
                pair = np.exp(fwd[i - 1][:, :, None] + move + (e[:, i] + bwd[i])[:, None, :] - z[:, None, None])
                true = gold[at[:, i - 1]][:, :, None] * gold[at[:, i]][:, None, :]
                g_move += ((true - pair) * sw[:, None, None]).sum(0)
            g_begin += ((gold[at[:, 0]] - marginal[at[:, 0]]) * sw[:, None]).sum(0)
            g_end += ((gold[at[:, -1]] - marginal[at[:, -1]]) * sw[:, None]).sum(0)
        off = (gold - marginal) * weight_of[:, None]
        g_w = np.stack([np.bincount(features, off[rows, t], minlength=SPACE) for t in range(n_tags)], axis=1)
        if tied:
            g_w[: SPACE // 2, tied] = g_w[: SPACE // 2, tied].mean(axis=1, keepdims=True)
        for p, g, m, v in zip(params, (g_w, g_move, g_begin, g_end), first, second):
            g = g / total - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            pace = np.where(np.arange(SPACE) < SPACE // 2, rate, rate * lead)[:, None] if p is w else rate
            p += pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, move, begin, end
