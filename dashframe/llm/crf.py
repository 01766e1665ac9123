"""Linear-chain conditional random field over many sequences at once (numpy)."""

from __future__ import annotations

import numpy as np


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the sequences by falling length, number still running at
    each step)."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max()) if len(lengths) else 0
    running = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
    return starts[order], running


def forward_backward(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray,
                     expected: bool = False):
    """Label marginals of every token, from log potentials; with ``expected``
    also the expected transition counts and the log partition sum of all.

    Sequences advance together, one step a time; those that have ended drop
    out, so the work is that of the tokens.
    """
    peak = emission.max(axis=1, keepdims=True) if len(emission) else emission
    e = np.exp(emission - peak)
    t = np.exp(transition)
    starts, running = _layout(lengths)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    scale = np.empty(len(e))
    before = None
    for step, n in enumerate(running):
        at = starts[:n] + step
        a = e[at] if step == 0 else (before[:n] @ t) * e[at]
        s = a.sum(axis=1)
        before = a / s[:, None]
        alpha[at], scale[at] = before, s
    after = np.empty((0, e.shape[1]))
    counts = np.zeros_like(t)
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        at = starts[:n] + step
        b = np.ones((n, e.shape[1]))
        m = len(after)
        if m:
            ahead = starts[:m] + step + 1
            w = e[ahead] * after / scale[ahead][:, None]
            b[:m] = w @ t.T
            if expected:
                counts += (alpha[at[:m]].T @ w) * t
        beta[at] = b
        after = b
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300)
    if not expected:
        return marginal
    return marginal, counts, float(np.log(scale).sum() + peak.sum())


def train(words: list[np.ndarray], tokens: np.ndarray, labels: np.ndarray, lengths: np.ndarray,
          n_features: int, n_labels: int, steps: int = 40, rate: float = 0.5,
          decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition weights) by AdaGrad on the log-likelihood.
    ``words``: feature ids of each distinct word; ``tokens``: each token's
    word."""
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words) if len(words) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    weight = np.zeros((n_features, n_labels))
    trans = np.zeros((n_labels, n_labels))
    g_weight, g_trans = np.full_like(weight, 1e-8), np.full_like(trans, 1e-8)
    gold = np.zeros((len(tokens), n_labels))
    gold[np.arange(len(tokens)), labels] = 1
    ends = np.cumsum(lengths)
    inner = np.ones(max(len(tokens) - 1, 0), bool)
    inner[ends[:-1] - 1] = False
    gold_pairs = np.zeros_like(trans)
    np.add.at(gold_pairs, (labels[:-1][inner], labels[1:][inner]), 1)
    for _ in range(steps):
        by_word = np.stack([np.bincount(owner, weight[flat, k], len(words))
                            for k in range(n_labels)], axis=1)
        marginal, pairs, _ = forward_backward(by_word[tokens], trans, lengths, expected=True)
        miss = gold - marginal
        d_word = np.stack([np.bincount(tokens, miss[:, k], len(words))
                           for k in range(n_labels)], axis=1)
        d_weight = np.stack([np.bincount(flat, d_word[owner, k], n_features)
                             for k in range(n_labels)], axis=1) / len(lengths) - decay * weight
        d_trans = (gold_pairs - pairs) / len(lengths) - decay * trans
        g_weight += d_weight ** 2
        g_trans += d_trans ** 2
        weight += rate * d_weight / np.sqrt(g_weight)
        trans += rate * d_trans / np.sqrt(g_trans)
    return weight, trans
