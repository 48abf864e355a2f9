"""Hashed byte n-grams and linear classifiers over them, trained with numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIERS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]


def ngrams(texts: list[bytes], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams of all texts, text by text, and where each text's hashes begin (with the total at the end).

    Every text counts as bounded by a space on either side. One pass of array operations serves the whole batch.
    """
    if len(texts) > 256:  # in parts, so that only the hashes themselves are held for all
        parts = [ngrams(texts[i : i + 256], orders, bits) for i in range(0, len(texts), 256)]
        offsets = np.cumsum([0, *(len(h) for h, _ in parts)])
        return np.concatenate([h for h, _ in parts]), np.concatenate([*(s[:-1] + o for (_, s), o in zip(parts, offsets)), offsets[-1:]])
    padded = [b" " + t + b" " * max(1, max(orders) - len(t) - 1) for t in texts]
    lengths = np.array([len(t) for t in padded], dtype=np.int64)
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    begins = np.zeros(len(padded) + 1, dtype=np.int64)
    np.cumsum(lengths, out=begins[1:])
    parts, owners = [], []
    owner = np.repeat(np.arange(len(padded), dtype=np.int64), lengths)
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        for k, n in enumerate(orders):
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, 17 + n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ data[j : len(data) - n + 1 + j]) * _MULTIPLIERS[(j + k) % 5]
                h ^= h >> np.uint32(15)
            ok = owner[: len(h)] == owner[n - 1 :]
            parts.append(((h * _MULTIPLIERS[k % 5]) >> shift)[ok])
            owners.append(owner[: len(h)][ok])
    if not parts:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
    which = np.concatenate(owners)
    order = np.argsort(which, kind="stable")
    hashes = np.concatenate(parts)[order]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(which, minlength=len(texts)), out=starts[1:])
    return hashes, starts


def scores(weights: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class scores of every text: sums of the weights of its n-grams over the square root of their number."""
    n = np.diff(starts)
    out = np.zeros((len(n), weights.shape[1]), dtype=np.float32)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(weights[hashes], starts[:-1][some], axis=0)
    return out / np.sqrt(np.maximum(1, n))[:, None]


def score_texts(weights: np.ndarray, texts: list[bytes], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """What ``scores(weights, *ngrams(texts, ...))`` gives, without sorting; for long texts."""
    padded = [b" " + t + b" " * max(1, max(orders) - len(t) - 1) for t in texts]
    lengths = np.array([len(t) for t in padded], dtype=np.int64)
    data = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    begins = np.zeros(len(padded), dtype=np.int64)
    np.cumsum(lengths[:-1], out=begins[1:])
    total = np.zeros((len(texts), weights.shape[1]), dtype=np.float32)
    count = np.zeros(len(texts))
    ends = begins + lengths
    shift = np.uint32(32 - bits)
    with_zero = np.vstack([weights, np.zeros((1, weights.shape[1]), dtype=weights.dtype)])
    nothing = np.uint32(len(weights))
    with np.errstate(over="ignore"):
        for k, n in enumerate(orders):
            h = np.full(len(data) - n + 1, 17 + n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ data[j : len(data) - n + 1 + j]) * _MULTIPLIERS[(j + k) % 5]
                h ^= h >> np.uint32(15)
            h = (h * _MULTIPLIERS[k % 5]) >> shift
            for j in range(1, n):  # windows across two texts
                h[ends[:-1] - j] = nothing
            total += np.add.reduceat(with_zero[h], begins, axis=0)
            count += lengths - n + 1
    return total / np.sqrt(np.maximum(1, count))[:, None]


def train_logistic(texts: list[bytes], labels: np.ndarray, classes: int, orders: tuple[int, ...], bits: int, epochs: int = 6, rate: float = 0.5, batch: int = 512, seed: int = 7) -> np.ndarray:
    """Weights (and a last row of biases) of a multinomial logistic regression, by stochastic gradients with AdaGrad steps."""
    size = 1 << bits
    w = np.zeros((size, classes), dtype=np.float32)
    past = np.full((size, classes), 1e-6, dtype=np.float32)
    hashes, starts = ngrams(texts, orders, bits)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            h, s = _take(hashes, starts, chosen)
            z = scores(w, h, s)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            _step(w, past, h, s, p / len(chosen), rate)
    return w


def train_hinge(texts: list[bytes], labels: np.ndarray, classes: int, orders: tuple[int, ...], bits: int, epochs: int = 8, rate: float = 0.5, decay: float = 1e-5, batch: int = 256, seed: int = 7, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of one linear support-vector classifier per class (one against the rest), by stochastic subgradients.

    ``labels`` is a 0/1 matrix, one column per class; ``weight`` scales the loss of each example.
    """
    size = 1 << bits
    w = np.zeros((size, classes), dtype=np.float32)
    past = np.full((size, classes), 1e-6, dtype=np.float32)
    hashes, starts = ngrams(texts, orders, bits)
    sign = np.where(labels > 0, 1.0, -1.0).astype(np.float32)
    share = np.clip(labels.mean(0), 0.02, 0.98)
    balance = np.where(labels > 0, np.minimum(8.0, np.sqrt((1 - share) / share)), 1.0).astype(np.float32)
    if weight is not None:
        balance = balance * weight[:, None]
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            h, s = _take(hashes, starts, chosen)
            z = scores(w, h, s)
            y = sign[chosen]
            g = np.where(z * y < 1, -y * balance[chosen], 0).astype(np.float32)
            _step(w, past, h, s, g / len(chosen), rate)
            w *= 1 - decay
    return w


def _take(hashes, starts, chosen):
    n = (starts[1:] - starts[:-1])[chosen]
    s = np.zeros(len(chosen) + 1, dtype=np.int64)
    np.cumsum(n, out=s[1:])
    at = np.arange(s[-1]) - np.repeat(s[:-1], n) + np.repeat(starts[chosen], n)
    return hashes[at], s


def _step(w, past, h, s, g, rate):
    """One AdaGrad step from the gradients ``g`` of the scores of a batch; texts without gradient are left out."""
    n = np.diff(s)
    active = np.nonzero((g != 0).any(1) & (n > 0))[0]
    if not len(active):
        return
    if len(active) < len(n):
        h, s = _take(h, s, active)
        n, g = np.diff(s), g[active]
    spread = np.repeat(g / np.sqrt(n)[:, None], n, axis=0)
    for c in range(w.shape[1]):
        if g[:, c].any():
            d = np.bincount(h, weights=spread[:, c], minlength=len(w)).astype(np.float32)
            past[:, c] += d * d
            w[:, c] -= rate * d / np.sqrt(past[:, c])
