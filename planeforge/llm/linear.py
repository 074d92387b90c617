"""Hashed n-gram features and small linear models, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np

#: Multipliers of the rolling hash and of the final mix (fixed values).
STEP = np.uint32(0x01000193)
MIX = np.uint32(0x9E3779B1)


def gram_ids(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed ids of all byte n-grams of the given ascending sizes, repeats included."""
    return _grams(np.frombuffer(text, dtype=np.uint8).astype(np.uint32), sizes, bits)


def char_gram_ids(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed ids of all n-grams of characters (code points) of a UTF-8 text, repeats included."""
    if text.isascii():
        return gram_ids(text, sizes, bits)
    return _grams(np.frombuffer(text.decode().encode("utf-32-le"), dtype="<u4").astype(np.uint32), sizes, bits)


def _grams(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    out, code, done = [], None, 0
    for size in sizes:
        if len(data) < size:
            break
        if code is None:
            code, done = data.copy(), 1
        while done < size:
            code = code[:-1] * STEP + data[done:]
            done += 1
        out.append(((code + np.uint32(size)) * MIX) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(ids: list[np.ndarray], scale: np.ndarray, y: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times ``scale``; returns weights and intercept.

    Full-batch gradient descent with Nesterov momentum; nothing in it is random.  Rows are gone through a chunk at a
    time, so beside the ids memory holds one chunk's numbers.
    """
    counts = np.zeros(len(scale), dtype=np.int64)
    for x in ids:
        counts[x] += 1
    used = np.flatnonzero(counts)
    places = np.zeros(len(scale), dtype=np.int32)
    places[used] = np.arange(len(used), dtype=np.int32)
    sizes = np.array([len(x) for x in ids])
    chunks, at = [], 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 500_000, side="right")) + at)
        chunks.append((at, end, np.concatenate([places[x] for x in ids[at:end]]), np.r_[0, np.cumsum(sizes[at : end - 1])]))
        at = end
    value = scale[used].astype(np.float32)

    def sums(per_feature: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(per_feature[flat], starts) for _, _, flat, starts in chunks])

    norm = float(sums(np.square(value)).mean()) + 1.0
    rate, w, b = 4.0 / norm, np.zeros(len(used), dtype=np.float32), 0.0
    lead_w, lead_b, last_w, last_b = w, b, w, b
    for k in range(rounds):
        gap = sigmoid(sums(lead_w * value) + lead_b) - y
        slope = np.zeros(len(used))
        for first, end, flat, _ in chunks:
            slope += np.bincount(flat, weights=np.repeat(gap[first:end], sizes[first:end]), minlength=len(used))
        slope = slope * value / len(ids) + decay * lead_w
        w, b = (lead_w - rate * slope).astype(np.float32), lead_b - rate * float(gap.mean())
        push = k / (k + 3.0)
        lead_w, lead_b = w + push * (w - last_w), b + push * (b - last_b)
        last_w, last_b = w, b
    out = np.zeros(len(scale), dtype=np.float32)
    out[used] = w * value
    return out, b


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, cost: float = 10.0) -> np.ndarray:
    """L2-regularised linear SVM (squared hinge) by dual coordinate descent; the bias is the last weight.

    ``y`` holds -1 and 1.  Rows are visited in an order drawn from a fixed seed.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = np.where(y > 0, len(y) / (2.0 * max(1, (y > 0).sum())), len(y) / (2.0 * max(1, (y < 0).sum())))
    soft = 1.0 / (2.0 * cost * share)
    square = np.einsum("ij,ij->i", x, x) + soft
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            slope = y[i] * (w @ x[i]) - 1.0 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w
