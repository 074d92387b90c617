"""Whole-tile wavelet kernels: numpy lifting on 2D arrays, used by block-form operators."""

from __future__ import annotations

import numpy as np

from .lifting import ALPHA, BETA, DELTA, GAMMA, K


def _neighbours(a: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right neighbours (mirrored) of the rows ``first::2``."""
    n = len(a)
    at = np.arange(first, n, 2)
    left, right = at - 1, at + 1
    left = np.where(left < 0, right, left)
    right = np.where(right >= n, at - 1, right)
    right = np.where(right < 0, left, right)
    return a[left], a[right]


def forward(a: np.ndarray, kind: str, origin: int = 0) -> np.ndarray:
    """One pass down axis 0, packed low before high."""
    odd, n = (1 + origin) % 2, len(a)
    even = 1 - odd
    if n == 1:
        return a * 2 if kind == "5/3" and origin % 2 else a.copy()
    a = a.copy()
    if kind == "5/3":
        l, r = _neighbours(a, odd)
        a[odd::2] -= (l + r) >> 1
        l, r = _neighbours(a, even)
        a[even::2] += (l + r + 2) >> 2
    else:
        for start, c in ((odd, ALPHA), (even, BETA), (odd, GAMMA), (even, DELTA)):
            l, r = _neighbours(a, start)
            a[start::2] += np.float32(c) * (l + r)
        a[odd::2] *= np.float32(K)
        a[even::2] *= np.float32(1) / np.float32(K)
    return np.concatenate([a[even::2], a[odd::2]])


def inverse(a: np.ndarray, kind: str, origin: int = 0) -> np.ndarray:
    odd, n = (1 + origin) % 2, len(a)
    even = 1 - odd
    if n == 1:
        return a >> 1 if kind == "5/3" and origin % 2 else a.copy()
    lows = (origin + n + 1 >> 1) - (origin + 1 >> 1)
    out = np.empty_like(a)
    out[even::2], out[odd::2] = a[:lows], a[lows:]
    if kind == "5/3":
        l, r = _neighbours(out, even)
        out[even::2] -= (l + r + 2) >> 2
        l, r = _neighbours(out, odd)
        out[odd::2] += (l + r) >> 1
    else:
        out[odd::2] *= np.float32(1) / np.float32(K)
        out[even::2] *= np.float32(K)
        for start, c in ((even, DELTA), (odd, GAMMA), (even, BETA), (odd, ALPHA)):
            l, r = _neighbours(out, start)
            out[start::2] -= np.float32(c) * (l + r)
    return out


def _halved(origin: int, size: int) -> tuple[int, int]:
    low = (origin + 1) >> 1
    return low, ((origin + size + 1) >> 1) - low


def shapes(h: int, w: int, levels: int, y0: int = 0, x0: int = 0) -> list[tuple[int, int, int, int]]:
    """Origin and size of the low-pass region before each level and after the last."""
    out = [(y0, x0, h, w)]
    for _ in range(levels):
        y0, x0, h, w = out[-1]
        (ny, nh), (nx, nw) = _halved(y0, h), _halved(x0, w)
        out.append((ny, nx, nh, nw))
    return out


def analyse(a: np.ndarray, levels: int, kind: str = "5/3", y0: int = 0, x0: int = 0) -> np.ndarray:
    """All levels in place; each along y, then along x."""
    a = a.astype(np.int64 if kind == "5/3" else np.float32)
    for oy, ox, h, w in shapes(*a.shape, levels, y0, x0)[:-1]:
        if h and w:
            part = forward(a[:h, :w], kind, oy)
            a[:h, :w] = forward(part.T, kind, ox).T
    return a


def synthesise(a: np.ndarray, levels: int, kind: str = "5/3", y0: int = 0, x0: int = 0, reduce: int = 0) -> np.ndarray:
    """Inverse; with ``reduce``, the finest levels are left out and the smaller plane is returned."""
    a = a.astype(np.int64 if kind == "5/3" else np.float32)
    dims = shapes(*a.shape, levels, y0, x0)
    for oy, ox, h, w in dims[reduce:levels][::-1]:
        if h and w:
            part = inverse(a[:h, :w].T, kind, ox).T
            a[:h, :w] = inverse(part, kind, oy)
    _, _, h, w = dims[reduce]
    return a[:h, :w]
