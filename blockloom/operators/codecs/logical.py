"""Logical codecs: int32 arrays to int32 arrays, modulo 2^32, so that every full-range array survives."""

from __future__ import annotations

import numpy as np

from .backends import _unzz, _zz


def anchors(n: int, group: int) -> np.ndarray:
    """For each place the place that its value is held against, -1 for none; group 1, 4, 8 (pairs) or 16."""
    at = np.arange(-1, n - 1)
    i = np.arange(n)
    if group == 4 and n >= 4:
        end = 1 + 4 * max(0, -(-(n - 5) // 4))
        inside = (i >= 1) & (i < end)
        at[inside] = 4 * ((i[inside] - 1) // 4)
    if group in (8, 16) and n >= group:
        end = group + group * max(0, -(-(n - 2 * group) // group))
        at[:group] = -1
        first = (i >= group) & (i < min(2 * group, end))
        at[first] = i[first] - group
        later = (i >= 2 * group) & (i < end)
        at[later] = 8 * (i[later] // 8) - 2 + i[later] % 2 if group == 8 else 16 * (i[later] // 16) - 1
    return at


def followed(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each step added to the value at its anchor (-1: none), that to the one at its own, and so on: halving all ways at once."""
    out, at = steps.copy(), np.asarray(at)
    while (more := np.flatnonzero(at >= 0)).size:
        up = at[more]
        out[more] += out[up]
        at = at.copy()
        at[more] = at[up]
    return out


class Delta:
    """Zig-zagged differences; group 1 keeps the first value raw, group 8 copies arrays under eight values."""

    def __init__(self, group: int = 1):
        self.group = group

    def encode(self, u: np.ndarray) -> np.ndarray:
        if self.group == 8 and len(u) < 8:
            return u.copy()
        at = anchors(len(u), self.group)
        out = _zz(u - np.where(at >= 0, u[np.maximum(at, 0)], np.uint32(0))) if len(u) else u
        if self.group == 1 and len(u):
            out[0] = u[0]
        return out

    def decode(self, z: np.ndarray, n: int) -> np.ndarray:
        if self.group == 8 and n < 8 or not n:
            return z.copy()
        d = _unzz(z)
        if self.group == 1:
            d[0] = z[0]
            return np.cumsum(d, dtype=np.uint32)
        return followed(d, anchors(n, self.group))


class Reference:
    """The least value, then twice the distances from it."""

    def encode(self, u: np.ndarray) -> np.ndarray:
        v = u.view(np.int32).astype(np.int64)
        low = int(v.min()) if len(v) else 0
        return np.concatenate([[low], _zz((v - low).astype(np.uint32).view(np.uint32))]).astype(np.int64).astype(np.uint32)

    def decode(self, z: np.ndarray, n: int) -> np.ndarray:
        return _unzz(z[1:]) + z[0]


class Runs:
    """(value, length) pairs of runs of equal values."""

    def encode(self, u: np.ndarray) -> np.ndarray:
        if not len(u):
            return u.copy()
        heads = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1])
        return np.stack([u[heads], np.diff(np.concatenate([heads, [len(u)]])).astype(np.uint32)], axis=1).ravel().astype(np.uint32)

    def decode(self, z: np.ndarray, n: int) -> np.ndarray:
        return np.repeat(z[::2], z[1::2])
