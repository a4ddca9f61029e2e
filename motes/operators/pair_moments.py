"""Moments over the pairs of two blocks of particles by class of distance: what a task does with blocks that Spark has brought together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs worked on at once, about: what they need stays in a core's cache.
TILE = 32768


class Moments:
    """n, mean and m2 (sum of squares about the mean) of classes 0 .. k - 1."""

    def __init__(self, k: int):
        self.n, self.mean, self.m2 = np.zeros(k), np.zeros(k), np.zeros(k)

    def add(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        both, d = self.n + n, mean - self.mean
        part = np.divide(n, both, out=np.zeros(len(n)), where=both > 0)
        self.m2 += m2 + d * d * self.n * part
        self.mean += d * part
        self.n = both


def _tiles(p: dict, q: dict, own: bool, width: float, most: float, k: int, cut: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Class (k or more: none), cos and number of the pairs of p with q, or of each of p with those after it, tile by tile; the arrays are used again. Rows are sorted by x."""
    size = max(TILE, len(q["x"]))
    d, e, c, i = np.empty(size), np.empty(size), np.empty(size), np.empty(size, np.intp)
    pv, qv = np.column_stack([p["u"], p["v"]]), np.vstack([q["u"], q["v"]])
    many = max(p["n"].max(), q["n"].max()) > 1
    if own and many:  # particles alike, with each other
        at = np.flatnonzero(p["n"] > 1)
        yield np.zeros(len(at), np.intp), p["u"][at] * p["u"][at] + p["v"][at] * p["v"][at], p["n"][at] * (p["n"][at] - 1.0) / 2
    far = most + 1e-9 * (np.abs(p["x"]) + most)
    low = np.arange(1, len(p["x"]) + 1) if own else np.searchsorted(q["x"], p["x"] - far)
    high = np.searchsorted(q["x"], p["x"] + far, "right")
    at = 0
    while at < len(p["x"]):
        first, last = low[at], high[at]
        rows = max(1, min(len(p["x"]) - at, TILE // max(1, last - first)))
        last = high[at : at + rows].max()
        rows = max(1, min(rows, size // max(1, last - first)))
        cols, shape = slice(first, last), (rows, max(0, last - first))
        one, at = slice(at, at + rows), at + rows
        if shape[1] == 0:
            continue
        flat = slice(0, shape[0] * shape[1])
        dx, dy, cos, to = d[flat].reshape(shape), e[flat].reshape(shape), c[flat].reshape(shape), i[flat].reshape(shape)
        np.subtract(q["x"][cols], p["x"][one, None], out=dx)
        np.subtract(q["y"][cols], p["y"][one, None], out=dy)
        np.multiply(dx, dx, out=dx)
        np.multiply(dy, dy, out=dy)
        r = np.sqrt(np.add(dx, dy, out=dx), out=dx)
        np.copyto(to, np.divide(r, width, out=dy), casting="unsafe")
        if cut:
            to[r >= most] = k
        if own:
            for row in range(1, rows):
                to[row, :row] = k
        np.matmul(pv[one], qv[:, cols], out=cos)
        yield i[flat], c[flat], np.outer(p["n"][one], q["n"][cols]).ravel().astype(float) if many else None


def _moments(tiles: Callable[[], Iterator], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def total(value) -> np.ndarray:
        s = np.zeros((len(value), k))
        for i, c, w in tiles():
            for row, f in zip(s, value, strict=True):
                x = f(i, c)
                row += np.bincount(i, w if x is None else x if w is None else x * w, k)[:k]
        return s

    n, s, q = total([lambda i, c: None, lambda i, c: c, lambda i, c: c * c])
    mean = np.divide(s, n, out=np.zeros(k), where=n > 0)
    m2 = np.where(n > 1, q - n * mean * mean, 0.0)
    if np.any((n > 1) & (m2 < 1e-4 * n * mean * mean)):  # nearly alike: rounding of the squares would show
        at = np.append(mean, 0.0)
        m2 = total([lambda i, c: (c - at[np.minimum(i, k)]) ** 2])[0]
    return n, mean, m2


def meet(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, same: Moments, other: Moments, width: float, most: float) -> None:
    """All pairs of block a with block b, or inside a, nearer than `most`, by floor(r / width): the moments of cos for ends of the same kind and for others.

    Blocks are columns x, y, u, v, kind and n, the number of particles that are alike in all this.
    """
    k, cut = classes(width, most)

    def kinds(x):
        for v in np.unique(x["kind"]):
            at = np.flatnonzero(x["kind"] == v)
            at = at[np.argsort(x["x"][at], kind="stable")]
            yield v, {c: x[c][at] for c in ("x", "y", "u", "v", "n")}

    first = list(kinds(a))
    second = first if b is None else list(kinds(b))
    for f, p in first:
        for s, q in second:
            if b is not None or f <= s:
                got = _moments(lambda p=p, q=q, own=b is None and f == s: _tiles(p, q, own, width, most, k, cut), k)
                (same if f == s else other).add(*got)


def classes(width: float, most: float) -> tuple[int, bool]:
    """Number of classes that distances below `most` have, and whether those from `most` on may fall into the last one."""
    k = math.floor(math.nextafter(most, 0) / width) + 1
    return k, most / width < k


def over_blocks(keys: list[str], width: float, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (keys, one, two): the moments of a task's pairs of blocks, a row for each of keys, same and bin. A block meets itself if two is null."""
    k, _ = classes(width, most)

    def block(array: pa.ListArray, i: int) -> dict[str, np.ndarray] | None:
        rows = array[i].values
        return None if rows is None else {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "u", "v", "n", "kind")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, tuple[Moments, Moments]] = {}
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in keys]
            one, two = batch.column("one"), batch.column("two")
            for i in range(batch.num_rows):
                same, other = got.setdefault(tuple(x[i] for x in names), (Moments(k), Moments(k)))
                with np.errstate(all="ignore"):
                    meet(block(one, i), block(two, i), same, other, width, most)
        rows = [(*of, m is both[0], b, m.n[b], m.mean[b], m.m2[b]) for of, both in got.items() for m in both for b in np.flatnonzero(m.n).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[*keys, "same", "bin", "n", "mean", "m2"])

    return run
