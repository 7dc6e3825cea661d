"""Square bitmaps stored as arrays, row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The moves a query is tried at.
SHIFTS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))


def unit_norm(v: Column) -> Column:
    """Scale to length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # The norm is bound once per row, as the only element of an array, not once per element.
    return F.flatten(F.transform(F.array(n), lambda z: F.transform(v, lambda x: F.when(z > 0, x / z).otherwise(x))))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _pixel(v: Column, i: Column, dx: int, dy: int, side: int) -> Column:
    """The pixel `(dx, dy)` from position `i`, 0 outside."""
    x, y = i % side + dx, F.floor(i / side) + dy
    inside = (x >= 0) & (x < side) & (y >= 0) & (y < side)
    return F.when(inside, F.get(v, (y * side + x).cast("int"))).otherwise(0.0)


def shifted(v: Column, dx: int, dy: int, side: int) -> Column:
    """The bitmap moved one way, 0 coming in at the edge."""
    return F.transform(v, lambda x, i: _pixel(v, i, dx, dy, side))


def blur3(v: Column, side: int) -> Column:
    """3x3 blur, weights 1-2-1 by 1-2-1."""
    def cell(x: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                total = total + _pixel(v, i, dx, dy, side) * float((2 - abs(dx)) * (2 - abs(dy)))
        return total / 16

    return F.transform(v, cell)


# ------------------------------------------------------------------ batches of bitmaps
def _grid(side: int) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = np.mgrid[0:side, 0:side]
    return xs.astype(float), ys.astype(float)


def _fetch(b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    side = b.shape[1]
    ok = (x >= 0) & (x < side) & (y >= 0) & (y < side)
    rows = np.arange(len(b))[:, None, None]
    return np.where(ok, b[rows, np.clip(y, 0, side - 1), np.clip(x, 0, side - 1)], 0.0)


def deskewed(b: np.ndarray) -> np.ndarray:
    """Shear upright and move to the middle by moments; `b` is (n, side, side)."""
    side = b.shape[1]
    xs, ys = _grid(side)
    m = b.sum((1, 2))
    safe = np.where(m != 0, m, 1.0)
    cx, cy = (b * xs).sum((1, 2)) / safe, (b * ys).sum((1, 2)) / safe
    dx, dy = xs - cx[:, None, None], ys - cy[:, None, None]
    mu11, mu02 = (b * dx * dy).sum((1, 2)), (b * dy * dy).sum((1, 2))
    skew = np.where(mu02 > 1e-6, mu11 / np.where(mu02 > 1e-6, mu02, 1.0), 0.0)
    mid = (side - 1) / 2
    sy = ys + (cy - mid)[:, None, None]
    sx = xs + (cx - mid)[:, None, None] + skew[:, None, None] * (sy - cy[:, None, None])
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    out = (
        _fetch(b, x0, y0) * (1 - fx) * (1 - fy) + _fetch(b, x0 + 1, y0) * fx * (1 - fy)
        + _fetch(b, x0, y0 + 1) * (1 - fx) * fy + _fetch(b, x0 + 1, y0 + 1) * fx * fy
    )
    return np.where((m != 0)[:, None, None], out, b)


def moved(b: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Each bitmap read `(dx, dy)` away, 0 outside."""
    xs, ys = _grid(b.shape[1])
    return _fetch(b, (xs + dx).astype(int)[None], (ys + dy).astype(int)[None])


def unit(flat: np.ndarray) -> np.ndarray:
    n = np.sqrt((flat * flat).sum(1, keepdims=True))
    return flat / np.where(n > 0, n, 1.0)


def ready(v: np.ndarray, side: int) -> np.ndarray:
    """What every bitmap, a row of `v`, gets before it is compared: upright, blurred, unit length."""
    b = deskewed(v.astype(float).reshape(-1, side, side))
    soft = sum(
        moved(b, dx, dy) * ((2 - abs(dx)) * (2 - abs(dy))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    ) / 16
    return unit(soft.reshape(len(b), -1))
