"""Crops of an Arrow batch laid side by side into frames of one size, and what is done on all of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pixels of a frame; a larger crop has one to itself.
FRAME = 1 << 20


def frames(y: pa.Array, px: pa.Array, in_turn: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`(crops, pixels, lines, heights, widths)` of crops whose lines are lists `y` and `px`, in any order.

    `pixels` is (crops, height, width), 0 beyond a crop; `lines` has the y of each. A line lies at its place among the crop's lines if
    `in_turn`, else as far below the first as its y says, and lines that are absent are 0. A crop without lines has height 0.
    """
    counts = y.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of, ys = np.repeat(np.arange(len(counts)), counts), y.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = px.flatten()
    sizes, v = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), flat.flatten().to_numpy(zero_copy_only=False)
    began, starts = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sizes)]
    if in_turn:
        at = np.empty(len(ys), np.int64)
        at[np.lexsort((ys, of))] = np.arange(len(ys)) - np.repeat(began[:-1], counts)
    else:
        first = np.full(len(counts), np.iinfo(np.int64).max)
        np.minimum.at(first, of, ys)
        at = ys - first[of]
    heights, widths = np.zeros((2, len(counts)), np.int64)
    np.maximum.at(heights, of, at + 1)
    np.maximum.at(widths, of, sizes)
    a = 0
    while a < len(counts):
        b, h, w = a + 1, heights[a], widths[a]
        while b < len(counts) and (b + 1 - a) * max(h, heights[b]) * max(w, widths[b]) <= FRAME:
            h, w, b = max(h, heights[b]), max(w, widths[b]), b + 1
        part = slice(began[a], began[b])
        pixels, lines = np.zeros((b - a, h, w), v.dtype), np.zeros((b - a, h), np.int64)
        crop, line, size = of[part] - a, at[part], sizes[part]
        lines[crop, line] = ys[part]
        along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pixels[np.repeat(crop, size), np.repeat(line, size), along] = v[starts[began[a]]:starts[began[b]]]
        yield slice(a, b), pixels, lines, heights[a:b], widths[a:b]
        a = b


def inside(shape: tuple[int, ...], heights: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Which pixels of a frame are their crop's."""
    down, along = np.arange(shape[1])[:, None] < heights[:, None, None], np.arange(shape[2]) < widths[:, None, None]
    return down & along


def widest(m: np.ndarray, r: int) -> np.ndarray:
    """Maximum over the square of radius `r` in the last two axes, 0 outside: the window doubles, it is not rescanned."""
    for axis in (-1, -2):
        a, size = np.moveaxis(m, axis, -1), 1
        a = np.pad(a, [(0, 0)] * (m.ndim - 1) + [(r, r)])
        while size < 2 * r + 1:
            step = min(size, 2 * r + 1 - size)
            a, size = np.maximum(a[..., :-step], a[..., step:]), size + step
        m = np.moveaxis(a, -1, axis)
    return m


def _thin(flags: np.ndarray, most: int, near=lambda row, start, end: True) -> np.ndarray:
    """Flags that stand in runs no longer than `most` along their row, of the runs that are `near`."""
    turn = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(turn == 1)
    end = np.nonzero(turn == -1)[1] - 1
    kept = (end - start < most) & near(row, start, end)
    marks = np.zeros_like(turn)
    marks[row[kept], start[kept]] = 1
    marks[row[kept], end[kept] + 1] = -1
    return marks[:, :-1].cumsum(axis=1) > 0


def struck_ink(
    pixels: np.ndarray, heights: np.ndarray, widths: np.ndarray, *, depth: int = 22, window: int = 9, rule_frac: float = 0.5,
    rule_thick: int = 6, wall_frac: float = 0.5, wall_thick: int = 6, wall_edge: float = 0.25,
) -> np.ndarray:
    """`raster.ink_mask` of a frame's crops: what is darker than the paper around it, without thin rules and walls near a side."""
    own = inside(pixels.shape, heights, widths)
    ink = (widest(pixels, window).astype(np.int32) - pixels >= depth) & own
    rules = _thin((ink.sum(2) >= widths[:, None] * rule_frac) & own.any(2), rule_thick)
    edge = np.maximum(2, np.floor(widths * wall_edge + 0.5))
    walls = _thin(
        (ink.sum(1) >= heights[:, None] * wall_frac) & own.any(1), wall_thick,
        lambda row, start, end: (start < edge[row]) | (end >= (widths - edge)[row]),
    )
    return ink & ~rules[:, :, None] & ~walls[:, None, :]
