"""Drawing geometries, not only their centres: a canvas of pixels, and tables of covered pixels.

A polygon covers the pixels whose centres it holds, a line those that it runs through, a point its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.st import FIELDS, decode

Area = tuple[float, float, float, float]


def _place(c: np.ndarray, area: Area, width: int, height: int) -> np.ndarray:
    """Coordinates in pixels, y from the top."""
    x1, y1, x2, y2 = area
    return np.stack([(c[:, 0] - x1) * width / (x2 - x1), (y2 - c[:, 1]) * height / (y2 - y1)], axis=1)


def _fill(rings: list[np.ndarray], mask: np.ndarray) -> None:
    """Pixels whose centres lie inside an odd number of rings; a centre on a left or upper edge counts."""
    height, width = mask.shape
    seg = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings])
    low, high = seg[:, [1, 3]].min(axis=1), seg[:, [1, 3]].max(axis=1)
    for row in range(max(0, int(np.floor(low.min()))), min(height, int(np.ceil(high.max())) + 1)):
        y = row + 0.5
        s = seg[(low <= y) & (y < high)]
        if len(s):
            x = np.sort(s[:, 0] + (y - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1]))
            first, last = np.ceil(x[0::2] - 0.5), np.ceil(x[1::2] - 0.5)
            for a, b in zip(np.clip(first, 0, width).astype(int), np.clip(last, 0, width).astype(int)):
                mask[row, a:b] = True


def _trace(path: np.ndarray, mask: np.ndarray) -> None:
    """Pixels that the path runs through: each piece between two pixel borders lies in one."""
    height, width = mask.shape
    for a, b in zip(path[:-1], path[1:]):
        cuts = [np.array([0.0, 1.0])]
        for axis in (0, 1):
            if a[axis] != b[axis]:
                lo, hi = sorted((a[axis], b[axis]))
                lines = np.arange(np.ceil(max(lo, -1)), np.floor(min(hi, mask.shape[1 - axis] + 1)) + 1)
                cuts.append((lines - a[axis]) / (b[axis] - a[axis]))
        t = np.unique(np.clip(np.concatenate(cuts), 0, 1))
        middle = a + ((t[:-1] + t[1:]) / 2)[:, None] * (b - a) if len(t) > 1 else a[None]
        _points(middle, mask)


def _points(c: np.ndarray, mask: np.ndarray) -> None:
    at = np.floor(c).astype(int)
    at = at[(at[:, 0] >= 0) & (at[:, 0] < mask.shape[1]) & (at[:, 1] >= 0) & (at[:, 1] < mask.shape[0])]
    mask[at[:, 1], at[:, 0]] = True


def rasterize(g: G.Geom, area: Area, width: int, height: int, outline: bool = False) -> np.ndarray:
    """(height, width) of the pixels that the geometry covers; outline: polygons as their rings."""
    mask = np.zeros((height, width), bool)
    for s in g.simple():
        if s.kind == "POLYGON" and not outline:
            _fill([_place(r, area, width, height) for r in s.data], mask)
        elif s.kind == "POINT":
            _points(_place(s.data[None], area, width, height), mask)
        else:
            for path in s.data if s.kind == "POLYGON" else [s.data]:
                _trace(_place(path, area, width, height), mask)
    return mask


def covered_pixels(df: DataFrame, area: Area, width: int, height: int, geom: str = "geom", outline: bool = False) -> DataFrame:
    """(px, py, count): how many geometries cover each pixel, py from the top. A task adds up its own before the shuffle."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((height, width), np.int64)
        for pdf in frames:
            for row in zip(*(pdf[c] for c in FIELDS)):
                g = decode(*row)
                if g is not None and not g.is_empty:
                    total += rasterize(g, area, width, height, outline)
        py, px = np.nonzero(total)
        yield pd.DataFrame({"px": px.astype(np.int64), "py": py.astype(np.int64), "count": total[py, px]})

    g = F.col(geom)
    meets = (g["xmin"] <= area[2]) & (g["xmax"] >= area[0]) & (g["ymin"] <= area[3]) & (g["ymax"] >= area[1])
    drawn = df.where(meets).select(*[g[c].alias(c) for c in FIELDS]).mapInPandas(draw, "px long, py long, count long")
    return drawn.groupBy("px", "py").agg(F.sum("count").alias("count"))


def draw_image(df: DataFrame, area: Area, width: int = 1000, height: int = 1000, geom: str = "geom", color: tuple[int, int, int] = (0, 0, 0), outline: bool = False) -> bytes:
    """PNG of the geometries themselves; at most width x height rows reach the driver."""
    from .tiles import _shade, png

    counts = np.zeros((height, width))
    for r in covered_pixels(df, area, width, height, geom, outline).collect():
        counts[r.py, r.px] = r["count"]
    return png(_shade(counts, color))
