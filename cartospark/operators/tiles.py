"""Map tiles: ids, pyramids, pixel aggregation, images, vector tiles.

A tile is (z, x, y), y counted from the top; its id is z << 52 | x << 26 | y, a sortable long.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.st import FIELDS, geoms
from .synopses import Grid

_BITS = 26


def tile_id(z, x: Column, y: Column) -> Column:
    z = z if isinstance(z, Column) else F.lit(z)
    return F.shiftleft(z.cast("long"), 2 * _BITS).bitwiseOR(F.shiftleft(x.cast("long"), _BITS)).bitwiseOR(y.cast("long"))


def tile_z(t: Column) -> Column:
    return F.shiftright(t, 2 * _BITS).cast("int")


def tile_x(t: Column) -> Column:
    return F.shiftright(t, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def tile_y(t: Column) -> Column:
    return t.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def tile_parent(t: Column) -> Column:
    return tile_id(tile_z(t) - 1, F.shiftright(tile_x(t), 1), F.shiftright(tile_y(t), 1))


def tile_flipped(t: Column) -> Column:
    """Counted from the bottom instead of the top."""
    return tile_id(tile_z(t), tile_x(t), F.pow(F.lit(2.0), tile_z(t)).cast("int") - 1 - tile_y(t))


def tile_bounds(z: int, x: int, y: int, area: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    x1, y1, x2, y2 = area
    w, h = (x2 - x1) / 2**z, (y2 - y1) / 2**z
    return (x1 + x * w, y2 - (y + 1) * h, x1 + (x + 1) * w, y2 - y * h)


def _level_grid(area: tuple[float, float, float, float], z: int) -> Grid:
    return Grid(*area, 1 << z, 1 << z)


def _column_tiles(z: int, rows: Column):
    return lambda c: F.transform(rows, lambda r: tile_id(z, c, r))


def tiles_of(g: Column, area: tuple[float, float, float, float], levels: list[int]) -> Column:
    """Array of the ids of all tiles of the levels that the bounds meet."""
    out = []
    for z in levels:
        grid = _level_grid(area, z)
        cols = F.sequence(grid.column(g["xmin"]), grid.column(g["xmax"]))
        rows = F.sequence(F.lit((1 << z) - 1) - grid.row(g["ymax"]), F.lit((1 << z) - 1) - grid.row(g["ymin"]))
        out.append(F.flatten(F.transform(cols, _column_tiles(z, rows))))
    meets = (g["xmin"] <= area[2]) & (g["xmax"] >= area[0]) & (g["ymin"] <= area[3]) & (g["ymax"] >= area[1])
    return F.when(meets, F.concat(*out)).otherwise(F.array().cast("array<long>"))


def flat_tiles(df: DataFrame, area: tuple[float, float, float, float], levels: list[int], geom: str = "geom") -> DataFrame:
    """df with a copy of each row for every tile that it meets."""
    return df.withColumn("tile", F.explode(tiles_of(F.col(geom), area, levels)))


def tile_counts(df: DataFrame, area: tuple[float, float, float, float], levels: list[int], geom: str = "geom") -> DataFrame:
    """(tile, count) of all tiles with data."""
    return flat_tiles(df.select(F.col(geom).alias("geom")), area, levels).groupBy("tile").agg(F.count(F.lit(1)).alias("count"))


def pyramid_counts(deepest: DataFrame, levels: int) -> DataFrame:
    """(tile, count) of a level and its parents up to `levels` above, from the deepest level's counts of points."""
    out = level = deepest
    for _ in range(levels):
        level = level.select(tile_parent(F.col("tile")).alias("tile"), "count").groupBy("tile").agg(F.sum("count").alias("count"))
        out = out.unionByName(level)
    return out


def classify_tiles(counts: DataFrame, image_from: int) -> DataFrame:
    """kind of each tile with data: 'image' where it and some child hold enough, 'shallow' where no child does, 'data' below that.

    A tile that isn't in the table is empty.
    """
    children = counts.where(F.col("count") >= image_from).select(tile_parent(F.col("tile")).alias("tile")).distinct().withColumn("deep", F.lit(True))
    joined = counts.join(children, "tile", "left")
    kind = F.when(F.col("count") < image_from, "data").when(F.col("deep"), "image").otherwise("shallow")
    return joined.select("tile", "count", kind.alias("kind"))


def deepest_level(counts: DataFrame, threshold: int) -> int:
    """The deepest level with a tile of more than the threshold; -1 if none."""
    r = counts.where(F.col("count") > threshold).agg(F.max(tile_z(F.col("tile")))).first()
    return -1 if r[0] is None else int(r[0])


# --- images -------------------------------------------------------------------------------------------


def pixel_counts(df: DataFrame, area: tuple[float, float, float, float], width: int, height: int, geom: str = "geom", tile: bool = False) -> DataFrame:
    """([tile,] px, py, count) of the bounds' centres, py from the top."""
    g = F.col(geom)
    grid = Grid(*area, width, height)
    x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    return df.where(grid.inside(x, y)).groupBy(grid.column(x).alias("px"), (F.lit(height - 1) - grid.row(y)).alias("py")).agg(F.count(F.lit(1)).alias("count"))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA image (height, width, 4) as PNG."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _shade(counts: np.ndarray, color: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros((*counts.shape, 4), np.uint8)
    out[..., :3] = color
    top = counts.max()
    out[..., 3] = np.where(counts > 0, 55 + 200 * np.log1p(counts) / np.log1p(max(top, 1)), 0)
    return out


def plot_image(df: DataFrame, area: tuple[float, float, float, float], width: int = 1000, height: int = 1000, geom: str = "geom", color: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """PNG of the data's centres; at most width x height rows reach the driver."""
    grid = np.zeros((height, width))
    for r in pixel_counts(df, area, width, height, geom).toLocalIterator():
        grid[r.py, r.px] = r["count"]
    return png(_shade(grid, color))


def plot_pyramid(df: DataFrame, area: tuple[float, float, float, float], levels: list[int], size: int = 256, geom: str = "geom", color: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(tile, png): an image for every tile with data; pixels are counted before tiles are drawn, so a tile is size^2 rows at most."""
    g = F.col(geom)
    x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    out = []
    for z in levels:
        fine = Grid(*area, size << z, size << z)
        px, py = fine.column(x), F.lit((size << z) - 1) - fine.row(y)
        out.append(df.where(fine.inside(x, y)).groupBy(px.alias("px"), py.alias("py")).agg(F.count(F.lit(1)).alias("count")).withColumn("tile", tile_id(z, F.floor(F.col("px") / size), F.floor(F.col("py") / size))))
    pixels = out[0]
    for p in out[1:]:
        pixels = pixels.unionByName(p)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((size, size))
        counts[pdf["py"] % size, pdf["px"] % size] = pdf["count"]
        return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "png": [png(_shade(counts, color))]})

    return pixels.groupBy("tile").applyInPandas(draw, "tile long, png binary")


def svg_path(g: G.Geom, area: tuple[float, float, float, float], width: int, height: int) -> str:
    """A geometry as SVG path data in pixels."""
    x1, y1, x2, y2 = area
    at = lambda c: f"{round((c[0] - x1) * width / (x2 - x1), 2):g} {round((y2 - c[1]) * height / (y2 - y1), 2):g}"
    out = []
    for s in g.simple():
        if s.kind == "POINT":
            out.append(f"M{at(s.data)}h0")
        for path in [s.data] if s.kind == "LINESTRING" else s.data if s.kind == "POLYGON" else []:
            ring = s.kind == "POLYGON"
            out.append("M" + "L".join(at(c) for c in (path[:-1] if ring else path)) + ("Z" if ring else ""))
    return "".join(out)


def svg_paths(df: DataFrame, area: tuple[float, float, float, float], width: int = 1000, height: int = 1000, geom: str = "geom") -> DataFrame:
    """df with `path`, SVG path data of each geometry."""

    @F.pandas_udf("string")
    def path(g: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None else svg_path(x, area, width, height) for x in geoms(g)])

    return df.withColumn("path", path(F.col(geom)))


# --- vector tiles ---------------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes | int) -> bytes:
    if isinstance(data, int):
        return _varint(number << 3) + _varint(data)
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _commands(paths: list[np.ndarray], closed: bool) -> list[int]:
    out, x, y = [], 0, 0
    for p in paths:
        for k, (px, py) in enumerate(p.tolist()):
            if k == 0:
                out.append(1 | 1 << 3)
            elif k == 1:
                out.append(2 | (len(p) - 1) << 3)
            out += [_zigzag(px - x), _zigzag(py - y)]
            x, y = px, py
        if closed:
            out.append(7 | 1 << 3)
    return out


def encode_feature(g: G.Geom, bounds: tuple[float, float, float, float], extent: int = 4096) -> list[tuple[int, list[int]]]:
    """(type, commands) of a geometry's points, lines and polygons within a tile's bounds."""
    x1, y1, x2, y2 = bounds

    def to_tile(c: np.ndarray) -> np.ndarray:
        at = np.stack([(c[:, 0] - x1) * extent / (x2 - x1), (y2 - c[:, 1]) * extent / (y2 - y1)], axis=1).round().astype(int)
        keep = np.ones(len(at), bool)
        keep[1:] = (at[1:] != at[:-1]).any(axis=1)
        return at[keep]

    pad_x, pad_y = (x2 - x1) / 64, (y2 - y1) / 64
    cut = G.clip_to_box(g, x1 - pad_x, y1 - pad_y, x2 + pad_x, y2 + pad_y)
    points, lines, rings = [], [], []
    for s in cut.simple():
        if s.kind == "POINT":
            points.append(to_tile(s.data[None])[0])
        elif s.kind == "LINESTRING":
            p = to_tile(s.data)
            lines += [p] if len(p) > 1 else []
        else:
            for k, r in enumerate(s.data):
                p = to_tile(r)[:-1]
                area = G.ring_area(np.concatenate([p, p[:1]]).astype(float)) if len(p) > 2 else 0
                if area:
                    rings.append(p if (area > 0) == (k == 0) else p[::-1])  # y runs down: positive shells
                elif k == 0:
                    break
    out = []
    if points:
        flat, x, y = [1 | len(points) << 3], 0, 0
        for px, py in points:
            flat += [_zigzag(int(px - x)), _zigzag(int(py - y))]
            x, y = px, py
        out.append((1, flat))
    if lines:
        out.append((2, _commands(lines, False)))
    if rings:
        out.append((3, _commands(rings, True)))
    return out


def encode_layer(name: str, features: list[tuple[int, list[int], dict[str, object]]], extent: int = 4096) -> bytes:
    """A vector tile of one layer."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for kind, commands, tags in features:
        pairs = []
        for k, v in tags.items():
            if v is None:
                continue
            if isinstance(v, bool):
                raw = _varint(7 << 3) + _varint(int(v))
            elif isinstance(v, (int, np.integer)):
                raw = _varint(6 << 3) + _varint(_zigzag(int(v)))
            elif isinstance(v, float):
                raw = _varint(3 << 3 | 1) + struct.pack("<d", v)
            else:
                raw = _field(1, str(v).encode())
            pairs += [keys.setdefault(k, len(keys)), values.setdefault(raw, len(values))]
        feature = _field(2, b"".join(map(_varint, pairs))) if pairs else b""
        feature += _field(3, kind) + _field(4, b"".join(map(_varint, commands)))
        body += _field(2, feature)
    layer = _field(1, name.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values) + _field(5, extent) + _field(15, 2)
    return _field(3, layer)


def vector_tiles(df: DataFrame, area: tuple[float, float, float, float], levels: list[int], layer: str = "features", attributes: list[str] | None = None, geom: str = "geom", extent: int = 4096, most: int = 100_000) -> DataFrame:
    """(tile, part, mvt): vector tiles of all levels. A tile of more than `most` features is several parts, all kept."""
    attributes = attributes or []
    rows = flat_tiles(df.select(F.col(geom).alias("geom"), *attributes), area, levels).select("tile", *attributes, *[F.col(f"geom.{f}").alias(f"__{f}") for f in FIELDS])
    sizes = rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    rows = rows.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("__shape", "__xmin", "__ymin", *attributes), F.col("parts")).cast("int")).drop("parts")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tile"].iloc[0])
        bounds = tile_bounds(t >> 52, t >> 26 & (1 << 26) - 1, t & (1 << 26) - 1, area)
        shapes = geoms(pdf.rename(columns={f"__{f}": f for f in FIELDS}))
        found = [(kind, commands, row) for g, row in zip(shapes, pdf[attributes].to_dict("records")) if g is not None for kind, commands in encode_feature(g, bounds, extent)]
        return pd.DataFrame({"tile": [t], "part": [int(pdf["part"].iloc[0])], "mvt": [encode_layer(layer, found, extent)]})

    return rows.groupBy("tile", "part").applyInPandas(encode, "tile long, part int, mvt binary")
