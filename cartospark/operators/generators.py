"""Seeded synthetic spatial data. A row's numbers come from its id and the seed alone, so any partitioning gives the same data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.st import st_makebox, st_point

DISTRIBUTIONS = ("uniform", "diagonal", "gaussian", "bit", "sierpinski", "parcel")
ROWS_PER_PARTITION = 1_000_000


def unit(seed: int, salt: int, key: Column | None = None) -> Column:
    """A uniform number in [0, 1) for each id."""
    h = F.xxhash64(F.col("id") if key is None else key, F.lit(seed).cast("long"), F.lit(salt))
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def bernoulli(seed: int, salt: int, p: float) -> Column:
    return (unit(seed, salt) < p).cast("double")


def normal(seed: int, salt: int, mean: float, deviation: float) -> Column:
    """Box-Muller over two uniform numbers."""
    return F.lit(mean) + deviation * F.sqrt(-2 * F.log(1 - unit(seed, salt))) * F.cos(2 * math.pi * unit(seed, salt + 1))


def dice(seed: int, salt: int, sides: int) -> Column:
    return (F.floor(unit(seed, salt) * sides) + 1).cast("int")


def _bits(seed: int, salt: int, p: float, digits: int) -> Column:
    out = F.lit(0.0)
    for d in range(1, digits + 1):
        out = out + F.when(unit(seed, salt + d) < p, 0.5**d).otherwise(0.0)
    return out


def _sierpinski(seed: int, depth: int = 27) -> tuple[Column, Column]:
    """The chaos game from a fixed start, one fold over `depth` corners of a triangle."""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.5, math.sqrt(3) / 2))])
    picks = F.array(*[dice(seed, 100 + k, 3) - 1 for k in range(depth)])
    start = F.struct(F.lit(0.5).alias("x"), F.lit(0.0).alias("y"))
    walk = F.aggregate(picks, start, lambda acc, i: F.struct(((acc["x"] + F.get(corners, i)["x"]) / 2).alias("x"), ((acc["y"] + F.get(corners, i)["y"]) / 2).alias("y")))
    return walk["x"], walk["y"]


def _parcel(n: int, seed: int, split: float, dither: float) -> Column:
    """The id's path down a binary tree of cuts, each along the longer side, the box then shrunk by the dither."""
    depth = max(0, math.ceil(math.log2(max(1, n))))
    start = F.struct(*[F.lit(v).alias(k) for v, k in ((0.0, "x1"), (0.0, "y1"), (1.0, "x2"), (1.0, "y2"))])

    def cut(acc: Column, level: Column) -> Column:
        side = F.pmod(F.floor(F.col("id") / F.pow(F.lit(2.0), level)), F.lit(2))
        node = F.pmod(F.col("id"), F.pow(F.lit(2.0), level).cast("long"))
        at = F.lit(split) + (1 - 2 * split) * unit(seed, 7, F.struct(level, node))
        wide = (acc["x2"] - acc["x1"]) > (acc["y2"] - acc["y1"])
        x, y = acc["x1"] + (acc["x2"] - acc["x1"]) * at, acc["y1"] + (acc["y2"] - acc["y1"]) * at
        low = side == 0
        return F.struct(
            F.when(wide & ~low, x).otherwise(acc["x1"]).alias("x1"), F.when(~wide & ~low, y).otherwise(acc["y1"]).alias("y1"),
            F.when(wide & low, x).otherwise(acc["x2"]).alias("x2"), F.when(~wide & low, y).otherwise(acc["y2"]).alias("y2"),
        )

    if depth == 0:
        box = start
    else:
        box = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), start, cut)
    dx, dy = (box["x2"] - box["x1"]) * dither * unit(seed, 8), (box["y2"] - box["y1"]) * dither * unit(seed, 9)
    return F.struct((box["x1"] + dx / 2).alias("x1"), (box["y1"] + dy / 2).alias("y1"), (box["x2"] - dx / 2).alias("x2"), (box["y2"] - dy / 2).alias("y2"))


def generate(
    spark: SparkSession, distribution: str, n: int, seed: int = 0, area: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0), shape: str = "point", max_size: tuple[float, float] = (0.01, 0.01),
    segments: tuple[int, int] = (3, 10), percentage: float = 0.5, buffer: float = 0.2, probability: float = 0.2, digits: int = 10, split: float = 0.2, dither: float = 0.2, affine: tuple[float, ...] | None = None,
) -> DataFrame:
    """(id, geom): n seeded points, boxes (of sizes up to max_size) or polygons (of a number of segments) in an area.

    affine: a, b, c, d, e, f applied to the unit square's points before they are scaled to the area.
    """
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {distribution!r}; one of {', '.join(DISTRIBUTIONS)}")
    ids = spark.range(0, n, numPartitions=max(1, -(-n // ROWS_PER_PARTITION)))
    x1, y1, x2, y2 = area
    to_x, to_y = (lambda v: F.lit(x1) + v * (x2 - x1)), (lambda v: F.lit(y1) + v * (y2 - y1))
    if distribution == "parcel":
        boxes = ids.withColumn("b", _parcel(n, seed, split, dither))
        return boxes.select("id", st_makebox(to_x(F.col("b.x1")), to_y(F.col("b.y1")), to_x(F.col("b.x2")), to_y(F.col("b.y2"))).alias("geom"))
    if distribution == "uniform":
        x, y = unit(seed, 1), unit(seed, 2)
    elif distribution == "gaussian":
        x, y = normal(seed, 1, 0.5, 0.1), normal(seed, 3, 0.5, 0.1)
    elif distribution == "bit":
        x, y = _bits(seed, 10, probability, digits), _bits(seed, 50, probability, digits)
    elif distribution == "sierpinski":
        x, y = _sierpinski(seed)
    else:
        base, off = unit(seed, 1), normal(seed, 2, 0.0, buffer / 5)
        on = unit(seed, 5) < percentage
        x, y = F.when(on, base).otherwise(base + off / math.sqrt(2)), F.when(on, base).otherwise(base - off / math.sqrt(2))
    pts = ids.withColumn("x", x).withColumn("y", y)
    if affine:
        a, b, c, d, e, f = affine
        pts = pts.withColumns({"x": a * F.col("x") + b * F.col("y") + c, "y": d * F.col("x") + e * F.col("y") + f})
    cx, cy = to_x(F.col("x")), to_y(F.col("y"))
    if shape == "point":
        return pts.select("id", st_point(cx, cy).alias("geom"))
    if shape == "box":
        w, h = unit(seed, 20) * max_size[0] / 2, unit(seed, 21) * max_size[1] / 2
        return pts.select("id", st_makebox(cx - w, cy - h, cx + w, cy + h).alias("geom"))
    if shape != "polygon":
        raise ValueError("shape: point, box or polygon")
    from ..functions.st import st_createpolygon

    low, high = segments
    sides = (F.lit(low) + F.floor(unit(seed, 30) * (high - low + 1))).cast("int")
    angle = lambda k: 2 * math.pi * (k + 0.9 * unit(seed, 31, F.struct("id", k))) / F.col("sides")
    radius = (0.5 + 0.5 * unit(seed, 32)) * max_size[0] / 2
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.array(cx + F.col("r") * F.cos(angle(k)), cy + F.col("r") * F.sin(angle(k)))))
    rings = pts.withColumn("sides", sides).withColumn("r", radius).withColumn("flat", flat)
    closed = F.concat("flat", F.slice("flat", 1, 2))
    return rings.select("id", st_createpolygon(closed).alias("geom"))
