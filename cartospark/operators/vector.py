"""Vector analysis: buffer, dissolve, overlay, reprojection, splitting, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.crs import transformer
from ..functions.geodesic import DEGREE_KM
from ..functions.st import FIELDS, GEOM, frame, geoms, st_difference, st_intersection, st_symdifference, st_union, unary
from .join import gathered, measure, self_join, spatial_join, spread
from .store import Folder, written

OVERLAYS = {"intersection": st_intersection, "union": st_union, "difference": st_difference, "symdifference": st_symdifference}
UNITS = {"degree": 1.0, "km": 1 / DEGREE_KM, "m": 1 / DEGREE_KM / 1000}


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(a, b), nodes(id) -> (id, component): the smallest id that links reach. Alternating star contraction, a written table each round."""
    folder, k = Folder(nodes, "components"), 0
    links = folder.keep(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "0")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = None
    while (now := mark(links)) != seen and now[0]:
        seen, k = now, k + 1
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        down = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        links = folder.keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), str(k))
        folder.drop(str(k - 1))
    return nodes.select(F.col("id")).join(links.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


def buffer(df: DataFrame, radius: float, unit: str = "degree", geom: str = "geom", quadrant: int = 8) -> DataFrame:
    """df with every geometry grown by the radius."""
    r = radius * UNITS[unit]
    return df.withColumn(geom, unary(lambda x: G.buffer(x, r, quadrant), GEOM)(F.col(geom)))


def dissolve(df: DataFrame, id_col: str, geom: str = "geom", method: str = "pbsm", group_rows: int = 2000) -> DataFrame:
    """(component, members, geom): the union of every group of geometries that meet, single ones too.

    Groups are united in rounds: parts of at most about `group_rows` members by hash, then parts of as many of the results, until each group
    is one, so no task opens more of a large group.
    """
    return _dissolved(_places(df, id_col, geom), method, group_rows)


def _places(df: DataFrame, id_col: str, geom: str) -> DataFrame:
    """(id, geom, n): a row for all rows of an equal geometry, with the smallest id and their number; empty and null ones stay apart."""
    rows = df.select(F.col(id_col).alias("id"), F.col(geom).alias("geom"))
    same = rows.groupBy("geom", F.when(F.col("geom")["xmin"].isNull(), F.col("id")).alias("apart"))
    return same.agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "geom", "n")


def _dissolved(places: DataFrame, method: str = "pbsm", group_rows: int = 2000) -> DataFrame:
    places = written(places)
    pairs = self_join(places.drop("n"), "id", "intersects", "geom", method)
    of = components(pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")), places.select("id"))
    rows = places.join(of, "id")
    sizes = rows.groupBy("component").agg(F.sum("n").alias("members"), F.count("*").alias("left"))
    rows = rows.join(sizes, "component").select("component", "id", "left", "geom.*")
    most = sizes.agg(F.max("left")).first()[0] or 1

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        out = frame([G.union_all([g for g in geoms(pdf[FIELDS]) if g is not None and not g.is_empty])])
        for k, name in enumerate(("component", "id", "left")):
            out.insert(k, name, pdf["part" if name == "id" else name].iloc[0])
        out["left"] = -(-out["left"] // group_rows)
        return out

    kind = places.schema["id"].dataType.simpleString()
    schema = f"component {kind}, id long, left long, kind string, srid int, xmin double, ymin double, xmax double, ymax double, shape binary"
    while True:
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("left") / group_rows)).alias("part")
        rows = rows.withColumn("part", part).groupBy("component", "part").applyInPandas(unite, schema)
        if most <= group_rows:
            break
        most = -(-most // group_rows)
    return rows.drop("left").join(sizes, "component").select("component", "members", F.struct(*FIELDS).alias("geom"))


def buffer_dissolve(df: DataFrame, id_col: str, radius: float, unit: str = "degree", geom: str = "geom") -> DataFrame:
    return _dissolved(buffer(_places(df, id_col, geom), radius, unit))


def overlay(left: DataFrame, right: DataFrame, left_id: str, right_id: str, how: str = "intersection", left_geom: str = "geom", right_geom: str = "geom", method: str = "auto") -> DataFrame:
    """(left_id, right_id, geom): the set operation of every pair that intersects; empty results are left out."""
    a = left.select(F.col(left_id).alias("left_id"), F.col(left_geom).alias("g1"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_geom).alias("g2"))
    s, t = measure(a, "g1"), measure(b, "g2")
    a, b = (gathered(x, g, name) if side.repeated else x for x, g, name, side in ((a, "g1", "lefts", s), (b, "g2", "rights", t)))
    pairs = spatial_join(a, b, "intersects", method, "g1", "g2")
    rest = [c for c in pairs.columns if c not in ("g1", "g2")]
    found = pairs.select(*rest, OVERLAYS[how](F.col("g1"), F.col("g2")).alias("geom")).where("geom.xmin is not null")  # of equal geometries once
    return spread(found, ["left_id", "right_id", "geom"], [c for c in ("lefts", "rights") if c in rest])


# --- reprojection -------------------------------------------------------------------------------------


def reproject_geom(g: G.Geom, srid: int) -> G.Geom:
    """The geometry in another system of the registry (functions/crs.py)."""
    return g if g.srid == srid else G.transform(g, transformer(g.srid, srid), srid)


def reproject_bounds(bounds: tuple[float, float, float, float], source: int, target: int, steps: int = 16) -> tuple[float, float, float, float]:
    """Bounds of the image of a box, whose sides may bend: points along them, not the corners alone."""
    x1, y1, x2, y2 = bounds
    t = np.linspace(0, 1, steps + 1)
    sides = [(x1 + t * (x2 - x1), np.full_like(t, y)) for y in (y1, y2)] + [(np.full_like(t, x), y1 + t * (y2 - y1)) for x in (x1, x2)]
    c = transformer(source, target)(np.concatenate([np.stack(s, axis=1) for s in sides]))
    return (*c.min(axis=0).tolist(), *c.max(axis=0).tolist())


def reproject(df: DataFrame, srid: int, geom: str = "geom") -> DataFrame:
    """df with its geometries in another system; null where there's no transform."""
    return df.withColumn(geom, unary(lambda x: reproject_geom(x, srid), GEOM)(F.col(geom)))


def affine(df: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, geom: str = "geom") -> DataFrame:
    """x' = a x + b y + c, y' = d x + e y + f."""
    m, t = np.array([[a, b], [d, e]]), np.array([c, f])
    return df.withColumn(geom, unary(lambda x: G.transform(x, lambda p: p @ m.T + t), GEOM)(F.col(geom)))


def clamp(g: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Bounds cut to an area (points and boxes)."""
    x = lambda c: F.least(F.greatest(c, F.lit(xmin)), F.lit(xmax))
    y = lambda c: F.least(F.greatest(c, F.lit(ymin)), F.lit(ymax))
    return g.withField("xmin", x(g["xmin"])).withField("xmax", x(g["xmax"])).withField("ymin", y(g["ymin"])).withField("ymax", y(g["ymax"]))
