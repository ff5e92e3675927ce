"""Rasters as DataFrames of tiles: (path, tile_id, x0, y0, image_width, image_height, transform, nodata, pixels).

transform is the affine a, b, c, d, e, f from pixels to the model: x = a i + b j + c, y = d i + e j + f.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_to_model(transform: Column, i: Column, j: Column) -> Column:
    t = [F.get(transform, F.lit(k)) for k in range(6)]
    return F.struct((t[0] * i + t[1] * j + t[2]).alias("x"), (t[3] * i + t[4] * j + t[5]).alias("y"))


def model_to_grid(transform: Column, x: Column, y: Column) -> Column:
    a, b, c, d, e, f = (F.get(transform, F.lit(k)) for k in range(6))
    det = a * e - b * d
    return F.struct(((e * (x - c) - b * (y - f)) / det).alias("i"), ((a * (y - f) - d * (x - c)) / det).alias("j"))


def tile_at_pixel(i: Column, j: Column, image_width: Column, tile: int) -> Column:
    return (F.floor(j / tile) * F.ceil(image_width / tile) + F.floor(i / tile)).cast("int")


def tile_count(image_width: Column, image_height: Column, tile: int) -> Column:
    return (F.ceil(image_width / tile) * F.ceil(image_height / tile)).cast("int")


def envelope(rasters: DataFrame) -> DataFrame:
    """(path, xmin, ymin, xmax, ymax): the model extent of every image."""
    corners = [grid_to_model(F.col("transform"), i, j) for i in (F.lit(0), F.col("image_width")) for j in (F.lit(0), F.col("image_height"))]
    pick = lambda f, n: f(*[c[n] for c in corners])
    return metadata(rasters).select("path", pick(F.least, "x").alias("xmin"), pick(F.least, "y").alias("ymin"), pick(F.greatest, "x").alias("xmax"), pick(F.greatest, "y").alias("ymax"))


def metadata(rasters: DataFrame) -> DataFrame:
    """Distinct georeferencing of the dataset's images."""
    return rasters.select("path", "image_width", "image_height", "transform", "nodata").distinct()


def pixels(rasters: DataFrame, samples: int = 1, empty: bool = False) -> DataFrame:
    """(path, i, j, x, y, value(s)): a row a pixel, of its centre; pixels without data are left out unless `empty`."""
    rows = rasters.select("path", "x0", "y0", "transform", "nodata", F.posexplode("pixels").alias("r", "line"))
    width = (F.size("line") / samples).cast("int")
    cells = rows.select("path", "transform", "nodata", "x0", (F.col("y0") + F.col("r")).alias("j"), "line", F.explode(F.sequence(F.lit(0), width - 1)).alias("c"))
    values = [F.get("line", F.col("c") * samples + k) for k in range(samples)]
    at = grid_to_model(F.col("transform"), F.col("x0") + F.col("c") + 0.5, F.col("j") + 0.5)
    named = values[0].alias("value") if samples == 1 else F.array(*values).alias("value")
    out = cells.select("path", (F.col("x0") + F.col("c")).alias("i"), "j", at["x"].alias("x"), at["y"].alias("y"), named, "nodata")
    first = F.col("value") if samples == 1 else F.get("value", F.lit(0))
    return (out if empty else out.where("nodata is null" if samples else "").unionByName(out.where(F.col("nodata").isNotNull() & (first != F.col("nodata"))))).drop("nodata")


def value_at(rasters: DataFrame, points: DataFrame, tile: int, x: str = "x", y: str = "y") -> DataFrame:
    """points with the value of the pixel each lies in, for every image that holds it: an equi-join on the tile."""
    meta = metadata(rasters).drop("nodata")
    at = points.crossJoin(F.broadcast(meta)).withColumn("__g", model_to_grid(F.col("transform"), F.col(x), F.col(y)))  # images, not pixels
    at = at.withColumn("__i", F.floor("__g.i").cast("int")).withColumn("__j", F.floor("__g.j").cast("int"))
    at = at.where("__i >= 0 and __j >= 0 and __i < image_width and __j < image_height").withColumn("tile_id", tile_at_pixel(F.col("__i"), F.col("__j"), F.col("image_width"), tile))
    joined = at.drop("image_width", "image_height", "transform", "__g").join(rasters.select("path", "tile_id", "x0", "y0", "pixels", "nodata"), ["path", "tile_id"])
    value = F.get(F.get("pixels", F.col("__j") - F.col("y0")), F.col("__i") - F.col("x0"))
    return joined.select(*points.columns, "path", F.when(F.col("nodata").isNull() | (value != F.col("nodata")), value).alias("value"))


def rescale(rasters: DataFrame, width: int, height: int) -> DataFrame:
    """(path, i, j, value): every image brought to so many pixels, each the mean of the centres that fall in it."""
    sized = pixels(rasters).join(metadata(rasters).select("path", "image_width", "image_height"), "path")
    i, j = F.floor((F.col("i") + 0.5) * width / F.col("image_width")), F.floor((F.col("j") + 0.5) * height / F.col("image_height"))
    return sized.groupBy("path", i.cast("int").alias("i"), j.cast("int").alias("j")).agg(F.avg("value").alias("value"))


def retile(rasters: DataFrame, tile: int) -> DataFrame:
    """The same images in tiles of another size (one sample a pixel)."""
    p = pixels(rasters.withColumn("nodata", F.lit(None).cast("double")), empty=True).select("path", "i", "j", "value")
    meta = metadata(rasters)
    rows = p.join(meta, "path").withColumn("tile_id", tile_at_pixel(F.col("i"), F.col("j"), F.col("image_width"), tile))
    lines = rows.groupBy("path", "tile_id", "j", "image_width", "image_height", "transform", "nodata").agg(F.min("i").alias("x0"), F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("line"))
    whole = lines.groupBy("path", "tile_id", "x0", "image_width", "image_height", "transform", "nodata").agg(F.min("j").alias("y0"), F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda s: s["line"]).alias("pixels"))
    return whole.select("path", "tile_id", "x0", "y0", "image_width", "image_height", "transform", "nodata", "pixels")
