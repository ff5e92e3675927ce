"""Dataset synopses as native aggregations: summaries, histograms, prefix sums, samples, box counting.

All take a DataFrame and the name of its geometry column (the GEOM struct) and read only the bounds, unless point
counts of general geometries are asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.st import st_numpoints, storage_size


@dataclass(frozen=True)
class Grid:
    """A uniform grid; cells are numbered row by row, x fastest."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    nx: int
    ny: int

    def column(self, x: Column) -> Column:
        """Column of a coordinate, clamped to the grid. Monotone, which the joins' duplicate rule rests on."""
        return _clamped(x, self.xmin, self.xmax, self.nx)

    def row(self, y: Column) -> Column:
        return _clamped(y, self.ymin, self.ymax, self.ny)

    def cell(self, x: Column, y: Column) -> Column:
        return self.row(y) * self.nx + self.column(x)

    def inside(self, x: Column, y: Column) -> Column:
        return (x >= self.xmin) & (x <= self.xmax) & (y >= self.ymin) & (y <= self.ymax)

    @property
    def width(self) -> float:
        return (self.xmax - self.xmin) / self.nx

    @property
    def height(self) -> float:
        return (self.ymax - self.ymin) / self.ny

    def bounds(self) -> list[tuple[int, float, float, float, float]]:
        """(cell, xmin, ymin, xmax, ymax) of every cell."""
        x = [self.xmin + i * (self.xmax - self.xmin) / self.nx for i in range(self.nx)] + [self.xmax]
        y = [self.ymin + j * (self.ymax - self.ymin) / self.ny for j in range(self.ny)] + [self.ymax]
        return [(j * self.nx + i, x[i], y[j], x[i + 1], y[j + 1]) for j in range(self.ny) for i in range(self.nx)]


def _clamped(v: Column, lo: float, hi: float, n: int) -> Column:
    if hi <= lo:
        return F.lit(0).cast("long")
    at = F.floor((v - lo) * n / F.lit(float(hi - lo)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("long")


def near_square(width: float, height: float, cells: int) -> tuple[int, int]:
    """Columns and rows of about so many near-square cells, never more than asked for."""
    if cells <= 1:
        return 1, 1
    if width <= 0 or height <= 0:
        return (cells, 1) if width > 0 else (1, cells)
    nx = min(cells, max(1, round(math.sqrt(cells * width / height))))
    ny = max(1, cells // nx)
    return nx, ny


# --- summaries --------------------------------------------------------------------------------------


def summary_columns(g: Column, simple: bool = True) -> list[Column]:
    """Aggregates of a summary: a null geometry counts as a feature only, an empty one has no bounds."""
    w, h = g["xmax"] - g["xmin"], g["ymax"] - g["ymin"]
    points = st_numpoints(g, simple=simple) if simple else F.coalesce(st_numpoints(g), F.lit(0))
    filled = g["xmin"].isNotNull()
    return [
        F.min(g["xmin"]).alias("xmin"), F.min(g["ymin"]).alias("ymin"), F.max(g["xmax"]).alias("xmax"), F.max(g["ymax"]).alias("ymax"),
        F.count(F.lit(1)).alias("num_features"), F.sum(F.when(filled, 1).otherwise(0)).cast("long").alias("num_nonempty"),
        F.coalesce(F.sum(F.when(filled, points)), F.lit(0)).cast("long").alias("num_points"),
        F.coalesce(F.sum(storage_size(g) if not simple else F.when(g["kind"] == "POINT", 80).when(g["kind"].isNotNull(), 96)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("sum_x"), F.coalesce(F.sum(h), F.lit(0.0)).alias("sum_y"), F.coalesce(F.sum(w * h), F.lit(0.0)).alias("sum_area"),
    ]


def coerced_kind(kinds: Column) -> Column:
    """One dataset type for a set of kinds: the kind itself, its multi-form, or a collection."""
    bare = F.array_distinct(F.transform(F.array_remove(kinds, "ENVELOPE"), lambda k: F.regexp_replace(k, "^MULTI", "")))
    with_box = F.when(F.array_contains(kinds, "ENVELOPE") & (F.size(kinds) > 1), F.array_distinct(F.concat(bare, F.array(F.lit("POLYGON"))))).otherwise(bare)
    multi = F.exists(kinds, lambda k: k.startswith("MULTI"))
    one = F.when(multi, F.concat(F.lit("MULTI"), F.get(with_box, F.lit(0)))).otherwise(F.get(with_box, F.lit(0)))
    return F.when(F.size(kinds) == 0, "EMPTY").when((F.size(kinds) == 1), F.get(kinds, F.lit(0))).when(F.size(with_box) == 1, one).otherwise("GEOMETRYCOLLECTION")


def summary(df: DataFrame, geom: str = "geom", simple: bool = False, by: list[str] | None = None) -> DataFrame:
    """One row: bounds, counts, size, sums of side lengths and areas, dataset type; or one row a group."""
    g = F.col(geom)
    kinds = F.array_sort(F.collect_set(g["kind"]))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*summary_columns(g, simple), coerced_kind(kinds).alias("kind"))


def partition_summary(df: DataFrame, geom: str = "geom", simple: bool = False) -> DataFrame:
    """A summary of every physical partition as it stands."""
    return summary(df.withColumn("partition", F.spark_partition_id()), geom, simple, by=["partition"])


def observed_summary(df: DataFrame, name: str, geom: str = "geom") -> tuple[DataFrame, Observation]:
    """(df, observation): the bounds and counts of the rows that pass through whatever is done with df, without a job of their own."""
    seen, g = Observation(name), F.col(geom)
    bounds = [f(g[c]).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    return df.observe(seen, *bounds, F.count(F.lit(1)).alias("num_features"), F.count(g["xmin"]).alias("num_nonempty")), seen


def summary_from_manifest(manifest: DataFrame) -> DataFrame:
    """The summary of an indexed dataset from its partitions' metadata, without a scan."""
    sums = [F.sum(c).alias(c) for c in ("num_features", "num_nonempty", "num_points", "size", "sum_x", "sum_y", "sum_area")]
    return manifest.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), *sums)


def grid_of(df: DataFrame, cells: int, geom: str = "geom") -> Grid | None:
    """A near-square grid over the data's bounds; None without data. One small job."""
    g = F.col(geom)
    r = df.agg(F.min(g["xmin"]), F.min(g["ymin"]), F.max(g["xmax"]), F.max(g["ymax"])).first()
    if r is None or r[0] is None:
        return None
    return Grid(*r, *near_square(r[2] - r[0], r[3] - r[1], cells))


def gridded_summary(df: DataFrame, grid: Grid, geom: str = "geom", simple: bool = True) -> DataFrame:
    """A summary for each grid cell; a record goes to the cell of its centre, its bounds cut to the cell."""
    g = F.col(geom)
    col, row = grid.column((g["xmin"] + g["xmax"]) / 2), grid.row((g["ymin"] + g["ymax"]) / 2)
    lo = lambda v, at, base, step: F.greatest(v, F.lit(base) + at * step)
    hi = lambda v, at, base, step: F.least(v, F.lit(base) + (at + 1) * step)
    cut = df.where(g["xmin"].isNotNull()).select(col.alias("i0"), row.alias("i1"), g.alias("g")).withColumn(
        "g", F.struct(
            F.col("g.kind").alias("kind"), F.col("g.srid").alias("srid"), lo(F.col("g.xmin"), F.col("i0"), grid.xmin, grid.width).alias("xmin"), lo(F.col("g.ymin"), F.col("i1"), grid.ymin, grid.height).alias("ymin"),
            hi(F.col("g.xmax"), F.col("i0"), grid.xmin, grid.width).alias("xmax"), hi(F.col("g.ymax"), F.col("i1"), grid.ymin, grid.height).alias("ymax"), F.col("g.shape").alias("shape"),
        ),
    )
    return cut.groupBy("i0", "i1").agg(*summary_columns(F.col("g"), simple))


# --- histograms -------------------------------------------------------------------------------------


def uniform_histogram(df: DataFrame, grid: Grid, geom: str = "geom", value: Column | None = None, zeros: bool = False) -> DataFrame:
    """(col, row, value): count, or the sum of `value`, by the cell of the bounds' centre; centres outside the grid are left out."""
    g = F.col(geom)
    x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    found = df.where(grid.inside(x, y)).groupBy(grid.column(x).alias("col"), grid.row(y).alias("row")).agg(total.alias("value"))
    return _with_zeros(found, grid, ["value"]) if zeros else found


def _with_zeros(found: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    cells = found.sparkSession.range(grid.nx * grid.ny).select((F.col("id") % grid.nx).alias("col"), F.floor(F.col("id") / grid.nx).alias("row"))
    return cells.join(found, ["col", "row"], "left").select("col", "row", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def euler_histogram(df: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """(col, row, c1, c2, c3, c4) of cells that an extent covers: all of them, those of its left column, its top row, its corner.

    With these any range of cells counts the extents that meet it exactly (see euler_count).
    """
    g = F.col(geom)
    span = df.where(g["xmin"].isNotNull() & (g["xmax"] >= grid.xmin) & (g["xmin"] <= grid.xmax) & (g["ymax"] >= grid.ymin) & (g["ymin"] <= grid.ymax))
    span = span.select(grid.column(g["xmin"]).alias("a"), grid.column(g["xmax"]).alias("b"), grid.row(g["ymin"]).alias("c"), grid.row(g["ymax"]).alias("d"))
    cells = span.select("*", F.explode(F.sequence("a", "b")).alias("col")).select("*", F.explode(F.sequence("c", "d")).alias("row"))
    left, top = F.col("col") == F.col("a"), F.col("row") == F.col("c")
    one = lambda ok: F.sum(F.when(ok, 1).otherwise(0)).cast("long")
    return cells.groupBy("col", "row").agg(F.count(F.lit(1)).alias("c1"), one(left).alias("c2"), one(top).alias("c3"), one(left & top).alias("c4"))


def euler_count(histogram: DataFrame, col: int, row: int, width: int, height: int) -> DataFrame:
    """How many extents meet the cells col..col+width-1, row..row+height-1: (value)."""
    inside = histogram.where((F.col("col") >= col) & (F.col("col") < col + width) & (F.col("row") >= row) & (F.col("row") < row + height))
    first_col, first_row = F.col("col") == col, F.col("row") == row
    part = F.when(first_col & first_row, F.col("c1")).when(first_row, F.col("c2")).when(first_col, F.col("c3")).otherwise(F.col("c4"))
    return inside.agg(F.coalesce(F.sum(part), F.lit(0)).alias("value"))


def prefix_sums(histogram: DataFrame, value: str = "value") -> DataFrame:
    """Each cell's sum over all cells left of and below it, itself included; over a histogram with zeros. Bounded by the grid."""
    across = F.sum(value).over(Window.partitionBy("row").orderBy("col"))
    up = F.sum("__across").over(Window.partitionBy("col").orderBy("row"))
    return histogram.withColumn("__across", across).withColumn("prefix", up).drop("__across")


def rectangle_sum(prefix: DataFrame, col: int, row: int, width: int, height: int) -> DataFrame:
    """The sum over a rectangle of cells from four prefix sums: (value)."""
    right, top, left, low = col + width - 1, row + height - 1, col - 1, row - 1
    pick = lambda c, r, sign: F.sum(F.when((F.col("col") == c) & (F.col("row") == r), sign * F.col("prefix")).otherwise(0))
    return prefix.agg((pick(right, top, 1) + pick(left, top, -1) + pick(right, low, -1) + pick(left, low, 1)).alias("value"))


def merge_histograms(*histograms: DataFrame) -> DataFrame:
    """Sum of histograms over one grid."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("col", "row").agg(F.sum("value").alias("value"))


def merge_unaligned(histogram: DataFrame, own: Grid, grid: Grid) -> DataFrame:
    """A histogram brought to another grid, each value dealt by overlapping area and cut to whole numbers."""
    x1, y1 = F.lit(own.xmin) + F.col("col") * own.width, F.lit(own.ymin) + F.col("row") * own.height
    x2, y2 = x1 + own.width, y1 + own.height
    spread = histogram.select("value", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    spread = spread.where((F.col("x2") > grid.xmin) & (F.col("x1") < grid.xmax) & (F.col("y2") > grid.ymin) & (F.col("y1") < grid.ymax))
    spread = spread.select("*", F.explode(F.sequence(grid.column(F.col("x1")), grid.column(F.col("x2")))).alias("c")).select("*", F.explode(F.sequence(grid.row(F.col("y1")), grid.row(F.col("y2")))).alias("r"))
    gx, gy = F.lit(grid.xmin) + F.col("c") * grid.width, F.lit(grid.ymin) + F.col("r") * grid.height
    w = F.greatest(F.lit(0.0), F.least(F.col("x2"), gx + grid.width) - F.greatest(F.col("x1"), gx))
    h = F.greatest(F.lit(0.0), F.least(F.col("y2"), gy + grid.height) - F.greatest(F.col("y1"), gy))
    share = F.floor(F.col("value") * w * h / (own.width * own.height) + 1e-9)
    return spread.withColumn("part", share).where("part > 0").groupBy(F.col("c").alias("col"), F.col("r").alias("row")).agg(F.sum("part").alias("value"))


# --- box counting, samples, estimates ------------------------------------------------------------------


def box_counts(df: DataFrame, grid: Grid, levels: int, q: int, geom: str = "geom") -> DataFrame:
    """(level, side, total): sum of (extents that meet a cell)^q over the cells of a 2^level x 2^level grid."""
    g = F.col(geom)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    n = F.pow(F.lit(2.0), F.col("level"))
    at = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) * n / F.lit(float(hi - lo or 1))), F.lit(0)), n.cast("long") - 1)
    rows = df.where(g["xmin"].isNotNull()).select(g.alias("g"), level)
    rows = rows.select("level", F.explode(F.sequence(at(F.col("g.xmin"), grid.xmin, grid.xmax), at(F.col("g.xmax"), grid.xmin, grid.xmax))).alias("c"), "g")
    rows = rows.select("level", "c", F.explode(F.sequence(at(F.col("g.ymin"), grid.ymin, grid.ymax), at(F.col("g.ymax"), grid.ymin, grid.ymax))).alias("r"))
    cells = rows.groupBy("level", "c", "r").agg(F.count(F.lit(1)).alias("v"))
    return cells.groupBy("level").agg(F.sum(F.pow(F.col("v").cast("double"), F.lit(float(q)))).alias("total")).withColumn("side", F.lit(float(max(grid.xmax - grid.xmin, grid.ymax - grid.ymin))) / n)


def box_count_slope(counts: list[tuple[float, float]], tolerance: float = 0.2) -> float:
    """Slope of log total over log side along the longest run of levels whose slopes agree within the tolerance."""
    pts = sorted((math.log(side), math.log(total)) for side, total in counts if side > 0 and total > 0)
    if len(pts) < 2:
        return 0.0
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(pts, pts[1:])]
    best, start = (0, 1), 0
    for i in range(1, len(slopes) + 1):
        if i == len(slopes) or abs(slopes[i] - slopes[i - 1]) > tolerance:
            best = max(best, (start, i), key=lambda r: r[1] - r[0])
            start = i
    run = pts[best[0] : best[1] + 1]
    mx, my = sum(p[0] for p in run) / len(run), sum(p[1] for p in run) / len(run)
    return sum((p[0] - mx) * (p[1] - my) for p in run) / sum((p[0] - mx) ** 2 for p in run)


def point_sample(df: DataFrame, size: int, seed: int = 0, geom: str = "geom", ratio: float = 1.0) -> DataFrame:
    """(x, y): centres of at most `size` records, after a sample of the given ratio. A sampling operator."""
    g = F.col(geom)
    rows = df.where(g["xmin"].isNotNull())
    rows = rows.sample(False, ratio, seed) if ratio < 1 else rows
    return rows.select(((g["xmin"] + g["xmax"]) / 2).alias("x"), ((g["ymin"] + g["ymax"]) / 2).alias("y"), F.rand(seed).alias("__r")).orderBy("__r").limit(size).drop("__r")


def geometry_points(df: DataFrame, geom: str = "geom") -> DataFrame:
    """df with a row for each vertex (x, y); a ring's closing point is left out."""
    import pandas as pd

    from ..functions.st import geoms

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def vertices(g: pd.DataFrame) -> pd.Series:
        out = []
        for x in geoms(g):
            pts: list = []
            for s in x.simple() if x is not None else ():
                for path in [s.data[None]] if s.kind == "POINT" else [s.data] if s.kind == "LINESTRING" else [r[:-1] for r in s.data]:
                    pts += [{"x": float(a), "y": float(b)} for a, b in path]
            out.append(pts)
        return pd.Series(out)

    return df.select("*", F.explode(vertices(F.col(geom))).alias("__p")).select(*df.columns, F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def join_selectivity(left: DataFrame, right: DataFrame) -> float:
    """Estimated share of pairs whose bounds meet, from two one-row summaries."""
    a, b = left.first(), right.first()
    if a is None or b is None or a.xmin is None or b.xmin is None:
        return 0.0
    w, h = min(a.xmax, b.xmax) - max(a.xmin, b.xmin), min(a.ymax, b.ymax) - max(a.ymin, b.ymin)
    if w < 0 or h < 0:
        return 0.0
    side = lambda s, total: total / max(1, s.num_nonempty)
    area1, area2 = (a.xmax - a.xmin) * (a.ymax - a.ymin), (b.xmax - b.xmin) * (b.ymax - b.ymin)
    if not area1 or not area2:
        return 1.0
    return min(1.0, (side(a, a.sum_x) + side(b, b.sum_x)) * (side(a, a.sum_y) + side(b, b.sum_y)) * w * h / (area1 * area2))


def synopsis(df: DataFrame, geom: str = "geom", sample: int = 10_000, buckets: int = 65_536, seed: int = 0, simple: bool = False) -> dict[str, object]:
    """Summary, sample, histogram and the box-counting slopes e0 and e2 of a dataset, as DataFrames and numbers."""
    grid = grid_of(df, buckets, geom)
    out: dict[str, object] = {"summary": summary(df, geom, simple), "sample": point_sample(df, sample, seed, geom), "grid": grid}
    if grid is not None:
        out["histogram"] = uniform_histogram(df, grid, geom)
        for q in (0, 2):
            rows = box_counts(df, grid, 8, q, geom).collect()  # one row a level
            out[f"e{q}"] = box_count_slope([(r.side, r.total) for r in rows])
    return out
