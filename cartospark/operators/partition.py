"""Spatial partitioners and Parquet-backed spatial indexes.

A partitioner turns a bounded sample of centres into a list of cells, a table of at most a few thousand rows; assigning records
to cells is then a native expression.  Disjoint cells cover the plane (outer cells reach to infinity) and take copies
of every record that they meet; others take each record once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .synopses import Grid, grid_of, point_sample, summary_columns

INF = math.inf
SAMPLE = 10_000


@dataclass
class Cells:
    """Cells (id, xmin, ymin, xmax, ymax). `splits`, for disjoint ones: a tree of cuts (axis, value, below, above) or an id."""

    bounds: list[tuple[int, float, float, float, float]]
    disjoint: bool
    splits: object = None
    keys: list[int] = field(default_factory=list)  # of curve cells: where each cell's range of keys begins
    curve: object = None

    def home(self, x: Column, y: Column) -> Column:
        """The one cell of a point: cuts hold values below them, half-open."""
        if self.curve is not None:
            return self.curve.cell(x, y, self.keys)
        return _descend(self.splits, x, y)


def _descend(tree, x: Column, y: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(int(tree))
    axis, cut, below, above = tree
    return F.when((x if axis == 0 else y) < F.lit(float(cut)), _descend(below, x, y)).otherwise(_descend(above, x, y))


def _cover(tree, g: Column, grow: float) -> Column:
    """Array of the cells that the bounds meet."""
    if not isinstance(tree, tuple):
        return F.array(F.lit(int(tree)))
    axis, cut, below, above = tree
    lo, hi = (g["xmin"], g["xmax"]) if axis == 0 else (g["ymin"], g["ymax"])
    none = F.array().cast("array<int>")
    low = F.when(lo - grow < float(cut), _cover(below, g, grow)).otherwise(none)
    high = F.when(hi + grow >= float(cut), _cover(above, g, grow)).otherwise(none)
    return F.concat(low, high)


def covering_cells(g: Column, cells: Cells, grow: float = 0.0) -> Column:
    """All cells that a record's bounds meet; no cell for empty ones."""
    if not cells.disjoint:
        raise ValueError("records have copies in disjoint cells only")
    return F.when(g["xmin"].isNotNull(), _cover(cells.splits, g, grow)).otherwise(F.array().cast("array<int>"))


def best_cell(g: Column, cells: Cells) -> Column:
    """The single cell of a record: that of its centre, or for given boxes the one that grows least (then the smaller area, then the id)."""
    x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    if cells.splits is not None or cells.curve is not None:
        return cells.home(x, y)
    options = []
    for i, x1, y1, x2, y2 in cells.bounds:
        w, h = F.greatest(g["xmax"], F.lit(x2)) - F.least(g["xmin"], F.lit(x1)), F.greatest(g["ymax"], F.lit(y2)) - F.least(g["ymin"], F.lit(y1))
        area = (x2 - x1) * (y2 - y1)
        options.append(F.struct((w * h - area).alias("growth"), F.lit(float(area)).alias("area"), F.lit(i).alias("id")))
    return F.array_min(F.array(*options))["id"]


# --- building cells ---------------------------------------------------------------------------------


def _leaves(tree, box: tuple[float, float, float, float]) -> list[tuple[int, float, float, float, float]]:
    if not isinstance(tree, tuple):
        return [(int(tree), *box)]
    axis, cut, below, above = tree
    x1, y1, x2, y2 = box
    left = (x1, y1, cut, y2) if axis == 0 else (x1, y1, x2, cut)
    right = (cut, y1, x2, y2) if axis == 0 else (x1, cut, x2, y2)
    return _leaves(below, left) + _leaves(above, right)


def _of_tree(tree) -> Cells:
    return Cells(sorted(_leaves(tree, (-INF, -INF, INF, INF))), True, tree)


def _halved(values: list[float], first: int, axis: int, make) -> object:
    """A balanced tree of cuts over consecutive parts; make(k) gives part k."""
    if not values:
        return make(first)
    m = len(values) // 2
    return (axis, values[m], _halved(values[:m], first, axis, make), _halved(values[m + 1 :], first + m + 1, axis, make))


def grid_cells(grid: Grid) -> Cells:
    xs = [grid.xmin + (i + 1) * grid.width for i in range(grid.nx - 1)]
    ys = [grid.ymin + (j + 1) * grid.height for j in range(grid.ny - 1)]
    return _of_tree(_halved(ys, 0, 1, lambda j: _halved(xs, 0, 0, lambda i: j * grid.nx + i)))


def kd_cells(points: np.ndarray, n: int) -> Cells:
    """Median cuts, axis by axis, always of the cell with most points."""
    state = {"next": 0}
    nodes: list = [("leaf",)]
    heap = [(0, points, 0)]
    while len(heap) < n:
        k = max(range(len(heap)), key=lambda i: len(heap[i][1]))
        at, pts, axis = heap[k]
        if len(pts) < 2 or (pts[:, axis] == pts[0, axis]).all() and (pts[:, 1 - axis] == pts[0, 1 - axis]).all():
            break
        if (pts[:, axis] == pts[0, axis]).all():
            axis = 1 - axis
        cut = _middle(pts[:, axis])
        low = pts[:, axis] < cut
        nodes += [("leaf",), ("leaf",)]
        nodes[at] = (axis, cut, len(nodes) - 2, len(nodes) - 1)
        heap[k] = (len(nodes) - 2, pts[low], 1 - axis)
        heap.append((len(nodes) - 1, pts[~low], 1 - axis))

    def build(at: int):
        if nodes[at] == ("leaf",):
            state["next"] += 1
            return state["next"] - 1
        axis, cut, lo, hi = nodes[at]
        return (axis, cut, build(lo), build(hi))

    return _of_tree(build(0))


def _middle(v: np.ndarray) -> float:
    """A value that leaves points on either side, near the median."""
    s = np.sort(v)
    cut = s[len(s) // 2]
    return float(cut if cut > s[0] else s[np.searchsorted(s, s[0], "right")])


def str_cells(points: np.ndarray, n: int) -> Cells:
    """Sort-tile: vertical slabs of equal counts, each cut into cells of equal counts."""
    slabs = max(1, math.ceil(math.sqrt(n)))
    xs = _quantiles(points[:, 0], slabs)
    state = {"next": 0}

    def slab(k: int):
        lo, hi = (xs[k - 1] if k else -INF), (xs[k] if k < len(xs) else INF)
        own = points[(points[:, 0] >= lo) & (points[:, 0] < hi)]
        ys = _quantiles(own[:, 1], max(1, round(n / slabs))) if len(own) else []
        first = state["next"]
        state["next"] += len(ys) + 1
        return _halved(ys, first, 1, lambda j: j)

    # slabs are built left to right, so that ids follow
    parts = [slab(k) for k in range(len(xs) + 1)]
    return _of_tree(_halved(xs, 0, 0, lambda k: parts[k]))


def _quantiles(v: np.ndarray, parts: int) -> list[float]:
    s = np.sort(v)
    cuts = [float(s[len(s) * k // parts]) for k in range(1, parts)] if len(s) else []
    return sorted({c for c in cuts if c > s[0]}) if len(s) else []


def grove_cells(points: np.ndarray, n: int, balance: float = 0.45, weights: np.ndarray | None = None, by_area: bool = False) -> Cells:
    """Cuts that keep each side at `balance` of the weight and make the sides' margins (or areas) smallest."""
    weights = np.ones(len(points)) if weights is None else weights
    target = max(1e-300, weights.sum() / max(1, n))
    state = {"next": 0}

    def cut(pts: np.ndarray, w: np.ndarray, parts: int):
        best = None
        if parts > 1 and len(pts) > 1 and w.sum() > target:
            for axis in (0, 1):
                order = np.argsort(pts[:, axis], kind="stable")
                p, total = pts[order], np.cumsum(w[order])
                lo, hi = np.searchsorted(total, total[-1] * balance), np.searchsorted(total, total[-1] * (1 - balance), "right")
                k = np.arange(max(1, int(lo)), min(len(p) - 1, max(int(hi), int(lo) + 1)) + 1)
                k = k[p[k, axis] > p[k - 1, axis]]
                if len(k):  # spans of all points before and from each place on
                    below = np.maximum.accumulate(p, axis=0) - np.minimum.accumulate(p, axis=0)
                    above = (np.maximum.accumulate(p[::-1], axis=0) - np.minimum.accumulate(p[::-1], axis=0))[::-1]
                    cost = below[k - 1].prod(axis=1) + above[k].prod(axis=1) if by_area else below[k - 1].sum(axis=1) + above[k].sum(axis=1)
                    i = int(np.argmin(cost))
                    if best is None or cost[i] < best[0]:
                        best = (float(cost[i]), axis, float(p[k[i], axis]))
        if best is None:
            state["next"] += 1
            return state["next"] - 1
        _, axis, at = best
        low = pts[:, axis] < at
        share = w[low].sum() / w.sum()
        left = min(parts - 1, max(1, round(parts * share)))
        return (axis, at, cut(pts[low], w[low], left), cut(pts[~low], w[~low], parts - left))

    return _of_tree(cut(points, weights, n))


def rtree_cells(points: np.ndarray, n: int, linear: bool = False) -> Cells:
    """Bounds of n groups of near points, from splits that take the worst pair as seeds (linear or quadratic). Not disjoint."""
    groups = [points]
    while len(groups) < n:
        k = max(range(len(groups)), key=lambda i: len(groups[i]))
        g = groups[k]
        if len(np.unique(g, axis=0)) < 2:
            break
        spread = g.max(axis=0) - g.min(axis=0)
        axis = int(np.argmax(spread))
        if linear:
            a, b = g[np.argmin(g[:, axis])], g[np.argmax(g[:, axis])]
        else:
            far = g[np.argmax(((g - g.mean(axis=0)) ** 2).sum(axis=1))]
            a, b = far, g[np.argmax(((g - far) ** 2).sum(axis=1))]
        near = ((g - a) ** 2).sum(axis=1) <= ((g - b) ** 2).sum(axis=1)
        groups[k] = g[near]
        groups.append(g[~near])
    return Cells([(i, *g.min(axis=0).tolist(), *g.max(axis=0).tolist()) for i, g in enumerate(groups) if len(g)], False)


def quad_cells(points: np.ndarray, n: int) -> Cells:
    """A quad tree over the points' bounds: always the cell with most points falls into four at its middle, while there are fewer than n."""
    low, high = points.min(axis=0), points.max(axis=0)
    nodes: list = [None]
    leaves = [(len(points), 0, points, low, high)]
    while len(leaves) + 3 <= max(n, 4):
        leaves.sort(key=lambda x: x[0])
        count, at, pts, lo, hi = leaves.pop()
        if count < 2 or (lo >= hi).all() or len(np.unique(pts, axis=0)) < 2:
            leaves.append((count, at, pts, lo, hi))
            break
        mid = (lo + hi) / 2
        nodes[at] = (float(mid[0]), float(mid[1]), [len(nodes) + k for k in range(4)])
        for k in range(4):
            right, upper = k & 1, k >> 1
            own = ((pts[:, 0] >= mid[0]) == bool(right)) & ((pts[:, 1] >= mid[1]) == bool(upper))
            nodes.append(None)
            leaves.append((int(own.sum()), len(nodes) - 1, pts[own], np.where([right, upper], mid, lo), np.where([right, upper], hi, mid)))
    state = {"next": 0}

    def build(at: int):
        if nodes[at] is None:
            state["next"] += 1
            return state["next"] - 1
        x, y, kids = nodes[at]
        return (1, y, (0, x, build(kids[0]), build(kids[1])), (0, x, build(kids[2]), build(kids[3])))

    return _of_tree(build(0))


def rstar_cells(points: np.ndarray, n: int, revised: bool = False, fill: float = 0.4) -> Cells:
    """Bounds of n groups from splits along the axis of least margins, where the two sides' boxes overlap least, then cover least.

    revised: a split's cost is weighed by how far it is from even, so that even ones win among nearly equal ones.  Not disjoint.
    """
    groups = [points]
    while len(groups) < n:
        k = max(range(len(groups)), key=lambda i: len(groups[i]))
        g = groups[k]
        if len(np.unique(g, axis=0)) < 2:
            break
        best = None
        for axis in (0, 1):
            p = g[np.lexsort((g[:, 1 - axis], g[:, axis]))]
            low, high = np.minimum.accumulate(p, axis=0), np.maximum.accumulate(p, axis=0)
            low2, high2 = np.minimum.accumulate(p[::-1], axis=0)[::-1], np.maximum.accumulate(p[::-1], axis=0)[::-1]
            least = max(1, int(fill * len(p)))
            at = np.arange(least, max(least + 1, len(p) - least + 1))
            at = at[at < len(p)]
            a, b = high[at - 1] - low[at - 1], high2[at] - low2[at]
            shared = np.maximum(0, np.minimum(high[at - 1], high2[at]) - np.maximum(low[at - 1], low2[at])).prod(axis=1)
            cost = shared + 1e-9 * (a.prod(axis=1) + b.prod(axis=1))
            if revised:
                cost = (cost + 1e-9 * (a.sum(axis=1) + b.sum(axis=1))) * (1 + (2 * at / len(p) - 1) ** 2)
            i = int(np.argmin(cost))
            margin = float((a.sum(axis=1) + b.sum(axis=1)).sum())
            if best is None or margin < best[0]:
                best = (margin, p[: at[i]], p[at[i] :])
        groups[k] = best[1]
        groups.append(best[2])
    return Cells([(i, *g.min(axis=0).tolist(), *g.max(axis=0).tolist()) for i, g in enumerate(groups) if len(g)], False)


# --- curves -------------------------------------------------------------------------------------------

CURVE_BITS = 16


def _spread_bits(v: Column) -> Column:
    """Bits of a 16-bit number moved to the even places."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_key(col: Column, row: Column) -> Column:
    """Place on the Z-order curve of 16-bit cell numbers."""
    return _spread_bits(col).bitwiseOR(F.shiftleft(_spread_bits(row), 1))


def hilbert_key(col: Column, row: Column, bits: int = CURVE_BITS) -> Column:
    """Place on the Hilbert curve, as one fold over the bits from the highest."""
    start = F.struct(col.cast("long").alias("x"), row.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = acc["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1)), F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), d.alias("d"))

    sides = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])
    return F.aggregate(sides, start, step, lambda acc: acc["d"])


@dataclass(frozen=True)
class Curve:
    """A space-filling curve over bounds."""

    grid: Grid
    hilbert: bool

    def key(self, x: Column, y: Column) -> Column:
        return (hilbert_key if self.hilbert else z_key)(self.grid.column(x), self.grid.row(y))

    def cell(self, x: Column, y: Column, starts: list[int]) -> Column:
        """Number of ranges that begin at or before the key, less one."""
        return F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= self.key(x, y))) - 1


def curve_cells(df: DataFrame, n: int, hilbert: bool, geom: str = "geom", sample: int = SAMPLE, seed: int = 0) -> Cells:
    """Ranges of equal counts along a curve, from a bounded sample."""
    base = grid_of(df, 1, geom)
    if base is None:
        return _of_tree(0)
    curve = Curve(Grid(base.xmin, base.ymin, base.xmax, base.ymax, 1 << CURVE_BITS, 1 << CURVE_BITS), hilbert)
    keys = sorted(r.k for r in point_sample(df, sample, seed, geom).select(curve.key(F.col("x"), F.col("y")).alias("k")).collect())  # the sample
    starts = sorted({0, *(keys[len(keys) * i // n] for i in range(1, n))})
    return Cells([(i, base.xmin, base.ymin, base.xmax, base.ymax) for i in range(len(starts))], False, keys=starts, curve=curve)


# --- facade -------------------------------------------------------------------------------------------

PARTITIONERS = ("grid", "kdtree", "str", "rsgrove", "rrsgrove", "rgrove", "rtreebb", "rstreebb", "rrstreebb", "zcurve", "hcurve", "quadtree")


def make_cells(df: DataFrame, partitioner: str, n: int, geom: str = "geom", sample: int = SAMPLE, seed: int = 0) -> Cells:
    """Cells of a registered partitioner for the data, about n of them, from its bounds and a bounded sample."""
    if partitioner not in PARTITIONERS:
        raise ValueError(f"unknown partitioner {partitioner!r}; one of {', '.join(PARTITIONERS)}")
    if n <= 1:
        return _of_tree(0)
    if partitioner in ("zcurve", "hcurve"):
        return curve_cells(df, n, partitioner == "hcurve", geom, sample, seed)
    if partitioner == "grid":
        grid = grid_of(df, n, geom)
        return grid_cells(grid) if grid else _of_tree(0)
    points = np.array([(r.x, r.y) for r in point_sample(df, sample, seed, geom).collect()]).reshape(-1, 2)  # the sample
    if not len(points):
        return _of_tree(0)
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    if partitioner == "kdtree":
        return kd_cells(points, n)
    if partitioner == "str":
        return str_cells(points, n)
    if partitioner in ("rsgrove", "rrsgrove"):
        return grove_cells(points, n, by_area=partitioner == "rrsgrove")
    if partitioner == "quadtree":
        return quad_cells(points, n)
    if partitioner in ("rstreebb", "rrstreebb"):
        return rstar_cells(points, n, revised=partitioner == "rrstreebb")
    return rtree_cells(points, n, linear=partitioner == "rtreebb")


def given_cells(boxes: list[tuple[float, float, float, float]]) -> Cells:
    """Any boxes as cells; a record goes to the one that grows least."""
    return Cells([(i, *map(float, b)) for i, b in enumerate(boxes)], False)


def partition_count(policy: str, summary_row) -> int:
    """Partitions of a policy string: fixed(n), count(n), pnum(n) or size(n, k/m/g), the last three per partition."""
    import re

    m = re.fullmatch(r"(fixed|count|pnum|size)\((\d+)([kmg]?)\)", policy.strip().lower())
    if not m:
        raise ValueError("fixed(n), count(n), pnum(n) or size(n[k|m|g])")
    kind, n, unit = m[1], int(m[2]), {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[m[3]]
    total = {"fixed": None, "count": summary_row.num_features, "pnum": summary_row.num_points, "size": summary_row.size}[kind]
    return max(1, n if total is None else -(-total // (n * unit)))


def spatial_partition(df: DataFrame, cells: Cells, geom: str = "geom", replicate: bool | None = None) -> DataFrame:
    """df with cell_id, shuffled by it; disjoint cells take copies unless replicate is False."""
    g = F.col(geom)
    copies = cells.disjoint if replicate is None else replicate
    cell = F.explode(covering_cells(g, cells)) if copies else best_cell(g, cells)
    return df.withColumn("cell_id", cell).repartition("cell_id")


def without_copies(df: DataFrame, cells: Cells, geom: str = "geom") -> DataFrame:
    """Rows of a replicated dataset in their home cells only: that of the bounds' smaller corner."""
    g = F.col(geom)
    return df.where(F.col("cell_id") == cells.home(g["xmin"], g["ymin"]))


# --- index on disk ------------------------------------------------------------------------------------


def write_index(df: DataFrame, path: str, cells: Cells, geom: str = "geom", simple: bool = False) -> None:
    """Parquet by cell under path/data, rows in curve order within a file, and one manifest row a cell under path/manifest."""
    placed = spatial_partition(df, cells, geom)
    g = F.col(geom)
    placed.sortWithinPartitions("cell_id", g["xmin"], g["ymin"]).write.partitionBy("cell_id").mode("error").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    manifest = written.groupBy("cell_id").agg(*summary_columns(F.col(geom), simple))
    shape = df.sparkSession.createDataFrame([(i, x1, y1, x2, y2) for i, x1, y1, x2, y2 in cells.bounds], "cell_id int, cell_xmin double, cell_ymin double, cell_xmax double, cell_ymax double")
    manifest.join(F.broadcast(shape), "cell_id").coalesce(1).write.parquet(f"{path}/manifest")  # the cell table


def read_index(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, cells: Cells | None = None, geom: str = "geom") -> DataFrame:
    """The indexed rows. With bounds, only cells whose rows may meet them are read; with the cells, copies are dropped."""
    df = spark.read.parquet(f"{path}/data")
    if bounds is not None:
        x1, y1, x2, y2 = bounds
        g = F.col(geom)
        hit = read_manifest(spark, path).where((F.col("xmin") <= x2) & (F.col("xmax") >= x1) & (F.col("ymin") <= y2) & (F.col("ymax") >= y1))
        ids = [r.cell_id for r in hit.select("cell_id").collect()]  # the cell table
        df = df.where(F.col("cell_id").isin(ids) if ids else F.lit(False)).where((g["xmin"] <= x2) & (g["xmax"] >= x1) & (g["ymin"] <= y2) & (g["ymax"] >= y1))
    return without_copies(df, cells, geom) if cells is not None and cells.disjoint else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")
