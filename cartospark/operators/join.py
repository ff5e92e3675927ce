"""Spatial joins.

One template serves every partitioned algorithm: rows are replicated to the integer cells that their bounds cover, cells
meet in an equi-join that Catalyst shuffles (and AQE splits where a cell is hot), and a pair counts only in the
cell of its reference point, the larger of the two minima.  The cell function is monotone and the same on both
sides, so every pair appears exactly once, without a distinct.  Strategies differ in where the cells come from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.st import INVERSE, PREDICATES, st_predicate, st_withindistance
from .partition import Cells, covering_cells
from .store import Folder, written
from .synopses import Grid, near_square

class JoinMetrics:
    """Counts of one join: rows of either side, pairs whose bounds meet, pairs of the result. The last two are known once the result has been
    computed; each partition's counts are added by Spark's own observation."""

    def __init__(self):
        self.left_count = self.right_count = 0
        self._met, self._found = Observation(), Observation()

    @property
    def mbr_count(self) -> int:
        return self._met.get["n"]

    @property
    def result_count(self) -> int:
        return self._found.get["n"]


METHODS = ("auto", "bnlj", "broadcast", "inlj", "pbsm", "sjmr", "sj1d", "dj", "repj")
#: A side is broadcast behind both checks, of its rows and of its bytes (shapes included).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: bnlj compares so many pairs of rows at most; beyond, it is pbsm.
NESTED_PAIRS = 1 << 32
#: Rows of equal geometries are joined as one in sides of at most so many rows, as gathering them shuffles the side, and in larger sides of
#: MANY_ROWS for each geometry or more; a list holds about LIST_ROWS.
GATHER_ROWS = 5_000_000
MANY_ROWS = 8
LIST_ROWS = 4096


@dataclass(frozen=True)
class Side:
    """What planning knows of one input."""

    rows: int
    xmin: float | None
    ymin: float | None
    xmax: float | None
    ymax: float | None
    mean_width: float
    mean_height: float
    simple: bool  # only points and boxes of positive width and height
    bytes: int = 0
    distinct: int = 0  # geometries, about

    @property
    def repeated(self) -> bool:
        return 2 * self.rows > 3 * self.distinct if self.rows <= GATHER_ROWS else self.rows >= MANY_ROWS * self.distinct

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def measure(df: DataFrame, geom: str) -> Side:
    """One aggregation over the bounds."""
    g = F.col(geom)
    flat = (g["kind"] == "POINT") | ((g["kind"] == "ENVELOPE") & (g["xmin"] < g["xmax"]) & (g["ymin"] < g["ymax"]))
    r = df.agg(
        F.count(F.lit(1)), F.min(g["xmin"]), F.min(g["ymin"]), F.max(g["xmax"]), F.max(g["ymax"]),
        F.coalesce(F.avg(g["xmax"] - g["xmin"]), F.lit(0.0)), F.coalesce(F.avg(g["ymax"] - g["ymin"]), F.lit(0.0)), F.coalesce(F.min(flat | g["xmin"].isNull()), F.lit(True)),
        F.coalesce(F.sum(F.coalesce(F.octet_length(g["shape"]), F.lit(0)) + 80), F.lit(0)), F.approx_count_distinct(F.xxhash64(g)),
    ).first()
    return Side(*r)


def _renamed(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clashing names get the prefixes l_ and r_."""
    both = set(left.columns) & set(right.columns)
    return (left.select(*[F.col(f"`{c}`").alias(f"l_{c}" if c in both else c) for c in left.columns]), right.select(*[F.col(f"`{c}`").alias(f"r_{c}" if c in both else c) for c in right.columns]))


def _shared(a: Side, b: Side, grow: float) -> tuple[float, float, float, float] | None:
    if a.xmin is None or b.xmin is None:
        return None
    x1, y1 = max(a.xmin, b.xmin - grow), max(a.ymin, b.ymin - grow)
    x2, y2 = min(a.xmax, b.xmax + grow), min(a.ymax, b.ymax + grow)
    return (x1, y1, x2, y2) if x1 <= x2 and y1 <= y2 else None


def join_grid(a: Side, b: Side, parallelism: int, strips: bool = False, grow: float = 0.0) -> Grid | None:
    """Cells over the area that both sides share: a few for each task, and none much smaller than the records."""
    area = _shared(a, b, grow)
    if area is None:
        return None
    x1, y1, x2, y2 = area
    cells = max(parallelism * 4, min(1 << 20, (a.rows + b.rows) // 2000))
    nx, ny = (1, cells) if strips else near_square(x2 - x1, y2 - y1, cells)
    fit = lambda n, size, mean: n if not mean else max(1, min(n, int(size / (mean + grow)) or 1))
    nx, ny = fit(nx, x2 - x1, max(a.mean_width, b.mean_width)), fit(ny, y2 - y1, max(a.mean_height, b.mean_height))
    if strips:  # a strip is swept along x, in steps
        nx = fit(cells // ny, x2 - x1, max(a.mean_width, b.mean_width))
    return Grid(x1, y1, x2, y2, nx, ny)


def choose_method(a: Side, b: Side, parallelism: int, left_cells=None, right_cells=None) -> str:
    """dj if both sides are partitioned; broadcast if a side's checked size allows; repj if one side is partitioned; else pbsm."""
    if left_cells is not None and right_cells is not None:
        return "dj"
    if a.small or b.small:
        return "broadcast"
    if left_cells is not None or right_cells is not None:
        return "repj"
    return "pbsm"


def _cell_range(g: Column, grid: Grid, grow: float = 0.0) -> Column:
    cols = F.sequence(grid.column(g["xmin"] - grow), grid.column(g["xmax"] + grow))
    rows = F.sequence(grid.row(g["ymin"] - grow), grid.row(g["ymax"] + grow))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: r * grid.nx + c)))


def _bounds_meet(a: Column, b: Column, grow: float) -> Column:
    return (a["xmin"] - grow <= b["xmax"]) & (b["xmin"] - grow <= a["xmax"]) & (a["ymin"] - grow <= b["ymax"]) & (b["ymin"] - grow <= a["ymax"])


def _grid_pairs(left: DataFrame, right: DataFrame, a: Column, b: Column, grid: Grid, grow: float, send: str | None = None) -> DataFrame:
    """Pairs whose bounds meet, each once. `grow` widens the left side by a distance; `send` names a side to broadcast, by cell."""
    box = F.struct(*[F.lit(float(v)).alias(n) for v, n in ((grid.xmin, "xmin"), (grid.ymin, "ymin"), (grid.xmax, "xmax"), (grid.ymax, "ymax"))])
    l = left.where(_bounds_meet(a, box, grow)).withColumn("__cell", F.explode(_cell_range(a, grid, grow)))
    r = right.where(_bounds_meet(b, box, 0.0)).withColumn("__rcell", F.explode(_cell_range(b, grid)))
    home = grid.cell(F.greatest(a["xmin"] - grow, b["xmin"]), F.greatest(a["ymin"] - grow, b["ymin"]))
    l, r = (F.broadcast(l) if send == "left" else l), (F.broadcast(r) if send == "right" else r)  # behind the caller's check
    return l.join(r, F.col("__cell") == F.col("__rcell")).where(_bounds_meet(a, b, grow) & (F.col("__cell") == home)).drop("__cell", "__rcell")


def _cells_pairs(left: DataFrame, right: DataFrame, a: Column, b: Column, l_cells: Cells, r_cells: Cells, grow: float) -> DataFrame:
    """Pairs over two sets of disjoint cells: two cells that meet are the join key, so a crowded cell is spread over its partners;
    the reference point's cells dedupe."""
    spark = left.sparkSession
    both = []
    for i, x1, y1, x2, y2 in l_cells.bounds:
        both += [(i, j, x1, y1, x2, y2, u1, v1, u2, v2) for j, u1, v1, u2, v2 in r_cells.bounds if x1 < u2 and u1 < x2 and y1 < v2 and v1 < y2]
    sides = [f"{s}{c}" for s in "lr" for c in ("x1", "y1", "x2", "y2")]
    meet = spark.createDataFrame(both, "lc int, rc int, " + ", ".join(f"{c} double" for c in sides))

    def placed(df: DataFrame, g: Column, cells: Cells, own: str, key: str, wide: float) -> DataFrame:
        rows = df.withColumn(key, F.explode(covering_cells(g, cells, wide)))
        pairs = meet.select(F.col(own).alias(f"{key}own"), *[F.col(c).alias(f"{key}{c}") for c in ("lc", "rc", *sides)])
        inside = lambda s: (g["xmin"] - wide < F.col(f"{key}{s}x2")) & (g["xmax"] + wide >= F.col(f"{key}{s}x1")) & (g["ymin"] - wide < F.col(f"{key}{s}y2")) & (g["ymax"] + wide >= F.col(f"{key}{s}y1"))
        return rows.join(F.broadcast(pairs), F.col(key) == F.col(f"{key}own")).where(inside("l") & inside("r"))  # the cells' table

    l, r = placed(left, a, l_cells, "lc", "__l", grow), placed(right, b, r_cells, "rc", "__r", 0.0)
    x, y = F.greatest(a["xmin"] - grow, b["xmin"]), F.greatest(a["ymin"] - grow, b["ymin"])
    in_cell = lambda s: (x >= F.col(f"__l{s}x1")) & (x < F.col(f"__l{s}x2")) & (y >= F.col(f"__l{s}y1")) & (y < F.col(f"__l{s}y2"))
    joined = l.join(r.drop(*[f"__r{c}" for c in sides]), (F.col("__llc") == F.col("__rlc")) & (F.col("__lrc") == F.col("__rrc")))
    home = in_cell("l") & in_cell("r")  # cells are half-open and tile the plane
    extra = [c for c in joined.columns if c in {f"__{k}{n}" for k in "lr" for n in ("", "own", "lc", "rc", *sides)}]
    return joined.where(_bounds_meet(a, b, grow) & home).drop(*extra)


def gathered(df: DataFrame, geom: str, name: str) -> DataFrame:
    """(geom, name): a row for the rows of equal geometries, their other columns in a list, or in several of about LIST_ROWS."""
    most = df.groupBy(F.col(geom)).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // LIST_ROWS) or 1
    rest = [F.col(f"`{c}`") for c in df.columns if c != geom]
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("__part")  # hashed: equal geometries may come in step
    rows = df.select(F.col(f"`{geom}`").alias(geom), F.struct(*rest, F.lit(0).alias("__one")).alias("__row"), part)
    tasks = (4 if parts == 1 else 16) * df.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(tasks, geom, "__part")  # by number: few bytes may stand for many pairs, and long lists for more
    return rows.groupBy(geom, "__part").agg(F.collect_list("__row").alias(name)).drop("__part")  # about LIST_ROWS at most


def spread(pairs: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The pairs of rows from pairs of lists of rows. Generated code holds all that comes of one of its input rows, which would be the product of
    the lists: a higher-order function isn't generated, so rows leave the first list one by one, and a list's rows are held at most."""
    for name in names:
        rows = F.col(name) if name == names[-1] else F.transform(name, lambda row: row)
        pairs = pairs.select(*[f"`{c}`" for c in pairs.columns if c != name], F.inline(rows)).drop("__one")
    return pairs.select(*[f"`{c}`" for c in columns])


def spatial_join(
    left: DataFrame, right: DataFrame, predicate: str = "intersects", method: str = "auto", left_geom: str = "geom", right_geom: str = "geom", how: str = "inner",
    distance: float | None = None, grid: Grid | None = None, left_cells: Cells | None = None, right_cells: Cells | None = None, keep_geometry: tuple[bool, bool] = (True, True),
    metrics: JoinMetrics | None = None,
) -> DataFrame:
    """Pairs of rows whose geometries satisfy the predicate, each once; clashing columns are named l_ and r_.

    predicate: one of PREDICATES, or 'withindistance' with a distance.  method: one of METHODS; dj and repj take disjoint
    cells; broadcast (inlj is another name) sends the smaller side, indexed by cell, if both its checks allow, and is pbsm otherwise, as bnlj
    is beyond NESTED_PAIRS.  Rows of equal geometries are compared as one.  how: inner, left (unmatched left rows with nulls), semi or anti.  Empty and null geometries match nothing
    (but are disjoint from everything: 'disjoint' is the cross product less the intersecting pairs).
    """
    if predicate not in PREDICATES and predicate != "withindistance":
        raise ValueError(f"unknown predicate {predicate!r}; one of {', '.join([*PREDICATES, 'withindistance'])}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if how != "inner":
        return _outer(left, right, how, predicate, method, left_geom, right_geom, distance, grid, left_cells, right_cells, keep_geometry)
    both = set(left.columns) & set(right.columns)
    lg, rg = (f"l_{left_geom}" if left_geom in both else left_geom), (f"r_{right_geom}" if right_geom in both else right_geom)
    if predicate == "disjoint":
        simple = measure(left, left_geom).simple and measure(right, right_geom).simple
        left, right = _renamed(left, right)
        a, b = F.col(f"`{lg}`"), F.col(f"`{rg}`")
        meet = F.coalesce(_bounds_meet(a, b, 0.0), F.lit(False))
        apart = left.crossJoin(right).where(~meet)
        if not simple:  # only pairs whose bounds meet are opened
            apart = apart.union(left.join(right, meet).where(st_predicate("disjoint", a, b)))
        return _dropped(apart, lg, rg, keep_geometry)
    s, t = measure(left, left_geom), measure(right, right_geom)
    left, right = _renamed(left, right)
    columns, lists = [*left.columns, *right.columns], []
    if s.repeated and left_cells is None and right_cells is None:
        left, lists = gathered(left, lg, "__lrows"), ["__lrows"]
    if t.repeated and left_cells is None and right_cells is None:
        right, lists = gathered(right, rg, "__rrows"), [*lists, "__rrows"]
    rows = reduce(lambda x, y: x * y, [F.size(c).cast("long") for c in lists], F.lit(1).cast("long"))
    a, b = F.col(f"`{lg}`"), F.col(f"`{rg}`")
    simple, grow = s.simple and t.simple, float(distance or 0.0) if predicate == "withindistance" else 0.0
    parallelism = left.sparkSession.sparkContext.defaultParallelism
    if method == "auto":
        method = choose_method(s, t, parallelism, left_cells, right_cells)
    if method in ("broadcast", "inlj") and not (s.small or t.small) or method == "bnlj" and s.rows * t.rows > NESTED_PAIRS:
        method = "pbsm"
    if method == "bnlj":
        pairs = left.join(right, _bounds_meet(a, b, grow))
    elif method in ("dj", "repj"):
        known = left_cells or right_cells
        if known is None:
            raise ValueError(f"{method} takes left_cells or right_cells")
        pairs = _cells_pairs(left, right, a, b, left_cells or known, right_cells or known, grow)
    else:
        # sent by cell, the small side is an index that every task looks into
        send = None if method not in ("broadcast", "inlj") else "left" if s.small and (not t.small or s.bytes < t.bytes) else "right"
        fine = parallelism if send is None else max(parallelism, min(s.rows, t.rows) // 16)
        grid = grid or join_grid(s, t, fine, strips=method == "sj1d", grow=grow)
        pairs = _grid_pairs(left, right, a, b, grid, grow, send) if grid else left.join(right, F.lit(False))
    if metrics is not None:
        metrics.left_count, metrics.right_count = s.rows, t.rows
        pairs = pairs.observe(metrics._met, F.coalesce(F.sum(rows), F.lit(0)).alias("n"))
    if predicate == "withindistance":
        pairs = pairs.where(st_withindistance(a, b, grow, simple))
    elif predicate not in ("mbrintersects",) and not (simple and predicate == "intersects"):
        pairs = pairs.where(st_predicate(predicate, a, b, simple))
    if metrics is not None:
        pairs = pairs.observe(metrics._found, F.coalesce(F.sum(rows), F.lit(0)).alias("n"))
    return _dropped(spread(pairs, columns, lists), lg, rg, keep_geometry)


def _dropped(pairs: DataFrame, lg: str, rg: str, keep: tuple[bool, bool]) -> DataFrame:
    return pairs.drop(*[c for c, k in ((lg, keep[0]), (rg, keep[1])) if not k])


def _outer(left, right, how, predicate, method, lgeom, rgeom, distance, grid, lcells, rcells, keep) -> DataFrame:
    """The left side is written once with a number for each row, so that both uses of it see the same numbers."""
    if how not in ("left", "semi", "anti"):
        raise ValueError("how: inner, left, semi or anti")
    key = "__row"
    marked = written(left.withColumn(key, F.monotonically_increasing_id()))
    pairs = spatial_join(marked, right, predicate, method, lgeom, rgeom, "inner", distance, grid, lcells, rcells)
    if how in ("semi", "anti"):
        return marked.join(pairs.select(key).distinct(), key, f"left_{how}").drop(key)
    both = set(left.columns) & set(right.columns)
    lonely = marked.join(pairs.select(key).distinct(), key, "left_anti")
    lonely = lonely.select(*[F.col(f"`{c}`").alias(f"l_{c}" if c in both else c) for c in left.columns])
    out = pairs.drop(key).unionByName(lonely, allowMissingColumns=True)
    lg, rg = (f"l_{lgeom}" if lgeom in both else lgeom), (f"r_{rgeom}" if rgeom in both else rgeom)
    return _dropped(out, lg, rg, keep)


def self_join(df: DataFrame, id_col: str, predicate: str = "intersects", geom: str = "geom", method: str = "pbsm", distance: float | None = None, grid: Grid | None = None, keep_geometry: tuple[bool, bool] = (True, True), metrics: JoinMetrics | None = None) -> DataFrame:
    """(l_id, r_id, ...): every unordered pair of different rows once, the smaller id on the left; ids are distinct. metrics count ordered pairs."""
    pairs = spatial_join(df, df, predicate, method, geom, geom, distance=distance, grid=grid, keep_geometry=keep_geometry, metrics=metrics)
    if predicate in INVERSE:
        return pairs.where(F.col(f"l_{id_col}") != F.col(f"r_{id_col}"))
    return pairs.where(F.col(f"l_{id_col}") < F.col(f"r_{id_col}"))


def join_with_splits(left: DataFrame, right: DataFrame, left_id: str, right_id: str, predicate: str = "intersects", threshold: int = 1000, adaptive: bool = False, geom: str = "geom", method: str = "pbsm") -> DataFrame:
    """(left_id, right_id) as spatial_join with 'intersects', complex geometries cut into parts first; each pair once."""
    from ..functions.st import st_adaptivesplit, st_quadsplit

    if predicate != "intersects":
        raise ValueError("only 'intersects' may be judged part by part")
    split = st_adaptivesplit if adaptive else st_quadsplit
    part = lambda df, key, name: df.select(F.col(key).alias(name), F.explode(split(F.col(geom), threshold)).alias("geom"))
    pairs = spatial_join(part(left, left_id, "left_id"), part(right, right_id, "right_id"), predicate, method)
    return pairs.select("left_id", "right_id").distinct()


def multi_way_join(driver: DataFrame, driven: list[tuple[DataFrame, str, str]], driver_id: str, geom: str = "geom", method: str = "auto") -> DataFrame:
    """(driver_id, source, ids): for each driver row and each driven input (frame, id column, predicate) the sorted ids that match."""
    out = []
    for k, (df, key, predicate) in enumerate(driven):
        slim = df.select(F.col(key).alias("driven_id"), F.col(geom).alias("geom"))
        pairs = spatial_join(driver.select(F.col(driver_id).alias("driver_id"), F.col(geom).alias("geom")), slim, predicate, method)
        out.append(pairs.groupBy("driver_id").agg(F.array_sort(F.collect_list("driven_id")).alias("ids")).withColumn("source", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


def range_query(df: DataFrame, query, geom: str = "geom", simple: bool = False, data_srid: int | None = None) -> DataFrame:
    """Rows that meet the query geometry (a kernel Geom). Bounds are plain comparisons that reach the scan; the exact test follows.

    A query in 4326 or 3857 is brought to the data's srid if that differs.
    """
    from ..functions import geometry as G
    from .vector import reproject_geom

    if data_srid is not None and data_srid != query.srid:
        query = reproject_geom(query, data_srid)
    b, g = query.bounds(), F.col(geom)
    if b is None:
        return df.where(F.lit(False))
    rough = df.where((g["xmin"] <= b[2]) & (g["xmax"] >= b[0]) & (g["ymin"] <= b[3]) & (g["ymax"] >= b[1]))
    if simple and G.is_rectangle(query):
        return rough
    from ..functions.st import BOOLEAN, unary

    return rough.where(unary(lambda x: G.intersects(x, query), BOOLEAN)(g))


def plane_sweep(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of boxes (xmin, ymin, xmax, ymax) of two arrays in memory that meet, by a sweep over x."""
    order = {"a": np.argsort(a[:, 0], kind="stable"), "b": np.argsort(b[:, 0], kind="stable")}
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        first_a = a[order["a"][i], 0] <= b[order["b"][j], 0]
        box, rest, others = (a[order["a"][i]], order["b"][j:], b) if first_a else (b[order["b"][j]], order["a"][i:], a)
        near = rest[: np.searchsorted(others[rest, 0], box[2], "right")]
        near = near[(others[near, 1] <= box[3]) & (others[near, 3] >= box[1])]
        out += [(int(order["a"][i]), int(k)) if first_a else (int(k), int(order["b"][j])) for k in near]
        i, j = (i + 1, j) if first_a else (i, j + 1)
    return out


def _near(p: DataFrame, side: float) -> DataFrame:
    """Pairs of points(id, x, y) in the same or neighbouring square cells."""
    at = lambda c: F.floor(F.col(c) / side)
    p = p.withColumns({"cx": at("x"), "cy": at("y")})
    near = p.select("id", "x", "y", F.explode(F.expr("sequence(cx - 1, cx + 1)")).alias("cx"), "cy").select("id", "x", "y", "cx", F.explode(F.expr("sequence(cy - 1, cy + 1)")).alias("cy"))
    return p.alias("l").join(near.alias("r"), ["cx", "cy"]).where("l.id < r.id")


def closest_pairs(df: DataFrame, id_col: str, x: str, y: str, cell: float | None = None, manhattan: bool = True) -> DataFrame:
    """(l_id, r_id, distance) of all pairs of points at the smallest distance; points without coordinates don't count.

    Points that share their place are at distance 0, which one aggregation tells.  Otherwise pairs in the same or neighbouring cells are
    compared, a join on cells; the side of the cells grows until some pair is found, and once more to its distance if that is larger.
    cell: the first side; by default that of cells with a point each.
    """
    p = df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    dx, dy = F.abs(F.col("l.x") - F.col("r.x")), F.abs(F.col("l.y") - F.col("r.y"))
    d = dx + dy if manhattan else F.sqrt(dx * dx + dy * dy)
    named = lambda pairs, d: pairs.select(F.col("l.id").alias("l_id"), F.col("r.id").alias("r_id"), d.alias("distance"))
    shared = p.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not shared.isEmpty():
        same = p.join(shared, ["x", "y"])
        return named(same.alias("l").join(same.alias("r"), ["x", "y"]).where("l.id < r.id"), F.lit(0.0))
    n, x1, y1, x2, y2 = p.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if n < 2:
        return named(p.alias("l").join(p.alias("r"), F.lit(False)), F.lit(0.0))
    wide = max(x2 - x1, y2 - y1)
    side = cell or max(wide / n, ((x2 - x1) * (y2 - y1) / n) ** 0.5)
    while (least := named(_near(p, side), d).agg(F.min("distance")).first()[0]) is None:
        side *= 4
    side = max(side, least)  # a nearer pair may lie across cells that aren't neighbours yet
    pairs = named(_near(p, side), d)
    return pairs.join(F.broadcast(pairs.agg(F.min("distance").alias("least"))), F.col("distance") == F.col("least")).drop("least")  # one row


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, left_geom: str = "geom", right_geom: str = "geom", side: float | None = None) -> DataFrame:
    """(left_id, right_id, distance, rank): the k nearest points of the right side for every point of the left, ties by the right's id.

    A round looks at the cells within a ring of each point's cell and settles the points whose k-th distance lies within the ring; the others
    go on with rings twice as wide, until they cover the right side.  Each round is one join on cells and one ranking by point.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.col(left_geom)["xmin"].alias("x"), F.col(left_geom)["ymin"].alias("y")).where("x is not null")
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_geom)["xmin"].alias("u"), F.col(right_geom)["ymin"].alias("v")).where("u is not null")
    # of points that share a place only the k of the smallest ids can be among the nearest, and places of the left side are looked at once
    b = b.withColumn("nth", F.row_number().over(Window.partitionBy("u", "v").orderBy("right_id"))).where(F.col("nth") <= k).drop("nth")
    n, x1, y1, x2, y2 = b.agg(F.count("*"), F.min("u"), F.min("v"), F.max("u"), F.max("v")).first()
    if not n:
        return a.join(b, F.lit(False)).select("left_id", "right_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    wide = max(x2 - x1, y2 - y1)
    side = side or max(wide / n, ((x2 - x1) * (y2 - y1) * k / n) ** 0.5) or 1.0
    at = lambda c: F.floor((F.least(F.greatest(F.col(c), F.lit(x1)), F.lit(x2)) if c == "x" else F.least(F.greatest(F.col(c), F.lit(y1)), F.lit(y2))) / side)
    out, todo, reach, folder = None, a.select("x", "y").distinct(), 1, Folder(a, "knn")
    b = folder.keep(b, "places")
    while True:
        last = (2 * reach + 1) * side > 2 * wide + 2 * side
        cells = b.withColumns({"cx": F.floor(F.col("u") / (side * reach)), "cy": F.floor(F.col("v") / (side * reach))})
        around = lambda c: F.expr(f"sequence({c} - 1, {c} + 1)")
        clamp = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
        own = todo.withColumns({"cx": F.floor(clamp("x", x1, x2) / (side * reach)), "cy": F.floor(clamp("y", y1, y2) / (side * reach))})
        if last:
            met = own.drop("cx", "cy").crossJoin(F.broadcast(cells.drop("cx", "cy"))) if n <= BROADCAST_ROWS else own.drop("cx", "cy").crossJoin(cells.drop("cx", "cy"))
        else:
            met = own.withColumn("cx", F.explode(around("cx"))).withColumn("cy", F.explode(around("cy"))).join(cells, ["cx", "cy"])
        d = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
        best = F.slice(F.array_sort(F.collect_list(F.struct(d.alias("distance"), F.col("right_id")))), 1, k)
        ranked = met.groupBy("x", "y").agg(best.alias("best"))
        # what lies beyond the neighbouring cells is further than the way to their border
        fx, fy = clamp("x", x1, x2), clamp("y", y1, y2)
        safe = F.lit(float("inf")) if last else F.lit(side * reach) - F.sqrt((F.col("x") - fx) ** 2 + (F.col("y") - fy) ** 2)
        ranked = folder.keep(ranked.withColumn("done", (F.size("best") >= min(k, n)) & (F.element_at("best", -1)["distance"] <= safe) | F.lit(last)), str(reach))
        found = a.join(ranked.where("done"), ["x", "y"]).select("left_id", F.posexplode("best").alias("rank", "b")).select("left_id", "b.right_id", "b.distance", (F.col("rank") + 1).alias("rank"))
        out = found if out is None else out.unionByName(found)
        todo = todo.join(ranked.where("done").select("x", "y"), ["x", "y"], "left_anti")
        if last or todo.isEmpty():
            return out
        reach *= 2
