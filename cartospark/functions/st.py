"""Geometry columns and ST functions.

A geometry column is the struct GEOM.  Its bounds are always there, so filters and joins prune on plain doubles that reach
the Parquet scan.  Points and boxes (kind ENVELOPE) are their bounds and carry no bytes: everything about them is a native
expression.  Other kinds carry WKB in `shape` and are opened by Arrow UDFs over the kernel only where bounds can't answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry as G

FIELDS = ["kind", "srid", "xmin", "ymin", "xmax", "ymax", "shape"]
GEOM = T.StructType([T.StructField(n, t) for n, t in zip(FIELDS, [T.StringType(), T.IntegerType(), *[T.DoubleType()] * 4, T.BinaryType()])])
STRING, BINARY, INT, LONG, DOUBLE, BOOLEAN = T.StringType(), T.BinaryType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# --- constructors (native) --------------------------------------------------------------------------


def _geom(kind: str, srid, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    values = [F.lit(kind), _lit(srid).cast("int"), x1.cast("double"), y1.cast("double"), x2.cast("double"), y2.cast("double"), F.lit(None).cast("binary")]
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS)])


def st_point(x, y, srid=G.DEFAULT_SRID) -> Column:
    """A point; empty (null bounds) if a coordinate is null or NaN."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    ok = ~(F.isnan(x) | F.isnan(y) | x.isNull() | y.isNull())
    x, y = F.when(ok, x), F.when(ok, y)
    return _geom("POINT", srid, x, y, x, y)


def st_createpointz(x, y, z, srid=G.DEFAULT_SRID) -> Column:
    """The kernel is planar: z stands beside the geometry, (geom, z)."""
    return F.struct(st_point(x, y, srid).alias("geom"), _col(z).cast("double").alias("z"))


def st_createpointm(x, y, m, srid=G.DEFAULT_SRID) -> Column:
    return F.struct(st_point(x, y, srid).alias("geom"), _col(m).cast("double").alias("m"))


def st_createpointzm(x, y, z, m, srid=G.DEFAULT_SRID) -> Column:
    return F.struct(st_point(x, y, srid).alias("geom"), _col(z).cast("double").alias("z"), _col(m).cast("double").alias("m"))


def st_makebox(x1, y1, x2, y2, srid=G.DEFAULT_SRID) -> Column:
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    return _geom("ENVELOPE", srid, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def st_createenvelopen(*mins_then_maxes) -> Column:
    """struct<min array<double>, max array<double>> of an even number of values."""
    if len(mins_then_maxes) % 2:
        raise ValueError("an envelope needs as many maxima as minima")
    n, v = len(mins_then_maxes) // 2, [_col(c).cast("double") for c in mins_then_maxes]
    return F.struct(F.array(*v[:n]).alias("min"), F.array(*v[n:]).alias("max"))


# --- accessors (native) -----------------------------------------------------------------------------


def st_xmin(g) -> Column:
    return _col(g)["xmin"]


def st_ymin(g) -> Column:
    return _col(g)["ymin"]


def st_xmax(g) -> Column:
    return _col(g)["xmax"]


def st_ymax(g) -> Column:
    return _col(g)["ymax"]


def st_srid(g) -> Column:
    return _col(g)["srid"]


def st_mbr(g) -> Column:
    """The bounds as a plain struct; null if empty."""
    g = _col(g)
    return F.when(g["xmin"].isNotNull(), F.struct(*[g[c].alias(c) for c in FIELDS[2:6]]))


def st_geometrytype(g) -> Column:
    return _col(g)["kind"]


def st_isempty(g) -> Column:
    return F.when(_col(g).isNotNull(), _col(g)["xmin"].isNull())


def st_dimension(g) -> Column:
    kind = _col(g)["kind"]
    return F.when(kind.isin("POINT", "MULTIPOINT"), 0).when(kind.isin("LINESTRING", "MULTILINESTRING"), 1).when(kind.isin("POLYGON", "MULTIPOLYGON", "ENVELOPE"), 2).when(kind.isNotNull(), _dimension(_col(g)))


def st_envelopeintersects(a, b) -> Column:
    """Whether two closed bounds meet; takes geometries or st_mbr structs."""
    a, b = _col(a), _col(b)
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def st_extent(*geoms) -> Column:
    """Bounds of all arguments as a box; empty ones don't count."""
    g = [_col(x) for x in geoms]
    pick = lambda f, n: f(*[x[n] for x in g]) if len(g) > 1 else g[0][n]
    return _geom("ENVELOPE", g[0]["srid"], pick(F.least, "xmin"), pick(F.least, "ymin"), pick(F.greatest, "xmax"), pick(F.greatest, "ymax"))


def st_extent_agg(g) -> Column:
    """Bounds of a group as a box (an aggregate)."""
    g = _col(g)
    return _geom("ENVELOPE", F.first(g["srid"]), F.min(g["xmin"]), F.min(g["ymin"]), F.max(g["xmax"]), F.max(g["ymax"]))


def envelope_contains_point(e, x, y) -> Column:
    """Half-open: minima belong, maxima don't."""
    e, x, y = _col(e), _col(x), _col(y)
    return (x >= e["xmin"]) & (x < e["xmax"]) & (y >= e["ymin"]) & (y < e["ymax"])


# --- kernel calls (Arrow) ---------------------------------------------------------------------------


def decode(kind, srid, xmin, ymin, xmax, ymax, shape) -> G.Geom | None:
    """A kernel geometry from a row's fields."""
    if kind is None or kind != kind:
        return None
    srid = G.DEFAULT_SRID if srid is None or srid != srid else int(srid)
    if shape is not None:
        return G.from_wkb(bytes(shape), srid)
    if xmin is None or xmin != xmin:
        return G.Geom("POINT", None, srid) if kind == "POINT" else G.empty(srid)
    return G.point(xmin, ymin, srid) if kind == "POINT" else G.box(xmin, ymin, xmax, ymax, srid)


def encode(g: G.Geom | None) -> tuple:
    if g is None:
        return (None,) * 7
    b = g.bounds() or (None,) * 4
    return (g.kind, g.srid, *b, None if g.kind == "POINT" else G.to_wkb(g))


def frame(geoms: list[G.Geom | None]) -> pd.DataFrame:
    return pd.DataFrame([encode(g) for g in geoms], columns=FIELDS).astype({"srid": "Int32"})


def geoms(df: pd.DataFrame) -> list[G.Geom | None]:
    return [decode(*row) for row in zip(*(df[c] for c in FIELDS))]


def _safe(f: Callable) -> Callable:
    def run(*args):
        if any(a is None for a in args):
            return None
        try:
            return f(*args)
        except (ValueError, IndexError, ZeroDivisionError):
            return None

    return run


def rings_of(g: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vertices (rows, n, 2)) of the polygons of one ring, those with equally many vertices together."""
    groups: dict[int, list[int]] = {}
    for i, (kind, raw) in enumerate(zip(g["kind"], g["shape"])):
        if kind == "POLYGON" and raw is not None and len(raw) > 13 and len(raw) % 16 == 13 and raw[0] == 1 and raw[5] == 1 and not any(raw[6:9]):
            groups.setdefault(len(raw), []).append(i)
    out = []
    for size, rows in groups.items():
        raw = g["shape"].to_numpy()
        data = np.frombuffer(b"".join([bytes(raw[i]) for i in rows]), np.uint8).reshape(len(rows), size)
        out.append((np.array(rows), np.ascontiguousarray(data[:, 13:]).view("<f8").reshape(len(rows), -1, 2)))
    return out


def _ring_areas(r: np.ndarray) -> np.ndarray:
    x, y = r[..., 0] - r[:, :1, 0], r[..., 1] - r[:, :1, 1]
    return (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1) / 2


def _ring_lengths(r: np.ndarray) -> np.ndarray:
    return np.hypot(*np.moveaxis(np.diff(r, axis=1), -1, 0)).sum(axis=1)


def unary(f: Callable[[G.Geom], object], returns: T.DataType, of_rings: Callable[[np.ndarray], np.ndarray] | None = None):
    """An Arrow UDF of one geometry column; of_rings answers for all polygons of one ring with equally many vertices together."""
    f = _safe(f)
    if of_rings is not None and returns != GEOM:

        @F.pandas_udf(returns)
        def together(g: pd.DataFrame) -> pd.Series:
            out = np.full(len(g), None, object)
            rest = np.ones(len(g), bool)
            for rows, vertices in rings_of(g):
                out[rows], rest[rows] = of_rings(vertices), False
            rest = np.flatnonzero(rest & g["kind"].notna().to_numpy())
            for i, x in zip(rest.tolist(), geoms(g.iloc[rest])):
                out[i] = f(x)
            return pd.Series(out, dtype=object)

        return together
    if returns == GEOM:

        @F.pandas_udf(GEOM)
        def run(g: pd.DataFrame) -> pd.DataFrame:
            return frame([f(x) for x in geoms(g)])
    else:

        @F.pandas_udf(returns)
        def run(g: pd.DataFrame) -> pd.Series:
            return pd.Series([f(x) for x in geoms(g)], dtype=object)

    return run


def binary(f: Callable[[G.Geom, G.Geom], object], returns: T.DataType):
    """An Arrow UDF of two geometry columns."""
    f = _safe(f)
    if returns == GEOM:

        @F.pandas_udf(GEOM)
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return frame([f(x, y) for x, y in zip(geoms(a), geoms(b))])
    else:

        @F.pandas_udf(returns)
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(geoms(a), geoms(b))], dtype=object)

    return run


_LIST = T.ArrayType(GEOM)


def _rows(gs: list[G.Geom]) -> list[dict]:
    return [dict(zip(FIELDS, encode(g))) for g in gs]


def lists(f: Callable[[G.Geom], list[G.Geom]]):
    """An Arrow UDF from a geometry to an array of geometries."""
    f = _safe(f)

    @F.pandas_udf(_LIST)
    def run(g: pd.DataFrame) -> pd.Series:
        return pd.Series([None if (out := f(x)) is None else _rows(out) for x in geoms(g)], dtype=object)

    return run


@F.pandas_udf(GEOM)
def st_fromwkt(text: pd.Series) -> pd.DataFrame:
    """Null where the text isn't WKT."""
    parse = _safe(G.from_wkt)
    return frame([parse(t) for t in text])


@F.pandas_udf(GEOM)
def st_fromwkb(data: pd.Series) -> pd.DataFrame:
    """Null where the bytes aren't WKB."""

    def parse(b):
        try:
            return G.from_wkb(bytes(b))
        except Exception:  # noqa: BLE001  any broken bytes
            return None

    return frame([None if b is None else parse(b) for b in data])


st_astext = unary(G.to_wkt, STRING)
st_towkb = unary(G.to_wkb, BINARY)
_dimension = unary(lambda g: g.dimension, INT)


def _polyline(coords: list[float]) -> G.Geom:
    if len(coords) % 2:
        raise ValueError("a coordinate is missing")
    return G.line(coords)


def _ring(coords: list[float]) -> G.Geom:
    g = _polyline(coords)
    if len(g.data) < 4 or tuple(g.data[0]) != tuple(g.data[-1]):
        raise ValueError("a ring is closed")
    return G.polygon([g.data])


def _line_polygon(coords: list[float], ids=None, pos=None) -> G.Geom:
    """Points in the order of pos; closed (by ids, else by coordinates) means polygon; two points or fewer a point, three a line."""
    pts = G.line(coords).data
    ids = list(range(len(pts))) if ids is None else list(ids)
    closed_by_id = len(ids) and len(set(ids)) < len(ids)
    if pos is not None:
        order = sorted(range(len(pts)), key=lambda i: pos[i])
        pts, ids = pts[order], [ids[i] for i in order]
    if len(pts) <= 2:
        return G.Geom("POINT", pts[0] if len(pts) else None)
    closed = ids[0] == ids[-1] if closed_by_id else tuple(pts[0]) == tuple(pts[-1])
    return G.polygon([pts]) if closed and len(pts) > 3 else G.line(pts)


def _from_arrays(f: Callable):
    f = _safe(f)

    @F.pandas_udf(GEOM)
    def run(coords: pd.Series) -> pd.DataFrame:
        return frame([f(list(c)) if c is not None else None for c in coords])

    return run


st_createline = _from_arrays(_polyline)


@F.pandas_udf(GEOM)
def st_createpolygon(coords: pd.Series) -> pd.DataFrame:
    """A polygon from x, y, x, y ... of a closed ring; null where that isn't one. Rings of equal size are encoded together."""
    out: dict[str, np.ndarray] = {c: np.full(len(coords), None, object) for c in FIELDS}
    sizes: dict[int, list[int]] = {}
    for i, c in enumerate(coords):
        if c is not None and len(c) >= 8 and len(c) % 2 == 0:
            sizes.setdefault(len(c), []).append(i)
    for size, rows in sizes.items():
        try:
            v = np.array([coords.iloc[i] for i in rows], float).reshape(len(rows), -1, 2)
        except (TypeError, ValueError):  # a null coordinate
            v = np.array([[np.nan if x is None else x for x in coords.iloc[i]] for i in rows], float).reshape(len(rows), -1, 2)
        closed = (v[:, 0] == v[:, -1]).all(axis=1) & ~np.isnan(v).any(axis=(1, 2))
        rows, v = np.array(rows)[closed], np.ascontiguousarray(v[closed], "<f8")
        if not len(rows):
            continue
        head = b"\x01" + np.array([3, 1, size // 2], "<u4").tobytes()
        low, high = v.min(axis=1), v.max(axis=1)
        out["kind"][rows], out["srid"][rows] = "POLYGON", G.DEFAULT_SRID
        for name, value in zip(FIELDS[2:6], (low[:, 0], low[:, 1], high[:, 0], high[:, 1])):
            out[name][rows] = value
        out["shape"][rows] = np.array([head + x.tobytes() for x in v] + [None], object)[:-1]
    return pd.DataFrame(out).astype({"srid": "Int32", **{c: float for c in FIELDS[2:6]}})


@F.pandas_udf(GEOM)
def _st_createlinepolygon(coords: pd.Series, ids: pd.Series, pos: pd.Series) -> pd.DataFrame:
    f = _safe(_line_polygon)
    return frame([None if c is None else _line_polygon(list(c), i, p) if i is not None or p is not None else f(list(c)) for c, i, p in zip(coords, ids, pos)])


def st_createlinepolygon(coords, ids=None, pos=None) -> Column:
    none = F.lit(None).cast("array<long>")
    return _st_createlinepolygon(_col(coords), none if ids is None else _col(ids), none if pos is None else _col(pos))


@F.pandas_udf(GEOM)
def st_connect(first_ids: pd.Series, last_ids: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """Lines (WKT strings) joined end to end by the ids of their ends."""
    return frame([None if x is None else G.connect_lines(list(a), list(b), [G.from_wkt(t) for t in x]) for a, b, x in zip(first_ids, last_ids, lines)])


def _others(g: Column) -> Column:
    """The geometry where it's neither a point nor a box, which the kernel needn't see."""
    return F.when(~g["kind"].isin("POINT", "ENVELOPE"), g)


def _measure(f: Callable[[G.Geom], object], returns: T.DataType, of_point, of_box: Callable[[Column], Column], of_rings: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable:
    """Native for points and boxes, together for polygons of one ring. Plans over columns known to hold only points and boxes should call the native form."""
    call = unary(f, returns, of_rings)

    def run(g, simple: bool = False) -> Column:
        g = _col(g)
        native = F.when(g["kind"] == "POINT", F.lit(of_point)).when(g["kind"] == "ENVELOPE", of_box(g))
        return native.cast(returns) if simple else F.coalesce(native.cast(returns), call(_others(g)))

    return run


_width = lambda g: g["xmax"] - g["xmin"]
_height = lambda g: g["ymax"] - g["ymin"]

st_area = _measure(lambda g: g.area, DOUBLE, 0.0, lambda g: _width(g) * _height(g), lambda r: np.abs(_ring_areas(r)))
st_length = _measure(lambda g: g.length, DOUBLE, 0.0, lambda g: 2 * (_width(g) + _height(g)), _ring_lengths)
st_numpoints = _measure(lambda g: g.n_points, INT, 1, lambda g: F.lit(5), lambda r: np.full(len(r), r.shape[1]))
st_numgeometries = _measure(lambda g: len(g.parts), INT, 1, lambda g: F.lit(1))
st_boundarydimension = _measure(lambda g: G.boundary(g).dimension, INT, -1, lambda g: F.lit(1))
st_isvalid = unary(G.is_valid, BOOLEAN)
st_issimple = unary(G.is_simple, BOOLEAN)
st_isrectangle = unary(G.is_rectangle, BOOLEAN)
st_convexhull = unary(G.convex_hull, GEOM)
st_boundary = unary(G.boundary, GEOM)
st_norm = unary(G.normalize, GEOM)
st_reverse = unary(G.reverse, GEOM)
st_envelope = unary(G.envelope, GEOM)
st_breakline = lists(lambda g: [G.line(g.coords()[i : i + 2]) for i in range(g.n_points - 1)] if g.n_points > 1 else None)
st_geometries = lists(lambda g: g.parts)
st_splitatdateline = lists(G.split_at_date_line)


def st_centroid(g, simple: bool = False) -> Column:
    """Of boxes and points native; `simple` says that there are no others."""
    g = _col(g)
    middle = st_point((g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2, g["srid"])
    return middle if simple else F.when(g["kind"].isin("POINT", "ENVELOPE"), middle).otherwise(_centroid(_others(g)))


@F.pandas_udf(GEOM)
def _centroid(g: pd.DataFrame) -> pd.DataFrame:
    rest = np.ones(len(g), bool)
    found: list[G.Geom | None] = [None] * len(g)
    for rows, r in rings_of(g):
        area = _ring_areas(r)
        ok = area != 0
        base, v = r[ok, :1], r[ok] - r[ok, :1]
        cross = v[:, :-1, 0] * v[:, 1:, 1] - v[:, 1:, 0] * v[:, :-1, 1]
        middle = base[:, 0] + ((v[:, :-1] + v[:, 1:]) * cross[..., None]).sum(axis=1) / (6 * area[ok])[:, None]
        for i, srid, (x, y) in zip(rows[ok].tolist(), g["srid"].to_numpy()[rows[ok]], middle.tolist()):
            found[i] = G.point(x, y, int(srid))
        rest[rows[ok]] = False
    f, rest = _safe(G.centroid), np.flatnonzero(rest)
    for i, x in zip(rest.tolist(), geoms(g.iloc[rest])):
        found[i] = f(x)
    return frame(found)


def st_geometryn(g, n) -> Column:
    """Part n, counted from 0."""
    return F.get(st_geometries(_col(g)), _lit(n))


def st_quadsplit(g, threshold: int) -> Column:
    """Array of parts of at most so many vertices."""
    return lists(lambda x: G.quad_split(x, threshold))(_col(g))


def st_adaptivesplit(g, threshold: int, parts: int = 256) -> Column:
    """As st_quadsplit, with a higher threshold for geometries that would fall into more than `parts` parts."""
    return lists(lambda x: G.quad_split(x, max(x.n_points // parts, threshold)))(_col(g))


def st_buffer(g, radius: float, quadrant: int = 8) -> Column:
    return unary(lambda x: G.buffer(x, radius, quadrant), GEOM)(_col(g))


def st_voronoi(g) -> Column:
    return unary(G.voronoi, GEOM)(_col(g))


def st_concavity(g) -> Column:
    """(hull area - area) / area."""
    return unary(lambda x: (G.convex_hull(x).area - x.area) / x.area, DOUBLE)(_col(g))


def st_regularpolygon(x, y, radius: float, sides: int) -> Column:
    p = st_point(x, y)
    return unary(lambda g: G.regular_polygon(*g.data, radius, sides), GEOM)(p)


def _inside_box(shape: G.Geom, x1: float, y1: float, x2: float, y2: float) -> bool:
    b = shape.bounds()
    return b is not None and b[0] >= x1 and b[1] >= y1 and b[2] <= x2 and b[3] <= y2


@F.pandas_udf(GEOM)
def _intersection(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The kernel's answer; a polygon within the other side's box is its own. Equal pairs of shapes in a batch are computed once."""
    out, known = [], {}
    cut = _safe(lambda x, y: G.overlay(x, y, "intersection"))
    for row in zip(*(a[c] for c in FIELDS), *(b[c] for c in FIELDS)):
        if row[0] is None or row[7] is None:
            out.append(None)
            continue
        key = row[2:7] + row[9:]
        if key not in known:
            x, y = decode(*row[:7]), decode(*row[7:])
            if row[7] == "ENVELOPE" and row[0] in ("POLYGON", "MULTIPOLYGON") and _inside_box(x, *row[9:13]):
                known[key] = x
            elif row[0] == "ENVELOPE" and row[7] in ("POLYGON", "MULTIPOLYGON") and _inside_box(y, *row[2:6]):
                known[key] = y
            else:
                known[key] = cut(x, y)
        out.append(known[key])
    return frame(out)


def st_intersection(a, b, simple: bool = False) -> Column:
    """Native where two boxes share an area; `simple` says that there's nothing else but points and boxes that meet in points or not at all."""
    a, b = _col(a), _col(b)
    x1, y1, x2, y2 = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])
    boxes = (a["kind"] == "ENVELOPE") & (b["kind"] == "ENVELOPE") & (x1 < x2) & (y1 < y2)
    native = _geom("ENVELOPE", a["srid"], x1, y1, x2, y2)
    if simple:
        return F.when(boxes, native)
    rest = F.coalesce(~boxes, F.lit(True))
    return F.when(boxes, native).otherwise(_intersection(F.when(rest, a), F.when(rest, b)))


st_union = binary(lambda a, b: G.overlay(a, b, "union"), GEOM)
st_difference = binary(lambda a, b: G.overlay(a, b, "difference"), GEOM)
st_symdifference = binary(lambda a, b: G.overlay(a, b, "symdifference"), GEOM)


@F.pandas_udf(GEOM)
def st_union_agg(g: pd.DataFrame) -> pd.DataFrame:  # a scalar form over arrays is st_unionlist
    return frame([None if x is None else G.union_all([x]) for x in geoms(g)])


@F.pandas_udf(GEOM)
def st_unionlist(gs: pd.Series) -> pd.DataFrame:
    """Union of an array of geometries."""
    return frame([None if x is None else G.union_all([decode(*(r[c] for c in FIELDS)) for r in x]) for x in gs])


# --- predicates -------------------------------------------------------------------------------------

PREDICATES: dict[str, Callable[[G.Geom, G.Geom], bool]] = {
    "intersects": G.intersects, "mbrintersects": G.mbr_intersects, "contains": G.contains, "within": G.within, "covers": G.covers, "coveredby": G.covered_by,
    "touches": G.touches, "overlaps": G.overlaps, "crosses": G.crosses, "equals": G.equals, "disjoint": G.disjoint,
    "orderingequals": lambda a, b: a.kind == b.kind and a.coords().shape == b.coords().shape and bool((a.coords() == b.coords()).all()),
}
#: The predicate that says the same with sides swapped.
INVERSE = {"contains": "within", "within": "contains", "covers": "coveredby", "coveredby": "covers"}

#: For a point against another shape, by where the point lies (inside, border): of the point, and of the shape.
_OF_POINT = {"intersects": (True, True), "within": (True, False), "coveredby": (True, True), "touches": (False, True)}
_OF_SHAPE = {"intersects": (True, True), "contains": (True, False), "covers": (True, True), "touches": (False, True)}


def _located(points: pd.DataFrame, shapes: pd.DataFrame, rows: np.ndarray, truth: tuple[bool, bool], out: np.ndarray) -> None:
    """Judges rows of points against shapes: each distinct shape is opened once and takes all its points together."""
    groups: dict[bytes, list[int]] = {}
    for i, raw in zip(rows.tolist(), shapes["shape"].to_numpy()[rows]):
        groups.setdefault(bytes(raw), []).append(i)
    xy = points[["xmin", "ymin"]].to_numpy(float)
    table = np.array([*truth, False])  # inside, border, outside
    for raw, own in groups.items():
        g = G.from_wkb(raw)
        out[own] = table[G.locate(xy[own], g, 8 * G.tolerance(g))] if not g.is_empty else False


def predicate_udf(name: str, f: Callable[[G.Geom, G.Geom], bool]):
    """The exact predicate over Arrow batches."""
    f = _safe(f)

    @F.pandas_udf(BOOLEAN)
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = np.full(len(a), None, object)
        point = lambda d: (d["kind"] == "POINT").to_numpy() & d["xmin"].notna().to_numpy()
        flat = lambda d: d["kind"].isin(["POLYGON", "MULTIPOLYGON"]).to_numpy() & d["shape"].notna().to_numpy()
        pa_, pb, sa, sb = point(a), point(b), flat(a), flat(b)
        if name in _OF_POINT:
            _located(a, b, np.flatnonzero(pa_ & sb), _OF_POINT[name], out)
        if name in _OF_SHAPE:
            _located(b, a, np.flatnonzero(pb & sa), _OF_SHAPE[name], out)
        rest = np.flatnonzero([x is None for x in out])
        for i, x, y in zip(rest.tolist(), geoms(a.iloc[rest]), geoms(b.iloc[rest])):
            out[i] = f(x, y)
        return pd.Series(out, dtype=object)

    return run


_exact = {name: predicate_udf(name, f) for name, f in PREDICATES.items()}


def native_predicate(name: str, a: Column, b: Column) -> Column:
    """The predicate over columns that hold only points and boxes of positive width and height."""
    meet = st_envelopeintersects(a, b)
    pa, pb = a["kind"] == "POINT", b["kind"] == "POINT"
    inner = (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])
    same = (a["xmin"] == b["xmin"]) & (a["xmax"] == b["xmax"]) & (a["ymin"] == b["ymin"]) & (a["ymax"] == b["ymax"])
    holds = (a["xmin"] <= b["xmin"]) & (b["xmax"] <= a["xmax"]) & (a["ymin"] <= b["ymin"]) & (b["ymax"] <= a["ymax"])
    held = (b["xmin"] <= a["xmin"]) & (a["xmax"] <= b["xmax"]) & (b["ymin"] <= a["ymin"]) & (a["ymax"] <= b["ymax"])
    return {
        "intersects": meet, "mbrintersects": meet, "disjoint": ~meet, "equals": same, "covers": holds, "coveredby": held,
        "contains": holds & (pa | inner), "within": held & (pb | inner),
        "touches": meet & ~inner & ~(pa & pb), "overlaps": inner & ~holds & ~held, "crosses": F.lit(False), "orderingequals": same,
    }[name]


def st_predicate(name: str, a, b, simple: bool = False) -> Column:
    """Bounds first, then the exact test; `simple` columns hold only points and boxes."""
    a, b = _col(a), _col(b)
    if simple:
        return native_predicate(name, a, b)
    if name == "disjoint":
        return ~F.coalesce(st_envelopeintersects(a, b) & _exact["intersects"](a, b), F.lit(False))
    return st_envelopeintersects(a, b) & _exact[name](a, b)


def _named(name: str) -> Callable:
    def run(a, b, simple: bool = False) -> Column:
        return st_predicate(name, a, b, simple)

    run.__name__ = f"st_{name}"
    return run


st_intersects, st_contains, st_within, st_disjoint, st_overlaps = map(_named, ("intersects", "contains", "within", "disjoint", "overlaps"))
st_covers, st_coveredby, st_crosses, st_touches, st_equals = map(_named, ("covers", "coveredby", "crosses", "touches", "equals"))


def st_distance(a, b, simple: bool = False) -> Column:
    """Planar distance; native between bounds of points and boxes."""
    a, b = _col(a), _col(b)
    if not simple:
        return binary(G.distance, DOUBLE)(a, b)
    gap = lambda lo, hi: F.greatest(F.lit(0.0), a[lo] - b[hi], b[lo] - a[hi])
    dx, dy = gap("xmin", "xmax"), gap("ymin", "ymax")
    return F.sqrt(dx * dx + dy * dy)


def st_withindistance(a, b, distance: float, simple: bool = False) -> Column:
    a, b = _col(a), _col(b)
    near = (a["xmin"] - distance <= b["xmax"]) & (b["xmin"] - distance <= a["xmax"]) & (a["ymin"] - distance <= b["ymax"]) & (b["ymin"] - distance <= a["ymax"])
    return near & (st_distance(a, b, simple) <= distance)


# --- columnar encoding ------------------------------------------------------------------------------

PART = T.StructType([T.StructField("geomtype", INT), *[T.StructField(n, T.ArrayType(DOUBLE)) for n in ("xs", "ys", "zs", "ms")]])
SPATIAL_PARQUET = T.StructType([T.StructField("srid", INT), T.StructField("subgeometries", T.ArrayType(PART))])
_CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}


@F.pandas_udf(SPATIAL_PARQUET)
def st_tospatialparquet(g: pd.DataFrame) -> pd.DataFrame:
    """Collections become lists of points, lines and polygons; a polygon's rings follow each other."""
    out = []
    for x in geoms(g):
        if x is None:
            out.append((None, None))
            continue
        parts = []
        for s in x.simple():
            c = s.coords()
            parts.append({"geomtype": _CODES[s.kind], "xs": c[:, 0].tolist(), "ys": c[:, 1].tolist(), "zs": [], "ms": []})
        out.append((x.srid, parts))
    return pd.DataFrame(out, columns=["srid", "subgeometries"]).astype({"srid": "Int32"})


@F.pandas_udf(GEOM)
def st_fromspatialparquet(s: pd.DataFrame) -> pd.DataFrame:
    """Rings end where a vertex repeats the ring's first one; several parts of a kind are a multi-geometry."""
    out = []
    for srid, parts in zip(s["srid"], s["subgeometries"]):
        if parts is None:
            out.append(None)
            continue
        found = []
        for p in parts:
            pts = list(zip(p["xs"], p["ys"]))
            if p["geomtype"] == 1:
                found += [G.point(*q, srid) for q in pts]
            elif p["geomtype"] == 2:
                found.append(G.line(pts, srid))
            else:
                rings, start = [], 0
                for i, q in enumerate(pts):
                    if i > start and q == pts[start]:
                        rings.append(pts[start : i + 1])
                        start = i + 1
                found.append(G.polygon(rings, srid))
        out.append(G.collect(found, int(srid)) if found else G.empty(int(srid)))
    return frame(out)


def storage_size(g, dims: int = 2) -> Column:
    """Bytes that a geometry counts for in size policies: 64 + 8 a coordinate, boxes 64 + 16 a dimension."""
    g = _col(g)
    return F.when(g["kind"] == "ENVELOPE", 64 + 16 * dims).when(g["kind"] == "POINT", 64 + 8 * dims).when(g["kind"].isNotNull(), _storage(g)).cast("long")


def _stored(x: G.Geom) -> int:
    extra = sum(4 * len(s.data) for s in x.simple() if s.kind == "POLYGON") + (4 * len(x.parts) if x.parts != [x] else 0)
    return 64 + 16 * x.n_points + extra


_storage = unary(_stored, LONG)
