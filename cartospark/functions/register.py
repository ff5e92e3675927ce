"""SQL names of the functions. Native ones become SQL functions that Catalyst inlines; kernel ones are Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import st

_G = "STRUCT<kind: STRING, srid: INT, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, shape: BINARY>"
_E = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"


def _made(kind: str, x1: str, y1: str, x2: str, y2: str, srid: str = "4326") -> str:
    return f"named_struct('kind', '{kind}', 'srid', {srid}, 'xmin', {x1}, 'ymin', {y1}, 'xmax', {x2}, 'ymax', {y2}, 'shape', CAST(NULL AS BINARY))"


_MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"

#: name: (parameters, result type, body)
NATIVE = {
    "ST_CreatePoint": ("x DOUBLE, y DOUBLE", _G, _made("POINT", "nanvl(x, NULL)", "nanvl(y, NULL)", "nanvl(x, NULL)", "nanvl(y, NULL)")),
    "ST_CreatePointZ": ("x DOUBLE, y DOUBLE, z DOUBLE", f"STRUCT<geom: {_G}, z: DOUBLE>", f"named_struct('geom', {_made('POINT', 'x', 'y', 'x', 'y')}, 'z', z)"),
    "ST_CreatePointM": ("x DOUBLE, y DOUBLE, m DOUBLE", f"STRUCT<geom: {_G}, m: DOUBLE>", f"named_struct('geom', {_made('POINT', 'x', 'y', 'x', 'y')}, 'm', m)"),
    "ST_CreatePointZM": ("x DOUBLE, y DOUBLE, z DOUBLE, m DOUBLE", f"STRUCT<geom: {_G}, z: DOUBLE, m: DOUBLE>", f"named_struct('geom', {_made('POINT', 'x', 'y', 'x', 'y')}, 'z', z, 'm', m)"),
    "ST_CreateBox": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", _G, _made("ENVELOPE", "least(x1, x2)", "least(y1, y2)", "greatest(x1, x2)", "greatest(y1, y2)")),
    "ST_CreateEnvelopeN": ("v ARRAY<DOUBLE>", "STRUCT<min: ARRAY<DOUBLE>, max: ARRAY<DOUBLE>>", "named_struct('min', slice(v, 1, size(v) DIV 2), 'max', slice(v, size(v) DIV 2 + 1, size(v) DIV 2))"),
    "ST_Extent": (f"g ARRAY<{_G}>", _G, _made("ENVELOPE", *[f"array_{f}(transform(g, x -> x.{c}))" for f, c in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))])),
    "ST_MBR": (f"g {_G}", _E, "if(g.xmin IS NULL, NULL, named_struct('xmin', g.xmin, 'ymin', g.ymin, 'xmax', g.xmax, 'ymax', g.ymax))"),
    "ST_EnvelopeIntersects": (f"a {_E}, b {_E}", "BOOLEAN", _MEET),
    "ST_XMin": (f"g {_G}", "DOUBLE", "g.xmin"),
    "ST_YMin": (f"g {_G}", "DOUBLE", "g.ymin"),
    "ST_XMax": (f"g {_G}", "DOUBLE", "g.xmax"),
    "ST_YMax": (f"g {_G}", "DOUBLE", "g.ymax"),
    "ST_GeometryType": (f"g {_G}", "STRING", "g.kind"),
    "ST_IsEmpty": (f"g {_G}", "BOOLEAN", "if(g IS NULL, NULL, g.xmin IS NULL)"),
    "ST_WithinDistance": (f"a {_G}, b {_G}, d DOUBLE", "BOOLEAN", "a.xmin - d <= b.xmax AND b.xmin - d <= a.xmax AND a.ymin - d <= b.ymax AND b.ymin - d <= a.ymax AND ST_Distance(a, b) <= d"),
}


def _udfs() -> dict[str, object]:
    from . import geometry as G

    out = {
        "ST_FromWKT": st.st_fromwkt, "ST_FromWKB": st.st_fromwkb, "ST_ToWKB": st.st_towkb, "ST_AsText": st.st_astext, "ST_CreateLine": st.st_createline, "ST_CreatePolygon": st.st_createpolygon,
        "ST_CreateLinePolygon": st._st_createlinepolygon, "ST_Connect": st.st_connect, "ST_BreakLine": st.st_breakline, "ST_ToSpatialParquet": st.st_tospatialparquet, "ST_FromSpatialParquet": st.st_fromspatialparquet,
        "ST_Area": st.unary(lambda g: g.area, st.DOUBLE), "ST_Length": st.unary(lambda g: g.length, st.DOUBLE), "ST_NumPoints": st.unary(lambda g: g.n_points, st.INT), "ST_NumGeometries": st.unary(lambda g: len(g.parts), st.INT),
        "ST_Dimension": st._dimension, "ST_BoundaryDimension": st.unary(lambda g: G.boundary(g).dimension, st.INT), "ST_Geometries": st.st_geometries, "ST_SRID": st.unary(lambda g: g.srid, st.INT), "ST_ConvexHull": st.st_convexhull, "ST_Envelope": st.st_envelope,
        "ST_Boundary": st.st_boundary, "ST_Norm": st.st_norm, "ST_Reverse": st.st_reverse, "ST_Centroid": st._centroid, "ST_IsValid": st.st_isvalid, "ST_IsSimple": st.st_issimple, "ST_IsRectangle": st.st_isrectangle,
        "ST_Intersection": st.st_intersection, "ST_Union": st.st_union, "ST_Difference": st.st_difference, "ST_SymDifference": st.st_symdifference, "ST_Distance": st.binary(G.distance, st.DOUBLE),
    }
    for name, f in st.PREDICATES.items():
        out["ST_" + {"mbrintersects": "MBRIntersects", "coveredby": "CoveredBy"}.get(name, name.capitalize())] = st.binary(f, st.BOOLEAN)
    return out


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to spark.sql; returns their names. ST_GeometryN counts from 0."""
    udfs = _udfs()
    for name, f in udfs.items():
        spark.udf.register(name, f)
    for name, (parameters, kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ST_GeometryN(g {_G}, n INT) RETURNS {_G} RETURN get(ST_Geometries(g), n)")
    return sorted([*udfs, *NATIVE, "ST_GeometryN"])
