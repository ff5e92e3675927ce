"""Text formats: CSV with points, boxes or WKT, JSON with WKT, GeoJSON, GPX, KML. Built on Spark's own readers and writers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.st import GEOM, STRING, frame, geoms, st_astext, st_fromwkt, st_makebox, st_point

_SPEC = re.compile(r"^\s*(\w+)\s*(?:\(([^)]*)\))?\s*$")


# --- CSV ------------------------------------------------------------------------------------------------


def _column(df: DataFrame, name: str, case_sensitive: bool = False) -> str:
    """A column by name (blanks round names don't count) or by place."""
    if name.isdigit():
        return df.columns[int(name)]
    fold = (lambda s: s.strip()) if case_sensitive else (lambda s: s.strip().lower())
    for c in df.columns:
        if fold(c) == fold(name):
            return c
    import difflib

    near = difflib.get_close_matches(name, [c.strip() for c in df.columns], 3, 0.5)
    raise ValueError(f"no column {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def read_csv(spark: SparkSession, path, spec: str, separator: str = ",", header: bool = False, quote: str | None = '"', case_sensitive: bool = False, srid: int = G.DEFAULT_SRID) -> DataFrame:
    """CSV whose geometry a spec names: point(x,y), pointk(k,first), envelope(x1,y1,x2,y2), envelopek(k,first), wkt(col) or nogeom.

    Columns are names or places from 0.  Blank, missing and NaN coordinates give an empty point, broken WKT null.  The other
    columns stay strings and `geom` comes first.
    """
    df = spark.read.option("sep", separator).option("header", header).option("quote", quote if quote else "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return with_geometry(df, spec, case_sensitive, srid)


def with_geometry(df: DataFrame, spec: str, case_sensitive: bool = False, srid: int = G.DEFAULT_SRID) -> DataFrame:
    m = _SPEC.match(spec)
    if not m:
        raise ValueError(f"not a geometry spec: {spec!r}")
    kind, args = m[1].lower(), [a.strip() for a in (m[2] or "").split(",") if a.strip()]
    if kind == "nogeom":
        return df
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    if kind in ("pointk", "envelopek"):
        k, first = int(args[0]), df.columns.index(_column(df, args[1], case_sensitive))
        used = df.columns[first : first + k * (2 if kind == "envelopek" else 1)]
        used = used[:2] if kind == "pointk" else [used[0], used[1], used[k], used[k + 1]]
        dropped = df.columns[first : first + k * (2 if kind == "envelopek" else 1)]
        kind = kind[:-1]
    else:
        used = dropped = [_column(df, a, case_sensitive) for a in args]
    if kind == "point":
        geom = st_point(number(used[0]), number(used[1]), srid)
    elif kind == "envelope":
        x1, y1, x2, y2 = (number(c) for c in used)
        whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
        geom = F.when(whole, st_makebox(x1, y1, x2, y2, srid)).otherwise(st_point(F.lit(None), F.lit(None), srid))
    elif kind == "wkt":
        geom = st_fromwkt(F.col(f"`{used[0]}`"))
    else:
        raise ValueError(f"unknown geometry {kind!r}; point, pointk, envelope, envelopek, wkt or nogeom")
    return df.select(geom.alias("geom"), *[F.col(f"`{c}`") for c in df.columns if c not in dropped])


def read_wkt(spark: SparkSession, path, column: str = "0", separator: str = "\t", header: bool = False) -> DataFrame:
    return read_csv(spark, path, f"wkt({column})", separator, header)


def read_csv_points(spark: SparkSession, path, x: str = "0", y: str = "1", separator: str = ",", header: bool = False) -> DataFrame:
    return read_csv(spark, path, f"point({x},{y})", separator, header)


def parse_lines(lines: DataFrame, kind: str, separator: str = ",", column: str = "value") -> DataFrame:
    """Geometries from lines of text: wkt, or xy, xyz, xym, xyzm (values after the second stand beside the geometry)."""
    if kind == "wkt":
        return lines.withColumn("geom", st_fromwkt(F.col(column)))
    if kind not in ("xy", "xyz", "xym", "xyzm"):
        raise ValueError("wkt, xy, xyz, xym or xyzm")
    part = lambda i: F.expr(f"try_cast(trim(get(split({column}, '{re.escape(separator)}'), {i})) as double)")
    return lines.withColumns({"geom": st_point(part(0), part(1))} | {c: part(2 + i) for i, c in enumerate(kind[2:])})


def sniff_csv(lines: list[str]) -> tuple[str, str, bool]:
    """(spec, separator, header) guessed from the first lines of a file."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return "nogeom", ",", False
    separator = max(("\t", ",", ";", "|", " "), key=lambda s: (min(x.count(s) for x in lines if not re.match(r"\s*[A-Z]+\s*\(", x)) if any(not re.match(r"\s*[A-Z]+\s*\(", x) for x in lines) else 0))
    wkt = re.compile(r'^"?\s*(?:SRID=\d+;)?(?:MULTI)?(?:POINT|LINESTRING|POLYGON|GEOMETRYCOLLECTION)\s*(?:Z|M|ZM)?\s*(?:\(|EMPTY)', re.I)
    if any(wkt.match(x) for x in lines[:2]):
        return "wkt(0)", "\t", not wkt.match(lines[0])
    cells = [x.split(separator) for x in lines]
    number = lambda s: re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", s) is not None
    header = not any(number(c) for c in cells[0]) and len(cells) > 1 and any(number(c) for c in cells[1])
    body = cells[1:] if header else cells
    for i, c in enumerate(body[0]):
        if wkt.match(c):
            return f"wkt({i})", separator, header
    names = [c.strip().lower() for c in cells[0]]
    for x, y in (("x", "y"), ("lon", "lat"), ("lng", "lat"), ("longitude", "latitude")):
        if header and x in names and y in names:
            return f"point({names.index(x)},{names.index(y)})", separator, header
    numeric = [i for i in range(len(body[0])) if all(i < len(r) and number(r[i]) for r in body)]
    if len(numeric) >= 4 and numeric[:4] == list(range(numeric[0], numeric[0] + 4)):
        return f"envelope({','.join(map(str, numeric[:4]))})", separator, header
    if len(numeric) >= 2:
        return f"point({numeric[0]},{numeric[1]})", separator, header
    return "nogeom", separator, header


def write_csv(df: DataFrame, path: str, encoder: str = "wkt", separator: str = "\t", header: bool = False, geom: str = "geom") -> None:
    """point (x, y), envelope (four bounds) or wkt before the other columns."""
    g = F.col(geom)
    shape = {
        "point": [((g["xmin"] + g["xmax"]) / 2).alias("x"), ((g["ymin"] + g["ymax"]) / 2).alias("y")], "envelope": [g[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        "wkt": [st_astext(g).alias("wkt")],
    }[encoder]
    df.select(*shape, *[c for c in df.columns if c != geom]).write.option("sep", separator).option("header", header).csv(path)


def read_json_wkt(spark: SparkSession, path, column: str = "geometry", schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines with a WKT attribute, which becomes `geom`."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    return df.select(st_fromwkt(F.col(column)).alias("geom"), *[c for c in df.columns if c != column])


def write_json_wkt(df: DataFrame, path: str, column: str = "geometry", geom: str = "geom") -> None:
    df.select(st_astext(F.col(geom)).alias(column), *[c for c in df.columns if c != geom]).write.json(path)


# --- GeoJSON --------------------------------------------------------------------------------------------

_NAMES = {k.lower(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")}


def from_geojson(text: str | None) -> G.Geom | None:
    """A GeoJSON geometry; type names in any case."""
    if not text:
        return None
    return _from_object(json.loads(text))


def _from_object(o: dict | None) -> G.Geom | None:
    if not o:
        return None
    kind = o["type"].upper()
    if kind == "GEOMETRYCOLLECTION":
        return G.Geom(kind, [_from_object(x) for x in o["geometries"]])
    c = o["coordinates"]
    build = {
        "POINT": lambda v: G.point(*v[:2]) if v else G.Geom("POINT", None), "LINESTRING": lambda v: G.line([p[:2] for p in v]), "POLYGON": lambda v: G.polygon([[p[:2] for p in r] for r in v]),
    }
    if kind.startswith("MULTI"):
        return G.Geom(kind, [build[kind[5:]](v) for v in c])
    return build[kind](c)


def to_geojson(g: G.Geom) -> dict:
    if g.kind == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [to_geojson(p) for p in g.data]}
    path = lambda a: [[float(x), float(y)] for x, y in a]
    body = {"POINT": lambda h: [] if h.data is None else path(h.data[None])[0], "LINESTRING": lambda h: path(h.data), "POLYGON": lambda h: [path(r) for r in h.data]}
    if g.kind.startswith("MULTI"):
        return {"type": _NAMES[g.kind.lower()], "coordinates": [body[g.kind[5:]](p) for p in g.data]}
    return {"type": _NAMES[g.kind.lower()], "coordinates": body[g.kind](g)}


@F.pandas_udf(GEOM)
def st_fromgeojson(text: pd.Series) -> pd.DataFrame:
    """Null where the text isn't a GeoJSON geometry."""

    def parse(t):
        try:
            return from_geojson(t)
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    return frame([parse(t) for t in text])


@F.pandas_udf(STRING)
def st_asgeojson(g: pd.DataFrame) -> pd.Series:
    return pd.Series([None if x is None else json.dumps(to_geojson(x), separators=(",", ":")) for x in geoms(g)], dtype=object)


def read_geojson(spark: SparkSession, path, multiline: bool | None = None, properties: str | T.StructType | None = None) -> DataFrame:
    """Feature collections, features or one feature a line: geom, id and the properties, of the given or an inferred schema.

    Lines split; a collection is one value of one task, as JSON has it.
    """
    lines = spark.read.text(path, wholetext=True) if multiline or multiline is None and not _is_lines(spark, path) else spark.read.text(path)
    head = "type STRING, id STRING, geometry STRING, properties STRING, features ARRAY<STRING>"
    top = lines.select(F.from_json("value", head).alias("j"), "value").where("j.type is not null")
    one = F.struct(F.col("j.geometry").alias("geometry"), F.col("j.properties").alias("properties"), F.col("j.id").alias("id"))
    of = lambda f: F.from_json(f, "geometry STRING, properties STRING, id STRING")
    many = F.transform(F.coalesce("j.features", F.array().cast("array<string>")), of)
    bare = F.struct(F.col("value").alias("geometry"), F.lit(None).cast("string").alias("properties"), F.lit(None).cast("string").alias("id"))
    kind = F.lower(F.col("j.type"))
    found = F.when(kind == "featurecollection", many).when(kind == "feature", F.array(one)).otherwise(F.array(bare))
    rows = top.select(F.explode(found).alias("f")).select(st_fromgeojson(F.col("f.geometry")).alias("geom"), F.col("f.id").alias("id"), F.col("f.properties").alias("properties"))
    if properties is None:
        sample = rows.where("properties is not null").select("properties").limit(1000)
        properties = spark.read.json(sample.rdd.map(lambda r: r[0])).schema if not sample.isEmpty() else T.StructType()
    schema = properties if isinstance(properties, T.StructType) else T.StructType.fromDDL(properties)
    if not schema.fields:
        return rows.drop("properties")
    parsed = rows.withColumn("p", F.from_json("properties", schema))
    return parsed.select("geom", "id", *[F.col(f"p.`{c}`").alias(c) for c in schema.names if c not in ("geom", "id")])


def _is_lines(spark: SparkSession, path) -> bool:
    """Whether the first line is a whole JSON object."""
    first = spark.read.text(path).limit(1).collect()  # one line
    try:
        return bool(first) and isinstance(json.loads(first[0].value), dict) and '"FeatureCollection"' not in first[0].value
    except ValueError:
        return False


def feature_json(df: DataFrame, geom: str = "geom", always_properties: bool = True) -> Column:
    """One feature a row, as JSON text."""
    rest = [c for c in df.columns if c != geom]
    properties = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    shape = F.coalesce(st_asgeojson(F.col(geom)), F.lit("null"))
    parts = [F.lit('{"type":"Feature","geometry":'), shape]
    if rest or always_properties:
        parts += [F.lit(',"properties":'), properties]
    return F.concat(*parts, F.lit("}"))


def write_geojson(df: DataFrame, path: str, geom: str = "geom", always_properties: bool = True) -> None:
    """One feature a line in every part file."""
    df.select(feature_json(df, geom, always_properties).alias("value")).write.text(path)


# --- GPX, KML -------------------------------------------------------------------------------------------

_GPX = """name STRING, trkseg ARRAY<STRUCT<trkpt: ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, time: TIMESTAMP>>>>"""


def read_gpx(spark: SparkSession, path) -> DataFrame:
    """Track points: geom, elevation, time, filename, trackindex, trackname, segmentnumber."""
    tracks = spark.read.format("xml").option("rowTag", "trk").schema(_GPX).load(path).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1))
    segments = tracks.select("filename", F.col("name").alias("trackname"), F.posexplode("trkseg").alias("segmentnumber", "s"))
    points = segments.select("filename", "trackname", "segmentnumber", F.posexplode("s.trkpt").alias("pointnumber", "p"))
    return points.select(st_point(F.col("p._lon"), F.col("p._lat")).alias("geom"), F.col("p.ele").alias("elevation"), F.col("p.time").alias("time"), "filename", "trackname", "segmentnumber", "pointnumber")


def _kml(g: G.Geom) -> str:
    pts = lambda a: " ".join(f"{x!r},{y!r}" for x, y in a.tolist())
    if g.kind == "POINT":
        return f"<Point><coordinates>{pts(g.data[None]) if g.data is not None else ''}</coordinates></Point>"
    if g.kind == "LINESTRING":
        return f"<LineString><coordinates>{pts(g.data)}</coordinates></LineString>"
    if g.kind == "POLYGON":
        rings = [f"<{side}><LinearRing><coordinates>{pts(r)}</coordinates></LinearRing></{side}>" for side, r in zip(["outerBoundaryIs"] + ["innerBoundaryIs"] * len(g.data), g.data)]
        return f"<Polygon>{''.join(rings)}</Polygon>"
    return f"<MultiGeometry>{''.join(map(_kml, g.data))}</MultiGeometry>"


@F.pandas_udf(STRING)
def st_askml(g: pd.DataFrame) -> pd.Series:
    return pd.Series([None if x is None else _kml(x) for x in geoms(g)], dtype=object)


def write_kml(df: DataFrame, path: str, geom: str = "geom", name: str | None = None) -> None:
    """One whole KML document in every part file."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rest = [c for c in df.columns if c != geom]
    data = [F.concat(F.lit(f'<Data name="{c}"><value>'), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</value></Data>")) for c in rest]
    label = F.concat(F.lit("<name>"), escape(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit("</name>")) if name else F.lit("")
    mark = F.concat(F.lit("<Placemark>"), label, F.lit("<ExtendedData>"), *data, F.lit("</ExtendedData>"), F.coalesce(st_askml(F.col(geom)), F.lit("")), F.lit("</Placemark>"))

    def document(frames):
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>']})
        for pdf in frames:
            yield pdf
        yield pd.DataFrame({"value": ["</Document></kml>"]})

    df.select(mark.alias("value")).mapInPandas(document, "value string").write.text(path)


def kmz_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """(name, content): a zipped KML document for every partition, to be written by any sink."""
    rows = df.select(st_askml(F.col(geom)).alias("value")).where("value is not null")

    def pack(frames):
        import io
        import zipfile

        from pyspark import TaskContext

        marks = [f"<Placemark>{v}</Placemark>" for pdf in frames for v in pdf["value"]]
        if marks:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("doc.kml", '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "".join(marks) + "</Document></kml>")
            yield pd.DataFrame({"name": [f"part-{TaskContext.get().partitionId():05d}.kmz"], "content": [buffer.getvalue()]})

    return rows.mapInPandas(pack, "name string, content binary")
