"""Binary formats: GeoParquet, SpatialParquet, shapefiles (with DBF and zip), TIFF rasters.

Parquet formats are Spark's own scans.  Shapefiles and TIFF come through `binaryFile`, one file a task, as their parts can't be
split; shapefile parts are paired by their path without extension.
"""

from __future__ import annotations

import io
import struct
import zipfile
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.st import FIELDS, GEOM, encode, geoms, st_fromspatialparquet, st_fromwkb, st_tospatialparquet, st_towkb

BOUNDS = ("_minx", "_miny", "_maxx", "_maxy")


# --- Parquet --------------------------------------------------------------------------------------------


def write_geoparquet(df: DataFrame, path: str, geom: str = "geom") -> None:
    """WKB in the geometry's column, and its bounds as plain columns that scans prune by."""
    g = F.col(geom)
    bounds = [g[c].alias(n) for c, n in zip(FIELDS[2:6], BOUNDS)]
    df.select(*[c for c in df.columns if c != geom], st_towkb(g).alias(geom), *bounds).write.parquet(path)


def read_geoparquet(spark: SparkSession, path, geom: str = "geom", bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """With bounds, row groups and rows whose boxes miss them aren't decoded."""
    df = spark.read.parquet(path)
    if bounds is not None and set(BOUNDS) <= set(df.columns):
        x1, y1, x2, y2 = bounds
        df = df.where((F.col("_minx") <= x2) & (F.col("_maxx") >= x1) & (F.col("_miny") <= y2) & (F.col("_maxy") >= y1))
    return df.select(*[c for c in df.columns if c not in (geom, *BOUNDS)], st_fromwkb(F.col(geom)).alias(geom))


def write_spatial_parquet(df: DataFrame, path: str, geom: str = "geom") -> None:
    df.withColumn(geom, st_tospatialparquet(F.col(geom))).write.parquet(path)


def read_spatial_parquet(spark: SparkSession, path, geom: str = "geom") -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn(geom, st_fromspatialparquet(F.col(geom)))


# --- shapefiles -----------------------------------------------------------------------------------------

_SHAPES = {1: "POINT", 3: "LINE", 5: "POLYGON", 8: "MULTIPOINT"}


def shapes_of(shp: bytes) -> list[G.Geom | None]:
    """Geometries of a .shp file; Z and M values are left out. A null shape is None."""
    out, at = [], 100
    while at + 8 <= len(shp):
        (size,) = struct.unpack_from(">i", shp, at + 4)
        body = shp[at + 8 : at + 8 + 2 * size]
        at += 8 + 2 * size
        (code,) = struct.unpack_from("<i", body)
        kind = _SHAPES.get(code % 10)
        if kind is None:
            out.append(None)
        elif kind == "POINT":
            out.append(G.point(*struct.unpack_from("<2d", body, 4)))
        elif kind == "MULTIPOINT":
            (n,) = struct.unpack_from("<i", body, 36)
            out.append(G.Geom("MULTIPOINT", [G.point(*p) for p in np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2)]))
        else:
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*np.frombuffer(body, "<i4", parts, 44).tolist(), n]
            pts = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
            paths = [pts[a:b].copy() for a, b in zip(starts[:-1], starts[1:])]
            out.append(_lines(paths) if kind == "LINE" else _polygons(paths))
    return out


def _lines(paths: list[np.ndarray]) -> G.Geom:
    return G.line(paths[0]) if len(paths) == 1 else G.Geom("MULTILINESTRING", [G.line(p) for p in paths])


def _polygons(rings: list[np.ndarray]) -> G.Geom:
    """Clockwise rings are shells; a counter-clockwise one is a hole of the smallest shell round it."""
    shells = [[r] for r in rings if G.ring_area(r) <= 0]
    for h in (r for r in rings if G.ring_area(r) > 0):
        inside = [s for s in shells if G.locate(h[:1], G.polygon([s[0]]), 0.0)[0] != G.OUTSIDE]
        (min(inside, key=lambda s: abs(G.ring_area(s[0]))) if inside else shells.append([h]) or shells[-1]).append(h) if inside else None
    polys = [G.polygon(s) for s in shells]
    return polys[0] if len(polys) == 1 else G.Geom("MULTIPOLYGON", polys)


def dbf_fields(dbf: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type letter, width, decimals)."""
    out, at = [], 32
    while at < len(dbf) and dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    return out


def dbf_schema(fields: list[tuple[str, str, int, int]]) -> T.StructType:
    kinds = {"C": T.StringType(), "D": T.DateType(), "L": T.BooleanType(), "F": T.DoubleType(), "I": T.IntegerType(), "O": T.DoubleType()}
    number = lambda w, d: T.DoubleType() if d else T.IntegerType() if w < 10 else T.LongType()
    return T.StructType([T.StructField(n, number(w, d) if t == "N" else kinds.get(t, T.StringType())) for n, t, w, d in fields])


def dbf_rows(dbf: bytes) -> list[tuple | None]:
    """Values of all records; None for one that's marked as deleted."""
    fields = dbf_fields(dbf)
    count, head, width = struct.unpack_from("<IHH", dbf, 4)
    out = []
    for k in range(count):
        at = head + k * width
        if dbf[at : at + 1] == b"*":
            out.append(None)
            continue
        at, row = at + 1, []
        for _, kind, size, decimals in fields:
            raw = dbf[at : at + size]
            at += size
            row.append(_dbf_value(raw, kind, size, decimals))
        out.append(tuple(row))
    return out


def _dbf_value(raw: bytes, kind: str, size: int, decimals: int):
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    if kind == "O":
        return struct.unpack("<d", raw)[0]
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind == "C" or kind not in "NFLD":
        return text
    if not text or text.strip("*") == "":
        return None
    try:
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if kind == "D":
            return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        return float(text) if decimals or kind == "F" else int(float(text))
    except ValueError:
        return None


def read_shapefile(spark: SparkSession, path, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """geom and the DBF's attributes, of .shp/.dbf pairs and zip files. The schema is that of the first DBF. Deleted records are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf,zip,SHP,DBF,ZIP}").option("recursiveFileLookup", True).load(path)
    key = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "")
    packs = files.select(key.alias("key"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    pairs = packs.groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("shp", "dbf", "zip")])
    first = pairs.where("dbf is not null or zip is not null").select("dbf", "zip").limit(1).collect()  # one file
    attributes = T.StructType()
    if first:
        member = next(iter(_members(None, first[0].dbf, first[0].zip)), (None, None))
        attributes = dbf_schema(dbf_fields(member[1])) if member[1] else attributes
    schema = T.StructType([T.StructField("geom", GEOM), *attributes.fields])

    def rows(it):
        for pdf in it:
            for shp, dbf, packed in zip(pdf["shp"], pdf["dbf"], pdf["zip"]):
                for s, d in _members(shp, dbf, packed):
                    if s is None:
                        continue
                    shapes = shapes_of(s)
                    values = dbf_rows(d) if d else [()] * len(shapes)
                    out = []
                    for g, v in zip(shapes, values):
                        if v is None:
                            continue
                        b = g.bounds() if g is not None else None
                        if bounds and (b is None or b[0] > bounds[2] or b[2] < bounds[0] or b[1] > bounds[3] or b[3] < bounds[1]):
                            continue
                        out.append((dict(zip(FIELDS, encode(g))) if g is not None else None, *v))
                    yield pd.DataFrame(out, columns=schema.names, dtype=object)

    return pairs.mapInPandas(rows, schema)


def _members(shp: bytes | None, dbf: bytes | None, packed: bytes | None):
    """(shp, dbf) pairs of a file pair or of a zip."""
    if packed is not None:
        z = zipfile.ZipFile(io.BytesIO(bytes(packed)))
        names = {n.lower(): n for n in z.namelist()}
        for low, name in names.items():
            if low.endswith(".shp"):
                twin = names.get(low[:-4] + ".dbf")
                yield z.read(name), z.read(twin) if twin else None
    else:
        yield bytes(shp) if shp is not None else None, bytes(dbf) if dbf is not None else None


def shapefile_bytes(shapes: list[G.Geom | None]) -> tuple[bytes, bytes]:
    """(shp, shx) of geometries of one family."""
    code = {-1: 0, 0: 1, 1: 3, 2: 5}[max([g.dimension for g in shapes if g is not None], default=-1)]
    if code == 1 and any(g is not None and g.kind == "MULTIPOINT" for g in shapes):
        code = 8
    records, places, at = [], [], 50
    for k, g in enumerate(shapes):
        body = struct.pack("<i", 0) if g is None or g.is_empty else _shape_body(g, code)
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        places.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    boxes = [b for g in shapes if g is not None and (b := g.bounds())]
    bounds = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *bounds, 0, 0, 0, 0)
    return head(at) + b"".join(records), head(50 + 4 * len(shapes)) + b"".join(places)


def _shape_body(g: G.Geom, code: int) -> bytes:
    flat = lambda a: np.ascontiguousarray(a, "<f8").tobytes()
    if code == 1:
        return struct.pack("<i", 1) + flat(next(iter(g.simple())).data)
    bounds = struct.pack("<4d", *g.bounds())
    if code == 8:
        c = g.coords()
        return struct.pack("<i", 8) + bounds + struct.pack("<i", len(c)) + flat(c)
    paths = []
    for s in g.simple():
        if s.kind == "LINESTRING" and code == 3:
            paths.append(s.data)
        elif s.kind == "POLYGON" and code == 5:
            paths += [r if (G.ring_area(r) < 0) == (k == 0) else r[::-1] for k, r in enumerate(s.data)]
    starts = np.cumsum([0] + [len(p) for p in paths])
    return struct.pack("<i", code) + bounds + struct.pack("<2i", len(paths), int(starts[-1])) + starts[:-1].astype("<i4").tobytes() + flat(np.concatenate(paths))


def dbf_bytes(rows: list[tuple], schema: T.StructType) -> bytes:
    kinds = {"string": "C", "date": "D", "boolean": "L", "double": "N", "float": "N"}
    fields, cells = [], []
    for i, f in enumerate(schema.fields):
        kind = kinds.get(f.dataType.simpleString(), "N" if f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") else "C")
        decimals = 8 if f.dataType.simpleString() in ("double", "float") else 0
        texts = []
        for r in rows:
            v = r[i]
            v = None if v is None or v != v else v
            if kind == "C":
                raw = b"" if v is None else str(v).encode()[:254]
            elif kind == "D":
                raw = b"" if v is None else v.strftime("%Y%m%d").encode()
            elif kind == "L":
                raw = b"?" if v is None else b"T" if v else b"F"
            else:
                raw = b"" if v is None else (f"{v:.8f}" if decimals else str(int(v))).encode()
            texts.append(raw)
        width = {"D": 8, "L": 1}.get(kind) or max([len(t) for t in texts] + [12 if decimals else 10 if kind == "N" else 1])
        fields.append(f.name.encode()[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([width, decimals]) + bytes(14))
        cells.append([t.ljust(width) if kind in "CL" else t.rjust(width) for t in texts])
    head = 33 + 32 * len(fields)
    width = 1 + sum(len(c[0]) if c else 1 for c in cells)
    today = date.today()
    out = struct.pack("<4BIHH", 3, today.year - 1900, today.month, today.day, len(rows), head, width) + bytes(20) + b"".join(fields) + b"\r"
    return out + b"".join(b" " + b"".join(c[k] for c in cells) for k in range(len(rows))) + b"\x1a"


def shapefile_parts(df: DataFrame, geom: str = "geom", most: int = 1_000_000) -> DataFrame:
    """(name, content): a zipped shapefile for every partition (and every `most` rows), to be written by any sink."""
    rest = [c for c in df.columns if c != geom]
    schema = T.StructType([df.schema[c] for c in rest])
    flat = df.select(*rest, *[F.col(f"`{geom}`.{f}").alias(f"__{f}") for f in FIELDS])

    def pack(it):
        from pyspark import TaskContext

        shapes, rows, k = [], [], 0

        def flush():
            shp, shx = shapefile_bytes(shapes)
            buffer, name = io.BytesIO(), f"part-{TaskContext.get().partitionId():05d}-{k:03d}"
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for kind, data in (("shp", shp), ("shx", shx), ("dbf", dbf_bytes(rows, schema))):
                    z.writestr(f"{name}.{kind}", data)
            return pd.DataFrame({"name": [f"{name}.zip"], "content": [buffer.getvalue()]})

        for pdf in it:
            shapes += geoms(pdf.rename(columns={f"__{f}": f for f in FIELDS}))
            rows += list(pdf[rest].itertuples(index=False, name=None))
            if len(shapes) >= most:
                yield flush()
                shapes, rows, k = [], [], k + 1
        if shapes:
            yield flush()

    return flat.mapInPandas(pack, "name string, content binary")


def read_shapefile_parts(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of shapefile_parts."""
    whole = T.StructType([T.StructField("geom", GEOM), *schema.fields])

    def rows(it):
        for pdf in it:
            for content in pdf["content"]:
                for s, d in _members(None, None, content):
                    out = [(dict(zip(FIELDS, encode(g))) if g is not None else None, *v) for g, v in zip(shapes_of(s), dbf_rows(d)) if v is not None]
                    yield pd.DataFrame(out, columns=whole.names, dtype=object)

    return parts.mapInPandas(rows, whole)


# --- TIFF -----------------------------------------------------------------------------------------------

_TIFF_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}


def tiff_tags(data: bytes) -> tuple[str, list[dict[int, np.ndarray]]]:
    """(byte order, tags of every image) of a TIFF or BigTIFF."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    entry, count_format, inline = (20, "Q", 8) if big else (12, "H", 4)
    out = []
    while at:
        (n,) = struct.unpack_from(order + count_format, data, at)
        at += 8 if big else 2
        tags: dict[int, np.ndarray] = {}
        for k in range(n):
            e = at + k * entry
            tag, kind = struct.unpack_from(order + "HH", data, e)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, e + 4)
            dtype = np.dtype(order + _TIFF_TYPES[kind]) if kind in _TIFF_TYPES else None
            if dtype is None:
                continue
            value_at = e + (12 if big else 8)
            if dtype.itemsize * count > inline:
                (value_at,) = struct.unpack_from(order + ("Q" if big else "I"), data, value_at)
            tags[tag] = np.frombuffer(data, dtype, count, value_at)
        out.append(tags)
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + n * entry)
    return order, out


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    out, table, width, code_at, previous = bytearray(), [], 9, 0, None
    bits, total = int.from_bytes(data, "big"), len(data) * 8
    while code_at + width <= total:
        code = bits >> (total - code_at - width) & (1 << width) - 1
        code_at += width
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous is not None:
            table.append(previous + entry[:1])
        previous = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def tiff_image(data: bytes, image: int = 0) -> np.ndarray:
    """(rows, columns, samples) of one image; no compression, LZW, PackBits or deflate, strips or tiles."""
    import zlib

    order, images = tiff_tags(data)
    t = images[image]
    one = lambda tag, default: int(t[tag][0]) if tag in t else default
    w, h, samples = one(256, 0), one(257, 0), one(277, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    dtype = np.dtype(f"{order}{kind}{one(258, 8) // 8}")
    unpack = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32773: _unpack_bits, 32946: zlib.decompress}[one(259, 1)]
    tiled = 322 in t
    tw, th = (one(322, w), one(323, h)) if tiled else (w, min(h, one(278, h)))
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    planes, across = (samples if one(284, 1) == 2 else 1), -(-w // tw)
    per = samples // planes
    out = np.zeros((h, w, samples), dtype.newbyteorder("="))
    each = len(starts) // planes
    for k, (at, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
        plane, tile = divmod(k, each)
        y, x = tile // across * th, tile % across * tw
        rows = th if tiled else min(th, h - y)
        block = np.frombuffer(unpack(data[at : at + size]), dtype, rows * tw * per).reshape(rows, tw, per).astype(out.dtype)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + rows, x : x + tw, plane * per : (plane + 1) * per] = block[: h - y, : w - x]
    return out


def read_tiff(spark: SparkSession, path, tile: int = 256) -> DataFrame:
    """Rasters as tiles: path, tile_id, x0, y0 (pixels), width, height, image size, georeferencing and pixels by sample."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path", "content")
    schema = "path string, tile_id int, x0 int, y0 int, image_width int, image_height int, transform array<double>, nodata double, pixels array<array<double>>"

    def rows(it):
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content)
                image, tags = tiff_image(data), tiff_tags(data)[1][0]
                scale, tie = tags.get(33550), tags.get(33922)
                affine = [float(scale[0]), 0.0, float(tie[3] - tie[0] * scale[0]), 0.0, -float(scale[1]), float(tie[4] + tie[1] * scale[1])] if scale is not None and tie is not None else [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
                nodata = float(b"".join(tags[42113]).rstrip(b"\0") or b"nan") if 42113 in tags else None
                h, w = image.shape[:2]
                across = -(-w // tile)
                for y in range(0, h, tile):
                    out = []
                    for x in range(0, w, tile):
                        block = image[y : y + tile, x : x + tile].astype(float)
                        out.append((p, y // tile * across + x // tile, x, y, w, h, affine, nodata, [row.ravel().tolist() for row in block]))
                    yield pd.DataFrame(out, columns=["path", "tile_id", "x0", "y0", "image_width", "image_height", "transform", "nodata", "pixels"])

    return files.mapInPandas(rows, schema)
