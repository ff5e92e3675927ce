"""One reader and one writer over all formats, by name, extension or the first lines."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame, SparkSession

from . import binary, text
from ..operators.partition import read_index

READERS = {
    "csv": text.read_csv, "wkt": text.read_wkt, "point": text.read_csv_points, "jsonwkt": text.read_json_wkt, "geojson": text.read_geojson, "gpx": text.read_gpx, "shapefile": binary.read_shapefile,
    "geoparquet": binary.read_geoparquet, "spatialparquet": binary.read_spatial_parquet, "tiff": binary.read_tiff, "index": read_index, "rtree": read_index,
}
WRITERS = {
    "csv": text.write_csv, "jsonwkt": text.write_json_wkt, "geojson": text.write_geojson, "kml": text.write_kml, "geoparquet": binary.write_geoparquet, "spatialparquet": binary.write_spatial_parquet,
}
_EXTENSIONS = {"geojson": "geojson", "geojsonl": "geojson", "json": "geojson", "gpx": "gpx", "shp": "shapefile", "zip": "shapefile", "tif": "tiff", "tiff": "tiff", "wkt": "wkt", "parquet": "geoparquet"}


def _known(kind: str, names: dict) -> str:
    if kind in names:
        return kind
    near = difflib.get_close_matches(kind, names, 3, 0.5)
    raise ValueError(f"unknown format {kind!r}; " + (f"did you mean {', '.join(near)}?" if near else f"one of {', '.join(names)}"))


def detect(spark: SparkSession, path: str) -> tuple[str, dict]:
    """(format, options) from the extension, or from the first lines of a text file."""
    names = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/").lower())
    extension = names.rsplit(".", 1)[-1] if "." in names.rsplit("/", 1)[-1] else ""
    if extension in _EXTENSIONS:
        return _EXTENSIONS[extension], {}
    spec, separator, header = text.sniff_csv([r.value for r in spark.read.text(path).limit(10).collect()])  # ten lines
    return "csv", {"spec": spec, "separator": separator, "header": header}


def read_spatial(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:  # noqa: A002
    """path may hold wildcards or be several paths with commas between them (a list for text formats)."""
    if format is None:
        format, found = detect(spark, path)  # noqa: A001
        options = found | options
    paths = [p for p in path.split(",") if p] if "," in path else path
    return READERS[_known(format, READERS)](spark, paths, **options)


def write_spatial(df: DataFrame, path: str, format: str, **options) -> None:  # noqa: A002
    WRITERS[_known(format, WRITERS)](df, path, **options)


def convert(spark: SparkSession, source: str, target: str, format: str, partitions: int | None = None, **options) -> None:  # noqa: A002
    """Reads a dataset and writes it in another format, in so many files if given."""
    df = read_spatial(spark, source, **options)
    write_spatial(df.coalesce(partitions) if partitions else df, target, format)
