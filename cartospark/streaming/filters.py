"""Streams: range filters and grid counts over Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.join import range_query
from ..operators.synopses import Grid


def stream_range_query(stream: DataFrame, query: G.Geom, geom: str = "geom", simple: bool = True) -> DataFrame:
    """Stateless: rows of a stream that meet the query geometry."""
    return range_query(stream, query, geom, simple)


def stream_histogram(stream: DataFrame, grid: Grid, time: str, window: str, late: str, geom: str = "geom") -> DataFrame:
    """(window, col, row, value): counts by cell and tumbling window; rows later than `late` no longer count."""
    g = F.col(geom)
    x, y = (g["xmin"] + g["xmax"]) / 2, (g["ymin"] + g["ymax"]) / 2
    inside = stream.withWatermark(time, late).where(grid.inside(x, y))
    return inside.groupBy(F.window(time, window).alias("window"), grid.column(x).alias("col"), grid.row(y).alias("row")).agg(F.count(F.lit(1)).alias("value"))
