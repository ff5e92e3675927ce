"""Command line: python -m cartospark.cli COMMAND ... (cat, summary, gridsummary, histogram, index, sj, mindex, splot, mplot, vmplot)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import join, partition, synopses, tiles
from .operators.synopses import Grid
from .sources.facade import convert, read_spatial


def _read(spark: SparkSession, path: str, args) -> DataFrame:
    options = {"spec": args.spec, "separator": args.separator, "header": args.header} if args.spec else {}
    return read_spatial(spark, path, "csv" if args.spec else args.format, **options)


def _area(df: DataFrame, text: str | None) -> tuple[float, float, float, float]:
    if text:
        return tuple(float(v) for v in text.split(","))
    grid = synopses.grid_of(df, 1)
    return (grid.xmin, grid.ymin, grid.xmax, grid.ymax)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartospark", description=__doc__)
    p.add_argument("command", choices=["cat", "summary", "gridsummary", "histogram", "index", "sj", "mindex", "splot", "mplot", "vmplot"])
    p.add_argument("inputs", nargs="+", help="inputs, then the output where the command writes one")
    p.add_argument("--format")
    p.add_argument("--oformat", default="geojson")
    p.add_argument("--spec", help="geometry of CSV columns, as point(x,y)")
    p.add_argument("--separator", default=",")
    p.add_argument("--header", action="store_true")
    p.add_argument("--partitioner", default="rsgrove", choices=partition.PARTITIONERS)
    p.add_argument("--partitions", type=int, default=16)
    p.add_argument("--predicate", default="intersects")
    p.add_argument("--method", default="auto", choices=join.METHODS)
    p.add_argument("--cells", type=int, default=1024)
    p.add_argument("--levels", type=int, default=4)
    p.add_argument("--area", help="x1,y1,x2,y2")
    p.add_argument("--size", type=int, default=1000)
    return p


def run(spark: SparkSession, args) -> DataFrame | None:
    """The command's result as a DataFrame, or None where it writes files."""
    if args.command == "cat":
        return convert(spark, args.inputs[0], args.inputs[1], args.oformat, args.partitions)
    df = _read(spark, args.inputs[0], args)
    if args.command == "summary":
        return synopses.summary(df)
    if args.command == "sj":
        other = _read(spark, args.inputs[1], args)
        pairs = join.spatial_join(df, other, args.predicate, args.method)
        return pairs.select(*[c for c in pairs.columns if not c.endswith("geom")]) if len(args.inputs) < 3 else pairs.drop("r_geom").write.parquet(args.inputs[2])
    if args.command == "index":
        return partition.write_index(df, args.inputs[1], partition.make_cells(df, args.partitioner, args.partitions))
    if args.command == "mindex":
        return partition.read_manifest(spark, args.inputs[0])
    area = _area(df, args.area)
    if args.command in ("gridsummary", "histogram"):
        grid = Grid(*area, *synopses.near_square(area[2] - area[0], area[3] - area[1], args.cells))
        return synopses.gridded_summary(df, grid, simple=False) if args.command == "gridsummary" else synopses.uniform_histogram(df, grid)
    levels = list(range(args.levels))
    if args.command == "mplot":
        return tiles.plot_pyramid(df, area, levels).write.parquet(args.inputs[1])
    if args.command == "vmplot":
        return tiles.vector_tiles(df, area, levels).write.parquet(args.inputs[1])
    with open(args.inputs[1], "wb") as f:
        f.write(tiles.plot_image(df, area, args.size, args.size))
    return None


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("cartospark").getOrCreate()
    out = run(spark, args)
    if out is not None:
        out.select([F.col(c) for c in out.columns]).show(1000, truncate=False)


if __name__ == "__main__":
    main()

