import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartospark.functions import geometry as G, st
from cartospark.operators import raster
from cartospark.sources import binary, facade, text
from cartospark.streaming.filters import stream_range_query


def shapes(spark):
    rows = [(1, "a", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (2, "b & c", "POLYGON ((9 9, 9 10, 10 10, 9 9))")]
    return spark.createDataFrame(rows, "n int, name string, w string").select("n", "name", st.st_fromwkt("w").alias("geom"))


def test_csv_forms(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("id,X ,y,text\n1,1.5,2,hello\n2,,NaN,there\n")
    df = text.read_csv(spark, str(f), "point(x,y)", header=True)
    assert df.columns[0] == "geom" and [(r.geom.xmin, r.geom.ymin) for r in df.collect()] == [(1.5, 2.0), (None, None)]
    (tmp_path / "b.csv").write_text("1,2,3,4\n5,6,7,8\n")
    assert text.read_csv(spark, str(tmp_path / "b.csv"), "envelopek(2,0)").first().geom.xmax == 3
    (tmp_path / "w.tsv").write_text("POINT (1 2)\tx\nbroken\ty\n")
    assert [r.geom and r.geom.kind for r in text.read_wkt(spark, str(tmp_path / "w.tsv")).collect()] == ["POINT", None]
    assert facade.detect(spark, str(f))[1] == {"spec": "point(1,2)", "separator": ",", "header": True}
    assert facade.read_spatial(spark, str(f)).count() == 2
    with pytest.raises(ValueError, match="did you mean"):
        facade.read_spatial(spark, str(f), "shapefil")
    with pytest.raises(ValueError, match="text"):
        text.read_csv(spark, str(f), "point(texd,y)", header=True)


def test_csv_write(spark, tmp_path):
    text.write_csv(shapes(spark), str(tmp_path / "o"), "envelope", ",", header=True)
    back = text.read_csv(spark, str(tmp_path / "o"), "envelope(xmin,ymin,xmax,ymax)", header=True)
    assert sorted(r.geom.xmax for r in back.collect()) == [4, 10]


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "id": "7", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1, "tags": ["x"]}}, {"type": "Feature", "geometry": {"type": "Linestring", "coordinates": [[0, 0], [1, 1]]}, "properties": {"b": "t"}}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "l.geojson").write_text("\n".join(map(json.dumps, features)))
    for name in ("c", "l"):
        rows = facade.read_spatial(spark, str(tmp_path / f"{name}.geojson")).orderBy("a").collect()
        assert [r.geom.kind for r in rows] == ["LINESTRING", "POINT"] and rows[1].a == 1 and rows[1].tags == ["x"] and rows[1].id == "7"
    facade.write_spatial(shapes(spark), str(tmp_path / "o"), "geojson")
    back = text.read_geojson(spark, str(tmp_path / "o"))
    assert sorted((r.n, r.name, r.a) for r in back.withColumn("a", st.st_area("geom")).collect()) == [(1, "a", 15.0), (2, "b & c", 0.5)]


def test_gpx_and_kml(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx><trk><name>run</name><trkseg><trkpt lat="1.5" lon="2.5"><ele>3</ele><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1.6" lon="2.6"/></trkseg></trk></gpx>')
    rows = text.read_gpx(spark, str(tmp_path / "t.gpx")).orderBy("pointnumber").collect()
    assert [(r.geom.xmin, r.trackname, r.filename) for r in rows] == [(2.5, "run", "t.gpx"), (2.6, "run", "t.gpx")] and rows[0].elevation == 3
    text.write_kml(shapes(spark).coalesce(1), str(tmp_path / "k"), name="name")
    out = "".join(r.value for r in spark.read.text(str(tmp_path / "k")).collect())
    assert out.count("<Placemark>") == 2 and "b &amp; c" in out and "<innerBoundaryIs>" in out and out.endswith("</kml>")


def test_kmz(spark):
    import io
    import zipfile

    parts = text.kmz_parts(shapes(spark).coalesce(1)).collect()
    assert zipfile.ZipFile(io.BytesIO(bytes(parts[0].content))).read("doc.kml").count(b"<Placemark>") == 2


def test_parquet_formats(spark, tmp_path):
    binary.write_geoparquet(shapes(spark), str(tmp_path / "g"))
    assert set(binary.BOUNDS) <= set(spark.read.parquet(str(tmp_path / "g")).columns)
    assert [r.n for r in binary.read_geoparquet(spark, str(tmp_path / "g"), bounds=(8, 8, 11, 11)).collect()] == [2]
    binary.write_spatial_parquet(shapes(spark), str(tmp_path / "s"))
    assert sorted(r.a for r in binary.read_spatial_parquet(spark, str(tmp_path / "s")).select(st.st_area("geom").alias("a")).collect()) == [0.5, 15.0]


def test_shapefiles(spark, tmp_path):
    parts = binary.shapefile_parts(shapes(spark).coalesce(1))
    for r in parts.collect():
        (tmp_path / r.name).write_bytes(bytes(r.content))
    back = binary.read_shapefile(spark, str(tmp_path))
    assert sorted((r.n, r.name, r.a) for r in back.withColumn("a", st.st_area("geom")).collect()) == [(1, "a", 15.0), (2, "b & c", 0.5)]
    assert binary.read_shapefile(spark, str(tmp_path), bounds=(8, 8, 20, 20)).count() == 1
    again = binary.read_shapefile_parts(parts, shapes(spark).select("n", "name").schema)
    assert again.count() == 2
    lines = binary.shapes_of(binary.shapefile_bytes([G.line([(0, 0), (1, 1)]), None])[0])
    assert lines[0].kind == "LINESTRING" and lines[1] is None


def tiff(pixels: np.ndarray, compression: int = 1) -> bytes:
    import struct

    h, w = pixels.shape
    raw = pixels.astype("<u1").tobytes()
    if compression == 32773:
        raw = b"".join(bytes([len(r) - 1]) + r for r in (raw[i : i + w] for i in range(0, len(raw), w)))
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, compression), (273, 4, 1, 0), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(raw)), (33550, 12, 3, 0), (33922, 12, 6, 0)]
    at = 8 + 2 + 12 * len(entries) + 4
    extra = struct.pack("<3d", 2.0, 2.0, 0.0) + struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0)
    values = {33550: at, 33922: at + 24, 273: at + len(extra)}
    body = b"".join(struct.pack("<HHI", t, k, n) + struct.pack("<I", values.get(t, v)) for t, k, n, v in entries)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + extra + raw


@pytest.mark.parametrize("compression", [1, 32773])
def test_tiff(spark, tmp_path, compression):
    image = np.arange(60).reshape(6, 10)
    (tmp_path / "a.tif").write_bytes(tiff(image, compression))
    df = binary.read_tiff(spark, str(tmp_path), tile=4)
    assert df.count() == 6
    assert raster.pixels(df).count() == 60
    at = spark.createDataFrame([(1, 101.0, 199.0), (2, 119.5, 188.5), (3, 0.0, 0.0)], "id int, x double, y double")
    assert sorted((r.id, r.value) for r in raster.value_at(df, at, 4).collect()) == [(1, 0.0), (2, 59.0)]
    e = raster.envelope(df).first()
    assert (e.xmin, e.ymin, e.xmax, e.ymax) == (100, 188, 120, 200)
    assert raster.rescale(df, 5, 3).where("i = 0 and j = 0").first().value == pytest.approx(5.5)
    assert raster.retile(df, 10).count() == 1


def test_stream(spark, tmp_path):
    df = spark.range(100).select("id", st.st_point(F.col("id") / 10, F.col("id") % 10).alias("geom"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_range_query(stream, G.box(2, 0, 4, 5)).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == df.where("id / 10 between 2 and 4 and id % 10 <= 5").count()


def test_cli(spark, tmp_path):
    from cartospark.cli import parser, run

    (tmp_path / "p.csv").write_text("1,1\n2,2\n9,9\n")
    args = parser().parse_args(["summary", str(tmp_path / "p.csv"), "--spec", "point(0,1)"])
    assert run(spark, args).first().num_features == 3
    args = parser().parse_args(["splot", str(tmp_path / "p.csv"), str(tmp_path / "o.png"), "--spec", "point(0,1)", "--size", "16"])
    run(spark, args)
    assert (tmp_path / "o.png").read_bytes().startswith(b"\x89PNG")
